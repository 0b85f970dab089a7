"""Ordered logs with cutoffs: pages, seals, membership, as-of reconstruction, loss reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.functions.hashing import manifest_bucket
from shardloom.operators.reads import keyset_page, with_completeness


def manifest_page(log: DataFrame, start_ms: int, cutoff_ms: int, after: tuple | None, limit: int) -> DataFrame:
    """A page of finalized records with start <= decided time <= cutoff, in order of (time, sequence, id)."""
    rows = log.where(F.col("decided_ms").between(start_ms, cutoff_ms) & F.col("sequence").isNotNull())
    return keyset_page(rows, ["decided_ms", "sequence", "tx_id"], list(after) if after else None, limit)


def members(log: DataFrame, cutoff_ms: int) -> DataFrame:
    """Records that belong to a cutoff: finalized, and decided no later."""
    return log.where((F.col("state") == "FINALIZED") & (F.col("decided_ms") <= cutoff_ms))


def enumerate_fleet(log: DataFrame, seals: DataFrame, cutoff_ms: int) -> DataFrame:
    """Per (day, bucket): (records, sealed_through, complete): complete if sealed through the cutoff or the day's end."""
    inside = log.where(F.col("decided_ms") <= cutoff_ms).groupBy("utc_day", "bucket").agg(F.count(F.lit(1)).alias("records"))
    sealed = seals.groupBy("utc_day", "bucket").agg(F.max("sealed_through").alias("sealed_through"))
    out = inside.join(sealed, ["utc_day", "bucket"], "left")
    need = F.least(F.lit(cutoff_ms), (F.unix_date(F.to_date("utc_day")).cast("bigint") + 1) * 86_400_000 - 1)
    return out.withColumn("complete", F.coalesce(F.col("sealed_through") >= need, F.lit(False)))


def bucketed(log: DataFrame, tx: str, ts: str) -> DataFrame:
    return log.withColumns(dict(zip(("utc_day", "bucket"), manifest_bucket(F.col(tx), F.col(ts)), strict=True)))


def seal(log: DataFrame, by: list[str], order: list[str], identity: str) -> DataFrame:
    """Seal receipts: (by, records, first, last, digest over the ordered identities of a group).

    Identities are digested in pages first, so that only digests of a group meet in one row.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    paged = log.withColumn("_rn", F.row_number().over(w)).withColumn("_p", F.floor((F.col("_rn") - 1) / 500))
    rows = F.array_sort(F.collect_list(F.struct("_rn", F.col(identity).cast("string").alias("i"))))
    pages = paged.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.sha2(F.array_join(F.transform(rows, lambda x: x["i"]), ","), 256).alias("d"))
    digests = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "d"))), lambda x: x["d"]), "")
    return pages.groupBy(*by).agg(F.sum("n").alias("records"), F.min("first").alias("first"), F.max("last").alias("last"), F.sha2(digests, 256).alias("digest"))


def root_digest(receipts: DataFrame, order: list[str]) -> DataFrame:
    """One digest over receipts in order: receipts are one for each day and bucket."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "digest")))
    return receipts.agg(F.count(F.lit(1)).alias("receipts"), F.sum("records").alias("records"), F.sha2(F.array_join(F.transform(rows, lambda x: x["digest"]), ""), 256).alias("root"))


def stamp(log: DataFrame, by: list[str], order: str, now: str, floor: int | Column) -> DataFrame:
    """Strictly increasing times: each is max(now, last + 1, floor + 1).

    t_i + ... unrolled: t_i = i + max over j <= i of (max(now_j, floor + 1) - j), so a running maximum does it.
    """
    w = Window.partitionBy(*by).orderBy(order)
    base = F.greatest(F.col(now), (F.lit(floor) if isinstance(floor, int) else floor) + 1)
    out = log.withColumn("_rn", F.row_number().over(w)).withColumn("_b", base - F.col("_rn"))
    return out.withColumn("assigned_ms", F.max("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_rn")).drop("_rn", "_b")


def check_seal(last_cutoff: int | None, cutoff: int, now: int) -> str:
    """Verdict on a new cutoff: cutoffs never go back and never lie in the future."""
    if cutoff > now:
        return "in_future"
    if last_cutoff is not None and cutoff < last_cutoff:
        return "non_monotone"
    return "replay" if cutoff == last_cutoff else "sealed"


def quarantine_split(log: DataFrame, floor: Column) -> DataFrame:
    """Rows with `lane`: late ones (decided at or below the floor) and ids with several contents go to quarantine."""
    w = Window.partitionBy("tx_id")
    conflict = F.size(F.collect_set("content_hash").over(w)) > 1
    return log.withColumn("lane", F.when(conflict, "conflict").when(F.col("decided_ms") <= floor, "late").otherwise("main"))


def lifecycle(events: DataFrame) -> DataFrame:
    """Latest state of each manifest record from its events: reserved, finalized, cancelled, released."""
    return events.groupBy("tx_id").agg(F.max_by("state", F.struct("seq")).alias("state"), F.count(F.lit(1)).alias("n_events"), F.max("seq").alias("last_seq"))


def expired(log: DataFrame, leases: DataFrame, now_ms: int, key: str = "tx_id") -> DataFrame:
    """Records whose deadline has passed and that no live lease holds."""
    held = leases.where(F.col("lease_until_ms") > now_ms).select(key)
    return log.where(F.col("expires_ms") <= now_ms).join(held, key, "left_anti")


# -- restore ---------------------------------------------------------------------------------------


def as_of(log: DataFrame, key: str, order: list[str], at: str, cutoff) -> DataFrame:
    """State of every key at a cutoff: its last log row no later than that."""
    cols = [c for c in log.columns if c != key]
    last = log.where(F.col(at) <= F.lit(cutoff)).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("s"))
    return last.select(key, "s.*")


def redo(base: DataFrame, log: DataFrame, manifest: DataFrame, cutoff_ms: int) -> DataFrame:
    """The log that rebuilds a rewound state: rows up to the cutoff, and those of committed members that are missing."""
    have = log.where(F.col("decided_ms") <= cutoff_ms)
    lost = members(manifest, cutoff_ms).join(have.select("tx_id").distinct(), "tx_id", "left_anti")
    return have.unionByName(lost.select(*have.columns))


def loss_window(journal: DataFrame, at: str, cutoff, through, order: str, after=None, limit: int = 100) -> DataFrame:
    """A page of writes in (cutoff, through] by sequence, with `complete`: whether the page is the last."""
    rows = journal.where((F.col(at) > F.lit(cutoff)) & (F.col(at) <= F.lit(through)))
    return with_completeness(keyset_page(rows, [order], None if after is None else [after], limit + 1), [order], limit)


def loss_digest(journal: DataFrame, by: list[str], identity: str) -> DataFrame:
    """(by, n, digest) of the hashes of lost writes in order."""
    return seal(journal, by, [identity], identity).select(*by, F.col("records").alias("n"), "digest")


def rpo_rto(journal: DataFrame, at_ms: str, cutoff_ms: int, started_ms: int, now_ms: int) -> DataFrame:
    """(rpo_ms, rto_ms): how far the newest write lies behind the cutoff, and how long the restore has run."""
    return journal.agg(F.greatest(F.max(at_ms) - F.lit(cutoff_ms), F.lit(0)).cast("bigint").alias("rpo_ms"), F.lit(now_ms - started_ms).cast("bigint").alias("rto_ms"))


def restore_progress(ops: DataFrame) -> DataFrame:
    """Counters of a restore's per-shard operations."""
    n = lambda s: F.count_if(F.col("phase") == s).alias(s)
    return ops.agg(F.count(F.lit(1)).alias("total"), *(n(s) for s in ("pending", "staged", "applied", "verified", "failed")))
