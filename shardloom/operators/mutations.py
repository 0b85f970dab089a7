"""Structured writes as folds of an ordered log over a table.

A log row is (seq, request_id, request_hash, tx, op, pk, where, values): `where` and `values` are maps from
column to text, where a null value is a supplied NULL. State is a map of columns for each key; one ordered
fold per key gives the new state, so a key's whole history is one group and no driver loop is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Legal direct transitions of a transaction's state.
TRANSITIONS = {
    "new": ["manifest_reserving", "preparing", "quarantined"],
    "manifest_reserving": ["preparing", "abort_decided", "aborted", "aborted_pending_manifest_cancel", "quarantined"],
    "preparing": ["abort_decided", "prepared", "quarantined"],
    "abort_decided": ["aborting", "quarantined"],
    "aborting": ["aborted", "aborted_pending_manifest_cancel", "quarantined"],
    "aborted": ["quarantined"],
    "aborted_pending_manifest_cancel": ["aborted", "quarantined"],
    "prepared": ["abort_decided", "commit_deciding", "commit_decided", "quarantined"],
    "commit_deciding": ["commit_pending_manifest", "manifest_registered", "quarantined"],
    "commit_decided": ["commit_pending_manifest", "manifest_registered", "quarantined"],
    "commit_pending_manifest": ["manifest_registered", "quarantined"],
    "manifest_registered": ["committing", "quarantined"],
    "committing": ["committed_pending_ack", "committed", "quarantined"],
    "committed_pending_ack": ["committed", "quarantined"],
    "committed": ["quarantined"],
    "quarantined": ["manifest_registered", "aborted"],
}
MAX_TX_ROWS = 8


# -- logs with at most one mutation for each key: joins --------------------------------------------


def insert_rows(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Base and the new rows whose key isn't there yet; `inserted` says which. A key that is there is an error row."""
    fresh = new.join(base.select(key), key, "left_anti")
    return base.withColumn("inserted", F.lit(False)).unionByName(fresh.withColumn("inserted", F.lit(True)))


def insert_conflicts(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.join(base.select(key), key, "left_semi")


def update_rows(base: DataFrame, changes: DataFrame, key: str, columns: list[str], guard: str | None = None) -> DataFrame:
    """Base with `columns` set from the changes of equal key; a supplied null overwrites. `guard` is a condition on (b, c)."""
    hit = F.col(f"c.{key}").isNotNull()
    hit = hit & F.expr(guard) if guard else hit
    hit = F.coalesce(hit, F.lit(False))
    out = base.alias("b").join(changes.alias("c"), F.col(f"b.{key}") == F.col(f"c.{key}"), "left")
    return out.select(*(F.when(hit, F.col(f"c.{c}")).otherwise(F.col(f"b.{c}")).alias(c) if c in columns else F.col(f"b.{c}") for c in base.columns))


def upsert_rows(base: DataFrame, new: DataFrame, key: str, supplied: list[str]) -> DataFrame:
    """Full outer join by key: columns that were supplied take the new value, even null; others keep the old."""
    is_new = F.col(f"n.{key}").isNotNull()
    out = base.alias("b").join(new.alias("n"), F.col(f"b.{key}") == F.col(f"n.{key}"), "full_outer")
    cols = []
    for c in base.columns:
        if c == key:
            cols.append(F.coalesce(F.col(f"n.{c}"), F.col(f"b.{c}")).alias(c))
        elif c in supplied:
            cols.append(F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
        else:
            cols.append(F.col(f"b.{c}"))
    return out.select(*cols)


def delete_rows(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def index_deltas(before: DataFrame, after: DataFrame, key: str, key_json: Column) -> DataFrame:
    """(pk, old_key_json, new_key_json) of rows whose index key changed: old gone, new come, both for a change."""
    old = before.select(F.col(key).alias("pk"), key_json.alias("old_key_json"))
    new = after.select(F.col(key).alias("pk"), key_json.alias("new_key_json"))
    return old.join(new, "pk", "full_outer").where(~F.col("old_key_json").eqNullSafe(F.col("new_key_json")))


# -- ordered logs ----------------------------------------------------------------------------------


def first_requests(log: DataFrame) -> DataFrame:
    """Idempotent replay: of rows with one request id the first; later ones repeat its result or conflict."""
    w = Window.partitionBy("request_id").orderBy("seq")
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def replay_conflicts(log: DataFrame) -> DataFrame:
    """Request ids that came with more than one content: (request_id, hashes, attempts)."""
    return log.groupBy("request_id").agg(F.countDistinct("request_hash").alias("hashes"), F.count(F.lit(1)).alias("attempts")).where("hashes > 1")


def replay_outcomes(log: DataFrame) -> DataFrame:
    """Each attempt with its outcome: applied, replayed (same content as the first) or conflict."""
    first = F.first_value("request_hash").over(Window.partitionBy("request_id").orderBy("seq"))
    rn = F.row_number().over(Window.partitionBy("request_id").orderBy("seq"))
    outcome = F.when(rn == 1, "applied").when(F.col("request_hash") == first, "replayed").otherwise("conflict")
    return log.withColumn("outcome", outcome)


_STATE = "struct<live:boolean,row:map<string,string>,touched:bigint,failed:bigint>"


def _matches(where: Column, row: Column) -> Column:
    """SQL equality of every entry: a null on either side never matches."""
    return F.coalesce(F.forall(F.map_entries(F.coalesce(where, F.create_map().cast("map<string,string>"))), lambda e: F.coalesce(F.element_at(row, e["key"]) == e["value"], F.lit(False))), F.lit(True))


def _merged(row: Column, values: Column) -> Column:
    both = F.concat(F.map_entries(F.map_filter(row, lambda k, v: ~F.array_contains(F.map_keys(values), k))), F.map_entries(values))
    return F.map_from_entries(both)


def fold_log(base: DataFrame, log: DataFrame) -> DataFrame:
    """State of every key after the log: (pk, live, row, touched, failed).

    base is (pk, row map). insert fails where the key lives; update and delete that match no row touch
    nothing; upsert sets the supplied columns. Keys without log rows keep their state without being folded.
    """
    empty = F.create_map().cast("map<string,string>")
    m = F.struct("seq", "op", F.coalesce("where", empty).alias("where"), F.coalesce("values", empty).alias("values"))
    logs = log.groupBy("pk").agg(F.collect_list(m).alias("ms"))
    # maps don't sort, so the order comes from the sequence number alone
    ordered = F.array_sort(F.col("ms"), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0))
    joined = base.join(logs, "pk", "full_outer")
    start = F.struct(F.col("row").isNotNull().alias("live"), F.coalesce("row", empty).alias("row"), F.lit(0).cast("bigint").alias("touched"), F.lit(0).cast("bigint").alias("failed")).cast(_STATE)

    def step(s: Column, x: Column) -> Column:
        op, live = x["op"], s["live"]
        hit = live & _matches(x["where"], s["row"])
        row = (
            F.when((op == "insert") & ~live, x["values"])
            .when((op == "upsert") & live, _merged(s["row"], x["values"]))
            .when((op == "upsert") & ~live, x["values"])
            .when((op == "update") & hit, _merged(s["row"], x["values"]))
            .when((op == "delete") & hit, empty)
            .otherwise(s["row"])
        )
        now = F.when((op == "delete") & hit, F.lit(False)).when(op.isin("insert", "upsert"), F.lit(True)).otherwise(live)
        applied = ((op == "insert") & ~live) | (op == "upsert") | (op.isin("update", "delete") & hit)
        failed = (op == "insert") & live
        return F.struct(now.alias("live"), row.alias("row"), (s["touched"] + applied.cast("bigint")).alias("touched"), (s["failed"] + failed.cast("bigint")).alias("failed")).cast(_STATE)

    folded = F.aggregate(F.coalesce(ordered, F.array().cast(joined.schema["ms"].dataType)), start, step)
    return joined.select("pk", folded.alias("s")).select("pk", "s.live", "s.row", "s.touched", "s.failed")


def atomic_batches(log: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Rows of transactions that may commit: at most MAX_TX_ROWS distinct rows, a request id, and no row refused.

    `allowed` has (tx, ok) for guards checked elsewhere; one false guard aborts the whole transaction.
    """
    sizes = log.groupBy("tx").agg(F.countDistinct("pk").alias("n_keys"), F.every(F.col("request_id").isNotNull()).alias("named"))
    good = sizes.where((F.col("n_keys") <= MAX_TX_ROWS) & F.col("named")).select("tx")
    if allowed is not None:
        good = good.join(allowed.groupBy("tx").agg(F.every("ok").alias("ok")).where("ok"), "tx", "left_semi")
    return log.join(good, "tx", "left_semi")


def guard_results(base: DataFrame, guards: DataFrame, key: str, column: str) -> DataFrame:
    """Compare-and-swap guards (tx, step, key, expected) against base: (tx, committed, first_mismatch).

    A guard on a missing row or another value touches no row, which aborts its transaction.
    """
    seen = guards.join(base.select(F.col(key).alias("pk"), F.col(column).alias("actual")), "pk", "left")
    bad = F.when(F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)), None).otherwise(F.col("step"))
    return seen.groupBy("tx").agg(F.min(bad).alias("first_mismatch")).withColumn("committed", F.col("first_mismatch").isNull())


def transition_check(states: DataFrame) -> DataFrame:
    """Each state change of (tx, seq, state) with `allowed`: the same state again, or a direct transition."""
    spark = states.sparkSession
    legal = spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "src string, dst string")
    w = Window.partitionBy("tx").orderBy("seq")
    steps = states.withColumn("src", F.lag("state").over(w)).where("src is not null")
    hit = steps.join(F.broadcast(legal.withColumn("legal", F.lit(True))), (steps.src == legal.src) & (steps.state == legal.dst), "left")
    return hit.select("tx", "seq", steps.src.alias("from_state"), F.col("state").alias("to_state"), (F.coalesce("legal", F.lit(False)) | (steps.src == F.col("state"))).alias("allowed"))


def fenced(log: DataFrame, fences: DataFrame) -> DataFrame:
    """Log rows with `rejected`: whether their bucket is fenced. Fences are a few rows of control data."""
    f = F.broadcast(fences.select("vbucket").distinct().withColumn("_f", F.lit(True)))
    return log.join(f, "vbucket", "left").withColumn("rejected", F.col("_f").isNotNull()).drop("_f")


def lock_conflicts(locks: DataFrame) -> DataFrame:
    """Locks (tx, pk, from_seq, to_seq) that begin while an earlier one on the same key is held: by running maximum, not by pairs."""
    w = Window.partitionBy("pk").orderBy("from_seq", "tx").rowsBetween(Window.unboundedPreceding, -1)
    return locks.withColumn("held_to", F.max("to_seq").over(w)).where("held_to >= from_seq")
