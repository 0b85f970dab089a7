"""The four reads: single-shard SQL, scatter, tenant scan with cursors, exact index lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.functions.hashing import json_array
from shardloom.plans.catalog import BUCKET, KEY, SHARD, TENANT, Catalog
from shardloom.plans.sqlguard import check_read

SYSTEM = (TENANT, KEY, BUCKET, SHARD)
PAGE, MAX_SCAN, MAX_INDEX = 100, 500, 100


def user_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in SYSTEM]


def shard_sql(catalog: Catalog, routed: DataFrame, sql: str, table: str, tenant: str, key: str, args: list | None = None) -> DataFrame:
    """A SELECT over everything on the shard of one key: the key picks the shard and nothing else."""
    check_read(sql)
    _, shard = catalog.route(table, tenant, key)
    spark = routed.sparkSession
    routed.where(F.col(SHARD) == shard).createOrReplaceTempView(table)
    return spark.sql(sql, args=args or [])


def scatter(catalog: Catalog, routed: DataFrame, columns: list[Column], where: Column | None = None, limit: int | None = None, failed: tuple[str, ...] = ()) -> DataFrame:
    """Projection and filter on every active shard, concatenated in shard order; a limit holds after that.

    Shards in `failed` are left out: scatter tolerates them, and scatter_report lists them.
    """
    live = [s for s in catalog.active() if s not in failed]
    out = routed.where(F.col(SHARD).isin(live))
    out = out if where is None else out.where(where)
    out = out.select(F.col(SHARD).alias("shard_id"), *columns)
    return out if limit is None else out.orderBy("shard_id", *[c for c in out.columns if c != "shard_id"]).limit(limit)


def scatter_report(catalog: Catalog, failed: tuple[str, ...] = ()) -> dict:
    live = catalog.active()
    return {"shardCount": len(live), "successCount": len([s for s in live if s not in failed]), "errors": sorted(set(failed) & set(live))}


def scatter_partial(routed: DataFrame, aggs: list[Column], by: list[str] | None = None) -> DataFrame:
    """Aggregates of each shard, unmerged, as scatter gives them."""
    return routed.groupBy(F.col(SHARD).alias("shard_id"), *(by or [])).agg(*aggs)


def scatter_global(routed: DataFrame, aggs: list[Column], by: list[str] | None = None) -> DataFrame:
    """The same over all shards, merged: partial sums before the shuffle, so shards don't matter to the plan."""
    return routed.groupBy(*(by or [])).agg(*aggs)


def tenant_pages(routed: DataFrame, tenant: str, cursors: dict[str, str] | None = None, page: int = PAGE) -> DataFrame:
    """Every shard's next page of one tenant's rows: keys after the shard's cursor, in byte order, at most `page`."""
    rows = routed.where(F.col(TENANT) == tenant)
    if cursors:
        after = F.lit(True)
        for shard, key in sorted(cursors.items()):
            after = after & ((F.col(SHARD) != shard) | (F.col(KEY) > key))
        rows = rows.where(after)
    w = Window.partitionBy(SHARD).orderBy(KEY)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= page)


def tenant_scan(routed: DataFrame, tenant: str, limit: int = PAGE, cursors: dict[str, str] | None = None) -> DataFrame:
    """The first `limit` rows of the merged pages, by key, then shard.

    Any row among the first `limit` of the merge is among the first `limit` of its shard, so there is no
    need to number rows by shard first: one top-k suffices, with a heap in each task and no shuffle of rows.
    """
    limit = min(MAX_SCAN, max(1, limit))
    rows = routed.where(F.col(TENANT) == tenant)
    for shard, key in sorted((cursors or {}).items()):
        rows = rows.where((F.col(SHARD) != shard) | (F.col(KEY) > key))
    if limit <= PAGE:
        return rows.orderBy(KEY, SHARD).limit(limit)
    return tenant_pages(routed, tenant, cursors).orderBy(KEY, SHARD).limit(limit).drop("_rn")


def next_cursors(routed: DataFrame, tenant: str, limit: int = PAGE, cursors: dict[str, str] | None = None, page: int = PAGE) -> DataFrame:
    """Per shard: (shard_id, scanned, returned, next_key, page_full, more).

    A cursor never passes the last row that was returned of its shard; only if the page was full and all of
    it returned (or none of it was a row) does it move to the last key scanned. `more` holds on every row
    if any row was cut off or any page was full.
    """
    pages = tenant_pages(routed, tenant, cursors, min(page, limit))
    rank = Window.orderBy(KEY, SHARD)
    ranked = pages.select(SHARD, KEY).withColumn("kept", F.row_number().over(rank) <= limit)
    per = ranked.groupBy(F.col(SHARD).alias("shard_id")).agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if("kept").alias("returned"),
        F.max(F.when(F.col("kept"), F.col(KEY))).alias("last_returned"),
        F.max(KEY).alias("last_scanned"),
    )
    full = F.col("scanned") >= min(page, limit)
    all_back = F.col("returned") == F.col("scanned")
    per = per.withColumn("next_key", F.when(full & all_back, F.col("last_scanned")).otherwise(F.col("last_returned"))).withColumn("page_full", full)
    more = F.max((full | ~all_back).cast("int")).over(Window.partitionBy(F.lit(1))) == 1
    return per.select("shard_id", "scanned", "returned", "next_key", "page_full", more.alias("more"))


def scan_all(routed: DataFrame, tenant: str, limit: int = PAGE):
    """Pages of one tenant until nothing is left: (rows, cursors) each. One bounded page at a time reaches the driver."""
    cursors: dict[str, str] = {}
    while True:
        state = next_cursors(routed, tenant, limit, cursors).collect()
        rows = tenant_scan(routed, tenant, limit, cursors).collect()
        cursors = cursors | {r.shard_id: r.next_key for r in state if r.next_key is not None}
        yield rows, dict(cursors)
        if not any(r.more for r in state):
            return


def index_backfill(routed: DataFrame, columns: list[str], name: str, ring: list[str], table: str) -> DataFrame:
    """All entries of an index: (index_name, key_json, pk, tenant, source shard, index shard), in one pass."""
    from shardloom.functions.hashing import index_shard

    kinds = dict(routed.dtypes)
    key_json = json_array([(F.col(c), kinds[c]) for c in columns])
    out = routed.select(F.lit(name).alias("index_name"), key_json.alias("index_key_json"), F.col(KEY).alias("pk"), F.col(TENANT).alias("tenant_id"), F.col(SHARD).alias("source_shard_id"))
    return out.withColumn("index_shard_id", index_shard(table, name, F.col("index_key_json"), F.array(*(F.lit(s) for s in ring))))


def index_query(routed: DataFrame, tenant: str, values: dict, limit: int = 20) -> DataFrame:
    """Rows of a tenant whose indexed columns equal the values exactly (null equals null), by key.

    The full tuple is an equality filter that reaches the scan; entries and rows can't disagree here, so
    looking a key up in a separate index and checking the row again is the same as this filter.
    """
    limit = min(MAX_INDEX, max(1, limit))
    out = routed.where(F.col(TENANT) == tenant)
    for c, v in values.items():
        out = out.where(F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
    return out.orderBy(KEY).limit(limit)


def index_lookup(entries: DataFrame, routed: DataFrame, tenant: str, key_json: str, values: dict, limit: int = 20, cap: int | None = None) -> DataFrame:
    """The same through a stored index that may be stale: candidates per index shard (capped, if asked for),
    distinct keys, rows by join, and the check of each indexed column against the row."""
    hit = entries.where((F.col("index_key_json") == key_json) & (F.col("tenant_id") == tenant)).select("pk", "index_shard_id")
    if cap is not None:
        w = Window.partitionBy("index_shard_id").orderBy("pk")
        hit = hit.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap)
    rows = routed.where(F.col(TENANT) == tenant).join(hit.select(F.col("pk").alias(KEY)).distinct(), KEY)
    for c, v in values.items():
        rows = rows.where(F.col(c).eqNullSafe(F.lit(v)))
    return rows.orderBy(KEY).limit(limit)


def tuple_after(columns: list[str], values: list) -> Column:
    """(a, b, c) > (x, y, z) in row order, in the form that lets the first column prune."""
    after, same = F.lit(False), F.lit(True)
    for c, v in zip(columns, values, strict=True):
        after = after | (same & (F.col(c) > F.lit(v)))
        same = same & (F.col(c) == F.lit(v))
    return (F.col(columns[0]) >= F.lit(values[0])) & after


def keyset_page(df: DataFrame, order: list[str], after: list | None, limit: int) -> DataFrame:
    """The next page of a total order; one row more than `limit` tells whether that was all (see `complete`)."""
    out = df if after is None else df.where(tuple_after(order, after))
    return out.orderBy(*order).limit(limit)


def with_completeness(page_plus_one: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Of a page of limit + 1 rows the first `limit`, each with `complete`: whether there was no further row."""
    w = Window.orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    out = page_plus_one.withColumn("_rn", F.row_number().over(w)).withColumn("complete", n <= limit)
    return out.where(F.col("_rn") <= limit).drop("_rn")


def dual_lookup(ring_hits: DataFrame, evacuating_hits: DataFrame, key: str = KEY) -> DataFrame:
    """Keys found on the ring's shard or on one being evacuated, each once."""
    return ring_hits.select(key).unionByName(evacuating_hits.select(key)).distinct()
