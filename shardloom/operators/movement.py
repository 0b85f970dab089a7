"""Moving buckets between shards and proving that nothing was lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.functions.hashing import vbucket
from shardloom.plans.catalog import BUCKET, KEY, SHARD, Catalog

PAGE = 500


def export_page(routed: DataFrame, bucket: int, after: str | None = None, limit: int = PAGE) -> DataFrame:
    """The next page of one bucket's rows by key."""
    out = routed.where(F.col(BUCKET) == bucket)
    out = out if after is None else out.where(F.col(KEY) > after)
    return out.orderBy(KEY).limit(limit)


def import_rows(target: DataFrame, incoming: DataFrame, version: str) -> DataFrame:
    """Target and incoming rows, the latest version of each key."""
    w = Window.partitionBy(KEY).orderBy(F.col(version).desc(), F.col("_src").desc())
    both = target.withColumn("_src", F.lit(0)).unionByName(incoming.withColumn("_src", F.lit(1)))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_src")


def bucket_checksums(rows: DataFrame, by: list[str], order: str, content: Column, page: int = PAGE) -> DataFrame:
    """(by, row_count, checksum): SHA-256 over the SHA-256 of each page of `page` rows in key order.

    Pages bound what is gathered at once; a group's digests of pages are some bytes for each 500 rows. The
    group (a bucket) is the unit of movement and is sized to fit a task.
    """
    w = Window.partitionBy(*by).orderBy("_k")
    paged = rows.select(*by, F.col(order).alias("_k"), content.alias("_c")).withColumn("_p", F.floor((F.row_number().over(w) - 1) / page))
    pages = paged.groupBy(*by, "_p").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_c"))), lambda x: x["_c"]), ""), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    digests = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "d"))), lambda x: x["d"]), "")
    return pages.groupBy(*by).agg(F.sum("n").alias("row_count"), F.sha2(digests, 256).alias("checksum"))


def compare_checksums(source: DataFrame, target: DataFrame, by: str) -> DataFrame:
    """Full outer join of checksums: (by, source_count, target_count, same)."""
    s, t = source.alias("s"), target.alias("t")
    same = F.coalesce(F.col("s.checksum") == F.col("t.checksum"), F.lit(False))
    return s.join(t, by, "full_outer").select(by, F.col("s.row_count").alias("source_count"), F.col("t.row_count").alias("target_count"), same.alias("same"))


def unattributed(base: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows without an owner row."""
    return base.join(owners.select(KEY), KEY, "left_anti")


def attribute(rows: DataFrame, catalog: Catalog, tenants: DataFrame, table: str) -> DataFrame:
    """(pk, candidates, verdict, tenant): tenants whose route of the key leads to the row's shard.

    One such tenant owns the row, none makes it an orphan, several make it ambiguous. Each row meets every
    tenant, which are registry data and broadcast: rows times tenants comparisons inside the join
    condition, of which only the matches come out.
    """
    t = F.broadcast(tenants.select(F.col("tenant").alias("_t")))
    target = catalog.shard_of(vbucket(F.col("_t"), table, F.col(KEY), catalog.buckets))
    hits = rows.select(KEY, SHARD).join(t, target == F.col(SHARD), "left")
    out = hits.groupBy(F.col(KEY).alias("pk")).agg(F.count("_t").alias("candidates"), F.min("_t").alias("_one"))
    verdict = F.when(F.col("candidates") == 0, "orphaned").when(F.col("candidates") == 1, "attributed").otherwise("ambiguous")
    return out.select("pk", "candidates", verdict.alias("verdict"), F.when(F.col("candidates") == 1, F.col("_one")).alias("tenant"))


def migrate(routed: DataFrame, bucket: int, target: str) -> DataFrame:
    """The table with one bucket's rows on another shard."""
    return routed.withColumn(SHARD, F.when(F.col(BUCKET) == bucket, F.lit(target)).otherwise(F.col(SHARD)))


def drop_bucket(routed: DataFrame, bucket: int, shard: str) -> DataFrame:
    """What is left on all shards once the moved bucket's copy on `shard` is gone."""
    return routed.where(~((F.col(BUCKET) == bucket) & (F.col(SHARD) == shard)))


def drain_progress(bucket_map: DataFrame, rings: DataFrame, in_flight: DataFrame, shard: str) -> DataFrame:
    """(vbuckets_remaining, rings_remaining) of a shard: rings that hold it or are still leaving it, each once."""
    left = bucket_map.agg(F.count_if(F.col("shard_id") == shard).alias("vbuckets_remaining"))
    names = rings.where(F.array_contains("ring", shard)).select("index_name").union(in_flight.where(F.col("shard_id") == shard).select("index_name")).distinct()
    return left.crossJoin(names.agg(F.count(F.lit(1)).alias("rings_remaining")))  # one row each


def copy_entries(entries: DataFrame, source: str, target: str) -> DataFrame:
    """Index entries of one shard, as they stand on another."""
    return entries.where(F.col("index_shard_id") == source).withColumn("index_shard_id", F.lit(target))
