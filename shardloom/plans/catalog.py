"""Tables, bucket maps and placement: the control data that routing needs, as small DataFrames.

A bucket map has one row per bucket (at most 65,536), so it is broadcast; with the default map the shard
follows from the bucket by arithmetic and no join is needed at all.
"""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.functions.hashing import fnv1a_py, ring_substitute, vbucket

TENANT, KEY, BUCKET, SHARD = "__tenant_id", "__pk", "__vbucket", "__shard_id"


@dataclasses.dataclass(frozen=True)
class TableDef:
    """A registered table: its key column and, in Spark, the expression that names a row's tenant."""

    name: str
    key: str
    tenant: str
    key_unique: bool = True


@dataclasses.dataclass
class Catalog:
    """Registry of tables and indexes, and the topology of one cluster."""

    shards: int = 8
    buckets: int = 1024
    prefix: str = ""
    tables: dict[str, TableDef] = dataclasses.field(default_factory=dict)
    indexes: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = dataclasses.field(default_factory=dict)
    draining: frozenset[str] = frozenset()

    def __post_init__(self):
        self.shards = min(256, max(1, self.shards))
        self.buckets = min(65536, max(64, self.buckets))

    def register(self, table: TableDef) -> Catalog:
        if table.name in self.tables:
            raise ValueError(f"table {table.name} is registered already")
        self.tables[table.name] = table
        return self

    def create_index(self, name: str, table: str, columns: tuple[str, ...], ring: tuple[str, ...] | None = None) -> Catalog:
        """The ring of shards is pinned when the index is made."""
        if table not in self.tables:
            raise ValueError(f"no table {table}")
        if name in self.indexes or not columns:
            raise ValueError(f"index {name} exists already or has no columns")
        self.indexes[name] = (table, tuple(columns), tuple(ring or self.active()))
        return self

    def drop_index(self, name: str) -> Catalog:
        self.indexes.pop(name)
        return self

    def shard(self, i: int) -> str:
        return f"{self.prefix}shard-{i}"

    def all_shards(self) -> list[str]:
        return sorted(self.shard(i) for i in range(self.shards))

    def active(self) -> list[str]:
        return [s for s in self.all_shards() if s not in self.draining]

    def route(self, table: str, tenant: str, key: str) -> tuple[int, str]:
        """(bucket, shard) of one key, on the driver: a literal that prunes partitions."""
        b = fnv1a_py(f"{tenant}:{table}:{key}") % self.buckets
        return b, self.shard(b % self.shards)

    # -- as DataFrames -----------------------------------------------------------------------------

    def shard_of(self, bucket: Column) -> Column:
        return F.concat(F.lit(f"{self.prefix}shard-"), (bucket % self.shards).cast("string"))

    def with_routes(self, df: DataFrame, table: TableDef) -> DataFrame:
        """Adds the four system columns. Computed once when a table is laid out, then stored with it."""
        tenant, key = F.expr(table.tenant), F.col(table.key).cast("string")
        out = df.withColumns({TENANT: tenant, KEY: key})
        out = out.withColumn(BUCKET, vbucket(F.col(TENANT), table.name, F.col(KEY), self.buckets))
        return out.withColumn(SHARD, self.shard_of(F.col(BUCKET)))

    def bucket_map(self, spark: SparkSession) -> DataFrame:
        """(vbucket, shard_id, map_version, status) of every bucket."""
        b = spark.range(self.buckets, numPartitions=1).select(F.col("id").cast("int").alias("vbucket"))
        return b.select("vbucket", self.shard_of(F.col("vbucket")).alias("shard_id"), F.lit(1).alias("map_version"), F.lit("active").alias("status"))

    def shard_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, "draining" if s in self.draining else "active") for s in self.all_shards()], "shard_id string, status string").coalesce(1)


def lay_out(df: DataFrame, path: str) -> None:
    """Writes a routed table by shard, sorted by tenant and key within files, so that scans prune by both.

    Tasks take ranges of shard, tenant and key, so that a shard is written by as many as its rows need.
    """
    df.repartitionByRange(SHARD, TENANT, KEY).sortWithinPartitions(SHARD, TENANT, KEY).write.mode("overwrite").partitionBy(SHARD).parquet(path)


def route_batch(keys: DataFrame, bucket_map: DataFrame) -> DataFrame:
    """Keys with their shard by the map; null where the map has no such bucket. The map has at most 65,536 rows."""
    m = F.broadcast(bucket_map.select(F.col("vbucket").alias(BUCKET), F.col("shard_id").alias(SHARD)))
    return keys.drop(SHARD).join(m, BUCKET, "left")


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts: empty if the column may be a partition key."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_gate(df: DataFrame, table: str, columns: list[str], declared: str) -> DataFrame:
    """One row: may these columns be the partition key? Text or blob by affinity, unique, and of binary collation."""
    from shardloom.functions.scalars import affinity

    text = F.concat_ws("|", *(F.col(c).cast("string") for c in columns))
    per_key = df.groupBy(text.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    folded = per_key.groupBy(F.lower("key").alias("l")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"))
    agg = folded.agg(F.sum("n").alias("n_rows"), F.sum("forms").cast("bigint").alias("n_keys"), F.count(F.lit(1)).alias("n_folded"))
    kind = affinity(F.lit(declared))
    return agg.select(
        F.lit(table).alias("table_name"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("n_keys", F.lit(0)).alias("n_keys"),
        kind.alias("affinity"),
        (F.col("n_folded") == F.coalesce("n_keys", F.lit(0))).alias("case_safe"),
        (kind.isin("TEXT", "BLOB") & (F.coalesce("n_rows", F.lit(0)) == F.coalesce("n_keys", F.lit(0)))).alias("eligible"),
    )


# -- changes of the map ----------------------------------------------------------------------------


def drain_targets(bucket_map: DataFrame, shard: str, active: list[str]) -> DataFrame:
    """The map after moving every bucket of `shard` to the other active shards in turn, in order of their names."""
    others = sorted(s for s in active if s != shard)
    if not others:
        raise ValueError("no shard is left to take the buckets")
    ring = F.array(*(F.lit(s) for s in others))
    target = F.element_at(ring, (F.col("vbucket") % len(others) + 1).cast("int"))
    moves = F.col("shard_id") == shard
    return bucket_map.select(
        "vbucket",
        F.when(moves, target).otherwise(F.col("shard_id")).alias("shard_id"),
        (F.col("map_version") + moves.cast("int")).alias("map_version"),
        F.when(moves, F.lit(shard)).alias("moved_from"),
    )


def move_bucket(bucket_map: DataFrame, bucket: int, target: str) -> DataFrame:
    """The map after one bucket moved; its version rises if it did."""
    moves = (F.col("vbucket") == bucket) & (F.col("shard_id") != target)
    return bucket_map.withColumns({"shard_id": F.when(moves, F.lit(target)).otherwise(F.col("shard_id")), "map_version": F.col("map_version") + moves.cast("int")})


def evacuate_rings(indexes: DataFrame, shard: str, active: list[str]) -> DataFrame:
    """Rings (index_name, ring) with `shard` replaced in place by its substitute: an active shard not yet in the ring."""
    free = F.array_except(F.array(*(F.lit(s) for s in active)), F.col("ring"))
    sub = ring_substitute(F.col("index_name"), free)
    return indexes.withColumn("substitute", F.when(F.array_contains("ring", shard), sub)).withColumn(
        "ring", F.when(F.col("substitute").isNotNull(), F.expr(f"transform(ring, s -> if(s = '{shard}', substitute, s))")).otherwise(F.col("ring"))
    )


def history_at(events: DataFrame, history: DataFrame, at: str = "seq") -> DataFrame:
    """Joins events to the configuration row valid at each: start <= seq < end, where a null end is open.

    `history` is small control data; its rows are broadcast and must not overlap.
    """
    h = F.broadcast(history)
    return events.join(h, (h.start_seq <= events[at]) & (h.end_seq.isNull() | (h.end_seq > events[at])), "left")


def coverage_hash(bucket_map: DataFrame) -> DataFrame:
    """Digest of the whole topology, in bucket order: (n, digest)."""
    rows = F.array_sort(F.collect_list(F.struct("vbucket", "shard_id", "map_version")))
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["vbucket"].cast("string"), r["shard_id"], r["map_version"].cast("string"))), ",")
    return bucket_map.agg(F.count(F.lit(1)).alias("n"), F.sha2(text, 256).alias("digest"))


def merge_status(per_catalog: DataFrame) -> DataFrame:
    """One status of several catalogs: flags by AND, counts by sum."""
    return per_catalog.agg(
        F.every("initialized").alias("initialized"),
        F.count(F.lit(1)).alias("catalog_shard_count"),
        F.sum("total").alias("total"),
        F.sum("active").alias("active"),
        F.sum("draining").alias("draining"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def newest(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in an order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
