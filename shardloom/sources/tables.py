"""Sources and sinks: the fixture tables, their routed forms, checksummed reports and change feeds."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.scalars import canonical_json
from shardloom.plans.catalog import Catalog, TableDef

#: The tables with tenants, and how a row names its tenant and key.
FIXTURES = {
    "orders": TableDef("orders", "o_orderkey", "concat('t', o_custkey % 16)"),
    "customer": TableDef("customer", "c_custkey", "concat('n', c_nationkey)"),
    "events": TableDef("events", "event_id", "concat('u', user_id % 16)"),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def routed(spark: SparkSession, sf_dir: str, name: str, catalog: Catalog) -> DataFrame:
    """A fixture table with its system columns."""
    return catalog.with_routes(load(spark, sf_dir, name), FIXTURES[name])


def ts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time as it is, without zone, which is taken as UTC."""
    return load(spark, sf_dir, "events")


def work_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir), or in /tmp where none is set on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/shardloom-work"
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def write_report(df: DataFrame, path: str) -> str:
    """Writes a small report as one line of canonical JSON and gives its digest; the report has one row per group."""
    rows = [json.loads(x) for x in df.toJSON().collect()]
    text = canonical_json({"rows": sorted(rows, key=canonical_json)})
    digest = hashlib.sha256(text.encode()).hexdigest()
    df.sparkSession.createDataFrame([(text, digest)], "report string, sha256 string").coalesce(1).write.mode("overwrite").json(path)
    return digest


def broadcast_changes(stream: DataFrame, publish, checkpoint: str):
    """Feeds each micro-batch of a change stream to `publish(rows, number)` on the driver: snapshots of a topology, which is small."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: publish(df.collect(), n)).start()


def scan_tables(spark: SparkSession, reserved: tuple[str, ...] = ("__cf_", "sqlite_")) -> list[str]:
    """Names of user tables: all but those under reserved prefixes."""
    return sorted(t.name for t in spark.catalog.listTables() if not t.name.startswith(reserved))


def latest_snapshot(ticks: DataFrame, key: str, order: str) -> DataFrame:
    return ticks.groupBy(key).agg(F.max_by(F.struct(*[c for c in ticks.columns if c != key]), order).alias("s")).select(key, "s.*")
