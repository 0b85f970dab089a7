"""The engine's methods end to end, and snapshots."""

import pytest
from pyspark.sql import functions as F

from shardloom.engine import Engine
from shardloom.operators.snapshots import SnapshotStore
from shardloom.plans.catalog import KEY, Catalog, TableDef
from shardloom.sources.tables import FIXTURES, load, scan_tables, write_report

T = TableDef("item", "id", "owner")


@pytest.fixture()
def engine(spark):
    e = Engine(spark, Catalog(shards=2, buckets=64))
    rows = [(f"k{i:02d}", "t1" if i % 2 else "t2", i, None if i == 3 else f"v{i % 3}") for i in range(20)]
    e.register(T, spark.createDataFrame(rows, "id string, owner string, n long, v string"))
    return e


def test_paging_through_the_api(engine):
    rows, cursor = [], None
    while True:
        page = engine.table_scan("item", "t1", 3, cursor)
        rows += [r["id"] for r in page.rows]
        cursor = page.next_cursor
        if cursor is None:
            break
    assert rows == [f"k{i:02d}" for i in range(1, 20, 2)]
    with pytest.raises(ValueError):
        engine.table_scan("item", "t1", 3, "bad")


def test_mutations_are_idempotent_and_atomic(engine):
    one = [{"op": "update", "key": "k01", "where": {"n": 1}, "values": {"v": None}}, {"op": "insert", "key": "k90", "values": {"n": 90, "owner": "t1"}}]
    assert engine.mutate("item", "t1", one, "r1") == {"ok": True, "rowsAffected": 2}
    state = sorted(map(tuple, engine.table("item").select("id", "n", "v").collect()), key=str)
    assert engine.mutate("item", "t1", one, "r1")["ok"] and sorted(map(tuple, engine.table("item").select("id", "n", "v").collect()), key=str) == state
    assert ("k01", 1, None) in state and ("k90", 90, None) in state
    with pytest.raises(ValueError):
        engine.mutate("item", "t1", one[:1], "r1")
    bad = [{"op": "delete", "key": "k05"}, {"op": "update", "key": "k07", "where": {"n": 8}, "values": {"v": "x"}}]
    assert engine.mutate("item", "t1", bad, "r2") == {"ok": False, "rowsAffected": 0}
    assert engine.table("item").where("id = 'k05'").count() == 1
    assert engine.mutate("item", "t1", bad[:1], "r3")["ok"] and engine.table("item").where("id = 'k05'").count() == 0
    assert engine.mutate("item", "t2", [{"op": "delete", "key": "k07"}], "r4") == {"ok": False, "rowsAffected": 0}


def test_mutation_limits(engine):
    with pytest.raises(ValueError):
        engine.mutate("item", "t1", [{"op": "delete", "key": f"k{i}"} for i in range(9)], "r")
    with pytest.raises(ValueError):
        engine.mutate("item", "t1", [{"op": "upsert", "key": "k1", "values": {"id": "other"}}], "r")


def test_index_and_scatter(engine):
    entries = engine.create_index("by_v", "item", ("v",))
    assert entries.count() == 20 and entries.where("index_key_json = '[null]'").count() == 1
    assert [r.id for r in engine.index_query("by_v", "t1", {"v": None}).collect()] == ["k03"]
    with pytest.raises(ValueError):
        engine.index_query("by_v", "t1", {"n": 1})
    assert engine.scatter("item", [F.col(KEY)], F.col("n") > 9).count() == 10
    assert engine.sql("SELECT count(*) AS n FROM item", "item", "t1", "k01").first().n > 0


def test_schema_rules(engine, spark):
    with pytest.raises(ValueError):
        engine.register(TableDef("x", "v", "'t'"), spark.createDataFrame([("a",), ("a",)], "v string"))
    engine.create_table("CREATE TABLE fresh (id TEXT PRIMARY KEY)", TableDef("fresh", "id", "'t'"), "id string")
    for sql in ("CREATE TABLE IF NOT EXISTS other (id TEXT)", "CREATE TABLE wrong (id TEXT)", "SELECT 1", "CREATE TABLE other (id TEXT); DROP TABLE item"):
        with pytest.raises(ValueError):
            engine.create_table(sql, TableDef("other", "id", "'t'"), "id string")
    assert engine.tables() == ["fresh", "item"]


def test_topology(engine):
    assert engine.status()["shards"] == {"total": 2, "active": 2, "draining": 0}
    assert engine.shard_stats().agg(F.sum("n_rows")).first()[0] == 20
    bucket, shard = engine.catalog.route("item", "t1", "k01")
    assert engine.set_row_owner("item", "k01", "t1", shard)
    assert engine.migrate("item", bucket, "shard-9", F.col("v"))
    assert engine.table("item").where(F.col(KEY) == "k01").first()["__shard_id"] == "shard-9"
    assert engine.audit_log()[0][1] == "migrate-vbucket"


def test_snapshots(spark, sf, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.current() is None and store.versions() == []
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_name").limit(50).cache()
    assert store.checkpoint(c) == 1
    changed = c.where("c_custkey % 5 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 7 == 0, "x").otherwise(F.col("c_name")))
    two = store.stage(changed)
    assert store.current() == 1
    assert {r.change: r.n for r in store.preview(two, "c_custkey").collect()} == {"removed": 10, "changed": changed.where("c_name = 'x'").count()}
    store.apply(two)
    assert store.read().count() == 40 and store.verify(two, changed, "c_nationkey", "c_custkey", F.col("c_name"))
    assert not store.verify(1, changed, "c_nationkey", "c_custkey", F.col("c_name"))
    store.apply(1)
    assert store.read().count() == 50 and store.release(keep=1) == [] and store.versions() == [1, 2]
    with pytest.raises(ValueError):
        store.apply(9)


def test_reports_have_a_digest(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.5)], "k string, v double")
    a = write_report(df, str(tmp_path / "r"))
    assert a == write_report(df.orderBy(F.desc("k")), str(tmp_path / "r")) and spark.read.json(str(tmp_path / "r")).first().sha256 == a


def test_user_tables_only(spark, sf):
    load(spark, sf, "region").createOrReplaceTempView("region_view")
    load(spark, sf, "region").createOrReplaceTempView("__cf_hidden")
    assert "region_view" in scan_tables(spark) and "__cf_hidden" not in scan_tables(spark)
    assert set(FIXTURES) == {"orders", "customer", "events"}
