"""Invariants of routing, scans, folds, movement and ledgers."""

import random

import pytest
from pyspark.sql import functions as F

from shardloom.functions import hashing as H
from shardloom.functions import scalars as S
from shardloom.operators import ledger as L
from shardloom.operators import movement as V
from shardloom.operators import mutations as M
from shardloom.operators import reads as R
from shardloom.operators import workload as K
from shardloom.plans import catalog as C
from shardloom.plans import sqlguard as G
from shardloom.plans.catalog import BUCKET, KEY, SHARD, TENANT, Catalog, TableDef, lay_out
from shardloom.queries import QUERIES
from shardloom.sources.tables import load, routed
from shardloom.streaming import jobs as T

CAT = Catalog(shards=4, buckets=64)


def test_hash_forms_agree(spark):
    words = ["", "a", "t1:events:e1", "x" * 31, "y" * 32, "z" * 33, "q" * 200, "é", "漢字", "a😀b", "t:ä:1"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", H.fnv1a(F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in rows} == {w: H.fnv1a_py(w) for w in words}
    assert H.fnv1a_py("t1:events:e1") == 2967449315


def test_every_row_has_one_shard_and_the_driver_agrees(spark, sf):
    rows = routed(spark, sf, "orders", CAT).select(TENANT, KEY, BUCKET, SHARD).collect()
    assert len(rows) == load(spark, sf, "orders").count()
    for r in rows[:300]:
        assert CAT.route("orders", r[TENANT], r[KEY]) == (r[BUCKET], r[SHARD])


@pytest.mark.parametrize("limit", [7, 30, 100])
def test_paging_gives_every_row_once(spark, sf, limit):
    rows = routed(spark, sf, "orders", CAT).where(F.col(TENANT).isin("t3", "t4")).cache()
    want = [r[KEY] for r in rows.where(F.col(TENANT) == "t3").orderBy(KEY).collect()]
    got = [r[KEY] for page, _ in R.scan_all(rows, "t3", limit) for r in page]
    assert got == want


def test_scan_of_unknown_tenant_is_empty(spark, sf):
    rows = routed(spark, sf, "orders", CAT)
    assert R.tenant_scan(rows, "nobody").count() == 0
    assert R.next_cursors(rows, "nobody").count() == 0


def test_cursor_round_trip():
    text = S.encode_cursor("orders", {"shard-0": "é9", "shard-1": ""})
    assert S.decode_cursor(text) == {"table": "orders", "shardCursors": {"shard-0": "é9", "shard-1": ""}}
    assert S.decode_cursor("???") is None and S.decode_cursor("e30=") is None


def test_layout_prunes_shards(spark, sf, tmp_path):
    lay_out(routed(spark, sf, "orders", CAT), str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    shard = CAT.route("orders", "t3", "7")[1]
    plan = stored.where((F.col(SHARD) == shard) & (F.col(TENANT) == "t3"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__shard_id" in plan and "EqualTo(__tenant_id,t3)" in plan


def test_scatter_tolerates_a_failed_shard(spark, sf):
    rows = routed(spark, sf, "orders", CAT)
    assert R.scatter_report(CAT, ("shard-1",)) == {"shardCount": 4, "successCount": 3, "errors": ["shard-1"]}
    left = R.scatter(CAT, rows, [F.col(KEY)], failed=("shard-1",))
    assert left.where("shard_id = 'shard-1'").count() == 0 and left.count() > 0


def test_shard_sql_refuses_writes(spark, sf):
    with pytest.raises(ValueError):
        R.shard_sql(CAT, routed(spark, sf, "orders", CAT), "DELETE FROM orders", "orders", "t1", "7")


def test_stale_index_entries_are_checked_again(spark, sf):
    rows = routed(spark, sf, "customer", CAT)
    entries = R.index_backfill(rows, ["c_mktsegment"], "i", CAT.all_shards(), "customer").withColumn("index_key_json", F.lit('["BUILDING"]'))
    got = R.index_lookup(entries, rows, "n7", '["BUILDING"]', {"c_mktsegment": "BUILDING"}, 100)
    assert got.count() == rows.where("c_mktsegment = 'BUILDING'").where(F.col(TENANT) == "n7").count()


def _base(spark, rows):
    return spark.createDataFrame(rows, "pk string, row map<string,string>")


def _log(spark, rows):
    return spark.createDataFrame(rows, "seq long, request_id string, request_hash string, op string, pk string, `where` map<string,string>, values map<string,string>")


def test_fold_against_a_plain_loop(spark):
    rnd = random.Random(4)
    base = [(f"k{i}", {"a": str(i % 3), "b": None}) for i in range(12)]
    log = []
    for i in range(300):
        op = rnd.choice(["insert", "update", "upsert", "delete"])
        where = {"a": rnd.choice(["0", "1", None])} if rnd.random() < 0.5 else None
        log.append((i, f"r{i}", "h", op, f"k{rnd.randrange(18)}", where if op in ("update", "delete") else None, {rnd.choice("abc"): rnd.choice(["0", "1", "2", None])} if op != "delete" else None))
    state, touched, failed = {k: dict(r) for k, r in base}, {}, {}
    for _, _, _, op, k, where, values in log:
        row = state.get(k)
        hit = row is not None and all(v is not None and row.get(c) == v for c, v in (where or {}).items())
        done = True
        if op == "insert" and row is None or op == "upsert" and row is None:
            state[k] = dict(values)
        elif op == "upsert" or op == "update" and hit:
            row.update(values)
        elif op == "delete" and hit:
            del state[k]
        else:
            done = False
            failed[k] = failed.get(k, 0) + (op == "insert")
        touched[k] = touched.get(k, 0) + done
    got = {r.pk: r for r in M.fold_log(_base(spark, base), _log(spark, log)).collect()}
    assert {k: r.row for k, r in got.items() if r.live} == state
    assert {k: r.touched for k, r in got.items() if r.touched} == {k: v for k, v in touched.items() if v}
    assert {k: r.failed for k, r in got.items() if r.failed} == {k: v for k, v in failed.items() if v}


def test_fold_is_invariant_to_repeated_requests(spark):
    base = _base(spark, [("k", {"n": "0"})])
    once = [(1, "r1", "h", "update", "k", {"n": "0"}, {"n": "1"}), (2, "r2", "h", "update", "k", {"n": "1"}, {"n": "2"})]
    twice = [*once, (3, "r1", "h", "update", "k", {"n": "0"}, {"n": "1"}), (4, "r2", "h", "update", "k", None, {"n": "9"})]
    fold = lambda log: [tuple(r) for r in M.fold_log(base, M.first_requests(_log(spark, log))).collect()]
    assert fold(once) == fold(twice)
    assert M.replay_conflicts(_log(spark, [*once, (5, "r1", "other", "delete", "k", None, None)])).count() == 1


def test_supplied_null_overwrites(spark):
    base = spark.createDataFrame([(1, "x", "y")], "id int, a string, b string")
    new = spark.createDataFrame([(1, None, "z"), (2, "n", "m")], "id int, a string, b string")
    got = {r.id: (r.a, r.b) for r in M.upsert_rows(base, new, "id", ["a"]).collect()}
    assert got == {1: (None, "y"), 2: ("n", None)}


def test_every_state_pair_against_the_table(spark):
    states = list(M.TRANSITIONS)
    rows = [(i, s, x) for i, (a, b) in enumerate((a, b) for a in states for b in states) for s, x in ((0, a), (1, b))]
    got = M.transition_check(spark.createDataFrame(rows, "tx int, seq int, state string")).collect()
    assert len(got) == len(states) ** 2
    assert all(r.allowed == (r.from_state == r.to_state or r.to_state in M.TRANSITIONS[r.from_state]) for r in got)


def test_checksum_survives_a_move_and_sees_a_loss(spark, sf):
    rows = routed(spark, sf, "orders", CAT)
    content = F.col("o_orderstatus")
    a = V.bucket_checksums(rows, [BUCKET], KEY, content, 50)
    moved = V.migrate(rows, 7, "shard-2").repartition(5)
    assert V.compare_checksums(a, V.bucket_checksums(moved, [BUCKET], KEY, content, 50), BUCKET).where("not same").count() == 0
    gone = rows.where(f"{KEY} <> '{rows.where(F.col(BUCKET) == 7).first()[KEY]}'")
    bad = V.compare_checksums(a, V.bucket_checksums(gone, [BUCKET], KEY, content, 50), BUCKET).where("not same").collect()
    assert [r[BUCKET] for r in bad] == [7]


def test_verifier_goes_red_on_a_planted_loss(spark):
    acked = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, None)], "k string, seq long, v string")
    good = spark.createDataFrame([("a", "y"), ("b", None)], "k string, v string")
    assert tuple(K.lost_writes(acked, good, "k", "v").first()) == (2, 0, False)
    assert tuple(K.lost_writes(acked, good.where("k = 'a'"), "k", "v").first()) == (2, 1, True)


def test_stamps_are_strictly_increasing(spark):
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate([5, 5, 3, 20, 20, 1])], "b string, i int, now long")
    got = [r.assigned_ms for r in L.stamp(rows, ["b"], "i", "now", 4).orderBy("i").collect()]
    last, want = 0, []
    for t in [5, 5, 3, 20, 20, 1]:
        last = max(t, last + 1, 5)
        want.append(last)
    assert got == want


def test_seal_verdicts():
    assert [L.check_seal(5, c, 10) for c in (4, 5, 6, 11)] == ["non_monotone", "replay", "sealed", "in_future"]


def test_token_bucket_batch_and_stream_agree(spark, tmp_path):
    rnd = random.Random(2)
    rows = sorted((f"t{rnd.randrange(3)}", rnd.randrange(20_000)) for _ in range(300))
    df = spark.createDataFrame([(t, a, i) for i, (t, a) in enumerate(sorted(rows, key=lambda r: r[1]))], "tenant string, at_ms long, i long")
    want = {}
    for t, a in sorted(rows, key=lambda r: r[1]):
        tokens, last, ok, no = want.get(t, (20.0, None, 0, 0))
        have = 20.0 if last is None else min(20.0, tokens + (a - last) / 500)
        want[t] = (have - 1, a, ok + 1, no) if have >= 1 else (tokens, last, ok, no + 1)
    got = {r.tenant: (r.allowed, r.limited) for r in T.token_bucket(df, "tenant", "at_ms", "i").collect()}
    assert got == {t: w[2:] for t, w in want.items()}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = T.token_bucket_stream(T.event_stream(spark, str(tmp_path / "in"), df.schema), "tenant", "at_ms")
    out = T.run_to_end(s, spark, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {r.tenant: r.n for r in out.where("allowed").groupBy("tenant").agg(F.count("*").alias("n")).collect()} == {t: w[2] for t, w in want.items()}


def test_circuit_opens_probes_and_closes(spark):
    x = [(1000, True), (1001, True), (1002, True), (1003, False), (1200, True), (1300, False), (1500, False), (1501, True)]
    df = spark.createDataFrame([("c", t, f) for t, f in x], "c string, t long, f boolean")
    r = T.circuit_breaker(df, "c", "t", "f", 3, 100, 10_000).first()
    # opens at 1002 until 1102; the probe at 1200 fails: open until 1400; the probe at 1500 closes it
    assert (r.opened, r.refused, r.open_until_ms) == (2, 2, 0)


def test_mirror_sink_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for cp in ("cp1", "cp2"):
        T.upsert_sink(T.event_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / cp), "k", "o").awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "y"), ("b", "z")]


def test_drain_needs_a_target(spark):
    with pytest.raises(ValueError):
        C.drain_targets(CAT.bucket_map(spark), "shard-0", ["shard-0"])
    got = C.drain_targets(CAT.bucket_map(spark), "shard-0", CAT.active())
    assert got.where("shard_id = 'shard-0'").count() == 0 and got.where("moved_from = 'shard-0'").count() == 16


def test_catalog_registry():
    c = Catalog(shards=999, buckets=3)
    assert (c.shards, c.buckets) == (256, 64)
    c.register(TableDef("t", "id", "'x'")).create_index("i", "t", ("a",))
    with pytest.raises(ValueError):
        c.register(TableDef("t", "id", "'x'"))
    with pytest.raises(ValueError):
        c.create_index("j", "nope", ("a",))


def test_completeness_looks_one_row_ahead(spark):
    df = spark.range(10).withColumnRenamed("id", "seq")
    for limit, complete in ((9, False), (10, True), (11, True)):
        rows = L.loss_window(df, "seq", -1, 100, "seq", None, limit).collect()
        assert len(rows) == min(10, limit) and all(r.complete == complete for r in rows)


def test_latency_report_takes_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(i), True) for i in range(1, 21)] + [("a", 99.0, False)], "t string, l double, ok boolean")
    r = K.latency_report(df, "t", "l", F.col("ok")).first()
    assert (r.n, r.ok, r.err, r.p50, r.p95, r.p99) == (21, 20, 1, 10.0, 19.0, 20.0)


GUARD = [
    ("select 1", False, None),
    ("\n-- insert\n/* update */ SELECT * FROM t", False, None),
    ("insert or replace into \"A b\" values (1)", True, "a b"),
    ("with x as (select 'a)' as y), z(q) as (values (1)) update t set a = 1", True, "t"),
    ("with recursive x as (select 1) select * from x", False, None),
    ("delete/**/from main . [T]", True, "t"),
    ("delete from a.b.c", True, None),
    ("WITH x AS (SELECT '/*') DELETE FROM __cf_row_owners", True, "__cf_row_owners"),
    ("create table t (a text)", True, None),
    ("explain select 1", False, None),
]


@pytest.mark.parametrize("sql,mutation,target", GUARD)
def test_sql_guard(sql, mutation, target):
    assert (G.is_mutation(sql), G.write_target(sql)) == (mutation, target)


def test_sql_guard_more():
    assert G.writes_internal("WITH x AS (SELECT '/*') DELETE FROM __cf_row_owners")
    assert not G.writes_internal("insert into t select * from row_locks")
    assert G.is_dangerous("select ';' from t") and G.is_dangerous("select 'pragma'") and not G.is_dangerous("select 1;")
    assert not G.is_dangerous_schema("create table t (a text)") and G.is_dangerous_schema("create table t (a text); drop table u")
    assert G.create_table_name('CREATE TABLE IF NOT EXISTS "a""b" (x)') == 'a"b' and G.create_table_name("select 1") is None
    assert G.create_if_not_exists("create  table t(a)") == "create  table IF NOT EXISTS t(a)"
    assert G.single_table("select a from `T x` where b") == "t x" and G.single_table("select a from t join u") is None
    assert G.is_expected_abort("remote row changed concurrently — remote line's stock update did not apply") and not G.is_expected_abort(None)


def test_canonical_json():
    assert S.canonical_json({"b": 1.0, "a": [None, True, {"y": 2, "x": "é"}]}) == '{"a":[null,true,{"x":"é","y":2}],"b":1}'
    with pytest.raises(ValueError):
        S.canonical_json(float("nan"))


def test_scalar_nulls(spark):
    r = spark.range(1).select(S.sql_max(F.lit(1), F.lit(None).cast("int")).alias("a"), S.sql_min(F.lit(1), F.lit(2)).alias("b"), S.affinity(F.lit(None).cast("string")).alias("c")).first()
    assert tuple(r) == (None, 1, "BLOB")
    assert [S.affinity_py(t) for t in ("", "CHARINT", "double", "date")] == ["BLOB", "INTEGER", "REAL", "NUMERIC"]


def test_keys_on_shard_route_there(spark):
    rows = K.keys_on_shard(spark, CAT, "orders", "t1", "shard-3", 20).collect()
    assert len(rows) == 20 and all(CAT.route("orders", "t1", r.pk)[1] == "shard-3" for r in rows)


def test_tpcc_tables_have_unique_keys(spark):
    for name, df in K.tpcc_tables(spark).items():
        key = df.columns[0]
        assert df.count() == df.select(key).distinct().count() > 0, name


def test_streams_count_whole_tables_in_any_order(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    more = e.withColumn("ts", F.col("ts") + F.expr("interval 90 days")).unionByName(e)
    # the latest events come first, one file for each of four spans of time
    later = more.orderBy(F.desc("ts")).repartitionByRange(4, F.desc("ts"))
    later.write.parquet(str(tmp_path / "events.parquet"))
    rows = {(r.utc_day, r.event_type): r.n for r in QUERIES["stream_daily_counts"](spark, str(tmp_path)).collect()}
    want = {(r.d, r.event_type): r["count"] for r in more.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d"), "event_type").count().collect()}
    assert rows == want
    assert {r.n for r in QUERIES["stream_dedup"](spark, str(tmp_path)).collect()} == {1}


def test_fold_hashes_utf16_units(spark):
    from shardloom.functions.hashing import fnv1a_fold, fnv1a_py

    texts = ["", "plain", "é", "a😀b", "漢字", "x" * 100, "😀" * 40]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fnv1a_fold(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in rows} == {t: fnv1a_py(t) for t in texts}


def test_attempts_at_one_time_keep_their_order(spark):
    first = spark.createDataFrame([("a", 10, 0, True), ("a", 10, 1, False), ("a", 10, 2, True)], "c string, t long, o long, f boolean")
    last = spark.createDataFrame([("a", 10, 0, False), ("a", 10, 1, True), ("a", 10, 2, True)], "c string, t long, o long, f boolean")
    opened = [T.circuit_breaker(df, "c", "t", "f", 2, 100, 10_000, "o").first().opened for df in (first, last)]
    assert opened == [0, 1]
