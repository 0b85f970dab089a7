"""The registered queries over the fixture tables, each next to the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
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
from shardloom.plans.catalog import BUCKET, KEY, SHARD, TENANT, Catalog, TableDef
from shardloom.sources.tables import FIXTURES, load, routed, ts_events
from shardloom.streaming import jobs as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CATALOG = Catalog()


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# -- pieces of SQL that several oracles share ------------------------------------------------------


def fnv(x: str) -> str:
    return f"list_reduce(list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT)"


def routed_sql(name: str) -> str:
    tenant = {"orders": "'t' || (o_custkey % 16)", "customer": "'n' || c_nationkey", "events": "'u' || (user_id % 16)"}[name]
    key = {"orders": "o_orderkey", "customer": "c_custkey", "events": "event_id"}[name]
    return (
        f"{name}_t as (select *, {tenant} as tenant, {key}::varchar as pk from {name}), "
        f"{name}_v as (select *, ({fnv(f"tenant || ':{name}:' || pk")} % 1024)::int as vbucket from {name}_t), "
        f"{name}_r as (select *, 'shard-' || (vbucket % 8) as shard from {name}_v)"
    )


RO, RC, RE = (f"with {routed_sql(n)} " for n in ("orders", "customer", "events"))
MAP = "map as (select i::int as vbucket, 'shard-' || (i % 8) as shard_id from range(1024) t(i))"
SHARDS = "'shard-0','shard-1','shard-2','shard-3','shard-4','shard-5','shard-6','shard-7'"


def names(df: DataFrame) -> DataFrame:
    """System columns under the names that the SQL uses."""
    return df.withColumnsRenamed({TENANT: "tenant", KEY: "pk", BUCKET: "vbucket", SHARD: "shard"})


# -- routing and placement -------------------------------------------------------------------------


@query("route_orders", RO + "select o_orderkey, tenant, pk, vbucket, shard, 'catalog-' || (" + fnv("tenant") + " % 4) as catalog_shard from orders_r")
def route_orders(spark, d):
    out = routed(spark, d, "orders", CATALOG)
    return names(out).select("o_orderkey", "tenant", "pk", "vbucket", "shard", H.catalog_shard(F.col("tenant")).alias("catalog_shard"))


@query("route_batch", RO + ", " + MAP + " select pk, vbucket, shard_id as shard from orders_r left join map using (vbucket)")
def route_batch(spark, d):
    out = C.route_batch(routed(spark, d, "orders", CATALOG), CATALOG.bucket_map(spark))
    return names(out).select("pk", "vbucket", "shard")


@query("vbucket_map_init", "select i::int as vbucket, 'shard-' || (i % 8) as shard_id, 1 as map_version, 'active' as status from range(1024) t(i)")
def vbucket_map_init(spark, d):
    return CATALOG.bucket_map(spark)


KEYJSON = "'[\"' || o_orderstatus || '\",\"' || o_orderpriority || '\"]'"


@query(
    "index_shard_placement",
    RO + f", k as (select pk, {KEYJSON} as key_json from orders_r) select pk, key_json, [{SHARDS}][({fnv("'orders:by_status:' || key_json")} % 8)::int + 1] as index_shard from k",
)
def index_shard_placement(spark, d):
    out = R.index_backfill(routed(spark, d, "orders", CATALOG), ["o_orderstatus", "o_orderpriority"], "by_status", CATALOG.all_shards(), "orders")
    return out.select("pk", F.col("index_key_json").alias("key_json"), F.col("index_shard_id").alias("index_shard"))


@query(
    "ring_substitute",
    f"with i as (select 'idx' || n_nationkey as index_name from nation), c as (select index_name, s as shard, {fnv("index_name || ':' || s")} as h from i, unnest([{SHARDS}]) u(s)) "
    "select index_name, arg_min(shard, (h, shard)) as substitute from c group by index_name",
)
def ring_substitute(spark, d):
    shards = F.array(*(F.lit(s) for s in CATALOG.all_shards()))
    return load(spark, d, "nation").select(F.concat(F.lit("idx"), "n_nationkey").alias("index_name")).withColumn("substitute", H.ring_substitute(F.col("index_name"), shards))


@query("manifest_bucket", "select event_id, strftime(ts, '%Y-%m-%d') as utc_day, (('0x' || right(sha256('tx' || event_id), 2))::int % 16)::int as bucket from events")
def manifest_bucket(spark, d):
    return L.bucketed(ts_events(spark, d).withColumn("tx", F.concat(F.lit("tx"), "event_id")), "tx", "ts").select("event_id", "utc_day", "bucket")


@query(
    "skewed_keys",
    f"with c as (select i as value, 'k' || i as pk, ({fnv("'t1:orders:k' || i")} % 1024)::int as vbucket from range(20000) t(i)) select * from c where vbucket % 8 = 3 order by value limit 50",
)
def skewed_keys(spark, d):
    return K.keys_on_shard(spark, CATALOG, "orders", "t1", "shard-3", 50)


@query("row_identity", RO + """select pk, '["' || tenant || '","orders","' || pk || '"]' as row_key, sha256('["' || tenant || '","req-' || pk || '"]') as tx_id from orders_r""")
def row_identity(spark, d):
    t, k = F.col(TENANT), F.col(KEY)
    return routed(spark, d, "orders", CATALOG).select(k.alias("pk"), H.row_key(t, "orders", k).alias("row_key"), H.transaction_id(t, F.concat(F.lit("req-"), k)).alias("tx_id"))


@query("request_hashes", "select event_id, sha256('{\"params\":[\"' || event_id || '\",' || user_id || '],\"sql\":\"UPDATE t SET v = ? WHERE id = ?\"}') as request_hash from events")
def request_hashes(spark, d):
    params = H.json_array([(F.col("event_id").cast("string"), "string"), (F.col("user_id"), "bigint")])
    return load(spark, d, "events").select("event_id", H.request_hash(F.lit("UPDATE t SET v = ? WHERE id = ?"), params).alias("request_hash"))


@query("routing_inspector", RO + "select tenant, pk, vbucket, shard, 'catalog-' || (" + fnv("tenant") + " % 4) as catalog_shard from orders_r where o_orderkey = (select min(o_orderkey) from orders)")
def routing_inspector(spark, d):
    first = load(spark, d, "orders").agg(F.min("o_orderkey").alias("o_orderkey"))
    one = names(routed(spark, d, "orders", CATALOG).join(F.broadcast(first), "o_orderkey"))
    return one.select("tenant", "pk", "vbucket", "shard", H.catalog_shard(F.col("tenant")).alias("catalog_shard"))


@query(
    "operation_mix",
    "with s as (select i as sequence, (i * 2654435769) & 4294967295 as m from range(5000) t(i)), a as (select sequence, case when xor(42, m) = 0 then 1 else xor(42, m) end as x0 from s), "
    "b as (select sequence, xor(x0, (x0 << 13) & 4294967295) as x1 from a), c as (select sequence, xor(x1, x1 >> 17) as x2 from b), e as (select sequence, xor(x2, (x2 << 5) & 4294967295) / 4294967296.0 as r from c) "
    "select sequence, case when r * 100 < 55 then 'single-write' when r * 100 < 85 then 'paired-write' else 'bounded-read' end as operation from e",
)
def operation_mix(spark, d):
    return spark.range(5000).select(F.col("id").alias("sequence"), K.operations(F.col("id"), 42).alias("operation"))


# -- reads -----------------------------------------------------------------------------------------

SCAN = "select pk, shard, o_orderkey, o_custkey, o_orderstatus from orders_r where tenant = 't3'"


@query("tenant_scan_first_page", RO + SCAN + " order by pk, shard limit 100")
def tenant_scan_first_page(spark, d):
    out = R.tenant_scan(routed(spark, d, "orders", CATALOG), "t3", 100)
    return names(out).select("pk", "shard", "o_orderkey", "o_custkey", "o_orderstatus")


AFTER = " and not (shard in ('shard-0', 'shard-5') and pk <= '2') and not (shard = 'shard-1' and pk <= '5')"


@query("tenant_scan_next_page", RO + SCAN + AFTER + " order by pk, shard limit 100")
def tenant_scan_next_page(spark, d):
    out = R.tenant_scan(routed(spark, d, "orders", CATALOG), "t3", 100, {"shard-0": "2", "shard-5": "2", "shard-1": "5"})
    return names(out).select("pk", "shard", "o_orderkey", "o_custkey", "o_orderstatus")


@query(
    "tenant_scan_merged",
    RO + ", p as (select *, row_number() over (partition by shard order by pk) as rn from orders_r where tenant = 't3') select pk, shard, o_orderkey from p where rn <= 100 order by pk, shard limit 300",
)
def tenant_scan_merged(spark, d):
    return names(R.tenant_scan(routed(spark, d, "orders", CATALOG), "t3", 300)).select("pk", "shard", "o_orderkey")


@query(
    "tenant_scan_cursor",
    RO + ", p as (select shard, pk, row_number() over (partition by shard order by pk) as rn from orders_r where tenant = 't3'), q as (select *, row_number() over (order by pk, shard) <= 40 as kept from p where rn <= 40), "
    "s as (select shard, count(*) as scanned, count(*) filter (kept) as returned, max(pk) filter (kept) as lr, max(pk) as ls from q group by shard) "
    "select shard as shard_id, scanned, returned, case when scanned >= 40 and returned = scanned then ls else lr end as next_key, scanned >= 40 as page_full, bool_or(scanned >= 40 or returned <> scanned) over () as more from s",
)
def tenant_scan_cursor(spark, d):
    return R.next_cursors(routed(spark, d, "orders", CATALOG), "t3", 40)


@query("index_query_exact", RC + "select pk, c_custkey, c_mktsegment from customer_r where tenant = 'n7' and c_mktsegment = 'BUILDING' order by pk limit 20")
def index_query_exact(spark, d):
    return names(R.index_query(routed(spark, d, "customer", CATALOG), "n7", {"c_mktsegment": "BUILDING"}, 20)).select("pk", "c_custkey", "c_mktsegment")


@query("index_query_composite", RO + "select pk, o_orderstatus, o_orderpriority from orders_r where tenant = 't3' and o_orderstatus = 'O' and o_orderpriority = '1-URGENT' order by pk limit 100")
def index_query_composite(spark, d):
    return names(R.index_query(routed(spark, d, "orders", CATALOG), "t3", {"o_orderstatus": "O", "o_orderpriority": "1-URGENT"}, 100)).select("pk", "o_orderstatus", "o_orderpriority")


@query(
    "index_query_limit",
    RO + ", e as (select *, row_number() over (partition by " + KEYJSON + " order by pk) as rn from orders_r where tenant = 't5' and o_orderstatus = 'F' and o_orderpriority = '5-LOW') select pk, o_orderkey from e where rn <= 15 order by pk limit 3",
)
def index_query_limit(spark, d):
    rows = routed(spark, d, "orders", CATALOG)
    entries = R.index_backfill(rows, ["o_orderstatus", "o_orderpriority"], "by_status", CATALOG.all_shards(), "orders")
    out = R.index_lookup(entries, rows, "t5", '["F","5-LOW"]', {"o_orderstatus": "F", "o_orderpriority": "5-LOW"}, 3, cap=15)
    return names(out).select("pk", "o_orderkey")


@query("index_backfill", RC + """select 'by_segment' as index_name, '["' || c_mktsegment || '"]' as index_key_json, pk, tenant as tenant_id, shard as source_shard_id from customer_r""")
def index_backfill(spark, d):
    out = R.index_backfill(routed(spark, d, "customer", CATALOG), ["c_mktsegment"], "by_segment", CATALOG.all_shards(), "customer")
    return out.drop("index_shard_id")


@query("single_shard_sql", RO + ", one as (select shard from orders_r where pk = '7' and tenant = 't1' union all select 'shard-' || ((" + fnv("'t1:orders:7'") + " % 1024) % 8) limit 1) select o_orderstatus, count(*) as n from orders_r where shard = (select 'shard-' || ((" + fnv("'t1:orders:7'") + " % 1024) % 8)) and o_orderkey > 100 group by o_orderstatus")
def single_shard_sql(spark, d):
    rows = routed(spark, d, "orders", CATALOG)
    return R.shard_sql(CATALOG, rows, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey > ? GROUP BY o_orderstatus", "orders", "t1", "7", [100])


@query("scatter_select", RO + "select shard as shard_id, pk, o_totalprice from orders_r where o_totalprice > 300000")
def scatter_select(spark, d):
    return R.scatter(CATALOG, routed(spark, d, "orders", CATALOG), [F.col(KEY).alias("pk"), F.col("o_totalprice")], F.col("o_totalprice") > 300000)


@query("scatter_limit", RO + "select shard as shard_id, pk from orders_r where o_orderstatus = 'P' order by shard, pk limit 25")
def scatter_limit(spark, d):
    return R.scatter(CATALOG, routed(spark, d, "orders", CATALOG), [F.col(KEY).alias("pk")], F.col("o_orderstatus") == "P", 25)


@query("scatter_partial_failure", RO + "select shard as shard_id, pk from orders_r where o_orderstatus = 'P' and shard <> 'shard-2'")
def scatter_partial_failure(spark, d):
    return R.scatter(CATALOG, routed(spark, d, "orders", CATALOG), [F.col(KEY).alias("pk")], F.col("o_orderstatus") == "P", failed=("shard-2",))


AGGS = "count(*) as n, sum(o_totalprice::decimal(18,2))::double as total, min(o_orderdate) as first_date"


def _aggs():
    return [F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.min("o_orderdate").alias("first_date")]


@query("scatter_partial_agg", RO + f"select shard as shard_id, o_orderstatus, {AGGS} from orders_r group by shard, o_orderstatus")
def scatter_partial_agg(spark, d):
    return R.scatter_partial(routed(spark, d, "orders", CATALOG), _aggs(), ["o_orderstatus"])


@query("scatter_global_agg", f"select o_orderstatus, {AGGS} from orders group by o_orderstatus")
def scatter_global_agg(spark, d):
    return R.scatter_global(load(spark, d, "orders"), _aggs(), ["o_orderstatus"])


@query("dual_lookup_union", RO + "select distinct pk from orders_r where tenant = 't3' and (o_orderstatus = 'O' or o_orderpriority = '2-HIGH')")
def dual_lookup_union(spark, d):
    rows = routed(spark, d, "orders", CATALOG).where(F.col(TENANT) == "t3")
    return names(R.dual_lookup(rows.where("o_orderstatus = 'O'"), rows.where("o_orderpriority = '2-HIGH'")))


@query("point_read", RC + "select pk, c_name, c_acctbal from customer_r where pk = '42'")
def point_read(spark, d):
    return names(routed(spark, d, "customer", CATALOG).where(F.col(KEY) == "42")).select("pk", "c_name", "c_acctbal")


# -- statistics and metadata -----------------------------------------------------------------------


@query("shard_stats", RO + ", " + routed_sql("customer") + " select 'orders' as table_name, shard as shard_id, count(*) as n_rows, count(distinct tenant) as tenants from orders_r group by shard union all select 'customer', shard, count(*), count(distinct tenant) from customer_r group by shard")
def shard_stats(spark, d):
    stats = [
        routed(spark, d, t, CATALOG).groupBy(F.lit(t).alias("table_name"), F.col(SHARD).alias("shard_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(TENANT).alias("tenants"))
        for t in ("orders", "customer")
    ]
    return C.union_all(stats)


@query("shard_spread", RO + ", c as (select shard, count(*) as n from orders_r group by shard) select min(n) as least, max(n) as most, round(avg(n), 6) as mean from c")
def shard_spread(spark, d):
    counts = routed(spark, d, "orders", CATALOG).groupBy(SHARD).count()
    return counts.agg(F.min("count").alias("least"), F.max("count").alias("most"), F.round(F.avg("count"), 6).alias("mean"))


@query("cluster_status", "select bool_and(ok) as initialized, count(*) as catalog_shard_count, sum(8)::bigint as total, sum(case when c < 3 then 8 else 7 end)::bigint as active, sum(case when c < 3 then 0 else 1 end)::bigint as draining from (select c, true as ok from range(4) t(c))")
def cluster_status(spark, d):
    per = spark.range(4).select(F.lit(True).alias("initialized"), F.lit(8).alias("total"), F.when(F.col("id") < 3, 8).otherwise(7).alias("active"), F.when(F.col("id") < 3, 0).otherwise(1).alias("draining"))
    return C.merge_status(per)


@query(
    "hottest_targets",
    RO + ", s as (select shard as target, count(*) as n from orders_r group by shard order by n desc, target limit 1), v as (select 'vb-' || vbucket as target, count(*) as n from orders_r group by vbucket order by n desc, vbucket limit 1) select 'shard' as kind, * from s union all select 'vbucket', * from v",
)
def hottest_targets(spark, d):
    rows = routed(spark, d, "orders", CATALOG)
    shard = K.hottest(rows.groupBy(F.col(SHARD).alias("target")).agg(F.count(F.lit(1)).alias("n")), "target")
    bucket = K.hottest(rows.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")), BUCKET).select(F.concat(F.lit("vb-"), F.col(BUCKET)).alias("target"), "n")
    return shard.select(F.lit("shard").alias("kind"), "target", "n").unionByName(bucket.select(F.lit("vbucket").alias("kind"), "target", "n"))


@query("audit_merge", "with a as (select event_id, ts, event_type, user_id % 4 as catalog_id, row_number() over (partition by user_id % 4 order by ts desc, event_id desc) as rn from events) select catalog_id, event_id, event_type from a where rn <= 100 order by ts desc, event_id desc limit 100")
def audit_merge(spark, d):
    log = load(spark, d, "events").withColumn("catalog_id", F.col("user_id") % 4)
    per = C.newest(log, ["catalog_id"], [F.col("ts").desc(), F.col("event_id").desc()], 100)
    return per.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(100).select("catalog_id", "event_id", "event_type")


TYPES = ("TEXT", "varchar(20)", "INTEGER", "bigint", "FLOATING POINT", "double", "REAL", "BLOB", "", "DECIMAL(10,5)", "CHARINT", "CLOB", "boolean", "date")


@query(
    "type_affinity",
    "with t as (select unnest([" + ",".join(f"'{t}'" for t in TYPES) + "]) as declared) select declared, case when upper(declared) like '%INT%' then 'INTEGER' when upper(declared) like '%CHAR%' or upper(declared) like '%CLOB%' or upper(declared) like '%TEXT%' then 'TEXT' "
    "when declared = '' or upper(declared) like '%BLOB%' then 'BLOB' when upper(declared) like '%REAL%' or upper(declared) like '%FLOA%' or upper(declared) like '%DOUB%' then 'REAL' else 'NUMERIC' end as affinity from t",
)
def type_affinity(spark, d):
    return spark.createDataFrame([(t,) for t in TYPES], "declared string").withColumn("affinity", S.affinity(F.col("declared")))


@query(
    "key_uniqueness_gate",
    "with k as (select 'orders' as table_name, o_orderkey::varchar as k from orders union all select 'lineitem', l_orderkey || '|' || l_linenumber from lineitem) "
    "select table_name, count(*) as n_rows, count(distinct k) as n_keys, 'TEXT' as affinity, count(distinct k) = count(distinct lower(k)) as case_safe, count(*) = count(distinct k) as eligible from k group by table_name",
)
def key_uniqueness_gate(spark, d):
    a = C.key_gate(load(spark, d, "orders"), "orders", ["o_orderkey"], "TEXT")
    return a.unionByName(C.key_gate(load(spark, d, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"], "TEXT"))


@query("key_violations", "select o_custkey as key, count(*) as n from orders group by o_custkey having count(*) > 1")
def key_violations(spark, d):
    return C.key_violations(load(spark, d, "orders"), "o_custkey")


@query("coverage_hash", "with " + MAP + " select count(*) as n, sha256(string_agg(vbucket || ':' || shard_id || ':1', ',' order by vbucket)) as digest from map")
def coverage_hash(spark, d):
    return C.coverage_hash(CATALOG.bucket_map(spark))


@query(
    "config_history_join",
    "with h as (select * from (values (0, 2500, 'a'), (2500, 6000, 'b'), (6000, null, 'c')) t(s, e, config)) select event_id, config from events left join h on s <= event_id and (e is null or e > event_id)",
)
def config_history_join(spark, d):
    h = spark.createDataFrame([(0, 2500, "a"), (2500, 6000, "b"), (6000, None, "c")], "start_seq long, end_seq long, config string")
    return C.history_at(load(spark, d, "events"), h, "event_id").select("event_id", "config")


# -- movement --------------------------------------------------------------------------------------

OWNED = "select * from orders_r where o_orderkey % 10 <> 0"


@query("unattributed_count", RO + "select count(*) as n from orders_r where o_orderkey % 10 = 0")
def unattributed_count(spark, d):
    rows = routed(spark, d, "orders", CATALOG)
    return V.unattributed(rows, rows.where("o_orderkey % 10 <> 0")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "provenance_backfill",
    RO + f", t as (select 't' || i as tenant from range(16) u(i)), m as (select pk, shard, t.tenant as cand from orders_r left join t on 'shard-' || (({fnv("t.tenant || ':orders:' || pk")} % 1024) % 8) = shard where o_orderkey % 10 = 0), "
    "g as (select pk, count(cand) as candidates, min(cand) as one from m group by pk) select pk, candidates, case when candidates = 0 then 'orphaned' when candidates = 1 then 'attributed' else 'ambiguous' end as verdict, case when candidates = 1 then one end as tenant from g",
)
def provenance_backfill(spark, d):
    rows = routed(spark, d, "orders", CATALOG)
    lost = V.unattributed(rows, rows.where("o_orderkey % 10 <> 0"))
    return V.attribute(lost, CATALOG, spark.range(16).select(F.concat(F.lit("t"), "id").alias("tenant")), "orders")


@query("vbucket_export_page", RO + "select pk, tenant, o_totalprice from orders_r where vbucket = 77 and pk > '3' order by pk limit 500")
def vbucket_export_page(spark, d):
    return names(V.export_page(routed(spark, d, "orders", CATALOG), 77, "3")).select("pk", "tenant", "o_totalprice")


@query(
    "vbucket_import",
    RO + ", a as (select pk, o_totalprice as v, 1 as version, 0 as src from orders_r where vbucket < 40 union all select pk, o_totalprice + 1, case when o_orderkey % 2 = 0 then 2 else 0 end, 1 from orders_r where vbucket between 20 and 60) "
    "select pk, v, version from (select *, row_number() over (partition by pk order by version desc, src desc) as rn from a) where rn = 1",
)
def vbucket_import(spark, d):
    rows = routed(spark, d, "orders", CATALOG)
    a = rows.where(F.col(BUCKET) < 40).select(KEY, F.col("o_totalprice").alias("v"), F.lit(1).alias("version"))
    b = rows.where(F.col(BUCKET).between(20, 60)).select(KEY, (F.col("o_totalprice") + 1).alias("v"), F.when(F.col("o_orderkey") % 2 == 0, 2).otherwise(0).alias("version"))
    return names(V.import_rows(a, b, "version"))


@query("vbucket_tables", RO + ", " + routed_sql("customer") + " select distinct 'orders' as table_name from orders_r where vbucket = 77 union select distinct 'customer' from customer_r where vbucket = 77")
def vbucket_tables(spark, d):
    t = [routed(spark, d, t, CATALOG).where(F.col(BUCKET) == 77).select(F.lit(t).alias("table_name")).distinct() for t in ("orders", "customer")]
    return C.union_all(t)


CONTENT = """'{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}'"""


def checksum_sql(rows: str, by: str) -> str:
    return (
        f"pg as (select {by}, pk, {CONTENT} as c, (row_number() over (partition by {by} order by pk) - 1) // 500 as p from {rows}), "
        f"pd as (select {by}, p, count(*) as n, sha256(string_agg(c, '' order by pk)) as d from pg group by {by}, p), "
        f"cs as (select {by}, sum(n)::bigint as row_count, sha256(string_agg(d, '' order by p)) as checksum from pd group by {by})"
    )


def _content(rows):
    kinds = dict(rows.dtypes)
    return H.json_object({c: (F.col(c), kinds[c]) for c in ("o_orderkey", "o_custkey", "o_orderstatus")})


@query("vbucket_checksum", RO + ", " + checksum_sql("orders_r", "vbucket") + " select vbucket, row_count, checksum from cs")
def vbucket_checksum(spark, d):
    rows = routed(spark, d, "orders", CATALOG)
    return V.bucket_checksums(rows, [BUCKET], KEY, _content(rows)).withColumnRenamed(BUCKET, "vbucket")


@query("shard_checksum", RO + ", " + checksum_sql("orders_r", "shard") + " select shard, row_count, checksum from cs")
def shard_checksum(spark, d):
    rows = routed(spark, d, "orders", CATALOG)
    return V.bucket_checksums(rows, [SHARD], KEY, _content(rows)).withColumnRenamed(SHARD, "shard")


@query(
    "checksum_compare",
    RO + ", c as (select vbucket, count(*) as n, count(*) filter (o_orderkey % 997 <> 0) as m from orders_r group by vbucket) select vbucket, n as source_count, case when m > 0 then m end as target_count, n = m as same from c",
)
def checksum_compare(spark, d):
    rows = routed(spark, d, "orders", CATALOG)
    copy = rows.where("o_orderkey % 997 <> 0")
    a, b = (V.bucket_checksums(x, [BUCKET], KEY, _content(x)) for x in (rows, copy))
    return V.compare_checksums(a, b, BUCKET).withColumnRenamed(BUCKET, "vbucket")


@query("migrate_vbucket", RO + "select pk, vbucket, case when vbucket = 77 then 'shard-2' else shard end as shard from orders_r")
def migrate_vbucket(spark, d):
    return names(V.migrate(routed(spark, d, "orders", CATALOG), 77, "shard-2")).select("pk", "vbucket", "shard")


@query(
    "drain_shard",
    "with " + MAP + ", o as (select ['shard-0','shard-1','shard-2','shard-4','shard-5','shard-6','shard-7'] as ring) select vbucket, case when shard_id = 'shard-3' then ring[vbucket % 7 + 1] else shard_id end as shard_id, case when shard_id = 'shard-3' then 2 else 1 end as map_version, case when shard_id = 'shard-3' then 'shard-3' end as moved_from from map, o",
)
def drain_shard(spark, d):
    return C.drain_targets(CATALOG.bucket_map(spark), "shard-3", CATALOG.active())


@query("split_vbucket", "with " + MAP + " select vbucket, case when vbucket = 500 then 'shard-8' else shard_id end as shard_id, case when vbucket = 500 then 2 else 1 end as map_version from map")
def split_vbucket(spark, d):
    return C.move_bucket(CATALOG.bucket_map(spark), 500, "shard-8").drop("status")


@query(
    "drain_progress",
    "with " + MAP + ", i as (select 'idx' || n_nationkey as index_name, n_nationkey as k from nation) select (select count(*) from map where shard_id = 'shard-3') as vbuckets_remaining, (select count(*) from i where k % 2 = 0 or k % 3 = 0) as rings_remaining",
)
def drain_progress(spark, d):
    n = load(spark, d, "nation").select(F.concat(F.lit("idx"), "n_nationkey").alias("index_name"), F.col("n_nationkey").alias("k"))
    rings = n.select("index_name", F.when(F.col("k") % 2 == 0, F.array(F.lit("shard-1"), F.lit("shard-3"))).otherwise(F.array(F.lit("shard-1"))).alias("ring"))
    flight = n.where("k % 3 = 0").select("index_name", F.lit("shard-3").alias("shard_id"))
    return V.drain_progress(CATALOG.bucket_map(spark), rings, flight, "shard-3")


@query(
    "ring_difference",
    f"with i as (select 'idx' || n_nationkey as index_name, case when n_nationkey % 2 = 0 then ['shard-0','shard-3'] else ['shard-1','shard-2'] end as ring from nation), f as (select index_name, ring, s from i, unnest([{SHARDS}]) u(s) where not list_contains(ring, s) and s <> 'shard-3'), "
    f"b as (select index_name, arg_min(s, ({fnv("index_name || ':' || s")}, s)) as sub from f group by index_name) select index_name, case when list_contains(ring, 'shard-3') then sub end as substitute, array_to_string(case when list_contains(ring, 'shard-3') then ['shard-0', sub] else ring end, ',') as ring from i join b using (index_name)",
)
def ring_difference(spark, d):
    k = F.col("n_nationkey")
    rings = load(spark, d, "nation").select(
        F.concat(F.lit("idx"), "n_nationkey").alias("index_name"), F.when(k % 2 == 0, F.array(F.lit("shard-0"), F.lit("shard-3"))).otherwise(F.array(F.lit("shard-1"), F.lit("shard-2"))).alias("ring")
    )
    out = C.evacuate_rings(rings, "shard-3", [s for s in CATALOG.active() if s != "shard-3"])
    return out.withColumn("ring", F.array_join("ring", ","))


@query("table_intersection", "select r_name as name from region intersect select upper(n_name) from nation union all (select distinct c_mktsegment from customer except select 'BUILDING')")
def table_intersection(spark, d):
    regions = load(spark, d, "region").select(F.col("r_name").alias("name"))
    nations = load(spark, d, "nation").select(F.upper("n_name").alias("name"))
    segments = load(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    return regions.intersect(nations).unionByName(segments.subtract(spark.createDataFrame([("BUILDING",)], "name string")))


# -- writes ----------------------------------------------------------------------------------------


def _new_customers(spark, d):
    c = load(spark, d, "customer")
    return c.where("c_custkey % 5 = 0").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 10 == 0, 0).otherwise(10_000_000)).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"))


NEW = "n as (select c_custkey + case when c_custkey % 10 = 0 then 0 else 10000000 end as c_custkey, 'new' as c_name, null::double as c_acctbal from customer where c_custkey % 5 = 0)"


@query("mutation_insert", f"with {NEW} select c_custkey, c_name, c_acctbal, false as inserted from customer union all select c_custkey, c_name, c_acctbal, true from n where c_custkey not in (select c_custkey from customer)")
def mutation_insert(spark, d):
    return M.insert_rows(load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), _new_customers(spark, d), "c_custkey")


@query("mutation_update", f"with {NEW} select c.c_custkey, case when n.c_custkey is not null and c.c_acctbal > 0 then n.c_name else c.c_name end as c_name, case when n.c_custkey is not null and c.c_acctbal > 0 then n.c_acctbal else c.c_acctbal end as c_acctbal from customer c left join n on c.c_custkey = n.c_custkey")
def mutation_update(spark, d):
    return M.update_rows(load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), _new_customers(spark, d), "c_custkey", ["c_name", "c_acctbal"], "b.c_acctbal > 0")


@query("mutation_upsert", f"with {NEW} select coalesce(n.c_custkey, c.c_custkey) as c_custkey, c.c_name, case when n.c_custkey is not null then n.c_acctbal else c.c_acctbal end as c_acctbal from customer c full outer join n on c.c_custkey = n.c_custkey")
def mutation_upsert(spark, d):
    return M.upsert_rows(load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), _new_customers(spark, d), "c_custkey", ["c_acctbal"])


@query("mutation_delete", f"with {NEW} select c_custkey, c_name from customer where c_custkey not in (select c_custkey from n)")
def mutation_delete(spark, d):
    return M.delete_rows(load(spark, d, "customer").select("c_custkey", "c_name"), _new_customers(spark, d), "c_custkey")


@query(
    "index_deltas",
    "with b as (select c_custkey::varchar as pk, '[\"' || c_mktsegment || '\"]' as j, c_custkey as k from customer), a as (select pk, case when k % 7 = 0 then '[\"X\"]' else j end as j from b where k % 11 <> 0) select pk, b.j as old_key_json, a.j as new_key_json from b full outer join a using (pk) where b.j is distinct from a.j",
)
def index_deltas(spark, d):
    before = load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_mktsegment", F.col("c_custkey").alias("k"))
    after = before.where("k % 11 <> 0").withColumn("c_mktsegment", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("c_mktsegment")))
    return M.index_deltas(before, after, "key", H.json_array([(F.col("c_mktsegment"), "string")]))


def _requests(spark, d):
    e = load(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("r"), F.col("event_id") % 4000).alias("request_id"), F.when(F.col("event_id") % 3 == 0, "h1").otherwise("h0").alias("request_hash"))


REQ = "with q as (select event_id as seq, 'r' || (event_id % 4000) as request_id, case when event_id % 3 = 0 then 'h1' else 'h0' end as request_hash from events)"


@query("idempotent_replay", REQ + ", w as (select *, first_value(request_hash) over (partition by request_id order by seq) as f, row_number() over (partition by request_id order by seq) as rn from q) select seq, request_id, request_hash, case when rn = 1 then 'applied' when request_hash = f then 'replayed' else 'conflict' end as outcome from w")
def idempotent_replay(spark, d):
    return M.replay_outcomes(_requests(spark, d))


@query("replay_conflicts", REQ + " select request_id, count(distinct request_hash) as hashes, count(*) as attempts from q group by request_id having count(distinct request_hash) > 1")
def replay_conflicts(spark, d):
    return M.replay_conflicts(_requests(spark, d))


@query("first_requests", REQ + " select arg_min(seq, seq) as seq, request_id, arg_min(request_hash, seq) as request_hash from q group by request_id")
def first_requests(spark, d):
    return M.first_requests(_requests(spark, d))


@query(
    "mutation_fold",
    "with b as (select c_custkey::varchar as pk, c_custkey as k, c_mktsegment as seg from customer) select pk, case when k % 3 = 1 then false else true end as live, case when k % 3 = 0 then 'gold' when k % 3 = 1 then null else seg end as seg, "
    "case when k % 3 = 0 then 'n1' when k % 3 = 1 then null end as note, case when k % 3 = 0 then 2 when k % 3 = 1 then 1 else 0 end::bigint as touched, case when k % 3 = 2 then 1 else 0 end::bigint as failed from b "
    "union all select 'new' || k, true, 'x', null, 1, 0 from b where k % 100 = 0",
)
def mutation_fold(spark, d):
    k = F.col("c_custkey")
    c = load(spark, d, "customer")
    base = c.select(k.cast("string").alias("pk"), F.create_map(F.lit("seg"), "c_mktsegment").alias("row"))
    no = F.lit(None).cast("map<string,string>")
    row = lambda df, seq, op, where, values, pk=k.cast("string"): df.select(F.lit(seq).alias("seq"), F.lit(op).alias("op"), pk.alias("pk"), where.alias("where"), values.alias("values"))
    log = [
        row(c.where(k % 3 == 0), 1, "update", F.create_map(F.lit("seg"), "c_mktsegment"), F.create_map(F.lit("seg"), F.lit("gold"))),
        row(c.where(k % 3 == 0), 2, "upsert", no, F.create_map(F.lit("note"), F.lit("n1"))),
        row(c.where(k % 3 == 0), 3, "update", F.create_map(F.lit("seg"), F.lit("silver")), F.create_map(F.lit("seg"), F.lit("lead"))),
        row(c.where(k % 3 == 1), 4, "delete", no, no),
        row(c.where(k % 3 == 1), 5, "update", no, F.create_map(F.lit("seg"), F.lit("ghost"))),
        row(c.where(k % 3 == 2), 6, "insert", no, F.create_map(F.lit("seg"), F.lit("dup"))),
        row(c.where(k % 100 == 0), 7, "insert", no, F.create_map(F.lit("seg"), F.lit("x")), F.concat(F.lit("new"), k.cast("string"))),
    ]
    out = M.fold_log(base, C.union_all(log))
    return out.select("pk", "live", F.col("row")["seg"].alias("seg"), F.col("row")["note"].alias("note"), "touched", "failed")


@query("tx_atomic_batch", "with g as (select l_orderkey from lineitem group by l_orderkey having count(distinct l_partkey) <= 8 and bool_and(l_quantity < 49)) select l_orderkey as tx, l_partkey::varchar as pk from lineitem where l_orderkey in (select l_orderkey from g)")
def tx_atomic_batch(spark, d):
    l = load(spark, d, "lineitem")
    log = l.select(F.col("l_orderkey").alias("tx"), F.col("l_partkey").cast("string").alias("pk"), F.lit("r").alias("request_id"))
    guards = l.select(F.col("l_orderkey").alias("tx"), (F.col("l_quantity") < 49).alias("ok"))
    return M.atomic_batches(log, guards).drop("request_id")


@query(
    "tx_guard_mismatch",
    "with g as (select o_orderkey // 8 as tx, o_orderkey as step, o_custkey as pk, case when o_orderkey % 50 = 0 then 'NONE' else c_mktsegment end as expected from orders left join customer on o_custkey = c_custkey) "
    "select tx, min(case when c.c_mktsegment = expected then null else step end) as first_mismatch, min(case when c.c_mktsegment = expected then null else step end) is null as committed from g left join customer c on g.pk = c.c_custkey group by tx",
)
def tx_guard_mismatch(spark, d):
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    g = o.join(c, o.o_custkey == c.c_custkey, "left").select(F.floor(F.col("o_orderkey") / 8).alias("tx"), F.col("o_orderkey").alias("step"), F.col("o_custkey").alias("pk"), F.when(F.col("o_orderkey") % 50 == 0, "NONE").otherwise(F.col("c_mktsegment")).alias("expected"))
    return M.guard_results(c, g, "c_custkey", "c_mktsegment")


STATES = ("new", "preparing", "prepared", "commit_decided", "manifest_registered", "committing", "committed")


@query(
    "tx_transition_check",
    "with s as (select event_id, [" + ",".join(f"'{s}'" for s in STATES) + "][(event_id * 7 % 11 % 7)::int + 1] as state, event_id % 900 as tx from events), t as (select tx, event_id as seq, state, lag(state) over (partition by tx order by event_id) as src from s), "
    "ok as (select unnest([" + ",".join(f"('{a}','{b}')" for a, bs in M.TRANSITIONS.items() for b in bs) + "]) as p) "
    "select tx, seq, src as from_state, state as to_state, src = state or (src, state) in (select (p[1], p[2]) from ok) as allowed from t where src is not null",
)
def tx_transition_check(spark, d):
    names_ = F.array(*(F.lit(s) for s in STATES))
    e = load(spark, d, "events").select((F.col("event_id") % 900).alias("tx"), F.col("event_id").alias("seq"), F.element_at(names_, (F.col("event_id") * 7 % 11 % 7 + 1).cast("int")).alias("state"))
    return M.transition_check(e)


@query("fence_rejections", RO + "select pk, vbucket, vbucket in (5, 77, 900) as rejected from orders_r")
def fence_rejections(spark, d):
    rows = names(routed(spark, d, "orders", CATALOG)).select("pk", "vbucket")
    return M.fenced(rows, spark.createDataFrame([(5,), (77,), (900,)], "vbucket int"))


@query("lock_conflicts", "with l as (select event_id as tx, user_id as pk, event_id as from_seq, event_id + 300 as to_seq from events), w as (select *, max(to_seq) over (partition by pk order by from_seq, tx rows between unbounded preceding and 1 preceding) as held_to from l) select * from w where held_to >= from_seq")
def lock_conflicts(spark, d):
    e = load(spark, d, "events")
    return M.lock_conflicts(e.select(F.col("event_id").alias("tx"), F.col("user_id").alias("pk"), F.col("event_id").alias("from_seq"), (F.col("event_id") + 300).alias("to_seq")))


# -- ledgers ---------------------------------------------------------------------------------------

CUT = "2024-01-15 00:00:00"
CUT_MS = 1705276800000


def _log(spark, d):
    e = ts_events(spark, d).withColumn("decided_ms", S.epoch_ms(F.col("ts")))
    return e.select(
        F.concat(F.lit("tx"), "event_id").alias("tx_id"), F.col("event_id").alias("sequence"), "decided_ms", F.when(F.col("event_type") == "error", "CANCELLED").otherwise("FINALIZED").alias("state"), "ts", "event_type", "user_id", "value"
    )


LOG = "with log as (select 'tx' || event_id as tx_id, event_id as sequence, (epoch_us(ts) // 1000) as decided_ms, case when event_type = 'error' then 'CANCELLED' else 'FINALIZED' end as state, ts, event_type, user_id, value from events)"


@query("asof_restore", LOG + f" select user_id, arg_max(event_type, (decided_ms, sequence)) as event_type, arg_max(value, (decided_ms, sequence)) as value, arg_max(sequence, (decided_ms, sequence)) as sequence from log where decided_ms <= {CUT_MS} group by user_id")
def asof_restore(spark, d):
    return L.as_of(_log(spark, d).select("user_id", "event_type", "value", "sequence", "decided_ms"), "user_id", ["decided_ms", "sequence"], "decided_ms", CUT_MS).drop("decided_ms")


@query("loss_window", LOG + f", w as (select tx_id, sequence, decided_ms from log where decided_ms > {CUT_MS} and decided_ms <= {CUT_MS + 86_400_000} order by sequence) select tx_id, sequence, (select count(*) from w) <= 100 as complete from w order by sequence limit 100")
def loss_window(spark, d):
    return L.loss_window(_log(spark, d).select("tx_id", "sequence", "decided_ms"), "decided_ms", CUT_MS, CUT_MS + 86_400_000, "sequence").drop("decided_ms")


def seal_sql(by: str, order: str, ident: str) -> str:
    return (
        f"sp as (select {by}, {order} as o, {ident}::varchar as i, row_number() over (partition by {by} order by {order}) as rn from src), sq as (select {by}, (rn - 1) // 500 as p, count(*) as n, min(o) as f, max(o) as l, sha256(string_agg(i, ',' order by rn)) as d from sp group by {by}, p), "
        f"sealed as (select {by}, sum(n)::bigint as records, min(f) as first, max(l) as last, sha256(string_agg(d, '' order by p)) as digest from sq group by {by})"
    )


@query("loss_digest", LOG + f", src as (select user_id % 8 as participant, sha256(tx_id) as h from log where decided_ms > {CUT_MS}), " + seal_sql("participant", "h", "h") + " select participant, records as n, digest from sealed")
def loss_digest(spark, d):
    lost = _log(spark, d).where(F.col("decided_ms") > CUT_MS).select((F.col("user_id") % 8).alias("participant"), F.sha2("tx_id", 256).alias("h"))
    return L.loss_digest(lost, ["participant"], "h")


@query("rpo_rto", LOG + f" select greatest(max(decided_ms) - {CUT_MS}, 0)::bigint as rpo_ms, 34465::bigint as rto_ms from log")
def rpo_rto(spark, d):
    return L.rpo_rto(_log(spark, d), "decided_ms", CUT_MS, CUT_MS, CUT_MS + 34_465)


@query("manifest_page", LOG + f" select tx_id, sequence, decided_ms from log where decided_ms between 1704067200000 and {CUT_MS} and (decided_ms, sequence, tx_id) > (1704500000000, 0, '') order by decided_ms, sequence, tx_id limit 200")
def manifest_page(spark, d):
    return L.manifest_page(_log(spark, d), 1704067200000, CUT_MS, (1704500000000, 0, ""), 200).select("tx_id", "sequence", "decided_ms")


@query("manifest_members", LOG + f" select tx_id, sequence from log where state = 'FINALIZED' and decided_ms <= {CUT_MS}")
def manifest_members(spark, d):
    return L.members(_log(spark, d), CUT_MS).select("tx_id", "sequence")


@query(
    "daily_seal",
    LOG + ", src as (select strftime(ts, '%Y-%m-%d') as utc_day, sequence, tx_id from log where state = 'FINALIZED'), " + seal_sql("utc_day", "sequence", "tx_id") + " select utc_day, records, first, last, digest from sealed",
)
def daily_seal(spark, d):
    rows = _log(spark, d).where("state = 'FINALIZED'").withColumn("utc_day", F.date_format("ts", "yyyy-MM-dd"))
    return L.seal(rows, ["utc_day"], ["sequence"], "tx_id")


@query(
    "fleet_root",
    LOG + ", src as (select strftime(ts, '%Y-%m-%d') as utc_day, sequence, tx_id from log where state = 'FINALIZED'), " + seal_sql("utc_day", "sequence", "tx_id") + " select count(*) as receipts, sum(records)::bigint as records, sha256(string_agg(digest, '' order by utc_day)) as root from sealed",
)
def fleet_root(spark, d):
    return L.root_digest(daily_seal(spark, d), ["utc_day"])


@query(
    "fleet_enumeration",
    LOG + f", b as (select strftime(ts, '%Y-%m-%d') as utc_day, (('0x' || right(sha256(tx_id), 2))::int % 16)::int as bucket, decided_ms from log), r as (select utc_day, bucket, count(*) as records from b where decided_ms <= {CUT_MS} group by all), "
    f"s as (select utc_day, bucket, max(decided_ms) as sealed_through from b where bucket < 8 group by all) select utc_day, bucket, records, sealed_through, coalesce(sealed_through >= least({CUT_MS}, epoch_ms(utc_day::timestamp) + 86400000 - 1), false) as complete from r left join s using (utc_day, bucket)",
)
def fleet_enumeration(spark, d):
    rows = L.bucketed(_log(spark, d), "tx_id", "ts")
    seals = rows.where("bucket < 8").select("utc_day", "bucket", F.col("decided_ms").alias("sealed_through"))
    return L.enumerate_fleet(rows, seals, CUT_MS)


@query(
    "decision_stamps",
    LOG + ", b as (select user_id, sequence, row_number() over (partition by user_id order by sequence) as rn, greatest(decided_ms // 86400000, 19730 + 1) as n from log) select user_id, sequence, max(n - rn) over (partition by user_id order by sequence) + rn as assigned_ms from b",
)
def decision_stamps(spark, d):
    rows = _log(spark, d).select("user_id", "sequence", F.floor(F.col("decided_ms") / 86_400_000).alias("now"))
    return L.stamp(rows, ["user_id"], "sequence", "now", 19_730).drop("now")


@query(
    "quarantine_split",
    LOG + f", q as (select 'g' || (sequence // 3) as tx_id, sequence, decided_ms, case when sequence % 10 = 0 then 'x' else 'y' end as content_hash from log), c as (select *, count(distinct content_hash) over (partition by tx_id) > 1 as conflict from q) select sequence, case when conflict then 'conflict' when decided_ms <= {CUT_MS} then 'late' else 'main' end as lane from c",
)
def quarantine_split(spark, d):
    rows = _log(spark, d).select(F.concat(F.lit("g"), F.floor(F.col("sequence") / 3).cast("string")).alias("tx_id"), "sequence", "decided_ms", F.when(F.col("sequence") % 10 == 0, "x").otherwise("y").alias("content_hash"))
    return L.quarantine_split(rows, F.lit(CUT_MS)).select("sequence", "lane")


@query("manifest_lifecycle", "with e as (select 'm' || (event_id % 3000) as tx_id, event_id as seq, event_type as state from events) select tx_id, arg_max(state, seq) as state, count(*) as n_events, max(seq) as last_seq from e group by tx_id")
def manifest_lifecycle(spark, d):
    e = load(spark, d, "events")
    return L.lifecycle(e.select(F.concat(F.lit("m"), F.col("event_id") % 3000).alias("tx_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state")))


@query("retention_gc", LOG + f" select tx_id from log where decided_ms + 604800000 <= {CUT_MS} and user_id % 5 <> 0")
def retention_gc(spark, d):
    rows = _log(spark, d).withColumn("expires_ms", F.col("decided_ms") + 604_800_000)
    leases = rows.where("user_id % 5 = 0").select("tx_id", F.lit(CUT_MS + 1).alias("lease_until_ms"))
    return L.expired(rows, leases, CUT_MS).select("tx_id")


@query("restore_redo", LOG + f" select tx_id, sequence from log where decided_ms <= {CUT_MS} and (sequence % 6 <> 0 or state = 'FINALIZED')")
def restore_redo(spark, d):
    full = _log(spark, d).select("tx_id", "sequence", "decided_ms", "state")
    return L.redo(full, full.where("sequence % 6 <> 0"), full, CUT_MS).select("tx_id", "sequence")


# -- workload --------------------------------------------------------------------------------------


@query(
    "latency_report",
    "select event_type as type, count(*) as n, count(*) filter (value >= 10) as ok, count(*) filter (value < 10) as err, quantile_disc(value, 0.5) filter (value >= 10) as p50, quantile_disc(value, 0.95) filter (value >= 10) as p95, quantile_disc(value, 0.99) filter (value >= 10) as p99 from events group by event_type",
)
def latency_report(spark, d):
    return K.latency_report(load(spark, d, "events"), "event_type", "value", F.col("value") >= 10)


@query("op_histogram", "select event_type as name, count(*) as n from events group by event_type")
def op_histogram(spark, d):
    return K.histogram(load(spark, d, "events"), "event_type")


OUTCOME = "case when event_type = 'error' then 'failure' when value > 90 then 'timeout' else 'success' end"


@query("outcome_reconcile", f"with a as (select {OUTCOME} as o from events) select count(*) as attempted, count(*) filter (o = 'success') as success, count(*) filter (o = 'failure') as failure, count(*) filter (o = 'timeout') as timeout, true as balanced from a")
def outcome_reconcile(spark, d):
    return K.reconcile(load(spark, d, "events").withColumn("outcome", F.expr(OUTCOME)), "outcome")


@query("throughput", "with a as (select count(*) filter (event_type <> 'error') as ok, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as elapsed_s from events) select ok, elapsed_s, round(ok / elapsed_s, 6) as per_second, round(ok / elapsed_s * 60, 6) as per_minute from a")
def throughput(spark, d):
    return K.throughput(ts_events(spark, d), F.col("event_type") != "error", "ts")


@query("latest_order_per_customer", "select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, max(o_orderdate) as o_orderdate, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as o_orderstatus from orders group by o_custkey")
def latest_order_per_customer(spark, d):
    return K.latest_orders(load(spark, d, "orders"))


@query("order_status", "with l as (select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by o_custkey) select o_custkey, o_orderkey, count(l_orderkey) as lines, sum(l_extendedprice::decimal(18,2))::double as amount from l left join lineitem on o_orderkey = l_orderkey group by all")
def order_status(spark, d):
    return K.order_status(load(spark, d, "orders"), load(spark, d, "lineitem"))


@query("oldest_open_order", "select o_custkey % 10 as district, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, min(o_orderdate) as o_orderdate from orders where o_orderstatus = 'O' group by district")
def oldest_open_order(spark, d):
    return K.oldest_open(load(spark, d, "orders"), F.col("o_custkey") % 10)


@query("delivery_sum", "with f as (select o_custkey % 10 as district, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders where o_orderstatus = 'O' group by district) select district, o_orderkey, count(l_orderkey) as lines, coalesce(sum(l_extendedprice::decimal(18,2)), 0)::double as amount from f left join lineitem on o_orderkey = l_orderkey group by all")
def delivery_sum(spark, d):
    return K.delivery_sum(load(spark, d, "orders"), load(spark, d, "lineitem"), F.col("o_custkey") % 10)


@query("stock_level", "with r as (select o_custkey % 10 as district, o_orderkey, row_number() over (partition by o_custkey % 10 order by o_orderdate desc, o_orderkey desc) as rn from orders) select district, count(distinct l_partkey) as low_parts from r join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey where rn <= 20 and p_retailprice < 1200 group by district")
def stock_level(spark, d):
    return K.stock_level(load(spark, d, "orders"), load(spark, d, "lineitem"), load(spark, d, "part"), F.col("o_custkey") % 10, 20, 1200)


@query("payment_totals", "select user_id, count(*) as payments, sum(value::decimal(18,4))::double as paid from events where event_type = 'purchase' group by user_id")
def payment_totals(spark, d):
    return K.payments(load(spark, d, "events").where("event_type = 'purchase'"), "value", "user_id")


@query(
    "new_order_log",
    "select 'no-' || o_orderkey as tx, 0 as step, 'insert' as op, 'orders' as table_name, o_orderkey::varchar as pk from orders union all "
    "select 'no-' || l_orderkey, n::int, 'insert', 'lineitem', l_orderkey || ':' || n from (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n from lineitem)",
)
def new_order_log(spark, d):
    return K.new_order_log(load(spark, d, "orders"), load(spark, d, "lineitem"))


@query("lost_writes", "with a as (select user_id, arg_max(event_type, event_id) as expected from events group by user_id), s as (select user_id, case when user_id % 50 = 0 then 'gone' else expected end as actual from a where user_id % 40 <> 0) select count(*) as checked, count(*) filter (expected is distinct from actual) as lost, count(*) filter (expected is distinct from actual) > 0 as red from a left join s using (user_id)")
def lost_writes(spark, d):
    e = load(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("seq"))
    state = e.groupBy("user_id").agg(F.max_by("event_type", "seq").alias("event_type")).where("user_id % 40 <> 0").withColumn("event_type", F.when(F.col("user_id") % 50 == 0, "gone").otherwise(F.col("event_type")))
    return K.lost_writes(e, state, "user_id", "event_type")


@query("migration_phase", "select 'cutover' as phase, 1000020::bigint as oldest_cutover_ms")
def migration_phase(spark, d):
    b = CATALOG.bucket_map(spark).withColumn("status", F.when(F.col("vbucket").isin(20, 300), "cutover").when(F.col("vbucket") == 7, "backfilling").otherwise("active")).withColumn("cutover_ms", F.lit(1_000_000).cast("bigint") + F.col("vbucket"))
    return K.migration_phase(b)


@query("chaos_verdicts", "select event_id, case event_id % 4 when 1 then 'survived' when 2 then 'double_write' when 0 then 'no_effect' else 'inconclusive' end as double_submit, case when event_id % 4 = 1 and event_id % 5 <> 0 then 'survived' when event_id % 4 in (2, 3) and event_id % 5 <> 0 then 'inconclusive' else 'broken' end as replay from events")
def chaos_verdicts(spark, d):
    o, f = F.lit(100).cast("bigint"), 100 - F.col("event_id") % 4
    return load(spark, d, "events").select("event_id", K.judge_double_submit(o, f).alias("double_submit"), K.judge_replay(o, f, F.col("event_id") % 5 != 0).alias("replay"))


@query("join_orders_lines_parts", "select p_brand, count(*) as n, sum(l_quantity::decimal(18,2))::double as qty from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey where o_orderstatus = 'F' group by p_brand")
def join_orders_lines_parts(spark, d):
    o, l, p = (load(spark, d, t) for t in ("orders", "lineitem", "part"))
    j = o.where("o_orderstatus = 'F'").join(l, o.o_orderkey == l.l_orderkey).join(p, l.l_partkey == p.p_partkey)
    return j.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"))


# -- scalar functions ------------------------------------------------------------------------------


@query(
    "scalar_functions",
    "select event_id, lpad((user_id % 100)::varchar, 4, '0') || ':' || lpad(event_id::varchar, 8, '0') as padded, round(value, 2) as rounded, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::varchar, 3, '0') || 'Z' as iso, "
    "least(60000, 1000 * 2 ** (event_id % 12))::bigint as backoff_ms, greatest(1, least(256, user_id - 50)) as clamped, base64(event_type::blob) as b64, '\"' || replace(event_type, '\"', '\"\"') || '\"' as quoted, case when event_id % 2 = 0 then null else greatest(event_id, user_id) end as max2 from events",
)
def scalar_functions(spark, d):
    e = ts_events(spark, d)
    half = F.when(F.col("event_id") % 2 != 0, F.col("event_id"))
    return e.select(
        "event_id",
        S.padded_key((F.col("user_id") % 100, 4), (F.col("event_id"), 8)).alias("padded"),
        F.round("value", 2).alias("rounded"),
        S.iso(F.col("ts")).alias("iso"),
        S.backoff_ms(F.col("event_id") % 12, 1000, 60_000).alias("backoff_ms"),
        S.clamp(F.col("user_id") - 50, 1, 256).alias("clamped"),
        S.base64_text(F.col("event_type")).alias("b64"),
        S.quote_identifier_col(F.col("event_type")).alias("quoted"),
        S.sql_max(half, F.col("user_id")).alias("max2"),
    )


@query("predicates", RO + "select pk, o_orderkey from orders_r where o_orderstatus in ('O', 'F') and o_orderpriority like '%-H_GH' and o_custkey is not null and o_totalprice between 1000 and 200000 and pk > '5' and (o_orderstatus, o_custkey) > ('F', 100)")
def predicates(spark, d):
    rows = routed(spark, d, "orders", CATALOG)
    where = F.col("o_orderstatus").isin("O", "F") & F.col("o_orderpriority").like("%-H_GH") & F.col("o_custkey").isNotNull() & F.col("o_totalprice").between(1000, 200000) & (F.col(KEY) > "5")
    return names(rows.where(where).where(R.tuple_after(["o_orderstatus", "o_custkey"], ["F", 100]))).select("pk", "o_orderkey")


STATEMENTS = (
    "SELECT 1",
    "  -- note\n INSERT INTO t VALUES (1)",
    "/* DELETE */ select * from t",
    "WITH a AS (SELECT ')' AS x) DELETE FROM \"My Table\" WHERE 1=1",
    "UPDATE OR IGNORE main.[Row_Locks] SET x = 1",
    "replace into `__cf_indexes` values (1)",
    "delete from a.b.c",
    "select 1; drop table t",
    "select 'drop' from t",
    "CREATE TABLE IF NOT EXISTS \"a\"\"b\" (id TEXT)",
    "select * from x join y",
)


@query("sql_guard")
def sql_guard(spark, d):
    rows = [(s, G.is_mutation(s), G.is_delete(s), G.write_target(s), G.writes_internal(s), G.is_dangerous(s), G.create_table_name(s), G.single_table(s)) for s in STATEMENTS]
    return spark.createDataFrame(rows, "sql string, mutation boolean, is_delete boolean, target string, internal boolean, dangerous boolean, creates string, reads string")


# -- stateful mechanisms ---------------------------------------------------------------------------


@query(
    "token_bucket",
    "with recursive e as (select 'u' || (user_id % 16) as tenant, epoch_us(ts) // 1000000 as t, row_number() over (partition by user_id % 16 order by epoch_us(ts) // 1000000, event_id) as rn from events), "
    f"s as (select distinct tenant, 0::bigint as rn, {T.CAPACITY}::double as tokens, null::bigint as last_t, 0::bigint as allowed, 0::bigint as limited from e union all "
    "select tenant, rn, case when have >= 1 then have - 1 else tokens end, case when have >= 1 then t else last_t end, allowed + (have >= 1)::int, limited + (have < 1)::int from ("
    f"select e.tenant, e.rn, e.t, s.tokens, s.last_t, s.allowed, s.limited, case when s.last_t is null then {T.CAPACITY}::double else least({T.CAPACITY}::double, s.tokens + greatest(0::double, (e.t - s.last_t)::double / 1000) * {T.REFILL}::double) end as have "
    "from s join e on e.tenant = s.tenant and e.rn = s.rn + 1) z) "
    "select tenant, max(allowed) as allowed, max(limited) as limited, round(arg_max(tokens, rn), 6) as tokens from s group by tenant",
)
def token_bucket(spark, d):
    e = ts_events(spark, d).withColumn("tenant", F.concat(F.lit("u"), F.col("user_id") % 16)).withColumn("at_ms", F.floor(S.epoch_ms(F.col("ts")) / 1000))
    return T.token_bucket(e, "tenant", "at_ms", "event_id")


@query(
    "circuit_breaker",
    "with recursive e as (select user_id % 16 as target, epoch_us(ts) // 1000 as t, event_type = 'error' as f, row_number() over (partition by user_id % 16 order by epoch_us(ts) // 1000, event_id) as rn from events), "
    "s as (select distinct target, 0::bigint as rn, 0 as fails, 0::bigint as since, 0::bigint as til, 0 as opens, 0::bigint as opened, 0::bigint as refused from e union all "
    "select target, rn, case when ref then fails when op or cl then 0 else nf end, case when ref then since when op or cl then 0 when inside then since else t end, "
    "case when ref then til when op then t + cool when cl then 0 else til end, case when ref then opens when op then opens + 1 when cl then 0 else opens end, opened + op::int, refused + ref::int from ("
    "select *, not ref and f and (probe or nf >= 3) as op, not ref and not f as cl from (select *, case when inside then fails + 1 else 1 end as nf from ("
    "select e.target, e.rn, e.t, e.f, s.fails, s.since, s.til, s.opens, s.opened, s.refused, s.til > e.t as ref, s.til <= e.t and s.til > 0 as probe, s.since > 0 and e.t - s.since <= 3600000 as inside, "
    "least(86400000, 3600000 * pow(2, least(s.opens, 10)))::bigint as cool from s join e on e.target = s.target and e.rn = s.rn + 1) a) b) c) "
    "select target, max(opened) as opened, max(refused) as refused, arg_max(til, rn) as open_until_ms from s group by target",
)
def circuit_breaker(spark, d):
    e = ts_events(spark, d).withColumns({"at_ms": S.epoch_ms(F.col("ts")), "failed": F.col("event_type") == "error", "target": F.col("user_id") % 16})
    return T.circuit_breaker(e, "target", "at_ms", "failed", 3, 3_600_000, 86_400_000, "event_id")


@query("stream_dedup", REQ + " select request_id, count(*) as n from (select request_id from q group by request_id) group by request_id")
def stream_dedup(spark, d):
    from shardloom.sources.tables import work_path

    s = T.event_stream(spark, f"{d}/events.parquet", load(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    s = s.withColumn("request_id", F.concat(F.lit("r"), F.col("event_id") % 4000))
    out = T.run_to_end(T.dedup_requests(s, days=None).select("request_id"), spark, work_path(spark, "dedup"), work_path(spark, "dedup-cp"))
    return out.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_daily_counts", "select strftime(ts, '%Y-%m-%d') as utc_day, event_type, count(*) as n from events group by all")
def stream_daily_counts(spark, d):
    from shardloom.sources.tables import work_path

    s = T.event_stream(spark, f"{d}/events.parquet", load(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = T.daily_counts(s, delay=None, by="event_type").select(F.date_format("window.start", "yyyy-MM-dd").alias("utc_day"), "event_type", "n")
    out = work_path(spark, "daily")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", work_path(spark, "daily-cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    return got.groupBy("utc_day", "event_type").agg(F.max_by("n", "batch").alias("n"))


def tables() -> dict[str, TableDef]:
    return FIXTURES


