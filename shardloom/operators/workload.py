"""The OLTP workload's reads and reports over tables, its generators, and the judges of its outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.functions.hashing import MASK32
from shardloom.plans.catalog import Catalog, newest

#: Operation mixes in percent, and the limits of the generators.
TPCC_MIX = (("new-order", 45), ("payment", 43), ("order-status", 4), ("delivery", 4), ("stock-level", 4))
OLTP_MIX = (("single-write", 55), ("paired-write", 30), ("bounded-read", 15))
MAX_TRIES = 20_000
GOLDEN = 0x9E3779B9


# -- generators ------------------------------------------------------------------------------------


def keys_on_shard(spark: SparkSession, catalog: Catalog, table: str, tenant: str, shard: str, count: int, prefix: str = "k", tries: int = MAX_TRIES) -> DataFrame:
    """The first `count` of at most `tries` candidate keys that route to one shard."""
    from shardloom.functions.hashing import vbucket

    c = spark.range(tries).select(F.col("id").alias("value"), F.concat(F.lit(prefix), F.col("id").cast("string")).alias("pk"))
    c = c.withColumn("vbucket", vbucket(F.lit(tenant), table, F.col("pk"), catalog.buckets))
    return c.where(catalog.shard_of(F.col("vbucket")) == shard).orderBy("value").limit(count)


def uniform_keys(spark: SparkSession, pool: int, count: int, prefix: str = "k", seed: int = 1) -> DataFrame:
    """`count` keys drawn evenly from a pool, by hash of the row number: the same for every run and partitioning."""
    return spark.range(count).select(F.concat(F.lit(prefix), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(pool)).cast("string")).alias("pk"))


def _uint32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK32))


def xorshift32(state: Column) -> Column:
    """The generator's next state, unsigned."""
    x = state.bitwiseXOR(_uint32(F.shiftleft(state, 13)))
    x = x.bitwiseXOR(F.shiftright(x, 17))
    return x.bitwiseXOR(_uint32(F.shiftleft(x, 5)))


def pick(share: Column, mix: tuple[tuple[str, int], ...]) -> Column:
    """The operation at a share (0 to 1) of the mix's cumulative weights."""
    total, upto, out = sum(w for _, w in mix), 0, None
    for name, w in mix:
        upto += w
        test = share * total < upto
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(mix[-1][0])


def operations(sequence: Column, seed: int, mix=OLTP_MIX) -> Column:
    """The operation of each sequence number: it depends on seed and number alone."""
    low = sequence.bitwiseAND(F.lit(MASK32))
    mixed = _uint32(F.lit(seed).cast("bigint").bitwiseXOR(_uint32(low * F.lit(GOLDEN))))
    state = F.when(mixed == 0, F.lit(1).cast("bigint")).otherwise(mixed)
    return pick(xorshift32(state) / F.lit(4294967296.0), mix)


def tpcc_tables(spark: SparkSession, warehouses: int = 2, districts: int = 10, customers: int = 100, items: int = 200) -> dict[str, DataFrame]:
    """Fixture tables of the workload, all by expression from row numbers."""
    u = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(10_000)) / 10_000.0
    wh = spark.range(1, warehouses + 1).select(F.col("id").alias("w_id"))
    di = wh.select("w_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(districts).cast("bigint"))).alias("d_id"))
    cu = di.select("w_id", "d_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(customers).cast("bigint"))).alias("c_id"))
    it = spark.range(1, items + 1).select(F.col("id").alias("i_id"))
    st = wh.select("w_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(items).cast("bigint"))).alias("i_id"))
    key = lambda *cols: F.concat_ws(":", *cols)
    return {
        "tpcc_warehouse": wh.select(key("w_id").alias("wh_key"), "w_id", F.round(u("w_id") * 0.2, 4).alias("w_tax"), F.lit(0.0).alias("w_ytd")),
        "tpcc_district": di.select(key("w_id", "d_id").alias("d_key"), "w_id", "d_id", F.round(u("w_id", "d_id") * 0.2, 4).alias("d_tax"), F.lit(0.0).alias("d_ytd"), F.lit(1).cast("bigint").alias("d_next_o_id")),
        "tpcc_customer": cu.select(key("w_id", "d_id", "c_id").alias("c_key"), "w_id", "d_id", "c_id", F.round(u("w_id", "d_id", "c_id") * 0.5, 4).alias("c_discount"), F.lit(-10.0).alias("c_balance")),
        "tpcc_item": it.select(key("i_id").alias("i_key"), "i_id", F.round(u("i_id") * 99 + 1, 2).alias("i_price")),
        "tpcc_stock": st.select(key("w_id", "i_id").alias("s_key"), "w_id", "i_id", (F.pmod(F.xxhash64("w_id", "i_id"), F.lit(91)) + 10).alias("s_quantity")),
    }


# -- reports ---------------------------------------------------------------------------------------


def latency_report(attempts: DataFrame, kind: str, latency: str, ok: Column) -> DataFrame:
    """(type, n, ok, err, p50, p95, p99): nearest-rank percentiles of successful attempts only."""
    lat = F.when(ok, F.col(latency))
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by _l)").alias(f"p{int(q * 100)}")
    rows = attempts.withColumn("_l", lat).withColumn("_ok", ok)
    return rows.groupBy(F.col(kind).alias("type")).agg(F.count(F.lit(1)).alias("n"), F.count_if("_ok").alias("ok"), F.count_if(~F.col("_ok")).alias("err"), p(0.5), p(0.95), p(0.99))


def histogram(attempts: DataFrame, by: str) -> DataFrame:
    return attempts.groupBy(F.col(by).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy("name")


def reconcile(attempts: DataFrame, outcome: str) -> DataFrame:
    """(attempted, success, failure, timeout, balanced)."""
    n = lambda v: F.count_if(F.col(outcome) == v).alias(v)
    out = attempts.agg(F.count(F.lit(1)).alias("attempted"), n("success"), n("failure"), n("timeout"))
    return out.withColumn("balanced", F.col("attempted") == F.col("success") + F.col("failure") + F.col("timeout"))


def throughput(attempts: DataFrame, ok: Column, ts: str) -> DataFrame:
    """(ok, elapsed_s, per_second, per_minute) over the time between the first and the last attempt."""
    e = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1e6
    out = attempts.agg(F.count_if(ok).alias("ok"), e.alias("elapsed_s"))
    rate = F.when(F.col("elapsed_s") > 0, F.col("ok") / F.col("elapsed_s"))
    return out.select("ok", "elapsed_s", F.round(rate, 6).alias("per_second"), F.round(rate * 60, 6).alias("per_minute"))


# -- reads of the transactions ---------------------------------------------------------------------


def latest_orders(orders: DataFrame) -> DataFrame:
    """The last order of each customer (order status): a map-side maximum, no window."""
    last = F.max_by(F.struct("o_orderkey", "o_orderdate", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("s")
    return orders.groupBy("o_custkey").agg(last).select("o_custkey", "s.*")


def order_status(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Line count and amount of each customer's last order."""
    last = latest_orders(orders)
    joined = last.join(lines, last.o_orderkey == lines.l_orderkey, "left")
    amount = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount")
    return joined.groupBy("o_custkey", "o_orderkey").agg(F.count("l_orderkey").alias("lines"), amount)


def oldest_open(orders: DataFrame, by: Column) -> DataFrame:
    """The oldest open order of each group (delivery)."""
    first = F.min_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("s")
    return orders.where("o_orderstatus = 'O'").groupBy(by.alias("district")).agg(first).select("district", "s.*")


def delivery_sum(orders: DataFrame, lines: DataFrame, by: Column) -> DataFrame:
    """The amount that delivering each group's oldest open order credits to its customer."""
    first = oldest_open(orders, by)
    amount = F.coalesce(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")), F.lit(0).cast("decimal(28,2)")).cast("double").alias("amount")
    return first.join(lines, first.o_orderkey == lines.l_orderkey, "left").groupBy("district", "o_orderkey").agg(F.count("l_orderkey").alias("lines"), amount)


def stock_level(orders: DataFrame, lines: DataFrame, parts: DataFrame, by: Column, last: int, threshold: float) -> DataFrame:
    """Per group: distinct parts in its last orders whose price is under a threshold."""
    recent = newest(orders.select(by.alias("district"), "o_orderkey", "o_orderdate"), ["district"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], last)
    low = parts.where(F.col("p_retailprice") < threshold).select("p_partkey")
    joined = recent.join(lines, recent.o_orderkey == lines.l_orderkey).join(low, lines.l_partkey == low.p_partkey)
    return joined.groupBy("district").agg(F.countDistinct("l_partkey").alias("low_parts"))


def payments(events: DataFrame, amount: str, by: str) -> DataFrame:
    """Totals that payments add to each account."""
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("payments"), F.sum(F.col(amount).cast("decimal(18,4)")).cast("double").alias("paid"))


def new_order_log(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """The mutation log that placing the orders writes: one header insert and one insert per line, as one transaction."""
    tx = lambda c: F.concat(F.lit("no-"), c.cast("string"))
    header = orders.select(tx(F.col("o_orderkey")).alias("tx"), F.lit(0).alias("step"), F.lit("insert").alias("op"), F.lit("orders").alias("table_name"), F.col("o_orderkey").cast("string").alias("pk"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = lines.withColumn("_n", F.row_number().over(w)).select(
        tx(F.col("l_orderkey")).alias("tx"), F.col("_n").alias("step"), F.lit("insert").alias("op"), F.lit("lineitem").alias("table_name"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("_n").cast("string")).alias("pk")
    )
    return header.unionByName(line)


# -- judges ----------------------------------------------------------------------------------------


def lost_writes(acked: DataFrame, state: DataFrame, key: str, column: str) -> DataFrame:
    """(checked, lost, red): the last acknowledged value of each key against what is read back; null equals null."""
    last = acked.groupBy(key).agg(F.max_by(column, "seq").alias("expected"))
    seen = last.alias("e").join(state.select(key, F.col(column).alias("actual"), F.lit(True).alias("there")).alias("s"), key, "left")
    lost = ~(F.coalesce("there", F.lit(False)) & F.col("expected").eqNullSafe(F.col("actual")))
    return seen.agg(F.count(F.lit(1)).alias("checked"), F.count_if(lost).alias("lost")).withColumn("red", F.col("lost") > 0)


def migration_phase(buckets: DataFrame) -> DataFrame:
    """(phase, oldest_cutover_ms): the most urgent status of all buckets."""
    rank = F.when(F.col("status") == "aborting", 3).when(F.col("status") == "cutover", 2).when(F.col("status") == "backfilling", 1).otherwise(0)
    top = buckets.agg(F.max(rank).alias("r"), F.min(F.when(F.col("status") == "cutover", F.col("cutover_ms"))).alias("oldest_cutover_ms"))
    return top.select(F.element_at(F.array(*(F.lit(x) for x in ("none", "backfilling", "cutover", "aborting"))), (F.coalesce("r", F.lit(0)) + 1).cast("int")).alias("phase"), "oldest_cutover_ms")


def verify_order(candidates: DataFrame) -> DataFrame:
    """Candidates with those on migrating buckets first, otherwise in their order."""
    return candidates.orderBy(F.col("is_migrating").desc(), "seq")


def hottest(counts: DataFrame, by: str, n: str = "n") -> DataFrame:
    """The target with the most rows, ties by name."""
    return counts.orderBy(F.col(n).desc(), by).limit(1)


def judge_double_submit(original: Column, final: Column) -> Column:
    """Verdict on one request sent twice: exactly one decrement is right."""
    d = original - final
    return F.when(d == 1, "survived").when(d == 2, "double_write").when(d == 0, "no_effect").otherwise("inconclusive")


def judge_replay(original: Column, final: Column, rejected: Column) -> Column:
    """Verdict on a request id reused for another write: it must be rejected and leave only the first write's effect."""
    moved = (final != original) & (final != original - 1)
    return F.when(rejected & (final == original - 1), "survived").when(rejected & moved, "inconclusive").otherwise("broken")
