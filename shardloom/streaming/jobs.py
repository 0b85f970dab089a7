"""Stateful mechanisms as Structured Streaming queries, with batch forms of the order-dependent ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Capacity and refill per second of a tenant's token bucket; days that request ids are remembered.
CAPACITY, REFILL, TTL_DAYS = 20.0, 2.0, 7


def event_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A table's files as a stream; the table is a folder, or a single file in one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        folder, _, name = path.rpartition("/")
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def dedup_requests(stream: DataFrame, key: str = "request_id", ts: str = "ts", days: int | None = TTL_DAYS) -> DataFrame:
    """The first row of each request id; ids are forgotten after `days`, so state is bounded by their rate. Without days none is forgotten."""
    if days is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, ts: str = "ts", delay: str | None = "1 hour", by: str | None = None) -> DataFrame:
    """Rows of each UTC day, final once the watermark has passed it: the seal of a day. Without delay no row is late and no day final."""
    keys = [F.window(ts, "1 day")] + ([F.col(by)] if by else [])
    return (stream.withWatermark(ts, delay) if delay else stream).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def run_to_end(stream: DataFrame, spark: SparkSession, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a query over what is there now and gives its output; a rerun with the same checkpoint goes on where it ended."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def upsert_sink(stream: DataFrame, out: str, checkpoint: str, key: str, order: str):
    """Mirror queue: every micro-batch is written once under its number, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("s")).select(key, "s.*")
        latest.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- token bucket ----------------------------------------------------------------------------------

_BUCKET = "struct<tokens:double,last_ms:bigint,allowed:bigint,limited:bigint>"


def token_bucket(requests: DataFrame, tenant: str, at_ms: str, order: str) -> DataFrame:
    """(tenant, allowed, limited, tokens) after all requests in order: a fold in the JVM.

    A refused request leaves the bucket and its time as they were. One tenant's requests are one group; the
    stateful stream below is the form for tenants whose history doesn't fit a task.
    """
    rows = requests.groupBy(F.col(tenant).alias("tenant")).agg(F.array_sort(F.collect_list(F.struct(F.col(at_ms).alias("t"), F.col(order).alias("o")))).alias("rs"))
    start = F.struct(F.lit(CAPACITY).alias("tokens"), F.lit(None).cast("bigint").alias("last_ms"), F.lit(0).cast("bigint").alias("allowed"), F.lit(0).cast("bigint").alias("limited")).cast(_BUCKET)

    def step(s: Column, r: Column) -> Column:
        elapsed = F.greatest(F.lit(0.0), (r["t"] - s["last_ms"]) / 1000.0)
        have = F.when(s["last_ms"].isNull(), F.lit(CAPACITY)).otherwise(F.least(F.lit(CAPACITY), s["tokens"] + elapsed * REFILL))
        ok = have >= 1
        return F.struct(
            F.when(ok, have - 1).otherwise(s["tokens"]).alias("tokens"),
            F.when(ok, r["t"]).otherwise(s["last_ms"]).alias("last_ms"),
            (s["allowed"] + ok.cast("bigint")).alias("allowed"),
            (s["limited"] + (~ok).cast("bigint")).alias("limited"),
        ).cast(_BUCKET)

    return rows.select("tenant", F.aggregate("rs", start, step).alias("s")).select("tenant", "s.allowed", "s.limited", F.round("s.tokens", 6).alias("tokens"))


def token_bucket_stream(stream: DataFrame, tenant: str, at_ms: str) -> DataFrame:
    """(tenant, at_ms, allowed) for every request, with one bucket of state for each tenant.

    Within a micro-batch requests are taken in order of time; across batches in order of arrival.
    """

    def serve(key, frames, state: GroupState):
        tokens, last = state.get if state.exists else (CAPACITY, None)
        for frame in frames:
            times = sorted(frame["at_ms"].tolist())
            verdicts = []
            for t in times:
                have = CAPACITY if last is None else min(CAPACITY, tokens + max(0.0, (t - last) / 1000.0) * REFILL)
                ok = have >= 1
                if ok:
                    tokens, last = have - 1, t
                verdicts.append(ok)
            yield pd.DataFrame({"tenant": [key[0]] * len(times), "at_ms": times, "allowed": verdicts})
        if last is not None:
            state.update((float(tokens), int(last)))

    rows = stream.select(F.col(tenant).alias("tenant"), F.col(at_ms).alias("at_ms"))
    return rows.groupBy("tenant").applyInPandasWithState(serve, "tenant string, at_ms bigint, allowed boolean", "tokens double, last_ms bigint", "append", GroupStateTimeout.NoTimeout)


# -- circuit breaker -------------------------------------------------------------------------------


def circuit_breaker(attempts: DataFrame, by: str, at_ms: str, failed: str, threshold: int, window_ms: int, max_cooldown_ms: int, order: str | None = None) -> DataFrame:
    """(by, opened, refused, open_until_ms) after attempts in order of time, at equal times of `order`: a fold.

    `threshold` failures within a window open the circuit; while open, attempts are refused; the first one
    after that is a probe, whose failure opens it again for twice as long and whose success closes it.
    """
    kind = "struct<fails:int,since:bigint,until:bigint,opens:int,opened:bigint,refused:bigint>"
    rows = attempts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(at_ms).alias("t"), (F.col(order) if order else F.lit(None)).alias("o"), F.col(failed).alias("f")))).alias("xs"))
    zero = F.struct(*(F.lit(0).alias(n) for n in ("fails", "since", "until", "opens", "opened", "refused"))).cast(kind)

    def step(s: Column, x: Column) -> Column:
        refused = s["until"] > x["t"]
        probe = ~refused & (s["until"] > 0)
        inside = (s["since"] > 0) & (x["t"] - s["since"] <= window_ms)
        fails = F.when(inside, s["fails"] + 1).otherwise(1)
        opens = ~refused & x["f"] & (probe | (fails >= threshold))
        cooldown = F.least(F.lit(max_cooldown_ms), F.lit(window_ms) * F.pow(F.lit(2.0), F.least(s["opens"], F.lit(10)))).cast("bigint")
        closed = ~refused & ~x["f"]
        return F.struct(
            F.when(refused, s["fails"]).when(opens | closed, 0).otherwise(fails).alias("fails"),
            F.when(refused, s["since"]).when(opens | closed, 0).when(inside, s["since"]).otherwise(x["t"]).alias("since"),
            F.when(refused, s["until"]).when(opens, x["t"] + cooldown).when(closed, 0).otherwise(s["until"]).alias("until"),
            F.when(refused, s["opens"]).when(opens, s["opens"] + 1).when(closed, 0).otherwise(s["opens"]).alias("opens"),
            (s["opened"] + opens.cast("bigint")).alias("opened"),
            (s["refused"] + refused.cast("bigint")).alias("refused"),
        ).cast(kind)

    return rows.select(by, F.aggregate("xs", zero, step).alias("s")).select(by, "s.opened", "s.refused", F.col("s.until").alias("open_until_ms"))


def stale_prepared(transactions: DataFrame, now_ms: int, after_ms: int = 300_000) -> DataFrame:
    """Prepared transactions that have waited too long: what the sweep asks the coordinator about."""
    return transactions.where((F.col("state") == "prepared") & (F.col("prepared_ms") <= now_ms - after_ms))
