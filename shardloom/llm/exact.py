"""Operator 10: exact deduplication as a stateful stream over narrow rows."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from shardloom.llm.shared import drop_path, scratch, shared_path, through_table

#: White space that doesn't count, U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Up to so many rows (8 bytes of key each) the ids of documents to be compared are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.unloadOnCommit": "false",
    # state of a query that has ended is closed on executors by their next maintenance
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}
#: Bytes of the narrow table for each partition of state.
STATE_BYTES = 16 << 20
#: With more partitions of state than this, each is closed when its task ends, and opened again by the next batch: executors
#: then hold what their running tasks need. With fewer, opening again costs more than it saves.
STATE_OPEN = 32


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256_of(text: Column) -> Column:
    return F.sha2(text, 256)


@contextlib.contextmanager
def settings(spark, values: dict[str, str]):
    """Session settings for a while, then as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def located(docs: DataFrame, text: str, key: str, state: str | None) -> DataFrame:
    """(k, t, at): rows with a content locator, the file and the row's place in it.

    Rows read from files have one already. Others, and all that go into a kept state, are written first.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    if state is not None:
        path = f"{state}/content"
        rows.write.mode("append").parquet(path)
        rows = docs.sparkSession.read.schema(rows.schema).parquet(path)
    else:
        try:
            at = docs.select(F.struct("_metadata.file_path", "_metadata.row_index").alias("at"), F.col(key).alias("k"), F.col(text).alias("t"))
            return at.select("k", "t", "at")
        except AnalysisException:
            rows = through_table(rows, "exact-content")
    return rows.select("k", "t", F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))


def exact_groups(
    docs: DataFrame, text: str = "text", key: str = "doc_id", digest: Callable[[Column], Column] = sha256_of, files_per_batch: int = 1000, state: str | None = None
) -> DataFrame:
    """One row per input row: (key, keep_id, group_size, kept, digest).

    Texts are equal when equal without white space; of equal ones the row with the most code points,
    then the smallest key, stays; keys may be of any type that has an order. Null counts as empty. Rows with
    a null key rank behind all others. Repeated rows are members of their group like any others; all rows of
    the key that stays are marked kept. An empty table gives no rows; other columns don't matter. Very long
    texts are hashed and compared whole.

    A narrow table (key, digest, code points, locator) is written first. A stream over it keeps for each
    digest, on the executors' disks (RocksDB, checkpointed in the shared folder, never expiring), the
    number of rows and the identifier and locator of the one that stays; counts are summed before the
    shuffle, so a hot digest is one row for each task. Then every row of a digest with several rows is
    compared, as a whole text, with the content at the locator of the row that stays; if any differ, rows of
    such a digest are grouped by the text itself.

    With `state`, a folder that executors share, the stream's state, the narrow table and the content outlive the
    call: a later call with the same folder adds its rows to them, only new rows pass the stream, and the
    result has the rows of all calls. Without it they last as long as the call.
    """
    with scratch(docs.sparkSession, "exact"):
        return through_table(_groups(docs, text, key, digest, files_per_batch, state), "exact-groups", keep=True)


def _groups(docs: DataFrame, text: str, key: str, digest: Callable[[Column], Column], files_per_batch: int, state: str | None) -> DataFrame:
    spark = docs.sparkSession
    size = F.char_length(F.coalesce(F.col("t"), F.lit("")))
    narrow = lambda rows: rows.select("k", digest(normalised(F.col("t"))).alias("digest"), size.alias("size"), "at")
    if state is None:
        content = located(docs, text, key, None)
        keyed = through_table(narrow(content), "exact-keys")
    else:
        before = _files(spark, f"{state}/content")
        content, path = located(docs, text, key, state), f"{state}/keys"
        new = content.where(~F.col("at.file_path").isin(before)) if before else content
        narrow(new).write.mode("append").parquet(path)
        keyed = spark.read.schema(narrow(content).schema).parquet(path)
    groups = _stream(keyed, files_per_batch, state)
    marked = through_table(
        keyed.select("k", "digest", "at").join(groups, "digest").select("k", "digest", "at", "n", F.col("best.k").alias("keep_id"), F.col("best.at").alias("keep_at")),
        "exact-marked",
    )
    several = marked.where("n > 1")
    ids = several.select("k").distinct()
    if several.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    whole = normalised(F.col("t"))
    texts = content.alias("d").join(ids.alias("i"), F.col("d.k").eqNullSafe(F.col("i.k")), "left_semi")
    texts = through_table(texts.select("k", "at", whole.alias("whole"), size.alias("size")).withColumn("digest", digest(F.col("whole"))), "exact-texts")
    # each row's content against that at the locator of the row that stays: plain rows on either side, so that a hot digest can be split
    keepers = through_table(several.where(F.col("at") == F.col("keep_at")).select("at"), "exact-keepers")
    stay = through_table(texts.join(keepers, "at").select("digest", F.col("whole").alias("other")), "exact-stay")
    unequal = through_table(texts.select("digest", "whole").join(stay, "digest").where("whole <> other").select("digest"), "exact-unequal")
    odd = through_table(unequal.distinct(), "exact-odd")
    out = marked.select("k", "keep_id", F.col("n").alias("group_size"), "digest")
    if not odd.isEmpty():
        members = texts.join(odd, "digest", "left_semi")
        one = through_table(members.groupBy("digest", "whole").agg(F.count(F.lit(1)).alias("group_size"), _best().alias("best")), "exact-again")
        again = members.alias("m").join(one.alias("o"), (F.col("m.digest") == F.col("o.digest")) & (F.col("m.whole") == F.col("o.whole")))
        out = out.join(odd, "digest", "left_anti").unionByName(again.select("m.k", F.col("o.best.k").alias("keep_id"), "o.group_size", "m.digest"))
    return out.select(F.col("k").alias(key), "keep_id", "group_size", F.col("k").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def _best() -> Column:
    """Of rows (size, k, at) the one that stays: the most code points, then the smallest key, null keys last."""
    return F.min(F.struct((-F.col("size")).alias("minus"), F.col("k").isNull().alias("none"), "k", "at"))


def _files(spark, path: str) -> list[str]:
    """The Parquet files of a folder, which may not be there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return []
    return [r[0] for r in spark.read.parquet(path).select("_metadata.file_path").distinct().collect()]  # one row a file of the state's former calls


def folder_bytes(spark, path: str) -> int:
    """Bytes of the files in a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


def _stream(keyed: DataFrame, files_per_batch: int, kept: str | None) -> DataFrame:
    """(digest, n, best) of all rows, from state that is kept across micro-batches, and with `kept` across calls."""
    spark = keyed.sparkSession
    root = kept or shared_path(spark, "exact-stream")
    out, checkpoint = f"{root}/changes", f"{root}/checkpoint"
    source = keyed.inputFiles()
    schema = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), _best().alias("best")).schema
    if not source:
        return spark.createDataFrame([], schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    need = -(-folder_bytes(spark, source[0].rpartition("/")[0]) // STATE_BYTES)
    with settings(spark, STATE | {"spark.sql.shuffle.partitions": str(min(parts, max(8, need)))}):
        if int(spark.conf.get("spark.sql.shuffle.partitions")) > STATE_OPEN:
            spark.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
        stream = spark.readStream.schema(keyed.schema).option("maxFilesPerTrigger", files_per_batch).parquet(source[0].rpartition("/")[0])
        state = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), _best().alias("best"))

        def write(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    changes = spark.read.schema(schema.add("batch", IntegerType())).parquet(out)
    if changes.select(F.max("batch")).first()[0] in (0, None):
        latest = through_table(changes.drop("batch"), "exact-latest")
    else:
        latest = through_table(changes.groupBy("digest").agg(F.max_by(F.struct("n", "best"), "batch").alias("s")).select("digest", "s.n", "s.best"), "exact-latest")
    if kept is None:
        drop_path(spark, root)
    return latest
