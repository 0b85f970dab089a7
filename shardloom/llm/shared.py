"""Places and small helpers that several text operators share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Used only where the session names no spark.checkpoint.dir, as in tests on one machine.
LOCAL_SHARED = "/tmp/shardloom-shared"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, read from the session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_SHARED
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


#: The folder for tables between an operator's steps, while it runs.
_SCRATCH: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession, kind: str):
    """While it lasts, through_table() writes into one folder, which is deleted at the end.

    What outlives it, an operator's result, is written with keep=True.
    """
    folder = shared_path(spark, kind)
    token = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        drop_path(spark, folder)


def through_table(df: DataFrame, kind: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    spark, folder = df.sparkSession, _SCRATCH.get()
    path = f"{folder}/{kind}-{uuid.uuid4().hex}" if folder and not keep else shared_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path that shared_path() gave, through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(df: DataFrame) -> None:
    """Deletes what through_table() wrote for df, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bounds of an Arrow batch to and from Python, so that a worker's memory doesn't depend on how long texts are.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def bound_batches(spark: SparkSession, bounds: dict[str, str] = BATCH) -> None:
    """Sets these bounds in the session where it has larger ones or none; what it leaves unset counts as Spark's default."""
    number = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for k, v in bounds.items():
        if not 0 < number(spark.conf.get(k)) <= int(v):
            spark.conf.set(k, v)


def from_driver(spark: SparkSession, columns: list[list], schema: StructType) -> DataFrame:
    """A table of the driver's values, by column, as Arrow: rows of Python would start workers of another kind on executors."""
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), schema)


def map_arrow(df: DataFrame, make: Callable[[], Callable], schema: str, end: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow where make() builds the batch function once for each task, and end() runs after its last batch.

    Batch sizes are read from the session when a plan runs, which may be after this returns: so they are set
    in the session, unless it has smaller ones.
    """
    bound_batches(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        f = make()
        try:
            for batch in batches:
                if batch.num_rows:
                    yield from f(batch)
        finally:
            if end:
                end()
            give_back()

    return df.mapInArrow(run, schema)
