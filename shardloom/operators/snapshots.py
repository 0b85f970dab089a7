"""Versioned snapshots of a table: checkpoint, preview, stage, apply, verify, release.

A version is a folder of Parquet and never changes. Which one is current is the newest row of a small
log beside them, so applying a version is one atomic append and going back is another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators.movement import bucket_checksums


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, version: int) -> str:
        return f"{self.root}/version={version}"

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs().exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))

    def versions(self) -> list[int]:
        if not self._exists(self.root):
            return []
        listed = self._fs().listStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root))
        names = [s.getPath().getName() for s in listed]
        done = [n for n in names if n.startswith("version=") and self._exists(f"{self.root}/{n}/_SUCCESS")]
        return sorted(int(n.partition("=")[2]) for n in done)

    def checkpoint(self, df: DataFrame) -> int:
        """Writes a new version and makes it current."""
        version = self.stage(df)
        self.apply(version)
        return version

    def stage(self, df: DataFrame) -> int:
        """Writes a new version without making it current. One writer at a time."""
        version = max(self.versions(), default=0) + 1
        df.write.mode("overwrite").parquet(self._path(version))
        return version

    def apply(self, version: int) -> None:
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        at = self.spark.range(1).select(F.lit(version).alias("version"), F.lit(self._seq() + 1).alias("seq"))
        at.coalesce(1).write.mode("append").parquet(f"{self.root}/current")

    def _seq(self) -> int:
        return self.spark.read.parquet(f"{self.root}/current").agg(F.max("seq")).first()[0] if self._exists(f"{self.root}/current") else 0

    def current(self) -> int | None:
        if not self._exists(f"{self.root}/current"):
            return None
        return self.spark.read.parquet(f"{self.root}/current").agg(F.max_by("version", "seq")).first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        if version is None:
            raise ValueError("no version is current")
        return self.spark.read.parquet(self._path(version))

    def preview(self, version: int, key: str) -> DataFrame:
        """(change, n): rows that going to `version` would add, remove and change."""
        now, then = self.read().alias("a"), self.read(version).alias("b")
        cols = [c for c in self.read().columns if c != key]
        differs = F.lit(False)
        for c in cols:
            differs = differs | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        kind = F.when(F.col(f"a.{key}").isNull(), "added").when(F.col(f"b.{key}").isNull(), "removed").when(differs, "changed")
        both = now.join(then, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(kind.alias("change"))
        return both.where("change is not null").groupBy("change").agg(F.count(F.lit(1)).alias("n"))

    def verify(self, version: int, expected: DataFrame, by: str, key: str, content) -> bool:
        """Whether a version has the same checksums by group as an expected table."""
        got, want = (bucket_checksums(df, [by], key, content).select(by, "checksum") for df in (self.read(version), expected))
        return got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()

    def release(self, keep: int = 2) -> list[int]:
        """Deletes all but the newest `keep` versions and the current one; gives the deleted."""
        current, gone = self.current(), []
        for v in self.versions()[:-keep] if keep else self.versions():
            if v != current:
                self._fs().delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(v)), True)
                gone.append(v)
        return gone
