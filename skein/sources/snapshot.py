"""Versioned Parquet tables: every change writes a new version, and a pointer names the current one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Snapshot:
    """A table at root/v=N, partitioned by a column; readers of an older version are not disturbed.

    The pointer is an empty file root/current/N, made only where there is none, so it works on any store that Spark writes to.
    """

    def __init__(self, spark: SparkSession, root: str, partition: str | None = "workspace"):
        self.spark, self.root, self.partition = spark, root.rstrip("/"), partition

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version, or 0 where there is none."""
        fs, path = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/current")
        return max((int(s.getPath().getName()) for s in fs.listStatus(path)), default=0) if fs.exists(path) else 0

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v={version or self.version()}")

    def write(self, df: DataFrame) -> int:
        """Write the next version. A writer that finds it taken by another one raises, and the other one's stays."""
        n = self.version() + 1
        w = df.write.mode("errorifexists")
        (w.partitionBy(self.partition) if self.partition else w).parquet(f"{self.root}/v={n}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/current/{n}")
        self._fs().create(path, False).close()
        return n

    def change(self, f: Callable[[DataFrame], DataFrame]) -> int:
        return self.write(f(self.read()))

    def drop(self) -> None:
        self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.root), True)
