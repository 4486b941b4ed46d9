"""Tables between the steps of an operator, in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast when its counted rows take fewer bytes than this.
BROADCAST_BYTES = 32 << 20


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local master without one takes a temporary folder for the session, others raise."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = kept.get() if kept.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster, tables between steps need a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables written on the way; those not kept go at the end of `scratch`."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        """df written and read back: its plan ends here, and a lost executor costs no recomputation of what came before."""
        path = f"{folder(self.spark)}/skein/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        if not keep:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths.clear()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    s = Scratch(spark)
    try:
        yield s
    finally:
        s.drop()


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A broadcast hint on df (a written table) when its counted rows are few enough; Spark chooses the join otherwise."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
