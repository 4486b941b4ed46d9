"""Shared helpers of the training-data operators: tables, scratch folder, size-checked broadcast."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows, at its widest row, stay below this many bytes.
BROADCAST_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a local master takes a temporary folder of its own, kept for the session; any other raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = kept.get() if kept.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster, tables between stages need a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/skein/{name}-{uuid.uuid4().hex}"


_MADE: list[str] = []


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df to the shared scratch folder and read it back: lineage ends here and a lost executor costs no recomputation.

    Inside `temporary` the table goes at the end of the block, unless it is to be kept.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    if not keep:
        _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables materialised in the block are deleted at its end; what is still wanted of them must be written by then."""
    mark = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[mark:]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del _MADE[mark:]


def discard(df: DataFrame) -> None:
    """Delete the table that `materialise` wrote and of which df is the whole."""
    files = df.inputFiles()
    if files:
        path = files[0].rsplit("/", 1)[0]
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run as the function of a task after which its worker gives back the memory that it no longer uses.

    Workers are used again and wait for a while, so what they hold counts against the executor's other work.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it none of df's columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of df (a materialised table) when its counted size is below limit; leave the join to Spark beyond it."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def crc_fold(id_col: str = "doc_id"):
    """Column: crc32 of the id written as text, modulo 5; rows with 0 are held out from every fit. A null id has 1: it is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(1))


def slices(batch: pa.RecordBatch, column: int | str, limit: int = 4 << 20):
    """Row ranges (start, end) of a batch whose values of one string column hold about limit bytes each."""
    import numpy as np

    col = batch.column(column)
    if len(col) == 0:
        return
    sizes = np.asarray(pc.binary_length(col).fill_null(0)).astype("int64")
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    yield start, len(col)
