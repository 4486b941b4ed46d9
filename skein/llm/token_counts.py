"""Operator 6, token counts by a separator scan of flat token files that have no index.

A flat file is token ids, one after the other, each document's followed by the end-of-document id. `scan` cuts files into
blocks of bytes, looks for the separator in a whole block at a time, and gives each block's inner lengths and its two open
ends. A prefix scan over the blocks of a file, one row a block, adds up the separators before a block and the tokens left
open at its start, so that documents that cross one or many blocks get whole lengths. `write_flat` makes such files.

Defined results: an empty document counts 0; tokens after a file's last separator are a document without an end and are
counted as one, unless there are none; a file whose size is no multiple of the id's width raises ValueError; null text is
the empty text; an empty table or folder gives an empty result; other columns are ignored. The separator's own marker,
written out in a text, is encoded as ordinary text, so that it never counts as an end. Ids are two bytes wide where the
vocabulary and the separator fit in them, else four.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, released, scratch, table
from .tokens import encoder

#: The end-of-document id of the vocabulary, and the bytes of one id of its files.
SEPARATOR, WIDTH = 50_256, 2
BLOCK_BYTES = 8 << 20
FLAT = "file string, bytes long, ordinal long, doc_id long"


def _fs(uri: str):
    """(file system, path) of a URI that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_flat(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR, vocabulary: str | None = None, width: int = WIDTH) -> DataFrame:
    """Write one flat file per task; (file, bytes, ordinal, doc_id) tells which document stands where.

    A task that runs again writes a file of another name, and only files in the returned (materialised) table count.
    """
    kind = f"<u{width}"
    end = np.array([separator], dtype=kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, marker=False).encode
        name = f"{folder}/{uuid.uuid4().hex}.tokens"
        fs, path = _fs(name)
        ids: list = []
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        size = 0
        with fs.open_output_stream(path) as out:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    flat = np.frombuffer(encode(text.as_py() or ""), dtype="<u4").astype(kind).tobytes()
                    out.write(flat)
                    out.write(end)
                    size += len(flat) + width
                    ids.append(doc)
        if not ids:
            fs.delete_file(path)
        for a in range(0, len(ids), 50_000):
            part = ids[a : a + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(part)), pa.array([size] * len(part), pa.int64()), pa.array(range(a, a + len(part)), pa.int64()), pa.array(part, pa.int64())],
                ["file", "bytes", "ordinal", "doc_id"])

    return materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), FLAT), "flat-documents")


def scan(files: DataFrame, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES, width: int = WIDTH) -> DataFrame:
    """files: file, bytes. One row per document: file, ordinal, start (in ids), n_tokens."""
    step, kind = max(1, block_bytes // width) * width, f"<u{width}"
    blocks = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0), (F.col("bytes") - 1).cast("long"), F.lit(step))).alias("at"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, at in zip(*(c.to_pylist() for c in batch.columns)):
                if size % width:
                    raise ValueError(f"{name}: {size} bytes are no whole ids")
                fs, path = _fs(name)
                with fs.open_input_file(path) as f:
                    f.seek(at)
                    ids = np.frombuffer(f.read(min(step, size - at)), dtype=kind)
                ends = np.flatnonzero(ids == separator)
                last = at + step >= size
                inner = np.diff(ends) - 1
                head, tail = (int(ends[0]), len(ids) - 1 - int(ends[-1])) if len(ends) else (len(ids), len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([at // width], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()),
                     pa.array([last]), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([inner.tolist()], pa.list_(pa.int64()))],
                    ["file", "at", "ends", "head", "tail", "last", "places", "inner"])

    found = blocks.repartition("file", "at").mapInArrow(released(read), "file string, at long, ends long, head long, tail long, last boolean, places array<long>, inner array<long>")
    found = materialise(found, "flat-blocks")
    # Prefix scan over the narrow columns of a file's blocks: separators before a block, tokens open at its start.
    own = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = found.select("file", "at", "ends", "tail").withColumns({"first": F.coalesce(F.sum("ends").over(own), F.lit(0)), "runs": F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(own)})
    open_at = Window.partitionBy("file", "runs").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # a run is the blocks after one with a separator; what that one left open was its tail
    left = before.select("file", "at", "first", F.coalesce("runs", F.lit(0)).alias("runs"), "ends", "tail").withColumn("within", F.coalesce(F.sum("tail").over(open_at), F.lit(0)))
    opener = before.where("ends > 0").select("file", (F.coalesce("runs", F.lit(0)) + 1).alias("runs"), F.col("tail").alias("opened"))
    carried = left.join(opener, ["file", "runs"], "left").select("file", "at", "first", (F.col("within") + F.coalesce("opened", F.lit(0))).alias("carry"))
    stitched = found.join(carried, ["file", "at"])
    one = stitched.where("ends > 0")
    head = one.select("file", F.col("first").alias("ordinal"), (F.col("at") - F.col("carry")).alias("start"), (F.col("carry") + F.col("head")).alias("n_tokens"))
    rest = one.select("file", "first", "at", F.posexplode(F.arrays_zip(F.slice("places", 1, F.greatest(F.size("places") - 1, F.lit(0))).alias("place"), F.col("inner").alias("n"))).alias("i", "x"))
    rest = rest.select("file", (F.col("first") + F.col("i") + 1).alias("ordinal"), (F.col("at") + F.col("x.place") + 1).alias("start"), F.col("x.n").alias("n_tokens"))
    end = stitched.where("last").select("file", (F.col("first") + F.col("ends")).alias("ordinal"), F.when(F.col("ends") > 0, F.col("at") + F.element_at("places", F.lit(-1)) + 1).otherwise(F.col("at") - F.col("carry")).alias("start"), F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")).alias("n_tokens"))
    return head.unionByName(rest).unionByName(end.where("n_tokens > 0"))


def id_width(vocabulary: str | None, separator: int) -> int:
    """Bytes that hold every id of a vocabulary and the separator; a separator that is an id of its words raises ValueError."""
    size = encoder(vocabulary, marker=False).size
    if separator < size:
        raise ValueError(f"separator {separator} is an id of the vocabulary's words")
    return 2 if separator < 1 << 16 else 4


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, separator: int = SEPARATOR, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, file, ordinal: documents written as flat files, and counted by scanning these."""
    width = id_width(vocabulary, separator)
    rows = write_flat(docs, scratch(docs.sparkSession, "flat"), id_col, text_col, separator, vocabulary, width)
    files = rows.select("file", "bytes").distinct()
    return scan(files, separator, block_bytes, width).join(rows, ["file", "ordinal"]).select("doc_id", "n_tokens", F.col("ordinal"), "start")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE: dict[str, str] = {}
