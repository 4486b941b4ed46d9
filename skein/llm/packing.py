"""Operator 1, best-fit packing: bounded-space online best-fit over token pieces.

Each packing task keeps a fixed number of open bins, listed by free space under a bitset (one bit per free amount). A
piece goes to the open bin with the least free space that still takes it; if none does, a bin is opened, and when that
is one too many, the fullest open bin closes. The bins are online from block to block; within a block of a shuffled partition,
which is what a task looks ahead, the largest pieces come first (block_pieces=1 takes them strictly as they come).

Defined results: null text is the empty text and gives one piece of the end id alone; a document of more than
`capacity` ids is cut so that all pieces but the first are full; repeated rows are packed as often as they occur; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, slices, table
from .tokens import encoder

CAPACITY, END_ID, OPEN_BINS = 1024, 2, 4096
#: Pieces that a task holds and sorts at a time; the open bins go on from block to block.
BLOCK_PIECES = 8_192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones from the end, the first one shorter if need be."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, vocabulary: str | None) -> DataFrame:
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for a, z in slices(batch, 1):
                out: list[tuple] = []
                for doc, text in zip(batch.column(0).slice(a, z - a).to_pylist(), batch.column(1).slice(a, z - a)):
                    ids = encode(text.as_py() or "") + end
                    for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                        out.append((doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), PIECES)


class BestFit:
    """Bounded-space best-fit over bins of one capacity."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.held, self.made = 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, n: int) -> tuple[int, int]:
        """(bin, offset) for a piece of n ids."""
        fit = self.bits >> n
        if fit:
            free = n + (fit & -fit).bit_length() - 1
            stack = self.at[free]
            b = stack.pop()
            if not stack:
                self.bits ^= 1 << free
            self.held -= 1
        else:
            b, free = self.made, self.capacity
            self.made += 1
        left = free - n
        if left:
            self.at[left].append(b)
            self.bits |= 1 << left
            self.held += 1
            if self.held > self.open_bins:  # the fullest closes
                low = (self.bits & -self.bits).bit_length() - 1
                stack = self.at[low]
                stack.pop()
                self.held -= 1
                if not stack:
                    self.bits ^= 1 << low
        return b, self.capacity - free


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of batches in tables of about `rows` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS, block_pieces: int = BLOCK_PIECES, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with the sequence and offset each is placed at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for block in blocks(batches, block_pieces):
            lengths = block.column("length").to_numpy()
            order = np.argsort(-lengths, kind="stable") if block_pieces > 1 else np.arange(len(lengths))
            placed = np.empty((2, len(order)), dtype="int64")
            for i, n in zip(order.tolist(), lengths[order].tolist()):
                placed[:, i] = fit.put(n)
            block = block.append_column("sequence_id", pa.array(placed[0] + base)).append_column("offset", pa.array(placed[1]))
            yield from block.combine_chunks().to_batches()

    dealt = pieces(docs, id_col, text_col, capacity, end_id, vocabulary).repartition("doc_id", "piece")
    return dealt.sortWithinPartitions("doc_id", "piece", "ids_crc32").mapInArrow(released(run), PACKED)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op1_packing": op1_packing}
ORACLE: dict[str, str] = {}
