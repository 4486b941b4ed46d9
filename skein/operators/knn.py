"""Nearest neighbours of a batch of query vectors, and the score of a distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.workers import give_back

#: Query vectors of one block, and their bytes; a block is held by the driver and sent to every task, and the chunks are read once a block.
MAX_QUERIES, MAX_QUERY_BYTES = 10_000, 32 << 20
#: Rows that a block's queries may find in a task, 16 bytes each; and of these as many as become one batch.
MAX_FOUND, FOUND_SLICE = 4_000_000, 200_000
#: Scores that a task computes at a time, and the most queries of one such tile.
SLICE_SCORES, SLICE = 1 << 19, 256


def distance_score(distance: Column) -> Column:
    return F.round(1 / (1 + F.greatest(F.lit(0.0), distance)), 6)


@dataclass(frozen=True)
class Arm:
    """The k best chunks of a query among those in its reach: all, those of its own key, of a shared key that is not its own, or linked to its key."""

    number: int
    k: int
    reach: str = "all"  # all, own, shared, linked
    shared: str | None = None


def scan(chunks: DataFrame, queries: DataFrame, arms: list[Arm], key: str | None = None, scopes: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(q, id_col, score, arm): the k nearest chunks of each query and arm by squared L2, ties by id, from one reading of the chunks.

    scopes: an array column of the keys that a chunk is linked to. Each task keeps k rows for a query and arm, whatever it
    reads, so what is shuffled grows with tasks and not with chunks. Queries of any number are gone through in blocks.
    """
    source = _source(chunks, key, scopes, id_col)
    found = [_block(source, held, arms, id_col) for held in _blocks(_asked(queries, key), arms)]
    return _best(found, arms, id_col) if found else _nothing(chunks, id_col)


def _source(chunks: DataFrame, key: str | None, scopes: str | None, id_col: str, *more: str) -> DataFrame:
    return chunks.where(F.col("vector").isNotNull()).select(
        F.col(id_col).cast("long").alias(id_col), "vector", (F.col(key) if key else F.lit(None).cast("string")).alias("key"),
        (F.col(scopes) if scopes else F.lit(None).cast("array<string>")).alias("scopes"), *more)


def _asked(queries: DataFrame, key: str | None) -> Iterator[Row]:
    return queries.where(F.col("vector").isNotNull()).select("q", (F.col(key) if key else F.lit(None).cast("string")).alias("key"), "vector").orderBy("q").toLocalIterator()


def _nothing(chunks: DataFrame, id_col: str) -> DataFrame:
    return chunks.select(F.lit(0).cast("long").alias("q"), F.col(id_col).cast("long").alias(id_col), F.lit(0.0).alias("score"), F.lit(0).alias("arm")).limit(0)


def _best(found: list[DataFrame], arms: list[Arm], id_col: str) -> DataFrame:
    """Of what tasks found, the k nearest of each query and arm."""
    most = F.create_map(*[F.lit(x) for a in arms for x in (a.number, a.k)])
    order = Window.partitionBy("q", "arm").orderBy(F.desc("score"), id_col)
    return reduce(DataFrame.unionByName, found).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most[F.col("arm")]).drop("_r")


def knn(chunks: DataFrame, queries: DataFrame, k: int, key: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(q, id_col, score) of the k nearest chunks of each query; with key only where it is equal."""
    return scan(chunks, queries, [Arm(0, k, "own" if key else "all")], key, None, id_col).drop("arm")


def _blocks(rows: Iterator[Row], arms: list[Arm]) -> Iterator[list[Row]]:
    most = max(1, min(MAX_QUERIES, MAX_FOUND // max(1, sum(a.k for a in arms))))
    held: list[Row] = []
    for r in rows:
        held.append(r)
        if len(held) >= most or 8 * len(held) * len(r["vector"]) >= MAX_QUERY_BYTES:
            yield held
            held = []
    if held:
        yield held


def _block(source: DataFrame, held: list[Row], arms: list[Arm], id_col: str, probes: np.ndarray | None = None) -> DataFrame:
    """The k nearest that each task finds for each query held and arm.

    probes: the cells (a row for each query) in which a query looks; the source then has each row's cell behind its scopes.
    """
    names, keys = np.array([r["q"] for r in held]), [r["key"] for r in held]
    codes = {k: i for i, k in enumerate(dict.fromkeys(k for k in keys if k is not None))}
    own = np.array([codes.get(k, -1) for k in keys])
    matrix = np.array([r["vector"] for r in held], dtype="float64")
    norms = (matrix**2).sum(axis=1)
    visits: dict[int, np.ndarray] = {}
    if probes is not None:
        cell, query = probes.ravel(), np.repeat(np.arange(len(names)), probes.shape[1])
        by = np.lexsort((query, cell))
        starts = np.nonzero(np.diff(cell[by], prepend=-1))[0]
        visits = {int(cell[by[i]]): query[by[i:j]] for i, j in zip(starts, [*starts[1:], len(by)])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from searched(batches)
        finally:
            give_back()

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {a: (np.full((len(names), a.k), -1.0), np.zeros((len(names), a.k), dtype="int64")) for a in arms}
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column(0).to_numpy()
            x = np.asarray(batch.column(1).flatten(), dtype="float64").reshape(len(ids), -1)
            order = np.argsort(ids, kind="stable")  # places in the order of ids, for ties
            ids, x = ids[order], x[order]
            text = [batch.column(2)[i].as_py() for i in order.tolist()] if codes or any(a.reach == "shared" for a in arms) else []
            place = np.array([codes.get(k, -2) for k in text]) if text else np.full(len(ids), -2)
            linked = None
            if any(a.reach == "linked" for a in arms):
                linked = np.zeros((len(codes) + 1, len(ids)), dtype=bool)
                for j, i in enumerate(order.tolist()):
                    for s in batch.column(3)[i].as_py() or ():
                        if s in codes:
                            linked[codes[s], j] = True
            length = (x**2).sum(axis=1)
            parts = [(np.arange(len(ids)), np.arange(len(names)))]
            if probes is not None:
                cells = batch.column(4).to_numpy()[order]
                parts = [(np.nonzero(cells == c)[0], visits[c]) for c in np.unique(cells).tolist() if c in visits]
            for rows, asking in parts:
                there, size = x[rows].T, max(1, min(SLICE, SLICE_SCORES // len(rows)))
                for a in range(0, len(asking), size):
                    at = asking[a : a + size]
                    score = norms[at, None] + length[None, rows] - 2 * matrix[at] @ there
                    np.maximum(score, 0, out=score)
                    score += 1
                    np.divide(1, score, out=score)
                    np.round(score, 6, out=score)
                    mine = own[at]
                    for arm in arms:
                        s = score
                        if arm.reach == "own":
                            s = np.where(place[None, rows] == mine[:, None], score, -1.0)
                        elif arm.reach == "shared":
                            s = np.where(np.array([text[i] == arm.shared for i in rows.tolist()])[None, :] & np.array([keys[i] != arm.shared for i in at.tolist()])[:, None], score, -1.0)
                        elif arm.reach == "linked":
                            s = np.where(linked[mine][:, rows], score, -1.0)
                        _merge(*best[arm], at, s, ids[rows])
        for arm, (score, ids) in best.items():
            size = max(1, FOUND_SLICE // max(1, arm.k))
            for a in range(0, len(names), size):
                r, c = np.nonzero(score[a : a + size] >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(names[a + r]), pa.array(ids[a + r, c]), pa.array(score[a + r, c]), pa.array(np.full(len(r), arm.number, dtype="int32"))], ["q", id_col, "score", "arm"])

    return source.mapInArrow(run, f"q long, {id_col} long, score double, arm int")


def _merge(top: np.ndarray, top_ids: np.ndarray, queries: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
    """Bring the k best of score (a row a query; ids in order) into the k best so far of the same queries."""
    k, n = top.shape[1], score.shape[1]
    if n > k:  # scores have six digits, so score and place make one whole number
        rank = (1_000_000 - np.rint(score * 1_000_000)).astype("int64") * n + np.arange(n)
        at = np.argpartition(rank, k - 1, axis=1)[:, :k]
    else:
        at = np.broadcast_to(np.arange(n), score.shape)
    both = np.concatenate((top[queries], np.take_along_axis(score, at, axis=1)), axis=1)
    both_ids = np.concatenate((top_ids[queries], ids[at]), axis=1)
    order = np.lexsort((both_ids, -both), axis=-1)[:, :k]
    top[queries], top_ids[queries] = np.take_along_axis(both, order, axis=1), np.take_along_axis(both_ids, order, axis=1)


def knn_sql(chunks: DataFrame, vector: list[float], k: int, id_col: str = "doc_id") -> DataFrame:
    """One query by column expressions only; the plan ends in a distributed top-k."""
    q = F.array(*(F.lit(float(v)) for v in vector))
    d = F.aggregate(F.zip_with(F.col("vector"), q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return chunks.where(F.col("vector").isNotNull()).select(id_col, distance_score(d).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
