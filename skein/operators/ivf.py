"""An inverted-file index over vectors: rows in cells of nearest centroids, searches that look into a few cells of each query.

Centroids come from a bounded sample (SAMPLE rows, those whose ids hash lowest), every row is assigned in one pass and written
with its columns, partitioned by cell; large cells go to several files. A search reads only partitions that some query of its
block probes, and a row is scored only against queries that probe its cell. How many cells a query probes is set when the index
is built: PILOT rows are searched exactly, and the least number of cells is taken that holds the wanted share of their true
neighbours; the share measured is kept with the index. `exact=True` looks into all cells, and `knn.scan` needs no index.

Defined results: rows without a vector are not indexed; vectors must be of one width; ties go to the smaller id; an index of no
rows finds nothing. Rows can be added later: they go to the cells of the centroids as they are.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from .knn import Arm, _asked, _best, _block, _blocks, _nothing, _source, knn

#: Rows from which centroids are made; rows of the sample for each centroid; centroids at most.
SAMPLE, ROWS_A_CELL, MAX_CELLS = 50_000, 64, 4096
#: Rows that are searched exactly to set the number of cells probed, their neighbours, and the share of them to be found.
PILOT, PILOT_K, TARGET = 100, 10, 0.95
ROUNDS = 12


def centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Lloyd rounds over the sample; a cell left without rows moves to the row that is farthest from its centroid."""
    c = sample[np.linspace(0, len(sample) - 1, cells).astype("int64")].copy()
    for _ in range(ROUNDS):
        at, far = nearest(sample, c)
        counts = np.bincount(at, minlength=len(c))
        sums = np.stack([np.bincount(at, weights=sample[:, i], minlength=len(c)) for i in range(sample.shape[1])], axis=1)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
        empty = np.nonzero(counts == 0)[0]
        c[empty] = sample[np.argsort(-far, kind="stable")[: len(empty)]]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its squared distance."""
    at, far = np.empty(len(x), dtype="int64"), np.empty(len(x))
    size = (c**2).sum(axis=1)
    for a in range(0, len(x), 4096):
        d = size[None] - 2 * x[a : a + 4096] @ c.T
        at[a : a + 4096] = d.argmin(axis=1)
        far[a : a + 4096] = d.min(axis=1) + (x[a : a + 4096] ** 2).sum(axis=1)
    return at, far


def cell_order(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cells of each query, nearest first, ties to the lower number."""
    return np.argsort((c**2).sum(axis=1)[None] - 2 * q @ c.T, axis=1, kind="stable")


def _in_cells(rows: DataFrame, c: np.ndarray) -> DataFrame:
    """rows with the number of their cell."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = np.asarray(batch.column("vector").flatten(), dtype="float64").reshape(len(batch), -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(x, c)[0].astype("int32"))], [*names, "cell"])

    return rows.mapInArrow(run, Ty.StructType([*rows.schema.fields, Ty.StructField("cell", Ty.IntegerType())]))


@dataclass(frozen=True)
class Index:
    """An index at a folder. probes: cells that a query looks into; recall: the share of true neighbours in them, as measured."""

    spark: SparkSession
    root: str
    centroids: np.ndarray
    probes: int
    recall: float
    schema: Ty.StructType

    @classmethod
    def build(cls, chunks: DataFrame, root: str, id_col: str = "doc_id", cells: int | None = None, target: float = TARGET) -> Index:
        """Index chunks (id_col, vector and other columns) at root, which must be new."""
        spark = chunks.sparkSession
        rows = chunks.where(F.col("vector").isNotNull())
        n = rows.count()
        cells = min(cells or max(1, round(math.sqrt(n))), MAX_CELLS, max(n, 1))
        order = F.xxhash64(F.col(id_col).cast("long"))
        taken = rows.select(id_col, "vector").orderBy(order, id_col).limit(min(SAMPLE, ROWS_A_CELL * cells)).toPandas()
        c = centroids(np.stack(taken["vector"].to_numpy()).astype("float64"), cells) if n else np.zeros((0, 1))
        schema = Ty.StructType([*rows.schema.fields, Ty.StructField("cell", Ty.IntegerType())])
        index = cls(spark, root.rstrip("/"), c, cells, 1.0, schema)
        index.add(chunks)
        pilot = taken.head(PILOT)
        probes, recall = index._measured(rows, pilot[id_col].tolist(), np.stack(pilot["vector"].to_numpy()).astype("float64"), id_col, target) if n else (0, 1.0)
        spark.createDataFrame([(json.dumps({"centroids": c.tolist(), "probes": probes, "recall": recall, "schema": schema.jsonValue()}),)], "value string").coalesce(1).write.text(f"{index.root}/about")
        return cls(spark, index.root, c, probes, recall, schema)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Index:
        about = json.loads(spark.read.text(f"{root.rstrip('/')}/about").first()[0])
        c = np.array(about["centroids"], dtype="float64") if about["centroids"] else np.zeros((0, 1))
        return cls(spark, root.rstrip("/"), c, about["probes"], about["recall"], Ty.StructType.fromJson(about["schema"]))

    def add(self, chunks: DataFrame) -> None:
        """Assign and append rows; a cell with many rows is written by several tasks."""
        rows = chunks.where(F.col("vector").isNotNull())
        placed = _in_cells(rows, self.centroids) if len(self.centroids) else rows.withColumn("cell", F.lit(0)).limit(0)
        placed.hint("rebalance", "cell").write.partitionBy("cell").mode("append").parquet(f"{self.root}/cells")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/cells")

    def _measured(self, rows: DataFrame, ids: list, vectors: np.ndarray, id_col: str, target: float) -> tuple[int, float]:
        """Cells to probe so that the target share of the pilot rows' true neighbours is found, and the share itself."""
        queries = self.spark.createDataFrame([(int(i), v) for i, v in zip(ids, vectors.tolist())], "q long, vector array<double>")
        true = knn(rows, queries, PILOT_K, id_col=id_col)
        where = self.rows().select(F.col(id_col).cast("long").alias(id_col), "cell")
        found = true.join(where, id_col).select("q", "cell").toPandas()  # PILOT * PILOT_K rows
        order = cell_order(vectors, self.centroids)
        rank = np.argsort(order, axis=1)
        at = {int(i): j for j, i in enumerate(ids)}
        ranks = np.sort([rank[at[q], cell] for q, cell in zip(found["q"].tolist(), found["cell"].tolist())])
        probes = int(ranks[math.ceil(target * len(ranks)) - 1]) + 1
        return probes, float((ranks < probes).mean())

    def scan(self, queries: DataFrame, arms: list[Arm], key: str | None = None, scopes: str | None = None, id_col: str = "doc_id", exact: bool = False) -> DataFrame:
        """As `knn.scan`, within the cells that the queries probe."""
        rows, found = self.rows(), []
        probes = len(self.centroids) if exact else self.probes
        if probes:
            for held in _blocks(_asked(queries, key), arms):
                near = cell_order(np.array([r["vector"] for r in held], dtype="float64"), self.centroids)[:, :probes]
                read = np.unique(near).tolist()
                source = rows if len(read) == len(self.centroids) else rows.where(F.col("cell").isin(read))  # partitions of other cells are not listed
                found.append(_block(_source(source, key, scopes, id_col, "cell"), held, arms, id_col, near))
        return _best(found, arms, id_col) if found else _nothing(rows, id_col)

    def knn(self, queries: DataFrame, k: int, key: str | None = None, id_col: str = "doc_id", exact: bool = False) -> DataFrame:
        """(q, id_col, score) of the k nearest indexed rows found for each query; with key only where it is equal."""
        return self.scan(queries, [Arm(0, k, "own" if key else "all")], key, None, id_col, exact).drop("arm")
