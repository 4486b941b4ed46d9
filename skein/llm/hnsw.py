"""Operator 12, approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged.

Rows are dealt to shards of about SHARD_ROWS by a hash of their id. In a shard, equal vectors are one node, whose smallest ids are
kept: as many as a result can take, so that a vector of any number of copies costs one node. Nodes are put in order of their
level, so that the nodes of a layer are the first ones and its neighbours are one flat array without an index. Nodes join in
batches that search the graph side by side (`beam`), a step of all of them being a few array operations; neighbours are chosen
so that none is nearer to another chosen one than to the node, and lists that overflow are chosen again. Graphs are written, a row
a shard. Queries go through them in blocks of bounded size; each shard returns its nearest rows of each query by exact score, and
a window ranks them over all shards.

A score is the cosine in double precision, its sums taken component by component in order, so that equal vectors tie exactly;
vectors of very large or small size are scaled by a power of two before, which changes no cosine.

Defined results: rows whose id is null, or whose vector is null, empty, zero or holds null or non-finite components, take no
part; vectors of another width than the query's are no candidates of it; of several rows of one id, one query is made, with the
least vector, and none of them is its candidate; a repeated row is a candidate each time. Other columns, whatever their names,
are ignored; an empty table gives an empty result. Graphs of no more nodes than a search keeps are searched whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, released, table

SHARD_ROWS = 16_384
#: Neighbours chosen for a new node, places of its list on the lowest layer and on others, and what an overflowing list is cut to.
CHOSEN, PLACES, UPPER_PLACES = 16, 32, 16
#: Nodes kept by a search that builds, and by one that answers.
BUILD_BEAM, BEAM = 64, 256
#: Nodes that join at a time; nodes of the beam that are expanded in one step; mates of the batch taken as candidates.
BATCH, STEP, MATES = 256, 4, 16
#: Queries of a block, and their bytes; a block is held by the driver and sent to every task.
MAX_QUERIES, MAX_QUERY_BYTES = 8192, 16 << 20
GRAPH = "shard int, width int, vectors binary, starts binary, members binary, sizes array<int>, links binary"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two so that their squares stay in range."""
    top = np.abs(x).max(axis=1, initial=0)
    power = np.frexp(np.where(top > 0, top, 1))[1]
    return np.ldexp(x, np.where(np.abs(power) > 400, -power, 0)[:, None])


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products over the last axis, in order."""
    out = a[..., 0] * b[..., 0]
    for i in range(1, a.shape[-1]):
        out = out + a[..., i] * b[..., i]
    return out


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the `keep` most similar nodes found for each row of q, best first; the node len(links) is none.

    x: unit vectors of the nodes and one of zeros. All rows take a step together: each expands the best STEP of its beam that
    it has not yet expanded, until nothing in its beam is left to expand.
    """
    none, rows = len(links), len(q)
    seen = np.zeros((rows, none + 1), dtype=bool)
    seen[:, none] = True
    every = np.arange(rows)[:, None]
    seen[every, entry] = True
    pad = max(keep, entry.shape[1], STEP)
    nodes = np.full((rows, pad), none, dtype="int32")
    sims = np.full((rows, pad), -np.inf, dtype="float32")
    nodes[:, : entry.shape[1]] = entry
    sims[:, : entry.shape[1]] = np.where(entry == none, -np.inf, np.matmul(x[entry], q[:, :, None])[:, :, 0])
    nodes, sims = _best(nodes, sims, max(keep, STEP))
    todo = sims > -np.inf
    live = np.arange(rows)
    while len(live):
        open_ = np.where(todo[live], sims[live], -np.inf)
        at = np.argpartition(-open_, STEP - 1, axis=1)[:, :STEP]
        good = np.take_along_axis(open_, at, axis=1) > -np.inf
        going = good.any(axis=1)
        live, at, good = live[going], at[going], good[going]
        if not len(live):
            break
        todo[live[:, None], at] = False
        near = links[np.where(good, nodes[live[:, None], at], 0)]
        near = np.where(good[:, :, None], near, none).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = none  # a node that two of the expanded ones share
        near = np.where(seen[live[:, None], near], none, near)
        seen[live[:, None], near] = True
        s = np.matmul(x[near], q[live][:, :, None])[:, :, 0]
        s[near == none] = -np.inf
        width = nodes.shape[1]
        both, both_s = np.concatenate((nodes[live], near), axis=1), np.concatenate((sims[live], s), axis=1)
        new = np.concatenate((todo[live], near != none), axis=1)
        pick = np.argpartition(-both_s, width - 1, axis=1)[:, :width]
        nodes[live], sims[live], todo[live] = (np.take_along_axis(v, pick, axis=1) for v in (both, both_s, new))
    return _best(nodes, sims, keep)


def _best(nodes: np.ndarray, sims: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((nodes, -sims), axis=1)[:, :keep]
    return np.take_along_axis(nodes, order, axis=1), np.take_along_axis(sims, order, axis=1)


def choose(x: np.ndarray, nodes: np.ndarray, sims: np.ndarray, most: int, none: int) -> np.ndarray:
    """Of candidates (rows x candidates, best first), up to `most` that are nearer to the row's node than to any chosen before, then the best others."""
    vectors = x[nodes]
    among = np.matmul(vectors, vectors.transpose(0, 2, 1))
    valid = (nodes != none) & (sims > -np.inf)
    hidden, taken, count = ~valid, np.zeros(nodes.shape, dtype=bool), np.zeros(len(nodes), dtype="int64")
    for j in range(nodes.shape[1]):
        ok = ~hidden[:, j] & (count < most)
        taken[:, j] = ok
        count += ok
        hidden |= ok[:, None] & (among[:, j] > sims)
    rank = np.where(taken, 0, np.where(valid, 1, 2)) * nodes.shape[1] + np.arange(nodes.shape[1])
    order = np.argsort(rank, axis=1)[:, :most]
    return np.where(np.take_along_axis(valid, order, axis=1), np.take_along_axis(nodes, order, axis=1), none)


class Layers:
    """The graph while it grows: unit vectors (with one of zeros behind them) and a flat array of neighbours for each layer."""

    def __init__(self, vectors: np.ndarray):
        n = len(vectors)
        size = np.maximum(np.sqrt((vectors.astype("float64") ** 2).sum(axis=1, keepdims=True)), 1e-300)
        self.x = np.zeros((n + 1, vectors.shape[1]), dtype="float32")
        self.x[:n] = vectors / size
        self.none = n
        self.sizes = [n]
        while self.sizes[-1] > CHOSEN * 2:  # of the nodes of a layer, one in CHOSEN is on the next
            self.sizes.append(-(-self.sizes[-1] // CHOSEN))
        self.links = [np.full((s, PLACES if i == 0 else UPPER_PLACES), n, dtype="int32") for i, s in enumerate(self.sizes)]

    def build(self) -> Layers:
        a = 0
        while a < self.none:
            z = min(self.none, a + max(min(BATCH, a // 2), 2 * CHOSEN if a == 0 else 1))
            self._join(a, z)
            a = z
        return self

    def _layer(self, i: int) -> np.ndarray:
        return np.where(self.links[i] == self.none, self.sizes[i], self.links[i])

    def _join(self, a: int, z: int) -> None:
        """Nodes a to z, which see all nodes before a and one another."""
        q = self.x[a:z]
        entry = np.zeros((z - a, 1), dtype="int32")
        for i in reversed(range(len(self.sizes))):
            here = max(0, min(self.sizes[i], z) - a)  # of the batch, the first ones are on this layer
            found = np.full((z - a, 1), self.none, dtype="int32")
            if a:
                links, x = self._at(i, min(a, self.sizes[i]))
                nodes, sims = np.full((z - a, BUILD_BEAM), self.none, dtype="int32"), np.full((z - a, BUILD_BEAM), -np.inf, dtype="float32")
                for lo, hi, keep in ((0, here, BUILD_BEAM), (here, z - a, STEP)):
                    if hi > lo:
                        got, s = beam(x, links, q[lo:hi], entry[lo:hi], keep)
                        nodes[lo:hi, : got.shape[1]], sims[lo:hi, : got.shape[1]] = np.where(s > -np.inf, got, self.none), s
                found = nodes
                entry = nodes[:, :1]
            if not here:
                continue
            mates = self.x[a : a + here] @ self.x[a : a + here].T
            np.fill_diagonal(mates, -np.inf)
            most = min(MATES if a else 2 * CHOSEN, here)
            order = np.argsort(-mates, axis=1, kind="stable")[:, :most]
            mate_sims = np.take_along_axis(mates, order, axis=1)
            cand = np.where(mate_sims > -np.inf, order + a, self.none).astype("int32")
            if a:
                cand, mate_sims = np.concatenate((found[:here], cand), axis=1), np.concatenate((sims[:here], mate_sims), axis=1)
            cand, mate_sims = _best(cand, mate_sims, cand.shape[1])
            picked = choose(self.x, cand, mate_sims, CHOSEN, self.none)
            self.links[i][a : a + here, : picked.shape[1]] = picked
            self._link_back(i, np.repeat(np.arange(a, a + here), picked.shape[1]), picked.ravel())

    def _at(self, i: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Layer i as it is among its first n nodes: neighbours beyond them do not exist yet."""
        links = np.minimum(self.links[i][:n], n)
        return links, np.concatenate((self.x[:n], self.x[self.none :]))

    def _link_back(self, i: int, source: np.ndarray, target: np.ndarray) -> None:
        """Each target gets its source; a list without room for all is chosen again from old and new."""
        links, places = self.links[i], self.links[i].shape[1]
        real = target != self.none
        source, target = source[real], target[real]
        fresh = ~(links[target] == source[:, None]).any(axis=1)  # mates may have chosen each other
        source, target = source[fresh], target[fresh]
        order = np.lexsort((source, target))
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        held = (links[nodes] != self.none).sum(axis=1)
        fits = held + count <= places
        place = np.arange(len(target)) - np.repeat(first, count)  # the how manyth new one of its target
        simple = np.repeat(fits, count)
        links[target[simple], (np.repeat(held, count) + place)[simple]] = source[simple]
        full = np.nonzero(~fits)[0]
        full = full[np.argsort(count[full], kind="stable")]
        for some in np.array_split(full, -(-len(full) // 512)) if len(full) else []:
            wide = places + int(count[some].max())
            cand = np.full((len(some), wide), self.none, dtype="int32")
            cand[:, :places] = links[nodes[some]]
            for j, k in enumerate(some.tolist()):
                cand[j, places : places + count[k]] = source[first[k] : first[k] + count[k]]
            sims = np.matmul(self.x[cand], self.x[nodes[some]][:, :, None])[:, :, 0]
            sims[cand == self.none] = -np.inf
            cand, sims = _best(cand, sims, min(wide, 2 * places))
            new = choose(self.x, cand, sims, places * 3 // 4, self.none)
            links[nodes[some]] = self.none
            links[nodes[some], : new.shape[1]] = new


def levels(ids: np.ndarray) -> np.ndarray:
    """An order of nodes by chance that depends on their ids alone."""
    z = ids.astype("uint64") + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return np.argsort(z ^ (z >> np.uint64(31)), kind="stable")


def _built(keep: int):
    def run(group: pa.Table) -> pa.Table:
        """The graph of a shard: equal vectors are one node with its `keep` smallest ids."""
        group = group.combine_chunks()
        ids = group.column("vec_id").to_numpy()
        vectors = np.ascontiguousarray(group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
        vectors = vectors + vectors.dtype.type(0)  # -0 is 0
        by = np.argsort(ids, kind="stable")
        ids, vectors = ids[by], vectors[by]
        _, first, of = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        node = np.argsort(levels(ids[first]))  # class -> node
        rows = np.argsort(node[of], kind="stable")
        at = node[of][rows]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        held = rank < keep
        starts = np.searchsorted(at[held], np.arange(len(first) + 1))
        own = np.empty(len(first), dtype="int64")
        own[node] = first
        vectors = vectors[own]
        graph = Layers(unit(vectors.astype("float64"))).build()
        links = np.concatenate([x.ravel() for x in graph.links])
        return pa.table({
            "shard": group.column("shard").slice(0, 1), "width": pa.array([vectors.shape[1]], pa.int32()), "vectors": pa.array([vectors.astype("float64" if vectors.dtype == "float64" else "float32").tobytes()], pa.binary()),
            "starts": pa.array([starts.astype("<i4").tobytes()], pa.binary()), "members": pa.array([ids[rows][held].astype("<i8").tobytes()], pa.binary()),
            "sizes": pa.array([graph.sizes], pa.list_(pa.int32())), "links": pa.array([links.astype("<i4").tobytes()], pa.binary())})

    return run


class Graph:
    """A shard's graph, read back from its row."""

    def __init__(self, row: dict, kind: str):
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(-1, row["width"]).astype("float64")
        self.starts, self.members = np.frombuffer(row["starts"], "<i4"), np.frombuffer(row["members"], "<i8")
        flat, at, n = np.frombuffer(row["links"], "<i4"), 0, len(self.vectors)
        self.links = []
        for i, size in enumerate(row["sizes"]):
            places = PLACES if i == 0 else UPPER_PLACES
            self.links.append(np.minimum(flat[at : at + size * places].reshape(size, places), size))
            at += size * places
        self.scaled = unit(self.vectors)
        self.norm = np.sqrt(dots(self.scaled, self.scaled))
        self.x = np.zeros((n + 1, row["width"]), dtype="float32")
        self.x[:n] = self.scaled / self.norm[:, None]

    def near(self, q: np.ndarray, keep: int) -> np.ndarray:
        """Nodes near each row of q, from the top layer down; all of a graph of no more than `keep`."""
        n = len(self.vectors)
        if n <= keep:
            return np.broadcast_to(np.arange(n), (len(q), n))
        unit_q = (q / np.sqrt(dots(q, q))[:, None]).astype("float32")
        entry = np.zeros((len(q), 1), dtype="int32")
        for i in reversed(range(len(self.links))):
            size = len(self.links[i])
            x = self.x if size == n else np.concatenate((self.x[:size], self.x[n:]))
            nodes, sims = beam(x, self.links[i], unit_q, entry, keep if i == 0 else STEP)
            entry = np.where(sims > -np.inf, nodes, nodes[:, :1])[:, : STEP if i else None]
            if i:
                entry = np.sort(entry, axis=1)
                entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = len(self.links[i - 1])
        return entry

    def answers(self, ids: np.ndarray, vectors: np.ndarray, k: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k nearest rows found for each query, by exact score."""
        q = unit(vectors)
        nodes = self.near(q, keep)
        score = dots(self.scaled[nodes], q[:, None]) / (self.norm[nodes] * np.sqrt(dots(q, q))[:, None])
        lowest = self.members[self.starts[nodes]]
        order = np.lexsort((lowest, -score), axis=1)[:, : k + 1]  # a query's own row may be one of them
        nodes, score = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(score, order, axis=1)
        count = np.minimum(np.diff(self.starts)[nodes], k + 1)
        place = np.arange(k + 1)[None, None]
        rows = self.members[np.minimum(self.starts[nodes][:, :, None] + place, len(self.members) - 1)].reshape(len(q), -1)
        bad = (place >= count[:, :, None]).reshape(len(q), -1) | (rows == ids[:, None])
        score = np.where(bad, -np.inf, np.repeat(score, k + 1, axis=1))
        order = np.lexsort((rows, -score), axis=1)[:, :k]
        rows, score = np.take_along_axis(rows, order, axis=1), np.take_along_axis(score, order, axis=1)
        r, c = np.nonzero(score > -np.inf)
        return ids[r], rows[r, c], score[r, c]


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows that take part."""
    x = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.where("vec_id IS NOT NULL").where(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0))


def index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graphs of all rows, written: one row a shard (and width of vector), its arrays flat."""
    rows = valid(vectors)
    shards = max(1, math.ceil(rows.count() / shard_rows))
    dealt = rows.withColumns({"shard": F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"), "width": F.size("embedding")})
    return materialise(dealt.groupBy("shard", "width").applyInArrow(_built(k + 1), GRAPH), "hnsw-graphs")


def search(graphs: DataFrame, queries: DataFrame, k: int, keep: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of each query (vec_id, embedding) found in the graphs."""
    kind = "<f8" if dict(queries.dtypes)["embedding"] == "array<double>" else "<f4"
    one = Window.partitionBy("vec_id").orderBy("embedding")
    wanted = valid(queries).withColumn("_r", F.row_number().over(one)).where("_r = 1").select("vec_id", "embedding").orderBy("vec_id")
    found = [materialise(_searched(graphs, block, k, keep, kind), "hnsw-found", keep=True) for block in _blocks(wanted.toLocalIterator())]
    if not found:
        return queries.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(rows: Iterator[Row]) -> Iterator[list[Row]]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 8 * len(r["embedding"])
        if len(held) >= MAX_QUERIES or size >= MAX_QUERY_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _searched(graphs: DataFrame, block: list[Row], k: int, keep: int, kind: str) -> DataFrame:
    """The nearest rows that each shard has for each query of a block."""
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w in {len(r["embedding"]) for r in block}:
        some = [r for r in block if len(r["embedding"]) == w]
        by_width[w] = np.array([r["vec_id"] for r in some], dtype="int64"), np.array([r["embedding"] for r in some], dtype="float64")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["width"] not in by_width:
                    continue
                ids, vectors = by_width[row["width"]]
                graph = Graph(row, kind)
                for a in range(0, len(ids), BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in graph.answers(ids[a : a + BATCH], vectors[a : a + BATCH], k, keep)], ["query_id", "vec_id", "score"])

    return graphs.repartition("shard", "width").mapInArrow(released(run), "query_id bigint, vec_id bigint, score double")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, keep: int = BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query its k nearest rows of vectors but its own, ties to the smaller id."""
    graphs = index(vectors, k, shard_rows)
    found = search(graphs, queries, k, keep)  # written by now
    discard(graphs)
    return found


def op12_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where("vec_id % 50 = 0"))


#: Exact search, which the graph's answers equal on small tables. Sums are taken in order, as the operator takes them.
_DOT = "list_reduce(list_transform(range(1, len(a) + 1), lambda i: CAST(a[i] AS DOUBLE) * CAST(b[i] AS DOUBLE)), lambda s, v: s + v)"
ORACLE = {
    "op12_hnsw": f"""
        WITH v AS MATERIALIZED (SELECT vec_id, embedding AS e, sqrt({_DOT.replace("a[i]", "embedding[i]").replace("b[i]", "embedding[i]").replace("len(a)", "len(embedding)")}) AS norm FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, {_DOT.replace("a[i]", "c.e[i]").replace("b[i]", "q.e[i]").replace("len(a)", "len(c.e)")} / (c.norm * q.norm) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id != c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
QUERIES = {"op12_hnsw": op12_hnsw}
