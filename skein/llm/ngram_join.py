"""Operator 5, n-gram Jaccard join by a count-vector R-tree.

Texts become sets of hashed word shingles. Shingles are hashed into groups, and a text's counts by group are a point: the
overlap of two sets is at most the sum of the smaller of their counts in each group, and, for a node of an R-tree over the
points, at most the same sum with the node's greatest counts. Pairs that survive the bound are verified on whole sets.

1. Texts of equal sets become one node (their class); only classes go on.
2. Any two sets that link share a shingle among the first n - ceil(t n) + 1 of either under one fixed order: their keys. The
   order puts shingles found often last, so few unrelated texts meet; it is fitted on all texts and any order gives the same
   links. A key that one class alone has joins nothing: a first pass shuffles six bytes a key, dealt to buckets of bounded
   size, and leaves a Bloom filter of the keys seen twice, so that hardly any other key is shuffled with its class.
3. Classes that share a key form a group, the R-tree's partition; equal groups are kept once. Each class is first bounded and
   verified against its group's first class, so that large groups of near copies join by checks in proportion to their size.
4. Groups that still hold several components are indexed, in cells of bounded size, by R-trees over their count vectors, which
   are searched with each member for pairs of different components; survivors are verified, and components are taken anew.

Vectors have a group for every four shingles or fewer (256 at least), as those of long texts say nothing in few groups; vectors
of different lengths are compared after folding the longer one, whose groups are parts of the shorter one's.

No links between different sets are lost, no group is collected, nothing is capped. Defined results: null text and text
without words have no shingles and link with nothing; fewer words than a shingle's count as one shingle; repeated rows
are equal texts, rows of one id with several texts are texts of their own, and a null id counts only where its component has
no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialise, released, slices, small, table
from .components import components
from .shingles import shingle_sets, text_buffers

#: Least and greatest count-vector dimensions, and shingles to a dimension; both powers of two.
GROUPS, MOST_GROUPS, PER_GROUP = 256, 1 << 20, 4
#: Shingles put last in the order: at most this many, each seen this often within some block of one task.
COMMON_SHINGLES, COMMON_LEAST = 262_144, 3
COMMON_BLOCK = 1 << 21
#: Keys of a bucket of the first pass, and keys that a task gathers before it deals them out.
BUCKET_KEYS, PACK_KEYS = 1 << 21, 1 << 20
#: Classes of a group that one R-tree cell takes from either of its two chunks, and children of a node of the tree.
CHUNK, FANOUT = 1024, 8
#: Counts compared at a time.
PAIR_CELLS = 1 << 21
_LOW48 = np.uint64((1 << 48) - 1)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    for a, z in slices(batch, 1):
        yield from shingle_sets(*text_buffers(batch.column(1).slice(a, z - a)), k)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def common_shingles(texts: DataFrame, k: int) -> np.ndarray:
    """The shingles most often seen, rarest first: counted over all texts in bounded blocks, equal sets of a block once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[bytes] = set()
        size = 0

        def often() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= COMMON_LEAST
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view("int64")), pa.array(n[keep].astype("int64"))], ["h", "n"])

        for batch in batches:
            for s in _sets(batch, k):
                if (key := hashlib.blake2b(s.tobytes(), digest_size=8).digest()) in seen:
                    continue
                seen.add(key)
                held.append(s)
                size += len(s)
                if size >= COMMON_BLOCK:
                    yield often()
                    held, size = [], 0
                    seen.clear()
        if held:
            yield often()

    found = texts.mapInArrow(released(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "h").limit(COMMON_SHINGLES).toPandas()
    return top["h"].to_numpy("int64").view("uint64")[::-1].copy()


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set it links with."""
    return -(-percent * n // 100)


def classes(texts: DataFrame, k: int, percent: int, common: np.ndarray) -> DataFrame:
    """Per text: n_shingles, digest of its set, its keys (first shingles in the order) and its count vector."""
    order = np.argsort(common)
    ranked, rank = common[order], order.astype("uint64")
    top = np.uint64(1 << 63)

    def rows(ids: pa.Array, sets: Iterator[np.ndarray]) -> pa.RecordBatch:
        n, digest, keys, vec = [], [], [], []
        for s in sets:
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            place = s >> np.uint64(1)
            if len(ranked):
                i = np.searchsorted(ranked, s)
                i[i == len(ranked)] = 0
                hit = ranked[i] == s
                place[hit] = top | rank[i[hit]]
            p = len(s) - needed(len(s), percent) + 1 if len(s) else 0
            keys.append((s[np.argpartition(place, p - 1)[:p]] if p < len(s) else s).view("int64"))
            vec.append(packed(counted(s)) if len(s) else b"")
        lengths = np.array([0, *map(len, keys)], dtype="int64").cumsum().astype("int32")
        flat = np.concatenate(keys) if keys else np.zeros(0, "int64")
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)), pa.array(vec, pa.binary())],
            ["doc_id", "n_shingles", "digest", "keys", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in slices(batch, 1):
                yield rows(batch.column(0).slice(a, z - a), shingle_sets(*text_buffers(batch.column(1).slice(a, z - a)), k))

    return texts.mapInArrow(released(run), "doc_id long, n_shingles long, digest binary, keys array<long>, vec binary")


def counted(s: np.ndarray) -> np.ndarray:
    """Counts of a set by the groups that its shingles' low bits name."""
    dims = GROUPS
    while dims < MOST_GROUPS and dims * PER_GROUP < len(s):
        dims *= 2
    return np.bincount((s & np.uint64(dims - 1)).astype("int64"), minlength=dims)


def folded(v: np.ndarray, dims: int) -> np.ndarray:
    """Count vectors (the last axis) in fewer groups."""
    return v if v.shape[-1] == dims else v.reshape(*v.shape[:-1], -1, dims).sum(axis=-2, dtype="uint32")


def packed(v: np.ndarray) -> bytes:
    """A count vector in the narrowest integers; the first byte tells their width."""
    top = int(v.max())
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + v.astype(f"<u{width}").tobytes()


def unpacked(row: bytes) -> np.ndarray:
    return np.frombuffer(row, dtype=f"<u{row[0]}", offset=1)


def by_dims(rows: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Count vectors of each length: (indices of the rows, matrix)."""
    held: dict[int, list[int]] = {}
    vectors = [unpacked(r) for r in rows]
    for i, v in enumerate(vectors):
        held.setdefault(len(v), []).append(i)
    return {d: (np.array(at), np.stack([vectors[i] for i in at])) for d, at in held.items()}


def overlap_bound(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.minimum(u, v).sum(axis=-1, dtype="int64")


class CountTree:
    """R-tree over count vectors: points sorted by size, then tiled by their most varied coordinates, FANOUT to a node."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        if len(points) <= FANOUT:  # one node of leaves
            self.order, self.levels = np.arange(len(points)), [(points, sizes, sizes)]
            return
        wide = np.argsort(-points.var(axis=0))[:2]
        strip = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // (FANOUT * FANOUT)
        slab = points[:, wide[0]] // max(1, int(points[:, wide[0]].std()))
        self.order = np.lexsort((points[:, wide[1]], slab, strip))
        level = (points[self.order], sizes[self.order], sizes[self.order])
        self.levels = [level]
        while len(level[1]) > FANOUT:
            cuts = np.arange(0, len(level[1]), FANOUT)
            level = (np.maximum.reduceat(level[0], cuts, axis=0), np.minimum.reduceat(level[1], cuts), np.maximum.reduceat(level[2], cuts))
            self.levels.append(level)

    def search(self, qs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a query, index of a point whose set may link with it) for all queries, level by level from the root."""
        t, top = self.percent, len(self.levels[-1][1])
        qi, at = np.repeat(np.arange(len(qs)), top), np.tile(np.arange(top), len(qs))
        most_pairs = max(1, PAIR_CELLS // qs.shape[1])
        for depth, (high, least, most) in enumerate(reversed(self.levels)):
            if depth:
                qi, at = np.repeat(qi, FANOUT), (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                qi, at = qi[at < len(least)], at[at < len(least)]
            m = n[qi]
            fits = (t * least[at] <= 100 * m) & (100 * most[at] >= t * m)
            qi, at, m = qi[fits], at[fits], m[fits]
            want = t * (m + np.maximum(least[at], -(-t * m // 100)))
            keep = np.empty(len(at), dtype=bool)
            for a in range(0, len(at), most_pairs):
                z = a + most_pairs
                keep[a:z] = (100 + t) * overlap_bound(high[at[a:z]], qs[qi[a:z]]) >= want[a:z]
            qi, at = qi[keep], at[keep]
        return qi, self.order[at]

    def near(self, q: np.ndarray, n: int) -> np.ndarray:
        """Indices of the points whose set may link with one of n shingles counted by q."""
        return self.search(q[None], np.array([n]))[1]


def near_pairs(vectors: list[bytes], sizes: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one of left and one of right, of different components, whose sets may link: an R-tree for each length of vectors."""
    points = by_dims([vectors[i] for i in right])
    queries = points if left is right else by_dims([vectors[i] for i in left])
    for dp, (to, ps) in points.items():
        to = right[to]
        least, most = percent * int(sizes[to].min()), -(-100 * int(sizes[to].max()) // percent)
        trees: dict[int, CountTree] = {}
        for dq, (at, qs) in queries.items():
            at = left[at]
            able = (100 * sizes[at] >= least) & (sizes[at] <= most)  # of a size with some point
            if not able.any():
                continue
            d = min(dp, dq)
            if d not in trees:
                trees[d] = CountTree(folded(ps, d), sizes[to], percent)
            i, j = trees[d].search(folded(qs[able], d), sizes[at[able]])
            i, j = at[able][i], to[j]
            apart = comp[i] != comp[j]
            yield i[apart], j[apart]


def search_cells(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that survive the bound, once for each cell that finds them."""

    def pairs(node: np.ndarray, comp: np.ndarray, n: np.ndarray, vec: list[bytes], query: np.ndarray, point: np.ndarray) -> np.ndarray:
        left, right = np.flatnonzero(query), np.flatnonzero(point)
        if len(left) == len(right) == len(node):
            left = right
        out = [np.stack((node[i], node[j]), axis=1) for i, j in near_pairs(vec, n, comp, left, right, percent)]
        return np.sort(np.concatenate(out), axis=1) if out else np.zeros((0, 2), dtype="int64")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; a cell that a batch ends in waits for the next one."""
        held: pa.Table | None = None
        for batch in chain(batches, [None]):
            rows = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if rows is None or not len(rows):
                continue
            gkey = rows.column("gkey").to_numpy()
            new = gkey[1:] != gkey[:-1]
            for c in ("ci", "cj"):
                code = pc.dictionary_encode(rows.column(c).combine_chunks()).indices.to_numpy()
                new = new | (code[1:] != code[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
            cuts += [len(rows)] if batch is None else []
            held = None if batch is None else rows.slice(cuts[-1]).combine_chunks()
            columns = [rows.column(c).to_numpy() for c in ("node", "component", "n_shingles")]
            flags = [rows.column(c).to_numpy() for c in ("as_query", "as_point")]
            vec = rows.column("vec").to_pylist()
            got = [pairs(*(x[a:z] for x in columns), vec[a:z], *(x[a:z] for x in flags)) for a, z in zip(cuts, cuts[1:])]
            found = np.unique(np.concatenate(got), axis=0) if got else np.zeros((0, 2), dtype="int64")
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    dealt = cells.repartition("gkey", "ci", "cj").sortWithinPartitions("gkey", "ci", "cj")
    return dealt.mapInArrow(released(run), "a long, b long")


def bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the bound of their two points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in slices(batch, "va"):
                part = batch.slice(a, z - a)
                m, n = (part.column(c).to_numpy() for c in ("na", "nb"))
                over = np.empty(z - a, dtype="int64")
                for i, (x, y) in enumerate(zip(part.column("va").to_pylist(), part.column("vb").to_pylist())):
                    u, v = unpacked(x), unpacked(y)
                    d = min(len(u), len(v))
                    over[i] = overlap_bound(folded(u, d), folded(v, d))
                yield part.select([0, 1]).filter(pa.array((100 + percent) * over >= percent * (m + n)))

    for end in "ab":
        pairs = pairs.join(points.select(F.col("node").alias(end), F.col("n_shingles").alias("n" + end), F.col("vec").alias("v" + end)), end)
    return pairs.where(f"100 * na >= {percent} * nb and 100 * nb >= {percent} * na").select("a", "b", "na", "nb", "va", "vb").mapInArrow(released(run), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                u, v = (np.frombuffer(s.as_buffer(), dtype="<u8") for s in (x, y))
                if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate((u, v)), kind="stable")
                over = int((both[1:] == both[:-1]).sum())
                keep.append(100 * over >= percent * (len(u) + len(v) - over))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    return two.select("a", "b", "sa", "sb").mapInArrow(released(run), "a long, b long")


def sets_of(texts: DataFrame, reps: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(node, s): the whole sets of the ends of pairs, read from the texts again."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = materialise(ends.join(reps, "node").select("node", "first_id", "digest"), "near-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [x.tobytes() for x in _sets(batch, k)]
            same = [hashlib.blake2b(x, digest_size=16).digest() == d for x, d in zip(s, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.binary())], ["node", "s"]).filter(pa.array(same, pa.bool_()))

    kept = texts.join(small(ids, 56), F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "text", "digest")
    sets = materialise(kept.mapInArrow(released(run), "node long, s binary"), "near-sets")
    return sets if sets.count() <= ids.count() else materialise(sets.dropDuplicates(["node"]), "near-sets")  # repeated rows


def shared_keys(own: DataFrame) -> DataFrame:
    """(gkey, node) of the keys that several classes have, and of few others."""
    total = own.agg(F.sum(F.size("keys"))).first()[0] or 0
    buckets = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_KEYS))

    def named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = keys.view("uint64")
        return (h >> np.uint64(48)) * np.uint64(0x9E3779B1) % np.uint64(buckets), h & _LOW48

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(keys: np.ndarray) -> pa.RecordBatch:
            h, n = np.unique(keys, return_counts=True)
            b, low = named(np.repeat(h, np.minimum(n, 2)))  # twice tells all
            order = np.argsort(b, kind="stable")
            b, raw = b[order], np.ascontiguousarray(low[order].astype("<u8").view("uint8").reshape(-1, 8)[:, :6])
            cuts = np.flatnonzero(np.diff(b)) + 1
            ends = np.concatenate((cuts, [len(b)])) if len(b) else cuts
            starts = np.concatenate(([0], cuts)) if len(b) else cuts
            return pa.RecordBatch.from_arrays([pa.array(b[starts].astype("int64")), pa.array([raw[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())], ["bucket", "blob"])

        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size >= PACK_KEYS:
                yield dealt(np.concatenate(held))
                held, size = [], 0
        if size:
            yield dealt(np.concatenate(held))

    def seen_twice(t: pa.Table) -> pa.Table:
        raw = np.zeros((sum(len(x.as_buffer()) for x in t.column("blob")) // 6, 8), dtype="uint8")
        raw[:, :6] = np.frombuffer(b"".join(t.column("blob").to_pylist()), dtype="uint8").reshape(-1, 6)
        h = np.sort(raw.view("<u8").ravel())
        h = np.unique(h[1:][h[1:] == h[:-1]])
        size = 1 << max(6, int(8 * len(h) - 1).bit_length() if len(h) else 0)
        bits = np.zeros(size, dtype=bool)
        for at in places(h, size):
            bits[at] = True
        kept = np.packbits(bits).tobytes() if len(h) else b""
        return pa.table({"bucket": t.column("bucket")[:1], "bits": pa.array([kept], pa.binary())})

    def places(low: np.ndarray, size: int) -> list[np.ndarray]:
        x = low * np.uint64(0xBF58476D1CE4E5B9)
        return [(x >> np.uint64(40)) & np.uint64(size - 1), (x >> np.uint64(17)) & np.uint64(size - 1)]

    sketch = own.select("keys").mapInArrow(released(pack), "bucket long, blob binary").groupBy("bucket").applyInArrow(seen_twice, "bucket long, bits binary")
    sketch = materialise(sketch.where("length(bits) > 0"), "near-sketch")
    held = sketch.agg(F.sum(F.length("bits") + 64)).first()[0] or 0
    if held > BROADCAST_BYTES:  # too large to send to every task: all keys go on
        return own.select(F.explode("keys").alias("gkey"), "node")
    bits = own.sparkSession.sparkContext.broadcast({r["bucket"]: bytes(r["bits"]) for r in sketch.collect()})

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = bits.value
        for batch in batches:
            lists = batch.column(0)
            keys, node = lists.flatten().to_numpy(), np.repeat(batch.column(1).to_numpy(), np.asarray(lists.value_lengths()))
            b, low = named(keys)
            order = np.argsort(b, kind="stable")
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(b[order])) + 1, [len(order)]))
            keep = np.zeros(len(keys), dtype=bool)
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if i < j and (raw := table_.get(int(b[order[i]]))):
                    part, flags = order[i:j], np.frombuffer(raw, "uint8")
                    keep[part] = np.logical_and.reduce([(flags[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype("uint8")) & 1 for at in places(low[part], 8 * len(raw))])
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(node[keep])], ["gkey", "node"])

    return materialise(own.select("keys", "node").mapInArrow(released(known), "gkey long, node long"), "near-shared")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest id reachable over links)."""
    texts = _texts(docs, id_col, text_col)
    common = common_shingles(texts, k)
    rows = materialise(classes(texts, k, percent, common).withColumn("row", F.monotonically_increasing_id()), "near-rows")
    reps = rows.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "doc_id", "row")).alias("m"), F.count("*").alias("c"))
    reps = materialise(reps.select("digest", F.col("m.doc_id").alias("first_id"), F.col("m.row").alias("row"), "c"), "near-classes")
    # a class goes by its least id, or, where an id is null or has several texts, by the number of its first row
    own_id = reps.groupBy("first_id").count().where("count > 1 OR first_id IS NULL").isEmpty()
    reps = reps.withColumn("node", F.col("first_id" if own_id else "row"))
    copies = rows.select("digest", F.col("row").alias("r")).join(small(reps.where("c > 1").select("digest", "row"), 48), "digest").where("r != row").select(F.col("r").alias("row"))
    copies = materialise(copies, "near-copies")
    own = rows.where("n_shingles > 0").join(small(copies, 16), "row", "left_anti").withColumn("node", F.col("doc_id" if own_id else "row"))

    shared = shared_keys(own)
    groups = shared.groupBy("gkey").agg(F.count("*").alias("c"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 17))").alias("y")).where("c > 1")
    groups = materialise(groups.groupBy("c", "x", "y", "lo", "hi").agg(F.min("gkey").alias("gkey")), "near-groups")
    several = materialise(groups.where("c > 2").select("gkey", "c", "lo"), "near-several")
    members = materialise(shared.join(small(several, 32), "gkey"), "near-members")
    points = own.select("node", "n_shingles", "vec")
    first = groups.where("c = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).union(members.where("node != lo").select(F.col("lo").alias("a"), F.col("node").alias("b")))
    first = materialise(bounded(first.distinct(), points, percent), "near-first")
    links = materialise(verified(first, sets_of(texts, reps, first, k), percent), "near-links")
    label = components(links)

    # Groups of several components, in cells of two chunks of one group (by size, so that far sizes never meet).
    held = members.join(label, "node", "left").select("gkey", "c", "node", F.coalesce("component", "node").alias("component"))
    split = held.groupBy("gkey").agg(F.min("component").alias("l"), F.max("component").alias("m")).where("l != m").select("gkey")
    open_rows = materialise(held.join(split, "gkey", "left_semi").join(points, "node"), "near-open")
    if not open_rows.isEmpty():
        more = materialise(search_cells(cells_of(open_rows, percent), percent).distinct().join(first, ["a", "b"], "left_anti"), "near-more")
        if not more.isEmpty():
            links = materialise(links.union(verified(more, sets_of(texts, reps, more, k), percent)), "near-links")
            label = components(links)

    linked = reps.select("digest", "first_id", "node").join(label, "node", "left")
    least = linked.where("component IS NOT NULL").groupBy("component").agg(F.min("first_id").alias("least"))
    ends = linked.join(least, "component", "left").select("digest", F.coalesce(F.when(F.col("component").isNotNull(), F.col("least")), "first_id").alias("component_id"))
    return rows.select("doc_id", "n_shingles", "digest").join(ends, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def cells_of(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of each group dealt to cells (gkey, ci, cj): small groups have one; others are cut into chunks by size."""
    from pyspark.sql import Window

    yes = F.lit(True)
    keep = ["gkey", "node", "component", "n_shingles", "vec", "ci", "cj", "as_query", "as_point"]
    one = rows.where(F.col("c") <= CHUNK).withColumns({"ci": F.lit(""), "cj": F.lit(""), "as_query": yes, "as_point": yes}).select(keep)
    big = rows.where(F.col("c") > CHUNK)
    if big.isEmpty():
        return one
    # Position by size inside a group: rows per size are counted first, so no task holds a group.
    sizes = big.groupBy("gkey", "n_shingles").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("gkey").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)))
    base = before.select("gkey", "n_shingles", F.floor(F.coalesce("before", F.lit(0)) / CHUNK).alias("base"), F.ceil(F.col("count") / CHUNK).alias("parts"))
    cut = materialise(big.join(base, ["gkey", "n_shingles"]).withColumn("chunk", F.concat_ws(":", "base", F.pmod(F.xxhash64("node"), F.col("parts")))), "near-cut")
    span = cut.groupBy("gkey", "chunk").agg(F.min("n_shingles").alias("a"), F.max("n_shingles").alias("z"))
    span = materialise(span, "near-span")
    i = span.select("gkey", F.col("chunk").alias("ci"), F.col("a").alias("ai"), F.col("z").alias("zi"))
    j = span.select("gkey", F.col("chunk").alias("cj"), F.col("a").alias("aj"), F.col("z").alias("zj"))
    pairs = i.join(j, "gkey").where(f"ci <= cj and 100 * ai <= 10000 * zj / {percent} and 100 * aj <= 10000 * zi / {percent}").select("gkey", "ci", "cj")
    sides = pairs.select("gkey", "ci", "cj", F.col("ci").alias("chunk")).union(pairs.select("gkey", "ci", "cj", F.col("cj").alias("chunk"))).distinct()
    dealt = cut.join(sides, ["gkey", "chunk"]).withColumns({"as_query": F.col("chunk") == F.col("ci"), "as_point": F.col("chunk") == F.col("cj")})
    return one.union(dealt.select(keep))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


QUERIES = {"op5_ngram_join": op5_ngram_join}
ORACLE: dict[str, str] = {}
