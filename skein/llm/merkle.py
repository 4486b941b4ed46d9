"""Operator 13, Merkle dataset manifest: a hash tree over the rows of a table, with proofs by scheduled tree traversal.

Every row is a leaf. Leaves are numbered within their group (a language) in the order of their ids and cut into aligned blocks
of 8^BLOCK_LEVELS, so that a block's nodes are nodes of the whole tree. In a block, one treehash stack for each level builds the
next run of siblings while the present one is in use, fed by one leaf for each leaf that goes by; what it holds is eight nodes a
level. Above the blocks the same is done with block roots as leaves, again and again until one node a group is left, and once
more over the groups' roots; these upper paths are appended to those of the block's leaves. Only (id, two digests) rows are
shuffled, never texts; numbers come from a range partitioning and counts by partition, so no group is in one task.

Defined results: rows of one id are ordered by their leaf digests; a null id comes first and is not tampered with; a null group
is a group of its own, before the others; a null field is `-`; a repeated row is a leaf each time. Other columns, whatever their
names, are ignored. An empty table has no leaves and gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, released, small, table, temporary

ARITY = 8
#: Levels of a block: it has ARITY ** BLOCK_LEVELS leaves at most.
BLOCK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:binary,right:binary>>"


def digest(*parts: bytes) -> bytes:
    """The hash of digests as hex text, as hex text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def height(nodes: int, most: int) -> int:
    """Levels above `nodes` nodes until one is left, or most."""
    h = 0
    while nodes > 1 and h < most:
        nodes, h = -(-nodes // ARITY), h + 1
    return h


class Treehash:
    """Nodes of one height from leaves that come one by one; it holds fewer than ARITY nodes of each lower level."""

    def __init__(self, top: int):
        self.top, self.tails = top, [[] for _ in range(top + 1)]

    def feed(self, leaf: bytes) -> None:
        tails, h = self.tails, 0
        tails[0].append(leaf)
        while h < self.top and len(tails[h]) == ARITY:
            tails[h + 1].append(digest(*tails[h]))
            tails[h].clear()
            h += 1

    def close(self) -> list[bytes]:
        """The nodes, after the last leaf; a last run with fewer nodes, even one, is hashed as it is."""
        for h in range(self.top):
            if self.tails[h]:
                self.tails[h + 1].append(digest(*self.tails[h]))
                self.tails[h].clear()
        return self.tails[self.top]


def root_of(leaves: Sequence[bytes], top: int) -> bytes:
    tree = Treehash(top)
    for leaf in leaves:
        tree.feed(leaf)
    return tree.close()[0]


def paths(leaves: Sequence[bytes], top: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """For each leaf its siblings left and right of it, level by level; the list is the same object, brought forward leaf by leaf."""
    n, span = len(leaves), [ARITY ** (h + 1) for h in range(top)]
    runs, coming = [], [Treehash(h) for h in range(top)]
    for h in range(top):
        first = Treehash(h)
        for leaf in leaves[: span[h]]:
            first.feed(leaf)
        runs.append(first.close())
    path = [(b"", b"".join(r[1:])) for r in runs]
    for i in range(n):
        yield path
        for h in range(top):  # by the time that a run is used up, its successor is whole
            if i + span[h] < n:
                coming[h].feed(leaves[i + span[h]])
        for h in range(top):
            step = ARITY**h
            if (i + 1) % step:
                break
            if (i + 1) % span[h] == 0:
                runs[h], coming[h] = coming[h].close(), Treehash(h)
            own = (i + 1) // step % ARITY
            path[h] = (b"".join(runs[h][:own]), b"".join(runs[h][own + 1 :]))


def folded(node: bytes, path: Sequence[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and its siblings give."""
    for left, right in path:
        node = digest(left, node, right)
    return node


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with pos (from 0, in each group by order) and n (the group's rows); the order must tell all rows apart that differ."""
    keys = [F.col(group), *(F.asc_nulls_first(c) for c in order)]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    placed = materialise(placed, name)
    part = F.shiftright("at", 33)
    counts = materialise(placed.groupBy(group, part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("held")), f"{name}-counts")
    # a row for each partition and group, not for each leaf
    own = f"PARTITION BY {group}"
    starts = counts.selectExpr(f"{group} AS of_group", "part AS of_part", "first", f"sum(held) OVER ({own} ORDER BY part) - held AS before", f"sum(held) OVER ({own}) AS n")
    starts = small(materialise(starts, f"{name}-starts"), 96)
    joined = placed.join(starts, (F.col(group) == F.col("of_group")) & (part == F.col("of_part")))
    return joined.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("of_group", "of_part", "first", "before", "at")


def _block(pos: Column, levels: int) -> Column:
    return F.floor(pos / ARITY**levels)


def climb(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes: grp, pos, n, node. (grp, pos, path, root) of each: its siblings' digests level by level up to its group's root."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("pos")
        n = rows.column("n")[0].as_py()
        top = height(n, levels)
        leaves = rows.column("node").to_pylist()
        root, found = root_of(leaves, top), [[{"left": a, "right": b} for a, b in p] for p in paths(leaves, top)]
        kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
        return pa.table({"grp": rows.column("grp"), "pos": rows.column("pos"), "n": rows.column("n"), "path": pa.array(found, kind), "root": pa.array([root] * len(leaves), pa.binary())})

    layers = []
    while True:
        layer = nodes.groupBy("grp", _block(F.col("pos"), levels)).applyInArrow(run, f"grp string, pos bigint, n bigint, path {PATH}, root binary")
        layers.append(materialise(layer, "merkle-layer"))
        if (layers[-1].agg(F.max("n")).first()[0] or 0) <= ARITY**levels:
            break
        first = F.col("pos") % ARITY**levels == 0
        nodes = layers[-1].where(first).select("grp", _block(F.col("pos"), levels).alias("pos"), F.ceil(F.col("n") / ARITY**levels).alias("n"), F.col("root").alias("node"))
    out = layers.pop().select("grp", "pos", "path", "root")
    while layers:
        up = out.select(F.col("grp").alias("u_grp"), F.col("pos").alias("u_pos"), F.col("path").alias("u_path"), F.col("root").alias("u_root"))
        low = layers.pop()
        out = low.join(up, (low["grp"] == up["u_grp"]) & (_block(low["pos"], levels) == up["u_pos"])).select("grp", "pos", F.concat("path", "u_path").alias("path"), F.col("u_root").alias("root"))
    return out


def leaf_digest(docs: DataFrame, text: Column | None = None) -> Column:
    """The hash of a row's fields, each as its length in bytes and its value; text: in place of the row's own."""

    def field(c: str) -> Column:
        value = text if c == "text" and text is not None else docs[c].cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, FIELDS)), 256)


def _packed(leaves: DataFrame, levels: int) -> DataFrame:
    """A row for each block of leaves: grp, block, n (of the group), root, and its rows side by side."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("pos").combine_chunks()
        digests, other = rows.column("leaf").to_pylist(), rows.column("other").to_pylist()
        root = root_of([d.hex().encode() for d in digests], height(rows.column("n")[0].as_py(), levels))
        changed = np.array([o is not None for o in other], dtype="u1")
        return pa.table({
            "grp": rows.column("grp").slice(0, 1), "block": pa.array([rows.column("pos")[0].as_py() // ARITY**levels], pa.int64()), "n": rows.column("n").slice(0, 1), "root": pa.array([root], pa.binary()),
            "ids": pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())), "leaves": pa.array([b"".join(digests)], pa.binary()),
            "changed": pa.array([changed.tobytes()], pa.binary()), "others": pa.array([b"".join(o for o in other if o is not None)], pa.binary())})

    return leaves.groupBy("grp", _block(F.col("pos"), levels)).applyInArrow(run, "grp string, block bigint, n bigint, root binary, ids array<bigint>, leaves binary, changed binary, others binary")


def _proved(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """A row for each leaf of the blocks."""
    for batch in batches:
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
            leaves = [row["leaves"][i : i + 32].hex().encode() for i in range(0, len(row["leaves"]), 32)]
            upper = [(p["left"], p["right"]) for p in row["path"]]
            above = b"".join(a + b for a, b in upper)
            changed, at = row["changed"], 0
            proofs, roots = [], []
            for i, path in enumerate(paths(leaves, height(row["n"], levels))):
                proofs.append(hashlib.sha256(b"".join(a + b for a, b in path) + above).hexdigest())
                leaf = leaves[i]
                if changed[i]:
                    leaf, at = row["others"][at : at + 32].hex().encode(), at + 32
                roots.append(folded(folded(leaf, path), upper).decode())
            n, root = len(leaves), row["root"].decode()
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array([x.decode() for x in leaves]), pa.array([row["subroot"].decode()] * n), pa.array([root] * n), pa.array(proofs), pa.array(roots), pa.array([x == root for x in roots])],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(docs: DataFrame, group: str = "lang", tampered: Column | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs (FIELDS).

    tampered: what a row's text is when its proof is checked, null where it is unchanged; its proof is verified against the root.
    levels: of a block of leaves.
    """
    spark = docs.sparkSession
    changed = F.lit(None).cast("string") if tampered is None else tampered
    leaf, other = F.unhex(leaf_digest(docs)), F.when(changed.isNotNull(), F.unhex(leaf_digest(docs, changed)))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("1"), docs[group].cast("string")), F.lit("0")).alias("grp"), leaf.alias("leaf"), F.nullif(other, leaf).alias("other"))
    with temporary(spark):
        leaves = numbered(materialise(rows, "merkle-rows"), "grp", ["doc_id", "leaf"], "merkle-leaves")
        blocks = materialise(_packed(leaves, levels), "merkle-blocks", keep=True)
        tops = climb(blocks.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / ARITY**levels).alias("n"), F.col("root").alias("node")), levels)
        tops = materialise(tops, "merkle-tops")
        subroots = tops.where("pos = 0").select(F.lit("").alias("whole"), F.col("grp").alias("of"), F.col("root").alias("node"))
        listed = materialise(numbered(subroots, "whole", ["of"], "merkle-groups").select(F.lit("").alias("grp"), "pos", "n", "node", "of"), "merkle-listed")
        over = climb(listed.drop("of"), levels).select(F.col("pos").alias("o_pos"), F.col("path").alias("o_path"), F.col("root").alias("o_root"))
        by_group = listed.join(over, F.col("pos") == F.col("o_pos")).select("of", F.col("node").alias("subroot"), "o_path", F.col("o_root").alias("root"))
        by_group = small(materialise(by_group, "merkle-subroots"), 1 << 14)
        upper = materialise(tops.select("grp", "pos", "path").join(by_group, F.col("grp") == F.col("of")).select(F.col("grp").alias("u_grp"), F.col("pos").alias("u_pos"), F.concat("path", "o_path").alias("path"), "subroot", "root"), "merkle-upper", keep=True)
    held = blocks.select("grp", "block", "n", "ids", "leaves", "changed", "others")
    held = held.join(small(upper, 1 << 14), (F.col("grp") == F.col("u_grp")) & (F.col("block") == F.col("u_pos"))).drop("grp", "block", "u_grp", "u_pos")
    return held.mapInArrow(released(lambda batches: _proved(batches, levels)), "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest(docs, tampered=F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower))


def _sql(levels: int = 7, group_levels: int = 3) -> str:
    """Level by level; enough for 8^levels rows of a language and 8^group_levels languages."""
    crc = "list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [
        f"leaves AS MATERIALIZED (SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS used FROM documents)",
        "numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
        "n0 AS (SELECT g, pos, n, leaf AS node FROM numbered)",
        "f0 AS (SELECT doc_id, g, pos, leaf, used AS fold, '' AS proof FROM numbered)"]

    def climb(n: str, f: str, count: int) -> None:
        for level in range(count):
            a, b = (f"{n}{level}", f"{n}{level + 1}")
            out.append(f"r{n}{level} AS MATERIALIZED (SELECT g, pos // 8 AS run, any_value(n) AS n, list(node ORDER BY pos) AS nodes FROM {a} GROUP BY g, pos // 8)")
            out.append(f"{b} AS (SELECT g, run AS pos, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node FROM r{n}{level})")
            own = f"CAST(s.pos // {8**level} % 8 AS INTEGER)"
            left, right = (f"array_to_string({x}, '')" for x in (f"list_slice(nodes, 1, {own})", f"list_slice(nodes, {own} + 2, len(nodes))"))
            out.append(
                f"""{f}{level + 1} AS MATERIALIZED (SELECT s.* REPLACE (CASE WHEN n = 1 THEN fold ELSE sha256({left} || fold || {right}) END AS fold,
                    CASE WHEN n = 1 THEN proof ELSE proof || {left} || {right} END AS proof) FROM {f}{level} s JOIN r{n}{level} r ON s.g = r.g AND s.pos // {8 ** (level + 1)} = r.run)""")

    climb("n", "f", levels)
    out.append(f"s0 AS MATERIALIZED (SELECT '' AS g, g AS lang, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, node FROM n{levels})")
    out.append(f"h0 AS (SELECT f.doc_id, '' AS g, s0.pos, f.leaf, f.fold, f.proof, s0.node AS subroot FROM f{levels} f JOIN s0 ON f.g = s0.lang)")
    climb("s", "h", group_levels)
    return f"""WITH {", ".join(out)}
        SELECT doc_id, leaf, subroot, (SELECT node FROM s{group_levels}) AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = (SELECT node FROM s{group_levels}) AS verified FROM h{group_levels}"""


QUERIES = {"op13_merkle": op13_merkle}
ORACLE = {"op13_merkle": _sql()}
