"""The Merkle manifest against a plain recursive tree."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, leaf string, pos long, n long, grp string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Levels of a tree, from the leaves to the root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, i):
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        yield "".join(run[: i % 8]), "".join(run[i % 8 + 1 :])
        i //= 8


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([y[2] for y in sorted(by[x], key=lambda y: y[:3])]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    root, out = top[-1][0], []
    for at, x in enumerate(langs):
        for i, (_, _, own, r) in enumerate(sorted(by[x], key=lambda y: y[:3])):
            path = [*siblings(trees[x], i), *siblings(top, at)]
            fold = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                fold = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in path:
                fold = h(a + fold + b)
            out.append((r[0], own, trees[x][-1][0], root, h("".join(a + b for a, b in path)), fold, fold == root))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return sorted(map(tuple, merkle.manifest(df, tampered=F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower), **more).collect()), key=str)


def rows(n, langs=("en", "de", None, "é", "z")):
    return [(i * 7 % n, f"s{i % 3}" if i % 11 else None, langs[i % len(langs)], i if i % 13 else None, f"Text {i} of É" if i % 17 else None) for i in range(n)]


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_equals_a_plain_tree(spark, levels):
    odd = [(None, "s", "en", 1, "No Id"), (5, None, None, None, None), (9, "s", "en", 3, ""), (9, "s", "en", 3, ""), (9, "s", "en", 3, "Again"), (10, "s", "en", 90000, "Long " * 18000), (11, "s", "", 1, "A")]
    got = run(spark, rows(700) + odd, levels=levels)  # small blocks make more layers above them
    assert got == plain(rows(700) + odd)
    assert {r[6] for r in got} == {True, False}


def test_single_rows_and_empty_tables(spark):
    for some in ([(0, "s", "en", 1, "A")], [(i, "s", "en", 1, "A") for i in range(9)], [(3, None, None, None, None)], [(i, "s", f"l{i}", 1, "B") for i in range(70)]):
        assert run(spark, some) == plain(some)
    assert run(spark, []) == []


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 500, 512, 513])
def test_traversal_gives_every_path_with_stacks_of_few_nodes(n, monkeypatch):
    leaves = [h(str(i)).encode() for i in range(n)]
    levels = tree([x.decode() for x in leaves])
    top = merkle.height(n, 9)
    assert top == len(levels) - 1 and merkle.root_of(leaves, top).decode() == levels[-1][0]
    most = []
    feed = merkle.Treehash.feed
    monkeypatch.setattr(merkle.Treehash, "feed", lambda self, x: (feed(self, x), most.append(sum(map(len, self.tails))))[0])
    for i, path in enumerate(merkle.paths(leaves, top)):
        assert [(a.decode(), b.decode()) for a, b in path] == list(siblings(levels, i))
    assert max(most, default=0) <= 8 * max(top, 1)
