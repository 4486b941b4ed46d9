"""Vector code compression against plain Lloyd rounds in Python's whole numbers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np

from skein.llm import codebooks

SCHEMA = "vec_id long, embedding array<double>, label int, code string, bounds binary"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (vec_id, vector, label) in any order; the result by position of the row."""
    kept = [(i, [math.floor(scale * v) for v in x], label) for i, x, label in rows if x and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(first[0][1])
    pad = -width % parts
    kept = [(i, x + [0] * pad, label) for i, x, label in kept if len(x) == width]
    w = (width + pad) // parts

    def cut(x):
        return [x[p * w : (p + 1) * w] for p in range(parts)]

    book = [[cut(x + [0] * pad)[p] for _, x, _ in first if len(x) == width] for p in range(parts)]

    def near(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book[p]))

    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for _, x, _ in kept:
                got[near(cut(x)[p], p)[1]].append(cut(x)[p])
            for e, xs in got.items():
                book[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    sha = hashlib.sha256(",".join(str(v) for p in book for e in p for v in e).encode()).hexdigest()
    coded = []
    for i, x, label in kept:
        at = [near(c, p) for p, c in enumerate(cut(x))]
        coded.append((i, label, "".join(f"{e:02x}" for _, e in at), sum(d for d, _ in at)))
    by = defaultdict(int)
    for _, label, _, error in coded:
        by[label] += error
    most = (1 << 63) - 1
    return sorted(((i, c, min(e, most), min(by[label], most), sha) for i, label, c, e in coded), key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", None) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in codebooks.encode(df, **more).collect()), key=str)


def vectors(n, width=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [(i, (centres[i % 6] + 0.2 * rng.normal(size=width)).tolist(), i % 4 if i % 5 else None) for i in range(n)]


def test_codes_equal_plain_rounds_and_bounds_spare_distances(spark):
    rows = vectors(400)
    random.Random(1).shuffle(rows)
    log = []
    assert run(spark, rows, log=log) == plain(rows)
    assert log[0] == (1.0, True) and log[-1][0] < 0.5 and len(log) == 6
    assert not all(w for _, w in log)  # some passes only return sums


def test_odd_rows_ties_and_repeats(spark):
    rows = vectors(60) + [(100, None, 1), (101, [], 1), (102, [None] * 16, 1), (103, [float("nan")] * 16, 1), (104, [float("inf")] + [0.0] * 15, 1), (105, [0.5] * 7, 1)]
    rows += [(None, [0.25] * 16, None), (3, [0.1] * 16, 2), (3, [0.1] * 16, 2)] + [(200 + i, [0.5] * 16, 9) for i in range(50)]
    assert run(spark, rows) == plain([r for r in rows if r[1] is None or len(r[1]) != 7])
    same = [(i, [1.0, -1.0] * 8, 0) for i in range(20)]  # all entries are equal: the lowest index wins
    assert {r[1] for r in run(spark, same)} == {"00" * 8} and run(spark, same) == plain(same)
    assert run(spark, []) == [] and run(spark, [(1, None, 1)]) == []
    few = vectors(3)
    assert run(spark, few) == plain(few)
    assert run(spark, vectors(40, width=13)) == plain(vectors(40, width=13))  # parts do not divide the width


def test_components_of_any_size_are_exact(spark):
    rows = vectors(30, width=8) + [(50 + i, [s * 10.0**e * (1 + i / 7) for s in (1, -1, 1, -1, 1, 1, -1, 1)], i) for i, e in enumerate([3, 4, 7, 12, 30, 38])]
    assert run(spark, rows, rounds=3) == plain(rows, rounds=3)
    near = [(i, [2.0**30 + (i % 3) / 4096, 0.0], 0) for i in range(12)]  # distances of one beside numbers near 2^42
    assert run(spark, near, parts=1, entries=4) == plain(near, parts=1, entries=4)


def test_groups_hold_every_entry():
    c = np.random.default_rng(0).normal(size=(16, 4))
    g = codebooks.grouped(c, 4)
    assert len(g) == 16 and set(g.tolist()) <= {0, 1, 2, 3} and len(set(g.tolist())) > 1
    assert codebooks.grouped(np.zeros((5, 2)), 4).tolist() == [0] * 5
