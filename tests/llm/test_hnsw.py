"""Approximate neighbours against exact search."""

import math

import numpy as np

from skein.llm import hnsw

SCHEMA = "vec_id long, embedding array<double>, label int, score double, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 1, 0.5, 7) for i, x in rows], SCHEMA)


def cosine(a, b):
    def total(x, y):
        s = x[0] * y[0]
        for u, v in zip(x[1:], y[1:]):
            s += u * v
        return s

    return total(a, b) / (math.sqrt(total(b, b)) * math.sqrt(total(a, a)))


def exact(rows, ids, k=5):
    whole = [(i, x) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    out = {}
    for q in ids:
        mine = min((x for i, x in whole if i == q), default=None)
        if mine is not None:
            near = sorted((-cosine(x, mine), i) for i, x in whole if i != q and len(x) == len(mine))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def vectors(n, width=12, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    return [(i, (centres[i % 8] + rng.normal(size=width)).tolist()) for i in range(n)]


def test_graphs_whose_shards_are_searched_whole_equal_exact_search(spark):
    rows = vectors(300)
    df = frame(spark, rows)
    assert found(hnsw.neighbours(df, df.where("vec_id % 50 = 0"), shard_rows=100)) == exact(rows, range(0, 300, 50))


def test_odd_rows_copies_and_ties(spark):
    rows = vectors(60) + [(100 + i, [1.0] * 12) for i in range(40)] + [(200 + i, [float(i + 1)] * 12) for i in range(5)]
    rows += [(300, None), (301, []), (302, [0.0] * 12), (303, [float("nan")] * 12), (304, [None] * 12), (305, [float("inf")] + [1.0] * 11), (None, [1.0] * 12), (306, [1.0, 2.0]), (307, [2.0, 1.0])]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (9, rows[9][1]), (400, [-0.0] + [1.0] * 11), (401, [0.0] + [1.0] * 11), (500, [1e200] * 12), (501, [1e-200] * 12)]
    ids = [0, 7, 9, 100, 139, 200, 300, 302, 306, 400, 500]
    df = frame(spark, rows)
    got, want = found(hnsw.neighbours(df, df.where(df.vec_id.isin(ids)), shard_rows=50)), exact([r for r in rows if r[0] not in (500, 501)], [i for i in ids if i != 500])
    big = got.pop(500)
    assert {i for i, _ in big} <= {501, *range(100, 140), *range(200, 205)} and all(abs(s - 1) < 1e-15 for _, s in big)  # out of the range of plain squares
    near = {q: [(i, round(s, 12)) for i, s in v if i not in (500, 501)] for q, v in got.items()}
    assert near.keys() == want.keys()
    for q, v in near.items():
        if q not in (100, 139, 200):
            assert len(v) >= 4 - (q == 306) * 3 and v == [(i, round(s, 12)) for i, s in want[q]][: len(v)]
    assert got[306] == [(307, cosine([1.0, 2.0], [2.0, 1.0]))] and got[139] == [(i, got[139][0][1]) for i in range(100, 105)]
    assert hnsw.neighbours(frame(spark, []), frame(spark, [])).count() == 0
    one = frame(spark, rows[:1])
    assert hnsw.neighbours(one, one).count() == 0


def test_recall_of_the_graph_on_a_whole_table(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = found(hnsw.op12_hnsw(spark, d))
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    hits = []
    for q, near in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -2
        hits.append(len({i for i, _ in near} & set(ids[np.argsort(-s)[:5]].tolist())) / 5)
    assert len(got) == (ids % 50 == 0).sum() and np.mean(hits) >= 0.97


def test_a_graph_reaches_its_nodes_without_seeing_all():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    g = hnsw.Layers(x).build()
    assert g.sizes == [3000, 188, 12]
    for links, size in zip(g.links, g.sizes, strict=True):
        real = links[links < g.none]
        assert real.max() < size and all(len(set(r[r < g.none].tolist())) == (r < g.none).sum() and i not in r.tolist() for i, r in enumerate(links))
    q = (x[:100] / np.linalg.norm(x[:100], axis=1, keepdims=True)).astype("float32")
    nodes, sims = hnsw.beam(g.x, g.links[0], q, np.zeros((100, 1), "int32"), 64)
    assert (nodes[:, 0] == np.arange(100)).mean() > 0.97 and (np.diff(sims, axis=1) <= 0).all()
