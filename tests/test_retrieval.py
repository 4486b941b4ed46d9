"""The inverted-file index, links by automaton and folders by prefix against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import folders, ivf, retrieve
from skein.operators import knn as search
from skein.operators.knn import Arm


def vectors(spark, n, width=8, seed=2):
    rng = np.random.default_rng(seed)
    centres = 3 * rng.normal(size=(12, width))
    rows = [(i, "abc"[i % 3], (centres[i % 12] + rng.normal(size=width)).tolist(), "clash", -1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, workspace string, vector array<double>, probes string, cell_ int")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_index_recall_partitions_and_exactness(spark, tmp_path):
    chunks = vectors(spark, 3000)
    index = ivf.Index.build(chunks, f"file://{tmp_path}/i")
    queries = chunks.where("doc_id % 30 = 7").select(F.col("doc_id").alias("q"), "workspace", "vector")
    true = rows(search.knn(chunks, queries, 10))
    assert rows(index.knn(queries, 10, exact=True)) == true
    got = rows(index.knn(queries, 10))
    assert len(index.centroids) == 55 and index.probes < 30 and index.recall >= 0.95
    assert len({r[:2] for r in got} & {r[:2] for r in true}) / len(true) >= 0.9
    arms = [Arm(0, 5, "own"), Arm(1, 4, "shared", "a")]
    assert rows(index.scan(queries, arms, "workspace", exact=True)) == rows(search.scan(chunks, queries, arms, "workspace"))
    # a search for one query reads only the partitions that it probes
    one = index.knn(queries.limit(1), 10)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters")[1][:200]
    again = ivf.Index.open(spark, index.root)
    assert again.probes == index.probes and rows(again.knn(queries, 10)) == got


def test_index_of_odd_tables(spark, tmp_path):
    chunks = vectors(spark, 40).unionByName(spark.createDataFrame([(100 + i, "a", [0.0] * 8, "", 0) for i in range(300)] + [(7, "a", None, "", 0), (900, None, [1.0] * 8, "", 0)], vectors(spark, 1).schema))
    index = ivf.Index.build(chunks, f"file://{tmp_path}/hot")  # most vectors are equal: cells without rows move, ties go to smaller ids
    q = chunks.where("doc_id IN (3, 150, 900)").select(F.col("doc_id").alias("q"), "workspace", "vector")
    assert rows(index.knn(q, 12, exact=True)) == rows(search.knn(chunks, q, 12))
    assert [r[1] for r in rows(index.knn(q.where("q = 150"), 5))] == [100, 101, 102, 103, 104]
    assert rows(index.knn(q, 6, key="workspace", exact=True)) == rows(search.knn(chunks, q, 6, key="workspace"))
    n = index.rows().count()
    index.add(vectors(spark, 45).where("doc_id >= 40"))
    assert index.rows().count() == n + 5 and index.knn(q.limit(0), 5).count() == 0
    empty = ivf.Index.build(chunks.limit(0), f"file://{tmp_path}/none")
    assert empty.knn(q, 5).count() == 0 and ivf.Index.open(spark, empty.root).probes == 0


def test_recall_on_a_given_table(spark):
    from skein.plans import retrieval

    d = "/root/testdata/sf0.1"
    got = retrieval.ivf_topk(spark, d).collect()
    true = {(r.q, r.doc_id) for r in retrieval.knn_batch_topk(spark, d).collect()}
    assert len({(r.q, r.doc_id) for r in got} & true) / len(true) >= 0.9 and got[0].probes < 45


@pytest.mark.parametrize("size", [16 << 20, 40])
def test_links_equal_a_plain_search(spark, monkeypatch, size):
    monkeypatch.setattr(retrieve, "LINK_BYTES", size)  # a small block makes several automata
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab/") for _ in range(n))
    links = [(f"w{rng.randint(0, 3)}", word(rng.randint(1, 4))) for _ in range(30)] + [("w1", "a\\b"), ("w9", ""), (None, "a"), ("w2", None), ("w1", "a/b")]
    paths = [word(rng.randint(0, 12)) for _ in range(200)] + [None, "", "zzz"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    ln = spark.createDataFrame(links, "workspace string, identifier string")
    got = {r.i: r.s for r in df.select("i", retrieve.linked_scopes(F.col("p"), ln).alias("s")).collect()}
    for i, p in enumerate(paths):
        assert got[i] == ([] if p is None else sorted({w for w, x in links if w and x is not None and x.replace("\\", "/") in p}))
    assert df.select(retrieve.linked_scopes(F.col("p"), ln.limit(0)).alias("s")).where("size(s) > 0").count() == 0


def test_the_plan_does_not_grow_with_links(spark):
    df = spark.createDataFrame([("a/b/c17/d",)], "p string")
    size = []
    for n in (10, 20_000):
        links = spark.range(n).select(F.lit("w").alias("workspace"), F.concat(F.lit("c"), "id").alias("identifier"))
        out = df.select(retrieve.linked_scopes(F.col("p"), links).alias("s"))
        size.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
    assert size[1] < size[0] + 20 and out.first().s == ["w"]


def test_folders_equal_a_plain_prefix_test(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab/") for _ in range(n))
    dirs = [(f"w{rng.randint(0, 4)}", word(rng.randint(1, 5))) for _ in range(25)] * 2 + [(None, "a"), ("w0", None)]
    files = [(i, word(rng.randint(0, 9)), "clash") for i in range(300)] + [(300, None, ""), (301, "", ""), (5, "ab", ""), (5, "ab", "")]
    f = spark.createDataFrame(files, "i int, path string, folder string")
    w = spark.createDataFrame(dirs, "workspace string, folder string")
    want = sorted((i, p, x, ws) for i, p, x in files if p is not None for ws in {a for a, b in dirs if a and b is not None and p.startswith(b)})
    assert rows(folders.under(f, w, "path").select("i", "path", "folder", "workspace")) == want
    everything = spark.createDataFrame([("all", ""), ("all", "x")], w.schema)
    assert folders.under(f, everything, "path").count() == 303 and folders.under(f, w.limit(0), "path").count() == 0 and folders.under(f.limit(0), w, "path").count() == 0
    plan = folders.under(f, w, "path")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
