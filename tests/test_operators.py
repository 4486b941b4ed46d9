import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.config import TRUNCATED, preset
from skein.functions import text, web
from skein.operators import knn as search
from skein.operators import ranking, sync
from skein.sources.files import discover, load_text
from skein.sources.snapshot import Snapshot
from skein.streaming.events import change_feed


def direct_round_robin(rows, k, per):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    out = []
    for turn in range(per):
        for g in groups.values():
            if turn < len(g) and len(out) < k:
                out.append(g[turn])
    return (out + [r for r in rows if r not in out])[:k]


def test_round_robin_equals_a_direct_loop(spark):
    rng = random.Random(1)
    rows = [(q, f"s{rng.randint(0, 4)}", i, f"t{q}-{i}") for q in range(40) for i in range(rng.randint(1, 20))]
    df = spark.createDataFrame([(q, i, s, 0.0, t) for q, s, i, t in rows], "q int, pos int, src string, score double, text string")
    for k, per in ((5, 1), (8, 2), (50, 3)):
        got = {}
        for r in ranking.round_robin(df, k, per).orderBy("q", "pos").collect():
            got.setdefault(r.q, []).append(r.text)
        for q in range(40):
            assert got[q] == [r[3] for r in direct_round_robin([r for r in rows if r[0] == q], k, per)]


def test_char_budget_keeps_three_and_cuts(spark):
    df = spark.createDataFrame([(0, i, "x" * n) for i, n in enumerate([400, 400, 400, 400, 50])] + [(1, i, "y" * 10) for i in range(3)], "q int, pos int, text string")
    got = ranking.char_budget(df, 1000).orderBy("q", "pos").collect()
    assert [len(r.text) for r in got if r.q == 0] == [400, 400, 400]
    got = ranking.char_budget(df, 1500).orderBy("q", "pos").collect()
    assert [len(r.text) for r in got if r.q == 0] == [400, 400, 400, 300 + len(TRUNCATED)]
    assert len([r for r in got if r.q == 1]) == 3


def test_threshold_falls_back_to_the_first(spark):
    df = spark.createDataFrame([(0, 0, 0.3), (0, 1, 0.2), (1, 0, 0.9), (1, 1, 0.1)], "q int, pos int, score double")
    assert {(r.q, r.pos) for r in ranking.threshold(df, 0.5).collect()} == {(0, 0), (1, 0)}


def test_presets():
    assert preset("research").top_k == 40 and preset("?").pool == 100


def test_snapshot_versions(spark, tmp_path):
    s = Snapshot(spark, f"file://{tmp_path}/t")
    assert s.version() == 0
    df = spark.createDataFrame([("a", "w"), ("b", "v")], "id string, workspace string")
    s.write(df)
    s.change(lambda d: d.where("workspace = 'w'"))
    assert s.version() == 2 and s.read().count() == 1 and s.read(1).count() == 2
    late = Snapshot(spark, s.root)
    late.version = lambda: 1  # another writer took the next version meanwhile
    with pytest.raises(Exception, match="already exists"):
        late.write(df)
    assert s.version() == 2 and s.read().count() == 1
    s.drop()
    assert s.version() == 0


def test_discover_and_load(spark, tmp_path):
    kept = ("a.md", "sub/b.txt", "build/c.CSS", "dist/vendor/d.tsx", "e.jsonl", "f.xlsx", "g.png")
    for name in (*kept, ".git/c.md", "node_modules/d.md", "Venv/d.md", "e.bin", "x.log", "y.rst", "~$f.docx", "._g.md"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_text("text of " + name)
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    got = {r.file_name: (r.text, r.corrupt) for r in load_text(discover(spark, f"file://{tmp_path}")).collect()}
    want = {n.split("/")[-1]: (None, True) if n.endswith(("xlsx", "png")) else ("text of " + n, False) for n in kept}
    assert got == want | {"bad.txt": (None, True)}


def test_change_feed_upserts(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").write.parquet(src)
    root = f"file://{tmp_path}/out"
    q = change_feed(spark, src, "id long, v string", root, f"{tmp_path}/cp")
    q.processAllAvailable()
    spark.createDataFrame([(2, "c")], "id long, v string").write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.v) for r in Snapshot(spark, root, None).read().collect()} == {(1, "a"), (2, "c")}


def test_sessions_on_a_stream(spark, tmp_path):
    from skein.streaming.events import sessions

    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 09:00:00"), (1, "2024-01-03 09:00:00")], "user_id long, t string").selectExpr("user_id", "CAST(t AS TIMESTAMP_NTZ) AS ts").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("user_id long, ts timestamp_ntz").parquet(f"{tmp_path}/e")
    q = sessions(stream, "2 hours", "1 hour").writeStream.format("memory").queryName("sess").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("sess").collect()) == [1, 2]


def test_links_are_absolute_and_once():
    html = '<a href="/a/">x</a><a href="/a#f">y</a><a href="mailto:z@z">m</a><a href="//H.com/b?q=1">h</a><a>none</a>'
    assert web._links(html, "https://h.com/p/") == ["https://h.com/a", "https://h.com/b?q=1"]


def test_rename_pairs_takes_each_file_once(spark):
    rows = [("w", "a/x.md", "deleted", 1), ("w", "b/x.md", "deleted", 1), ("w", "c/x.md", "new", 1)]
    got = sync.rename_pairs(spark.createDataFrame(rows, "workspace string, file_path string, status string, size long")).collect()
    assert [(r.old_path, r.new_path) for r in got] == [("a/x.md", "c/x.md")]


@pytest.mark.parametrize("key", [None, "workspace"])
def test_knn_goes_through_any_number_of_queries(spark, monkeypatch, key):
    monkeypatch.setattr(search, "MAX_QUERIES", 3)
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], [float(x) for x in rng.integers(0, 9, 4)]) for i in range(60)]
    chunks = spark.createDataFrame(rows, "doc_id long, workspace string, vector array<float>")
    queries = chunks.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "q")
    got = {}
    for r in search.knn(chunks, queries, 4, key=key).orderBy("q", "score", "doc_id").collect():
        got.setdefault(r.q, set()).add((r.doc_id, r.score))
    want = {}
    for q, w, v in rows[::5]:
        near = [(-round(1 / (1 + sum((a - b) ** 2 for a, b in zip(v, x))), 6), i) for i, u, x in rows if key is None or u == w]
        want[q] = {(i, -s) for s, i in sorted(near)[:4]}
    assert got == want and search.knn(chunks, queries.limit(0), 4).count() == 0


def test_a_search_task_is_bounded_by_tiles(monkeypatch):
    """What a task holds besides its best rows does not grow with queries and batches; tiles and blocks of any size give the same."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import Row

    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (4000, 8)).astype("float32")

    class Source:
        def mapInArrow(self, run, schema):
            return run

    def task(n_rows, n_queries):
        held = [Row(q=i, key=None, vector=x[i].tolist()) for i in range(n_queries)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(n_rows), pa.int64()), pa.array(list(x[:n_rows]), pa.list_(pa.float32())), pa.nulls(n_rows, pa.string()), pa.nulls(n_rows, pa.list_(pa.string()))], ["doc_id", "vector", "key", "scopes"])
        run = search._block(Source(), held, [search.Arm(0, 5)], "doc_id")
        tracemalloc.start()
        out = [b.to_pylist() for b in run(iter([batch]))]
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return sorted((r["q"], -r["score"], r["doc_id"]) for b in out for r in b), top

    whole, _ = task(500, 300)
    monkeypatch.setattr(search, "SLICE_SCORES", 1 << 14)
    monkeypatch.setattr(search, "FOUND_SLICE", 64)
    assert task(500, 300)[0] == whole and len(whole) == 1500
    monkeypatch.setattr(search, "SLICE", 256)
    assert task(4000, 256)[1] < 4_000_000  # 256 * 4000 scores at once would take 8 MB an array
    blocks = lambda k: [len(b) for b in search._blocks(iter([Row(q=i, key=None, vector=[1.0]) for i in range(25)]), [search.Arm(0, k), search.Arm(1, 2)])]
    monkeypatch.setattr(search, "MAX_FOUND", 100)
    assert blocks(8) == [10, 10, 5] and blocks(200) == [1] * 25


def test_chunking_is_linear(spark):
    import time

    def took(n):
        df = spark.createDataFrame([("word " * n,)], "t string").cache()
        df.count()
        began = time.perf_counter()
        assert df.select(F.size(text.chunk_words(F.col("t"), 1024, 200)).alias("n")).first()["n"] == -(-(n - 200) // 824)
        return time.perf_counter() - began

    took(1000)
    assert took(800_000) < 8 * max(0.3, took(200_000))


def test_index_documents_equals_plain_python(spark, sf_dir):
    from skein.plans import documents

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    lead = {r.doc_id: r.summary for r in documents.summary(spark, sf_dir).collect()}
    words = {}
    for r in documents.keyword_topn(spark, sf_dir).orderBy("doc_id", "rank").collect():
        words.setdefault(r.doc_id, []).append(r.keyword)
    want = set()
    for i, r in docs.items():
        w = (r.text or "").split()
        for n in range(max(-(-(len(w) - 200) // 824), 1) if w else 0):
            chunk = " ".join(w[n * 824 : n * 824 + 1024])
            body = f"[Context: {lead[i]} | Keywords: {', '.join(words.get(i, [])) or 'general'}]\n---\n{chunk}"
            want.add((i, n, f"{r.lang}_{hashlib.sha256(body.encode()).hexdigest()[:20]}", r.lang, hashlib.sha256(chunk.encode()).hexdigest(), 64))
    got = [tuple(r[c] for c in ("doc_id", "ord", "id", "workspace", "content_hash", "width")) for r in documents.index_documents(spark, sf_dir).collect()]
    assert len(got) == len(want) and set(got) == want


def test_embedding_stand_in(spark):
    from skein.plans.documents import embed

    rows = spark.createDataFrame([("a b a",), ("",), (None,)], "t string").select(embed("t").alias("v")).collect()
    v = np.zeros(64)
    for w in "aba":
        h = zlib.crc32(w.encode())
        v[h % 64] += 1 if h & 64 else -1
    assert np.allclose(rows[0].v, v / np.linalg.norm(v)) and not any(rows[1].v) and not any(rows[2].v)


def test_visible_text_and_entities(spark):
    html = [
        '<head><title>T</title></head><body><nav>menu</nav><h1>Head</h1><p>One <b>two</b></p><form>Ask <label>name</label></form><script>x()</script><footer>f</footer></body>',
        '<script type="application/ld+json">[{"@type": ["Product"], "name": "P", "brand": "B", "offers": [{"price": 3}]}, {"@type": "Product", "name": "P"}, {"@type": "Product"}]</script><p>see</p>',
        None]
    got = [r.t for r in spark.createDataFrame([(h,) for h in html], "h string").select(web.html_to_text("h").alias("t")).collect()]
    assert " ".join(got[0].split()) == "Head One two Ask name" and got[1].startswith("Product: P | Brand: B | Price: 3\n\n") and got[1].endswith("see") and got[2] == ""


def test_rename_pairs_in_hot_groups(spark):
    rows = [("w", f"a/{i}.md", "deleted", 0) for i in range(300)] + [("w", f"b/{i}.md", "new", 0) for i in range(300)] + [("w", "c/x.txt", "new", 0), ("w", "a/y.txt", "deleted", 0)]
    got = {(r.old_path, r.new_path) for r in sync.rename_pairs(spark.createDataFrame(rows, "workspace string, file_path string, status string, size long")).collect()}
    assert got == {(f"a/{i}.md", f"b/{i}.md") for i in range(300)}  # the others share neither name nor folder


def test_command_suggestions(spark):
    from skein.functions.scalars import suggested

    df = spark.createDataFrame([("/hepl me",), ("/zzzzqq",), (None,), ("/Folder x",)], "x string")
    assert [r.s for r in df.select(suggested(F.col("x"), ["/help", "/exit", "/folder"]).alias("s")).collect()] == ["/help", None, None, "/folder"]


def test_running_top_k_over_batches(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), "abc"[i % 3], [float(x) for x in rng.integers(0, 3, 4)]) for i in rng.permutation(500)]  # many ties
    chunks = spark.createDataFrame(rows, "doc_id long, workspace string, vector array<float>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = search.scan(chunks, chunks.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "q"), [search.Arm(0, 9, "own"), search.Arm(1, 5, "shared", "a")], "workspace").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for q, w, v in rows:
        if q % 50 == 0:
            for arm, k, ok in ((0, 9, lambda u: u == w), (1, 5, lambda u: u == "a" and w != "a")):
                near = sorted((-round(1 / (1 + sum((a - b) ** 2 for a, b in zip(v, x))), 6), i) for i, u, x in rows if ok(u))[:k]
                want |= {(q, i, -s, arm) for s, i in near}
    assert {(r.q, r.doc_id, r.score, r.arm) for r in got} == want and len(got) == len(want)
