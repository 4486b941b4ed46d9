"""Conditional requests, single URLs and the unified synchronisation against plain versions."""

import hashlib

from pyspark.sql import functions as F

from skein.functions import web
from skein.operators import fetch

SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()
WEB = "page_id long, url string, html string, etag string, last_modified string, title string"


def site(spark):
    rows = [(i, f"https://a.org/p{i}", f"<title>T{i}</title><p>page {i} " + "text " * 10, f"e{i}", f"2024-01-{i + 1:02d}", "clash") for i in range(8)]
    rows += [(50, "https://a.org/p1/", "<p>later page of one address", "x", None, ""), (60, "https://a.org/none", None, "e", None, ""), (61, None, "<p>", "e", None, ""), (62, "https://a.org/private/x", "<p>secret", "e", None, ""), (63, "https://a.org/bare", "<p>no headers", None, None, "")]
    rows += [(70, "https://a.org/news/2023/05/06/x", "<p>short", None, None, ""), (1, "https://a.org/p1", "<title>T1</title><p>page 1 " + "text " * 10, "e1", "2024-01-02", "")]
    return spark.createDataFrame(rows, WEB)


def rules(spark):
    return web.robots_rules(spark.createDataFrame([("https://a.org", 0, "User-agent: *"), ("https://a.org", 1, "Disallow: /private/")], "origin string, line_no int, line string"))


def test_answers(spark):
    asked = [("a.org/p0", None, None), ("https://a.org/p1#top", "e1", None), ("https://a.org/p2", "old", "2030-01-01"), ("https://a.org/p3", "", "2024-01-04"), ("https://a.org/p4", None, "2024-01-04"), ("https://a.org/none", "e", None),
             ("https://a.org/private/x", "e", None), ("https://a.org/bare", None, "2030-01-01"), (None, None, None), ("https://a.org/p0", None, None), ("https://a.org/news/2023/05/06/x", None, None), ("https://other.org/", None, None)]
    df = spark.createDataFrame([(*a, "clash") for a in asked], "url string, cached_etag string, cached_last_modified string, page_title string")
    got = {r.url: r for r in fetch.fetched(df, site(spark), "2030-05-05", rules(spark)).collect()}
    assert fetch.fetched(df, site(spark), "2030-05-05", rules(spark)).count() == 11  # one for each request that names a URL
    status = {u: r.http_status for u, r in got.items()}
    assert status == {"https://a.org/p0": 200, "https://a.org/p1#top": 304, "https://a.org/p2": 200, "https://a.org/p3": 304, "https://a.org/p4": 200, "https://a.org/none": 404, "https://a.org/private/x": 403, "https://a.org/bare": 200,
                      "https://a.org/news/2023/05/06/x": 200, "https://other.org/": 404}
    a = got["https://a.org/p0"]
    assert (a.title, a.etag, a.last_modified, a.date_confidence, a.content_type, a.is_spa) == ("T0", "e0", "2024-01-01", "http_header", "Web Documentation", False) and a.content_hash == SHA(a.content) and a.n_chars == len(a.content) and "page 0" in a.content
    b = got["https://a.org/p1#top"]
    assert (b.title, b.content, b.content_hash, b.n_chars, b.etag, b.date_confidence) == ("", "", "", 0, "e1", "http_conditional_304")
    c = got["https://a.org/private/x"]
    assert "disallowed" in c.content and c.content_hash == SHA(c.content) and c.date_confidence == "robots_compliance" and c.last_modified == "2030-05-05" and "secret" not in c.content
    assert got["https://other.org/"].content is None and got["https://a.org/bare"].date_confidence == "crawl_timestamp" and got["https://a.org/news/2023/05/06/x"].last_modified == "2023-05-06"
    assert fetch.fetched(df.limit(0), site(spark), "2030-05-05").count() == 0 and fetch.fetched(df, site(spark).limit(0), "2030-05-05").where("http_status <> 404").count() == 0


def test_single_urls_are_indexed_where_they_changed(spark):
    text = F.col("html")
    pages = site(spark)
    reg = spark.createDataFrame([("w", "https://a.org/p0", "t0", None, None, None), ("w", "https://a.org/p1", "t1", "h", "e1", None), ("w", "https://a.org/p2", "t2", SHA("<title>T2</title><p>page 2 " + "text " * 10), "old", None), ("v", "https://a.org/none", "t", "h", "e", "d"), ("v", "https://a.org/p2", "t2", "stale", None, None)],
                                "workspace string, url string, title string, last_hash string, etag string, http_last_modified string")
    told, now = fetch.index_urls(reg, pages, "2030-05-05", text=text)
    got = {(r.workspace, r.url[-2:]): r for r in told.collect()}
    assert {k: r.outcome for k, r in got.items()} == {("w", "p0"): "indexed", ("w", "p1"): "unchanged", ("w", "p2"): "unchanged", ("v", "ne"): "error", ("v", "p2"): "indexed"}
    assert got["w", "p0"].document.startswith("Web Document Title: T0\nSource URL: https://a.org/p0\n\n<title>") and got["w", "p1"].title == "t1" and got["w", "p1"].document is None
    kept = {(r.workspace, r.url[-2:]): (r.title, r.etag, r.http_last_modified) for r in now.collect()}
    assert kept["v", "ne"] == ("t", "e", "d") and kept["w", "p0"] == ("T0", "e0", "2024-01-01") and kept["w", "p2"] == ("t2", "old", None)
    again, _ = fetch.index_urls(now, pages, "2030-05-05", text=text)
    assert {r.outcome for r in again.collect()} == {"unchanged", "error"}
    forced, _ = fetch.index_urls(now, pages, "2030-05-05", text=text, force=True)
    assert [r.outcome for r in forced.where("url = 'https://a.org/p2' AND workspace = 'w'").collect()] == ["indexed"]


def test_a_crawl_skips_at_three_levels(spark):
    pages = site(spark)
    asked = spark.createDataFrame([("https://a.org/p0", "d0"), ("https://a.org/p1", "d1"), ("https://a.org/p2", None), ("https://a.org/p3", None), ("https://a.org/p4", "d4"), ("https://a.org/none", None), ("https://a.org/bare", None)], "url string, lastmod string")
    body = lambda i: f"<title>T{i}</title><p>page {i} " + "text " * 10
    ledger = spark.createDataFrame([("https://a.org/p0", "d0", "x", None, None), ("https://a.org/p1", "d0", SHA(body(1)), "e1", None), ("https://a.org/p2", None, SHA(body(2)), "old", None), ("https://a.org/p3", None, "old", None, None)],
                                   "url string, lastmod string, content_hash string, etag string, http_last_modified string")
    got = {r.url[-2:]: r.status for r in fetch.crawl(asked, ledger, pages, "2030-05-05", text=F.col("html")).collect()}
    assert got == {"p0": "skipped_lastmod", "p1": "skipped_304", "p2": "skipped_hash", "p3": "changed", "p4": "new", "ne": "error", "re": "error"}


def test_unified_synchronisation(spark):
    diff = spark.createDataFrame([("u", "a", "new", 1), ("u", "b", "unchanged", 1), ("v", "c", "unchanged", 1)], "workspace string, file_path string, status string, size long")
    none = spark.createDataFrame([], "workspace string, old_path string, new_path string")
    crawled = spark.createDataFrame([("u", "skipped_304"), ("u", "skipped_hash"), ("w", "changed"), ("w", "error")], "workspace string, status string")
    ws = spark.createDataFrame([(x,) for x in "uvwu"], "workspace string")
    got = sorted(map(tuple, fetch.unified(diff, none, crawled, spark.createDataFrame([("v",)], "workspace string"), ws).collect()))
    assert got == sorted([("u", "folders", "synchronised", 2, 1), ("u", "web", "up_to_date", 2, 0), ("u", "drives", "empty", 0, 0), ("v", "folders", "up_to_date", 1, 0), ("v", "web", "empty", 0, 0), ("v", "drives", "up_to_date", 1, 0),
                          ("w", "folders", "empty", 0, 0), ("w", "web", "synchronised", 2, 1), ("w", "drives", "empty", 0, 0)])


def test_a_url_of_several_pages_has_one_outcome_each(spark, tmp_path):
    import duckdb

    from skein.plans import discovery

    from .oracle import rows

    pages = [(i, f"https://a.org/p{i // 2}", f"<title>T{i}</title>page {i}") for i in range(12)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = rows(discovery.single_url_index(spark, str(tmp_path)).toPandas())
    assert len(got[1]) == 12 and got == rows(con.sql(discovery.ORACLE["single_url_index"]).df())
