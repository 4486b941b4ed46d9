"""Queries of incremental synchronisation, over the driver's tables and inline fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import web
from ..operators import sync
from ..schema import fixture, table
from ..streaming.polling import due_times
from . import discovery

# Snapshots derived from documents: a path of source and id, its length as size, its id as time.
_DISK = "concat(source, '/f', doc_id, '.md')"


def _disk(spark, d):
    docs = table(spark, d, "documents").where("doc_id % 7 <> 0")
    return docs.select(F.col("lang").alias("workspace"), F.expr(_DISK).alias("file_path"), (F.col("doc_id") * 1.0 + F.when(F.col("doc_id") % 5 == 0, 0.5).otherwise(0.0)).cast("double").alias("mtime"), F.col("n_chars").alias("size"))


def _cache(spark, d):
    docs = table(spark, d, "documents").where("doc_id % 11 <> 0")
    return docs.select(F.col("lang").alias("workspace"), F.expr(_DISK).alias("file_path"), (F.col("doc_id") * 1.0).cast("double").alias("mtime"), (F.col("n_chars") + F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0)).alias("size"))


def stat_diff(spark, d):
    return sync.stat_diff(_disk(spark, d), _cache(spark, d))


def change_summary(spark, d):
    return sync.change_summary(*sync.change_scan(_disk(spark, d), _cache(spark, d))[:2])


SOURCES = "('en', 1, 2, 9, 0), ('none', 0, 0, 0, 0), ('web', 0, 2, 7, 1), ('drive', 0, 0, 0, 3)"
SOURCE_COLUMNS = "workspace, n_folders, n_web, web_pages, n_drives"


def change_summary_sources(spark, d):
    return sync.change_scan(_disk(spark, d), _cache(spark, d), fixture(spark, SOURCE_COLUMNS, SOURCES))[2].select("workspace", "up_to_date", "message")


RENAMES = "('w', 'a/one.md', 'deleted', 10), ('w', 'b/one.md', 'new', 10), ('w', 'a/two.txt', 'deleted', 20), ('w', 'a/zwei.txt', 'new', 20), ('w', 'c/x.md', 'deleted', 30), ('w', 'd/y.md', 'new', 30), ('w', 'e/z.md', 'new', 30), ('v', 'q/old.csv', 'deleted', 5), ('v', 'r/other.csv', 'new', 5)"


def rename_pairs(spark, d):
    return sync.rename_pairs(fixture(spark, "workspace, file_path, status, size", RENAMES))


def _moved(spark, d):
    """Two snapshots of all documents: every ninth file has moved to another folder, every tenth is gone, new or changed."""
    docs = table(spark, d, "documents").select(F.col("lang").alias("workspace"), "doc_id", "source", "text", F.col("n_chars").alias("size"))
    file = lambda folder: F.concat(folder, F.lit("/f"), "doc_id", F.lit(".md")).alias("file_path")
    cache = docs.where("doc_id % 10 <> 1").select("workspace", file(F.col("source")), F.lit(1.0).alias("mtime"), "size", "doc_id", "text")
    folder = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("moved/"), "source")).otherwise(F.col("source"))
    disk = docs.where("doc_id % 10 <> 2").select("workspace", file(folder), F.when(F.col("doc_id") % 10 == 3, 2.0).otherwise(1.0).alias("mtime"), "size", "doc_id", "text")
    return disk, cache


def rename_diff(spark, d):
    disk, cache = _moved(spark, d)
    return sync.rename_pairs(sync.stat_diff(disk, cache))


def folder_index(spark, d):
    """Chunks after an incremental index: what was kept, moved or read again, and by which version of the file."""
    disk, cache = _moved(spark, d)
    chunks = cache.select("workspace", "file_path", F.sha2("text", 256).alias("h"), F.lit("old").alias("read"))
    read = lambda files: disk.join(files, ["workspace", "file_path"], "left_semi").select("workspace", "file_path", F.sha2("text", 256).alias("h"), F.lit("new").alias("read"))
    stat = ["workspace", "file_path", "mtime", "size"]
    return sync.index_folders(chunks, disk.select(stat), cache.select(stat), read)[0]


def stat_cache_upsert(spark, d):
    return sync.cache_upsert(_cache(spark, d), _disk(spark, d).where("size % 3 = 0")).groupBy("workspace").agg(F.count("*").alias("n"), F.round(F.sum("mtime"), 2).alias("mtimes"), F.sum("size").alias("sizes"))


def stat_cache_rename(spark, d):
    disk, cache = _moved(spark, d)
    stat = ["workspace", "file_path", "mtime", "size"]
    return sync.cache_rename(cache.select(stat), sync.rename_pairs(sync.stat_diff(disk, cache))).groupBy("workspace").agg(F.count("*").alias("n"), F.sum(F.col("file_path").startswith("moved/").cast("long")).alias("n_moved"))


def stat_cache_clear(spark, d):
    return _cache(spark, d).where("workspace <> 'fr'").groupBy("workspace").agg(F.count("*").alias("n"))


KINDS = "(1, 1, NULL), (2, 3, NULL), (3, NULL, 'section'), (4, 0, 'page'), (5, 1, 'custom')"


def sync_dispatch(spark, d):
    return fixture(spark, "id, page_count, scope", KINDS).select("id", sync.sync_kind(F.col("page_count"), F.col("scope")).alias("kind"))


#: Pages of a site that a crawl reads.
CRAWL_PAGES = 50


def crawl_cap(spark, d):
    """The first pages of each site in the order of a crawl: what one with a limit reads."""
    u = discovery.urls(spark, d).withColumn("site", web.origin(F.col("url")))
    starts = u.groupBy("site").agg(F.min(F.struct(F.length("url"), "url"))["url"].alias("start"))
    ranked = web.ranked_urls(u.join(starts, "site").withColumn("linked", F.lit(False)))
    return ranked.where(F.col("rank") <= CRAWL_PAGES).select("page_id", "url", "rank")


def _crawl(spark, d):
    p = table(spark, d, "pages")
    pages = p.select("url", "page_id", F.when(F.col("page_id") % 3 == 0, "2024-01-01").alias("lastmod"), F.when(F.col("page_id") % 5 == 1, 304).otherwise(200).alias("http_status"),
                     F.sha2("html", 256).alias("content_hash"), F.when(F.col("page_id") % 17 == 0, F.lit(10).cast("long")).otherwise(F.length("html").cast("long")).alias("n_chars"), (F.col("page_id") % 29 == 0).alias("is_spa"))
    led = p.where("page_id % 4 <> 0").groupBy("url").agg(F.max(F.when(F.col("page_id") % 2 == 0, "2024-01-01").otherwise("2023-01-01")).alias("lastmod"), F.max(F.when(F.col("page_id") % 7 == 0, F.lit("old")).otherwise(F.sha2("html", 256))).alias("content_hash"))
    return sync.crawl_status(pages, led)


def crawl_status(spark, d):
    return _crawl(spark, d).select("page_id", "status")


def crawl_index(spark, d):
    """The page table after a crawl: pages that are new or changed give way to what was read, all others stay."""
    from ..operators.dml import replace_files

    rows = table(spark, d, "pages").select(F.lit("w").alias("workspace"), F.col("url").alias("file_path"), "page_id", F.sha2("html", 256).alias("h"))
    old = rows.where("page_id % 4 <> 0").withColumn("h", F.lit("old"))
    read = _crawl(spark, d).where("status IN ('new', 'changed')").select("page_id")
    return replace_files(old, rows.join(read, "page_id", "left_semi").select(*old.columns)).select("page_id", "h")


def stat_cache_map(spark, d):
    """A workspace's stat cache, by path."""
    return _cache(spark, d).where("workspace = 'de'").select("file_path", "mtime", "size")


def lastmod_skip(spark, d):
    return _crawl(spark, d).groupBy((F.col("status") == "skipped_lastmod").alias("skipped")).agg(F.count("*").alias("n"))


def crawl_counters(spark, d):
    return sync.crawl_counters(_crawl(spark, d))


def new_urls(spark, d):
    p = table(spark, d, "pages")
    return p.select("url").distinct().join(p.where("page_id % 2 = 0").select("url"), "url", "left_anti")


def page_ledger_upsert(spark, d):
    p = table(spark, d, "pages").select(F.col("url").alias("url"), F.col("page_id").alias("updated_at"), F.sha2("html", 256).alias("h"), F.col("page_id").alias("created_at"))
    return sync.upsert_latest(p.where("updated_at % 3 <> 0"), p.where("updated_at % 3 = 0"), ["url"], ["created_at"])


DUE = "(1, TIMESTAMP'2024-01-01 00:00:00', 24), (2, TIMESTAMP'2024-01-01 23:00:00', 24), (3, NULL, 24), (4, TIMESTAMP'2024-01-01 12:00:00', 12)"


def polling_due(spark, d):
    s = fixture(spark, "id, last_scraped_at, polling_interval_hours", DUE)
    return sync.due(s, F.lit("2024-01-02 00:00:00").cast("timestamp")).select("id")


def polling_times(spark, d):
    """Every time at which a user fell due, each of a user's events being a reading, with an interval of one to five days."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5 * 24 + 24).alias("hours"))
    until = e.agg(F.max("ts")).first()[0]
    out = due_times(e, F.lit(until))
    return out.select("source", F.unix_micros("last").alias("last_us"), F.unix_micros("due").alias("due_us"))


BARS = "(0, 0, 'scanning', 8), (0, 0, 'x', 8), (5, 10, 'files', 8), (20, 20, 'pages', 10), (1, 3, 'embedding', 8), (3, 16, 'drives', 8), (5, 16, 'files', 8), (7, 7, 'x', 4), (15, 30, 'files', 8), (1, 16, 'files', 8)"


def progress_bar(spark, d):
    return sync.progress(fixture(spark, "current, total, stage, width", BARS), F.col("width")).drop("width")


def page_sum(spark, d):
    rows = fixture(spark, "workspace, page_count", "('a', 3), ('a', 0), ('a', NULL), ('b', 5)")
    return rows.groupBy("workspace").agg(F.sum(F.coalesce(F.nullif("page_count", F.lit(0)), F.lit(1))).alias("pages"))


def distinct_pages(spark, d):
    from ..functions.web import base_domain

    return table(spark, d, "pages").groupBy(base_domain(F.col("url")).alias("domain")).agg(F.countDistinct("url").alias("n_urls"), F.count("*").alias("n_pages"))


_SQL_DISK = "SELECT lang AS workspace, source || '/f' || doc_id || '.md' AS file_path, doc_id + CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE 0 END AS mtime, n_chars AS size FROM documents WHERE doc_id % 7 <> 0"
_SQL_CACHE = "SELECT lang AS workspace, source || '/f' || doc_id || '.md' AS file_path, doc_id AS mtime, n_chars + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 11 <> 0"
_SQL_DIFF = f"""diff AS (SELECT coalesce(d.workspace, c.workspace) AS workspace, coalesce(d.file_path, c.file_path) AS file_path, coalesce(d.size, c.size) AS size,
    CASE WHEN c.file_path IS NULL THEN 'new' WHEN d.file_path IS NULL THEN 'deleted' WHEN abs(d.mtime - c.mtime) > 0.001 OR d.size <> c.size THEN 'modified' ELSE 'unchanged' END AS status
    FROM ({_SQL_DISK}) d FULL OUTER JOIN ({_SQL_CACHE}) c ON d.workspace = c.workspace AND d.file_path = c.file_path)"""
_SQL_PAIRS = """sides AS (SELECT workspace, file_path, status, size, regexp_extract(file_path, '([^/]*)$', 1) AS name, regexp_replace(file_path, '/?[^/]*$', '') AS folder,
        CASE WHEN contains(regexp_extract(file_path, '([^/]*)$', 1), '.') THEN lower(regexp_extract(file_path, '([^.]*)$', 1)) ELSE '' END AS ext FROM diff WHERE status IN ('new', 'deleted')),
    lone AS (SELECT workspace, count(*) FILTER (status = 'deleted') = 1 OR count(*) FILTER (status = 'new') = 1 AS lone FROM sides GROUP BY workspace),
    r1 AS (SELECT *, row_number() OVER (PARTITION BY workspace, status, size, name ORDER BY file_path) AS r FROM sides),
    p1 AS (SELECT a.workspace, a.file_path AS old_path, b.file_path AS new_path FROM r1 a JOIN r1 b ON a.workspace = b.workspace AND a.size = b.size AND a.name = b.name AND a.r = b.r AND a.status = 'deleted' AND b.status = 'new'),
    s2 AS (SELECT * FROM sides s WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.workspace = s.workspace AND s.file_path = CASE s.status WHEN 'new' THEN new_path ELSE old_path END)),
    r2 AS (SELECT *, row_number() OVER (PARTITION BY workspace, status, size, ext, folder ORDER BY file_path) AS r FROM s2),
    p2 AS (SELECT a.workspace, a.file_path AS old_path, b.file_path AS new_path FROM r2 a JOIN r2 b ON a.workspace = b.workspace AND a.size = b.size AND a.ext = b.ext AND a.folder = b.folder AND a.r = b.r AND a.status = 'deleted' AND b.status = 'new'),
    s3 AS (SELECT s.* FROM s2 s JOIN lone USING (workspace) WHERE lone AND NOT EXISTS (SELECT 1 FROM p2 WHERE p2.workspace = s.workspace AND s.file_path = CASE s.status WHEN 'new' THEN new_path ELSE old_path END)),
    r3 AS (SELECT *, row_number() OVER (PARTITION BY workspace, status, size, ext ORDER BY file_path) AS r FROM s3),
    p3 AS (SELECT a.workspace, a.file_path AS old_path, b.file_path AS new_path FROM r3 a JOIN r3 b ON a.workspace = b.workspace AND a.size = b.size AND a.ext = b.ext AND a.r = b.r AND a.status = 'deleted' AND b.status = 'new'),
    pairs AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)"""
_SQL_SUMMARY = """c AS (SELECT workspace, count(*) FILTER (status = 'new') AS n_new, count(*) FILTER (status = 'modified') AS n_modified, count(*) FILTER (status = 'deleted') AS n_deleted, count(*) FILTER (status = 'unchanged') AS n_unchanged FROM diff GROUP BY workspace),
    n AS (SELECT workspace, n_new - m AS n_new, n_modified, n_deleted - m AS n_deleted, m AS n_renamed, n_unchanged, n_new > 0 AND n_modified + n_deleted + n_unchanged = 0 AS virgin FROM (SELECT c.*, coalesce(m, 0) AS m FROM c LEFT JOIN (SELECT workspace, count(*) AS m FROM pairs GROUP BY workspace) USING (workspace)))"""
_SQL_SAID = "concat_ws(', ', " + ", ".join(f"CASE WHEN n_{k} > 0 THEN n_{k} || ' {k} file' || CASE WHEN n_{k} > 1 THEN 's' ELSE '' END END" for k in ("new", "modified", "deleted", "renamed")) + ")"
_SQL_MOVED = """disk AS (SELECT lang AS workspace, CASE WHEN doc_id % 9 = 0 THEN 'moved/' ELSE '' END || source || '/f' || doc_id || '.md' AS file_path, CASE WHEN doc_id % 10 = 3 THEN 2.0 ELSE 1.0 END AS mtime, n_chars AS size, doc_id, text FROM documents WHERE doc_id % 10 <> 2),
    cache AS (SELECT lang AS workspace, source || '/f' || doc_id || '.md' AS file_path, 1.0 AS mtime, n_chars AS size, doc_id, text FROM documents WHERE doc_id % 10 <> 1)"""
_SQL_MOVES = "moves AS (SELECT c.workspace, c.file_path AS old_path, d.file_path AS new_path, d.mtime AS mtime FROM cache c JOIN disk d USING (doc_id) WHERE c.file_path <> d.file_path)"
_SQL_CRAWL = """pg AS (SELECT url, page_id, CASE WHEN page_id % 3 = 0 THEN '2024-01-01' END AS lastmod, CASE WHEN page_id % 5 = 1 THEN 304 ELSE 200 END AS http_status, sha256(html) AS content_hash,
        CASE WHEN page_id % 17 = 0 THEN 10 ELSE length(html) END AS n_chars, page_id % 29 = 0 AS is_spa FROM pages),
    led AS (SELECT url, max(CASE WHEN page_id % 2 = 0 THEN '2024-01-01' ELSE '2023-01-01' END) AS lm, max(CASE WHEN page_id % 7 = 0 THEN 'old' ELSE sha256(html) END) AS h FROM pages WHERE page_id % 4 <> 0 GROUP BY url),
    crawl AS (SELECT pg.*, CASE WHEN lastmod = lm THEN 'skipped_lastmod' WHEN http_status = 304 AND h IS NOT NULL THEN 'skipped_304' WHEN n_chars <= 30 THEN 'error'
        WHEN content_hash = h THEN 'skipped_hash' WHEN h IS NULL THEN 'new' ELSE 'changed' END AS status FROM pg LEFT JOIN led USING (url))"""
QUERIES = {f.__name__: f for f in (
    stat_diff, change_summary, change_summary_sources, rename_pairs, rename_diff, folder_index, stat_cache_upsert, stat_cache_rename, stat_cache_clear, sync_dispatch, crawl_cap, crawl_status, crawl_index, stat_cache_map, lastmod_skip,
    crawl_counters, new_urls, page_ledger_upsert, polling_due, polling_times, progress_bar, page_sum, distinct_pages)}
ORACLE = {
    "stat_diff": f"WITH {_SQL_DIFF} SELECT workspace, file_path, status, size FROM diff",
    "change_summary": f"""WITH {_SQL_DIFF}, {_SQL_PAIRS}, {_SQL_SUMMARY} SELECT workspace, n_new, n_modified, n_deleted, n_renamed, n_unchanged, n_new + n_modified + n_deleted + n_renamed = 0 AND NOT virgin AS up_to_date,
        CASE WHEN n_new + n_modified + n_deleted + n_renamed = 0 THEN 'Up to date (0 changes)' ELSE {_SQL_SAID} END AS message FROM n""",
    "change_summary_sources": f"""WITH {_SQL_DIFF}, {_SQL_PAIRS}, {_SQL_SUMMARY}, src AS (SELECT * FROM (VALUES {SOURCES}) t({SOURCE_COLUMNS})),
        j AS (SELECT workspace, coalesce(n_new, 0) AS n_new, coalesce(n_modified, 0) AS n_modified, coalesce(n_deleted, 0) AS n_deleted, coalesce(n_renamed, 0) AS n_renamed, coalesce(virgin, false) AS virgin,
              coalesce(n_folders, 0) AS f, coalesce(n_web, 0) AS w, coalesce(web_pages, 0) AS p, coalesce(n_drives, 0) AS dr FROM n FULL OUTER JOIN src USING (workspace))
        SELECT workspace, n_new + n_modified + n_deleted + n_renamed = 0 AND NOT virgin AS up_to_date, CASE WHEN n_new + n_modified + n_deleted + n_renamed > 0 THEN {_SQL_SAID} WHEN f + w + dr = 0 THEN 'No sources configured.'
            WHEN f = 0 AND w > 0 THEN 'All ' || w || ' web sources (' || p || ' pages) up to date.' WHEN f = 0 AND dr > 0 THEN 'All ' || dr || ' cloud drives connected.' ELSE 'Up to date (0 changes)' END AS message FROM j""",
    "rename_pairs": f"WITH diff AS (SELECT * FROM (VALUES {RENAMES}) t(workspace, file_path, status, size)), {_SQL_PAIRS} SELECT * FROM pairs",
    "rename_diff": f"WITH {_SQL_MOVED}, {_SQL_MOVES} SELECT workspace, old_path, new_path FROM moves",
    "folder_index": f"""WITH {_SQL_MOVED}, {_SQL_MOVES} SELECT d.workspace, d.file_path, sha256(d.text) AS h, CASE WHEN c.doc_id IS NULL OR (c.file_path = d.file_path AND d.mtime <> c.mtime) THEN 'new' ELSE 'old' END AS read
        FROM disk d LEFT JOIN cache c USING (doc_id)""",
    "stat_cache_upsert": f"""WITH a AS ({_SQL_CACHE}), b AS (SELECT * FROM ({_SQL_DISK}) WHERE size % 3 = 0)
        SELECT workspace, count(*) AS n, round(sum(mtime), 2)::DOUBLE AS mtimes, sum(size)::BIGINT AS sizes FROM (SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.workspace = a.workspace AND b.file_path = a.file_path)) GROUP BY workspace""",
    "stat_cache_rename": f"""WITH {_SQL_MOVED}, {_SQL_MOVES} SELECT c.workspace, count(*) AS n, count(*) FILTER (m.new_path IS NOT NULL) AS n_moved FROM cache c LEFT JOIN moves m ON m.workspace = c.workspace AND m.old_path = c.file_path GROUP BY c.workspace""",
    "stat_cache_clear": f"SELECT workspace, count(*) AS n FROM ({_SQL_CACHE}) WHERE workspace <> 'fr' GROUP BY workspace",
    "sync_dispatch": f"SELECT id, CASE WHEN coalesce(nullif(page_count, 0), 1) > 1 OR coalesce(scope, '') IN ('domain', 'section', 'custom') THEN 'portal' ELSE 'single_page' END AS kind FROM (VALUES {KINDS}) t(id, page_count, scope)",
    "crawl_cap": f"""WITH {discovery.SITES_SQL}, own AS (SELECT start, url, page_id, false AS linked FROM u JOIN starts USING (site)), {discovery.ranked_sql("r", "own")}
        SELECT page_id, url, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {CRAWL_PAGES}""",
    "crawl_status": f"WITH {_SQL_CRAWL} SELECT page_id, status FROM crawl",
    "crawl_index": f"""WITH {_SQL_CRAWL}, r AS (SELECT page_id, url, content_hash AS h FROM crawl WHERE status IN ('new', 'changed'))
        SELECT page_id, h FROM r UNION ALL SELECT page_id, 'old' FROM pages WHERE page_id % 4 <> 0 AND url NOT IN (SELECT url FROM r)""",
    "stat_cache_map": f"SELECT file_path, mtime::DOUBLE AS mtime, size FROM ({_SQL_CACHE}) WHERE workspace = 'de'",
    "lastmod_skip": f"WITH {_SQL_CRAWL} SELECT status = 'skipped_lastmod' AS skipped, count(*) AS n FROM crawl GROUP BY 1",
    "crawl_counters": f"""WITH {_SQL_CRAWL}, s AS (SELECT count(*) FILTER (status IN ('new', 'changed')) AS indexed, count(*) FILTER (starts_with(status, 'skipped')) AS skipped, count(*) FILTER (status = 'error') AS errors,
        sum(CASE WHEN status IN ('new', 'changed') THEN n_chars ELSE 0 END)::BIGINT AS chars, count(*) FILTER (status IN ('new', 'changed') AND is_spa) AS spa FROM crawl)
        SELECT *, spa > 0 AND spa >= 0.05 * (indexed + skipped) AS is_spa_site FROM s""",
    "new_urls": "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)",
    "page_ledger_upsert": """SELECT url, updated_at, h, created_at FROM (SELECT url, page_id AS updated_at, sha256(html) AS h, first_value(page_id) OVER (PARTITION BY url ORDER BY page_id % 3 = 0, page_id) AS created_at,
        row_number() OVER (PARTITION BY url ORDER BY page_id % 3 <> 0, page_id DESC) AS r FROM pages) WHERE r = 1""",
    "polling_due": f"SELECT id FROM (VALUES {DUE}) t(id, last, hours) WHERE last IS NULL OR last + to_hours(hours) <= TIMESTAMP '2024-01-02 00:00:00'",
    "polling_times": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS source, CAST(ts AS TIMESTAMP) AS ts, user_id % 5 * 24 + 24 AS hours, lead(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events)
        SELECT source, epoch_us(ts) AS last_us, epoch_us(ts + to_hours(CAST(hours AS INTEGER))) AS due_us FROM e WHERE (nxt IS NULL OR nxt > ts + to_hours(CAST(hours AS INTEGER))) AND ts + to_hours(CAST(hours AS INTEGER)) <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM events)""",
    "progress_bar": f"""SELECT current, total, stage, pct, CASE WHEN total > 0 THEN '[' || repeat('█', fill) || repeat('░', width - fill) || '] ' || trunc(pct)::INT || '% (' || current || '/' || total || CASE WHEN stage IN ('files', 'pages', 'drives') THEN ' ' || stage ELSE '' END || ')'
        WHEN stage = 'scanning' THEN '[scanning...]' ELSE '[calculating...]' END AS bar FROM (SELECT *, CASE WHEN total > 0 THEN round(100.0 * current::DOUBLE / total, 1) ELSE 0.0 END::DOUBLE AS pct,
        CASE WHEN total > 0 THEN least(width, greatest(0, round_even(width * (current::DOUBLE / total), 0)::INT)) ELSE 0 END AS fill FROM (VALUES {BARS}) t(current, total, stage, width))""",
    "page_sum": "SELECT workspace, sum(coalesce(nullif(page_count, 0), 1))::BIGINT AS pages FROM (VALUES ('a', 3), ('a', 0), ('a', NULL), ('b', 5)) t(workspace, page_count) GROUP BY workspace",
    "distinct_pages": r"SELECT regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://', ''), '^([^/?#]*)', 1), ':\d+$', ''), '^www\.', '') AS domain, count(DISTINCT url) AS n_urls, count(*) AS n_pages FROM pages GROUP BY 1",
}
