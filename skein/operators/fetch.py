"""Pages from a web that is a table: conditional requests, single URLs with a hash check, and one synchronisation of all sources.

The web has url, html, etag and last_modified, which are what a server would send. A request carries what was cached of an
earlier answer. As on a real server, a tag that was sent decides alone; only without one the date counts. Requests are settled
on addresses, tags and dates; the pages' texts are read only for those that get one.

Defined results: URLs are compared in their canonical form, `https://` is put before one without a scheme; repeated requests of
one URL are answered each; of several rows of a URL the web answers with the one whose page comes first by id; a page without
html is missing. Dates are texts of the form yyyy-MM-dd. Null URLs are asked for nothing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import web
from ..sources.scratch import Scratch, small
from .sync import change_summary, crawl_status

#: What stands for a page that robots rules forbid (fixed values).
BLOCKED_TITLE, BLOCKED_TYPE = "[Blocked by robots.txt] ", "Disallowed by Robots.txt"
BLOCKED_TEXT = ("[COMPLIANCE NOTICE] Crawling for '", "' was skipped because this path is disallowed by the website's robots.txt policy.")
UNCHANGED_TYPE, MIN_CHARS = "Unchanged (HTTP 304)", 30


def with_scheme(url: Column) -> Column:
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit("https://"), url))


def requests(asked: DataFrame, pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id") -> DataFrame:
    """asked (url, cached_etag, cached_last_modified and more) with http_status, server_etag, server_last_modified and page, the id of the page that answers.

    http_status: 200, 304, 404, or 403 where rules forbid the URL. No text is read.
    """
    out = asked.where("url IS NOT NULL").withColumn("url", with_scheme(F.col("url"))).withColumn("_at", web.canonical(F.col("url")))
    out = Scratch(asked.sparkSession).written(out, "asked", keep=True)  # addresses are made once, not again in each step
    known = pages.where("url IS NOT NULL AND html IS NOT NULL").select(web.canonical(F.col("url")).alias("_at"), F.struct(F.col(id_col).alias("page"), F.col("etag").alias("server_etag"), F.col("last_modified").alias("server_last_modified")).alias("_a"))
    out = out.join(known.groupBy("_at").agg(F.min_by("_a", F.col("_a.page")).alias("_a")), "_at", "left").select("*", "_a.*").drop("_a")
    barred = F.lit(False)
    if rules is not None:
        told = web.robots_allowed(out.select(web.origin(F.col("_at")).alias("origin"), F.col("_at").alias("url")).distinct(), rules).where("NOT allowed").select(F.col("url").alias("_barred"))
        out = out.join(told, F.col("_at") == F.col("_barred"), "left")
        barred = F.col("_barred").isNotNull()
    tagged, dated = F.coalesce("cached_etag", F.lit("")) != "", F.coalesce("cached_last_modified", F.lit("")) != ""
    same = F.when(tagged, F.col("cached_etag") == F.col("server_etag")).when(dated, F.col("server_last_modified") <= F.col("cached_last_modified")).otherwise(False)
    status = F.when(barred, 403).when(F.col("page").isNull(), 404).when(F.coalesce(same, F.lit(False)), 304).otherwise(200)
    return out.withColumn("http_status", status).drop("_at", "_barred")


def fetched(asked: DataFrame, pages: DataFrame, today: str, rules: DataFrame | None = None, id_col: str = "page_id", text: Column | None = None) -> DataFrame:
    """asked with the answer to each request: title, content, content_hash, n_chars, last_modified, date_confidence, content_type, is_spa, etag, http_last_modified.

    text: how a page's html becomes content; visible text by default. An unchanged page has no content and keeps its cached
    headers; a forbidden one has a notice; a missing one has nulls.
    """
    r = Scratch(asked.sparkSession).written(requests(asked, pages, rules, id_col), "requests", keep=True)
    body = text if text is not None else web.html_to_text("html")
    wanted = r.where("http_status = 200").select("page", F.col("server_last_modified").alias("_header")).distinct()
    rows = pages.select(F.col(id_col).alias("page"), F.col("url").alias("_own"), "html").join(small(wanted, 64), "page").dropDuplicates(["page"])
    rows = rows.withColumn("_text", body).withColumn("_m", web.modified(F.col("_own"), F.col("html"), F.col("_header"), F.lit(today)))
    rows = rows.select("page", web.page_title(F.col("html"), F.col("_own")).alias("_title"), "_text", "_m", web.content_type(F.col("_own"), F.col("html")).alias("_kind"), web.is_spa(F.col("html"), F.col("_text")).alias("_spa"))
    j = r.join(rows, "page", "left")
    ok, unchanged, barred = (F.col("http_status") == n for n in (200, 304, 403))
    notice = F.concat(F.lit(BLOCKED_TEXT[0]), "url", F.lit(BLOCKED_TEXT[1]))
    content = F.when(ok, F.col("_text")).when(unchanged, "").when(barred, notice)
    return j.withColumns({
        "title": F.when(ok, F.col("_title")).when(unchanged, "").when(barred, F.concat(F.lit(BLOCKED_TITLE), "url")),
        "content": content, "content_hash": F.when(unchanged, "").otherwise(F.sha2(content, 256)), "n_chars": F.length(content).cast("long"),
        "last_modified": F.when(ok, F.col("_m.last_modified")).when(unchanged, F.col("cached_last_modified")).when(barred, F.lit(today)),
        "date_confidence": F.when(ok, F.col("_m.date_confidence")).when(unchanged, "http_conditional_304").when(barred, "robots_compliance"),
        "content_type": F.when(ok, F.col("_kind")).when(unchanged, UNCHANGED_TYPE).when(barred, BLOCKED_TYPE), "is_spa": F.when(ok, F.col("_spa")).otherwise(False),
        "etag": F.when(ok, F.col("server_etag")).when(unchanged, F.col("cached_etag")), "http_last_modified": F.when(ok, F.col("server_last_modified")).when(unchanged, F.col("cached_last_modified")),
    }).drop("_title", "_text", "_m", "_kind", "_spa", "server_etag", "server_last_modified", "page")


def index_urls(registry: DataFrame, pages: DataFrame, today: str, rules: DataFrame | None = None, force: bool = False, text: Column | None = None, id_col: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(outcomes, registry): single URLs of a registry (workspace, url, title, last_hash, etag, http_last_modified) asked for and indexed where they changed.

    outcomes: workspace, url, outcome (indexed, unchanged, error), title, n_chars, document, last_hash (the one in the registry
    afterwards). A page that the server or its hash calls unchanged is not indexed, unless forced; a page with no answer is an
    error and leaves its entry as it was. A URL that the registry has several times has as many outcomes and entries.
    """
    asked = registry.withColumnsRenamed({"title": "_old_title", "etag": "cached_etag", "http_last_modified": "cached_last_modified"})
    got = fetched(asked, pages, today, rules, id_col, text)
    still = (F.col("http_status") == 304) | F.col("last_hash").eqNullSafe(F.col("content_hash"))
    outcome = F.when(F.col("http_status") == 404, "error").when(still & ~F.lit(force), "unchanged").when(F.col("http_status") == 304, "unchanged").otherwise("indexed")
    got = got.withColumn("outcome", outcome)
    document = F.concat(F.lit("Web Document Title: "), "title", F.lit("\nSource URL: "), "url", F.lit("\n\n"), "content")
    new = F.col("outcome") == "indexed"
    digest = F.when(new, F.col("content_hash")).otherwise(F.col("last_hash")).alias("last_hash")
    told = got.select("workspace", "url", "outcome", F.when(F.col("http_status") == 304, F.col("_old_title")).otherwise(F.col("title")).alias("title"), F.when(new, F.col("n_chars")).alias("n_chars"), F.when(new, document).alias("document"), digest)
    now = got.select("workspace", "url", F.when(new, F.col("title")).otherwise(F.col("_old_title")).alias("title"), digest,
                     F.when(new, F.col("etag")).otherwise(F.col("cached_etag")).alias("etag"), F.when(new, F.col("http_last_modified")).otherwise(F.col("cached_last_modified")).alias("http_last_modified"))
    return told, now


def crawl(asked: DataFrame, ledger: DataFrame, pages: DataFrame, today: str, rules: DataFrame | None = None, text: Column | None = None, id_col: str = "page_id") -> DataFrame:
    """asked (url, lastmod of its map) with content and status: skipped by its map's date, by the server, by its hash, or new, changed, error.

    ledger: url, lastmod, content_hash, etag, http_last_modified of earlier crawls. URLs whose map date is the ledger's are not asked for at all.
    """
    led = ledger.select(F.col("url").alias("_url"), F.col("lastmod").alias("_lastmod"), F.col("etag").alias("cached_etag"), F.col("http_last_modified").alias("cached_last_modified"))
    joined = asked.join(led, F.col("url") == F.col("_url"), "left").drop("_url")
    same = F.coalesce(F.col("lastmod") == F.col("_lastmod"), F.lit(False))
    got = fetched(joined.where(~same), pages, today, rules, id_col, text).select("url", "lastmod", "http_status", "content_hash", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), "is_spa", "title", "content")
    skipped = joined.where(same).select("url", "lastmod")
    out = crawl_status(got, ledger).withColumn("status", F.when(F.col("http_status").isin(403, 404), "error").otherwise(F.col("status")))
    return out.unionByName(skipped.withColumn("status", F.lit("skipped_lastmod")), allowMissingColumns=True)


def unified(diff: DataFrame, renames: DataFrame, crawled: DataFrame, drives: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(workspace, family, status, total, changed) of each workspace's folders, web sources and drives.

    diff, renames: of `sync.change_scan`; crawled: workspace, status; drives: workspace; workspaces: workspace. Families without
    sources are empty; drives are only counted.
    """
    s = change_summary(diff, renames)
    files = s.select("workspace", (F.col("n_new") + F.col("n_modified") + F.col("n_deleted") + F.col("n_renamed")).alias("changed"), (F.col("n_new") + F.col("n_modified") + F.col("n_unchanged") + F.col("n_renamed")).alias("total"))
    pages = crawled.groupBy("workspace").agg(F.count_if(F.col("status").isin("new", "changed")).alias("changed"), F.count("*").alias("total"))
    held = drives.groupBy("workspace").agg(F.lit(0).cast("long").alias("changed"), F.count("*").alias("total"))
    parts = [df.select("workspace", F.lit(name).alias("family"), "changed", "total") for name, df in (("folders", files), ("web", pages), ("drives", held))]
    every = workspaces.select("workspace").distinct().select("workspace", F.explode(F.array(*map(F.lit, ("folders", "web", "drives")))).alias("family"))
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = every.join(found, ["workspace", "family"], "left").fillna(0, ["changed", "total"])
    status = F.when((F.col("total") == 0) & (F.col("changed") == 0), "empty").when(F.col("changed") > 0, "synchronised").otherwise("up_to_date")
    return out.select("workspace", "family", status.alias("status"), "total", "changed")
