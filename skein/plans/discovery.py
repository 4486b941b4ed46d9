"""Queries on what a site has: sitemaps over two levels and a bounded walk, with `pages` as the web."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import web
from ..operators import discover, fetch
from ..schema import table
from .web import _CLASS

#: Robots lines that every host of the queries has.
ROBOTS = ("User-agent: *", "Disallow: /fr/", "Allow: /fr/1*", "Disallow: /*.html$")


def urls(spark, d) -> DataFrame:
    """(url, page_id) of the pages, each URL once."""
    p = table(spark, d, "pages").where("url IS NOT NULL")
    return p.groupBy(web.canonical(F.col("url")).alias("url")).agg(F.min("page_id").alias("page_id"))


def _starts(spark, d) -> DataFrame:
    """(start): of each site the URL with the shortest path."""
    u = urls(spark, d).withColumn("site", web.origin(F.col("url")))
    return u.groupBy("site").agg(F.min(F.struct(F.length("url"), "url"))["url"].alias("start")).select("start")


def _maps(spark, d) -> DataFrame:
    """(url, xml): a map for each last part of a site's paths, and an index that names them; pages of even ids have a date.

    The index of a host with a name of even length is at the second place; maps of parts that end in 7 break off.
    """
    u = urls(spark, d).withColumns({"site": web.origin(F.col("url")), "part": F.regexp_extract(web.url_path(F.col("url")), r"([^/.]*)(\.[^/]*)?$", 1)})
    text = lambda c: F.replace(c, F.lit("&"), F.lit("&amp;"))
    day = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<lastmod>"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")).cast("string"), F.lit("</lastmod>")))
    item = F.concat(F.lit("<url><loc>"), text(F.col("url")), F.lit("</loc>"), F.coalesce(day, F.lit("")), F.lit("</url>"))
    place = F.concat("site", F.lit("/sitemap-"), "part", F.lit(".xml"))
    subs = u.groupBy("site", "part").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("items"))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "items", F.when(F.col("part").endswith("7"), "").otherwise("</urlset>"))
    low = subs.select(place.alias("url"), xml.alias("xml"))
    names = subs.groupBy("site").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<sitemap><loc>"), place, F.lit("</loc></sitemap>")))), "").alias("items"))
    at = F.when(F.length("site") % 2 == 0, "/sitemap_index.xml").otherwise("/sitemap.xml")
    return low.unionByName(names.select(F.concat("site", at).alias("url"), F.concat(F.lit("<sitemapindex>"), "items", F.lit("</sitemapindex>")).alias("xml")))


def sitemap_nested(spark, d):
    """The pages that each site's maps name, with their dates: 12 maps of an index at most, those of the start's path first."""
    return discover.nested_sitemaps(_starts(spark, d), _maps(spark, d))[0].select("start", "loc", "lastmod")


def sitemap_broken(spark, d):
    """Maps that were asked for and are no XML."""
    return discover.nested_sitemaps(_starts(spark, d), _maps(spark, d))[1]


def site_discovery(spark, d):
    """The URLs of each site in the order in which a crawl reads them."""
    starts = _starts(spark, d)
    mapped = discover.nested_sitemaps(starts, _maps(spark, d), max_urls=discover.MAX_URLS)[0]
    lines = starts.select(web.origin(F.col("start")).alias("origin"), F.posexplode(F.array(*map(F.lit, ROBOTS))).alias("line_no", "line"))
    found = discover.site_urls(starts, table(spark, d, "pages"), mapped, web.robots_rules(lines))
    return found.select("start", "url", "depth", F.col("score").cast("int").alias("score"), "rank", "in_section")


QUERIES = {f.__name__: f for f in (sitemap_nested, sitemap_broken, site_discovery)}

SITES_SQL = r"""u AS MATERIALIZED (SELECT min(page_id) AS page_id, site, url FROM (SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) AS site,
        lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || coalesce(nullif(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') || regexp_extract(url, '^[^?#]*(\?[^#]+)', 1) AS url FROM pages) GROUP BY site, url),
    starts AS MATERIALIZED (SELECT site, min({'n': length(url), 'url': url}).url AS start FROM u GROUP BY site)"""
_U = SITES_SQL + r""",
    p AS (SELECT u.*, s.start, regexp_extract(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '([^/.]*)(\.[^/]*)?$', 1) AS part FROM u JOIN starts s USING (site)),
    tokens AS (SELECT start, list_filter(list_transform(string_split(regexp_replace(regexp_extract(start, '^https?://[^/?#]*([^?#]*)', 1), '\.(html|htm|php|asp|aspx)$', ''), '/'), lambda x: lower(x)), lambda x: length(x) > 2) AS whole FROM starts),
    maps AS (SELECT DISTINCT site, p.start, part, site || '/sitemap-' || part || '.xml' AS map FROM p),
    taken AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY site ORDER BY len(list_filter(list_concat(whole, list_filter(flatten(list_transform(whole, lambda x: list_concat(string_split(x, '-'), string_split(x, '_')))), lambda x: length(x) > 2)),
        lambda x: contains(lower(map), x))) = 0, '<sitemap><loc>' || map || '</loc></sitemap>') AS turn FROM maps JOIN tokens USING (start) QUALIFY turn <= 12),
    mapped AS MATERIALIZED (SELECT start, url AS loc, lastmod FROM (SELECT p.start, url, turn, CASE WHEN page_id % 2 = 0 THEN CAST(CAST('2024-01-01' AS DATE) + CAST(page_id % 365 AS INTEGER) AS VARCHAR) END AS lastmod,
        row_number() OVER (PARTITION BY p.start ORDER BY turn, '<url><loc>' || replace(url, '&', '&amp;') || '</loc>' || coalesce('<lastmod>' || CASE WHEN page_id % 2 = 0 THEN CAST(CAST('2024-01-01' AS DATE) + CAST(page_id % 365 AS INTEGER) AS VARCHAR) END || '</lastmod>', '') || '</url>') AS pos
        FROM p JOIN taken t ON p.site = t.site AND p.part = t.part WHERE p.part NOT LIKE '%7') WHERE pos <= MOST)"""


def ranked_sql(name: str, source: str) -> str:
    """URLs of each start in the order of a crawl, as SQL."""
    path = "lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1))"
    return rf"""{name}_a AS (SELECT *, {path} AS path, list_filter(string_split(regexp_replace(regexp_extract(start, '^https?://[^/?#]*([^?#]*)', 1), '\.(html|htm|php|asp|aspx)$', ''), '/'), lambda x: x <> '') AS parts FROM {source}),
    {name}_b AS (SELECT *, '/' || lower(array_to_string(parts, '/')) AS prefix, list_transform(list_filter(parts, lambda x: length(x) > 2), lambda x: lower(x)) AS terms FROM {name}_a),
    {name}_c AS (SELECT *, starts_with(path, prefix || '/') OR path = prefix OR path = prefix || '.html' AS inside FROM {name}_b),
    {name}_d AS (SELECT *, CASE WHEN url = start THEN 10000 ELSE CASE WHEN inside THEN 2000 WHEN starts_with(path, prefix) THEN 1500 ELSE 0 END + 300 * len(list_filter(terms, lambda x: contains(path, x) OR contains(lower(url), x)))
        + CASE WHEN linked THEN 500 ELSE 0 END END AS score, inside OR url = start OR len(list_filter(terms, lambda x: length(x) >= 5 AND contains(path, x))) > 0 AS in_section FROM {name}_c),
    {name} AS MATERIALIZED (SELECT * EXCLUDE (path, parts, prefix, terms, inside), row_number() OVER (PARTITION BY start ORDER BY url <> start, score DESC, length(path), url DESC) AS rank FROM {name}_d)"""


_SITE = rf"""WITH {_U.replace("MOST", str(discover.MAX_URLS))},
    links AS MATERIALIZED (SELECT DISTINCT u.url AS src, u.site, u.site || CASE WHEN length(split_part(href, '#', 1)) > 1 THEN regexp_replace(split_part(href, '#', 1), '/+$', '') ELSE '/' END AS url
        FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) h JOIN u USING (page_id) WHERE starts_with(href, '/')),
    f0 AS MATERIALIZED (SELECT start, url, bool_or(linked) AS linked, min(depth) AS depth FROM (SELECT start, start AS url, false AS linked, 0 AS depth FROM starts UNION ALL SELECT start, loc, false, 1 FROM mapped
        UNION ALL SELECT s.start, l.url, true, 1 FROM starts s JOIN links l ON l.src = s.start) GROUP BY start, url),
    few AS (SELECT start, count(*) AS held FROM f0 GROUP BY start HAVING count(*) < {discover.FEW_URLS}),
    waiting AS (SELECT f0.* FROM f0 JOIN few USING (start) WHERE url <> start), {ranked_sql("w", "waiting")},
    new AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY url) + held AS place FROM (SELECT DISTINCT w.start, l.url FROM w JOIN links l ON l.src = w.url WHERE w.rank <= {discover.SAMPLE} AND NOT EXISTS (SELECT 1 FROM f0 WHERE f0.start = w.start AND f0.url = l.url)) JOIN few USING (start)),
    f1 AS (SELECT * FROM f0 UNION ALL SELECT start, url, false, 2 FROM new WHERE place <= {discover.MAX_URLS}),
    allowed AS (SELECT *, regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS asked FROM f1),
    kept AS (SELECT * EXCLUDE (asked) FROM allowed WHERE CASE WHEN starts_with(asked, '/fr/1') THEN NOT (length('/*.html$') > length('/fr/1*') AND asked LIKE '%.html') WHEN asked LIKE '%.html' THEN false ELSE NOT starts_with(asked, '/fr/') END),
    {ranked_sql("r", "kept")}
    SELECT start, url, depth, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank, in_section FROM r"""
ORACLE = {
    "sitemap_nested": f"WITH {_U.replace('MOST', str(discover.MAX_MAP_URLS))} SELECT start, loc, lastmod FROM mapped",
    "sitemap_broken": f"WITH {_U.replace('MOST', str(discover.MAX_MAP_URLS))} SELECT start, map AS url FROM taken WHERE part LIKE '%7'",
    "site_discovery": _SITE,
}


def _web(spark, d) -> DataFrame:
    """The pages as a server sends them: a tag of the page's own text, and for two of three pages a date."""
    p = table(spark, d, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")).cast("string")
    return p.select("page_id", "url", "html", F.substring(F.sha2("html", 256), 1, 16).alias("etag"), F.when(F.col("page_id") % 3 != 0, day).alias("last_modified"))


def _cached(spark, d) -> DataFrame:
    """What was cached of every page: its tag, an older tag or none; a date or none; hashes of two of five, one of them old."""
    w = _web(spark, d)
    i = F.col("page_id")
    etag = F.when(i % 4 == 0, F.col("etag")).when(i % 4 == 1, "old")
    date = F.when(i % 5 == 0, "2024-12-31").when(i % 5 == 1, "2024-01-01")
    digest = F.when(i % 5 == 2, F.sha2("html", 256)).when(i % 5 == 3, "old")
    return w.select("page_id", "url", etag.alias("etag"), date.alias("http_last_modified"), digest.alias("last_hash"))


def _rules(spark, d) -> DataFrame:
    hosts = table(spark, d, "pages").where("url IS NOT NULL").select(web.origin(F.col("url")).alias("origin")).distinct()
    return web.robots_rules(hosts.select("origin", F.posexplode(F.array(*map(F.lit, ROBOTS))).alias("line_no", "line")))


def fetch_conditional(spark, d):
    """Every page asked for with what was cached of it, and a URL of each that no page answers."""
    asked = _cached(spark, d).select("url", F.col("etag").alias("cached_etag"), F.col("http_last_modified").alias("cached_last_modified"))
    asked = asked.unionByName(asked.select(F.concat(web.origin(F.col("url")), F.lit("/none/at/all")).alias("url"), "cached_etag", "cached_last_modified"))
    got = fetch.fetched(asked, _web(spark, d), "2030-01-01", _rules(spark, d), text=F.col("html"))
    return got.select("url", "cached_etag", "cached_last_modified", "http_status", "title", "content_hash", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), "content_type", "etag", "http_last_modified")


def single_url_index(spark, d):
    """The registry of single URLs after a synchronisation, with what came of each."""
    registry = _cached(spark, d).select(F.lit("w").alias("workspace"), "url", F.lit("kept").alias("title"), "last_hash", "etag", "http_last_modified")
    told, _ = fetch.index_urls(registry, _web(spark, d), "2030-01-01", text=F.col("html"))
    return told.select("url", "outcome", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.sha2("document", 256).alias("document"), "last_hash")


QUERIES |= {f.__name__: f for f in (fetch_conditional, single_url_index)}

_FETCH = r"""web AS (SELECT page_id, url, html, substr(sha256(html), 1, 16) AS etag, CASE WHEN page_id % 3 <> 0 THEN CAST(CAST('2024-01-01' AS DATE) + CAST(page_id % 365 AS INTEGER) AS VARCHAR) END AS last_modified,
        lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || coalesce(nullif(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') || regexp_extract(url, '^[^?#]*(\?[^#]+)', 1) AS addr FROM pages),
    answer AS (SELECT * FROM web QUALIFY row_number() OVER (PARTITION BY addr ORDER BY page_id) = 1),
    cached AS (SELECT url, addr, CASE page_id % 4 WHEN 0 THEN etag WHEN 1 THEN 'old' END AS cached_etag, CASE page_id % 5 WHEN 0 THEN '2024-12-31' WHEN 1 THEN '2024-01-01' END AS cached_last_modified, CASE page_id % 5 WHEN 2 THEN sha256(html) WHEN 3 THEN 'old' END AS last_hash FROM web),
    same AS (SELECT c.*, a.page_id, a.html, a.url AS own, a.etag, a.last_modified, regexp_extract(c.addr, '^https?://[^/?#]*([^#]*)', 1) AS path,
        coalesce(CASE WHEN cached_etag IS NOT NULL THEN cached_etag = a.etag WHEN cached_last_modified IS NOT NULL THEN a.last_modified <= cached_last_modified END, false) AS still FROM cached c LEFT JOIN answer a USING (addr))"""
ORACLE |= {
    "fetch_conditional": rf"""WITH {_FETCH}, r AS (SELECT *, CASE WHEN CASE WHEN starts_with(path, '/fr/1') THEN length('/*.html$') > length('/fr/1*') AND path LIKE '%.html' WHEN path LIKE '%.html' THEN true ELSE starts_with(path, '/fr/') END THEN 403 WHEN still THEN 304 ELSE 200 END AS http_status FROM same),
        t AS (SELECT *, '{fetch.BLOCKED_TEXT[0].replace("'", "''")}' || url || '{fetch.BLOCKED_TEXT[1].replace("'", "''")}' AS notice FROM r)
        SELECT url, cached_etag, cached_last_modified, http_status, CASE http_status WHEN 200 THEN CASE WHEN regexp_matches(html, '(?is)<title>.*?</title>') THEN trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) ELSE own END WHEN 304 THEN '' ELSE '{fetch.BLOCKED_TITLE}' || url END AS title,
            CASE http_status WHEN 200 THEN sha256(html) WHEN 304 THEN '' ELSE sha256(notice) END AS content_hash, CASE http_status WHEN 200 THEN length(html) WHEN 304 THEN 0 ELSE length(notice) END AS n_chars,
            CASE http_status WHEN 200 THEN {_CLASS.replace('lower(url)', 'lower(own)')} WHEN 304 THEN '{fetch.UNCHANGED_TYPE}' ELSE '{fetch.BLOCKED_TYPE}' END AS content_type,
            CASE http_status WHEN 200 THEN etag WHEN 304 THEN cached_etag END AS etag, CASE http_status WHEN 200 THEN last_modified WHEN 304 THEN cached_last_modified END AS http_last_modified FROM t
        UNION ALL SELECT regexp_extract(addr, '^(https?://[^/?#]*)', 1) || '/none/at/all', cached_etag, cached_last_modified, 404, NULL, NULL, 0, NULL, NULL, NULL FROM cached""",
    "single_url_index": rf"""WITH {_FETCH}, o AS (SELECT *, CASE WHEN still OR last_hash = sha256(html) THEN 'unchanged' ELSE 'indexed' END AS outcome, CASE WHEN regexp_matches(html, '(?is)<title>.*?</title>') THEN trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) ELSE own END AS title FROM same)
        SELECT url, outcome, CASE WHEN outcome = 'indexed' THEN length(html) ELSE 0 END AS n_chars, CASE WHEN outcome = 'indexed' THEN sha256('Web Document Title: ' || title || chr(10) || 'Source URL: ' || url || chr(10) || chr(10) || html) END AS document,
            CASE WHEN outcome = 'indexed' THEN sha256(html) ELSE last_hash END AS last_hash FROM o""",
}
