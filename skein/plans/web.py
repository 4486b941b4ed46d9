"""Queries over web pages and inline fixtures of pages, robots rules and sitemaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import web
from ..schema import fixture, table


def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", web.page_title(F.col("html"), F.col("url")).alias("title"))


PAGES = """(1, 'https://h/x', '<meta property="article:modified_time" content="2024-03-04T10:00">', NULL), (2, 'https://h/x', '<meta content="2023-01-02" name="dc.date">', NULL),
    (3, 'https://h/x', '{"dateModified": "2022-05-06"}', NULL), (4, 'https://h/x', '<time datetime="2021-07-08T00:00">', NULL), (5, 'https://h/x', 'Last updated: 2020-09-10', NULL),
    (6, 'https://h/2023/06/post', 'none', NULL), (7, 'https://h/2023/06/15/post', 'none', NULL), (8, 'https://h/x', 'none', '2019-11-12'), (9, 'https://h/x', 'none', NULL),
    (10, 'https://h/x', '<meta name="dc.date" content="soon"> {"datePublished": "2018-01-01"}', NULL)"""


def date_cascade(spark, d):
    p = fixture(spark, "id, url, html, http_date", PAGES)
    return p.select("id", web.modified(F.col("url"), F.col("html"), F.col("http_date"), F.lit("2030-01-01")).alias("m")).select("id", "m.last_modified", "m.date_confidence")


KINDS = """(1, 'https://h/news/a', 'x'), (2, 'https://h/docs/a', 'x'), (3, 'https://h/product/a', 'x'), (4, 'https://h/a', '{"@type": "Product"}'), (5, 'https://h/a', 'x'),
    (6, 'https://h/news/a', 'please verify your identity now'), (7, 'https://h/NEWS/docs/', 'x'), (8, 'https://h/a', 'Access Denied by Cloudflare')"""


def content_type(spark, d):
    return fixture(spark, "id, url, html", KINDS).select("id", web.content_type(F.col("url"), F.col("html")).alias("content_type"))


def content_type_pages(spark, d):
    return table(spark, d, "pages").groupBy(web.content_type(F.col("url"), F.col("html")).alias("content_type")).agg(F.count("*").alias("n"))


SPA = """(1, '<div id="root"></div>', ''), (2, '<div>text</div>', 'text'), (3, '<script>__next_data__</script>', 'short'), (4, '_next/static', repeat('x', 3000))"""


def spa_flag(spark, d):
    p = fixture(spark, "id, html, clean", SPA)
    return p.select("id", web.is_spa(F.col("html"), F.col("clean")).alias("is_spa"))


def base_domain(spark, d):
    return table(spark, d, "pages").select("page_id", web.base_domain(F.col("url")).alias("domain"))


URLS = """('https://h/docs/guide.html', 'https://h/docs/guide.html', false), ('https://h/docs/guide.html', 'https://h/docs/guide/a', true), ('https://h/docs/guide.html', 'https://h/docs/guide/b', false),
    ('https://h/docs/guide.html', 'https://h/docs/guides', false), ('https://h/docs/guide.html', 'https://h/other', true), ('https://h/docs/guide.html', 'https://h/docs/x?guide=1', false), ('https://h/docs/guide.html', 'https://h/aa', false), ('https://h/docs/guide.html', 'https://h/ab', false)"""


def _ranked(spark):
    return web.ranked_urls(fixture(spark, "start, url, linked", URLS))


def url_rank(spark, d):
    return _ranked(spark).select("url", F.col("score").cast("int").alias("score"), "rank")


def section_urls(spark, d):
    return _ranked(spark).where("in_section").select("url", "rank")


ROBOTS = """('o', 1, 'User-agent: *'), ('o', 2, 'Disallow: /private/'), ('o', 3, 'Disallow: /*.pdf$'), ('o', 4, 'Allow: /private/open'), ('o', 5, 'Disallow: /tmp # no'), ('o', 6, 'Disallow:'), ('o', 7, 'User-agent: Bot'),
    ('o', 8, 'Disallow: /bot'), ('o', 9, 'Allow: /bot')"""
PROBES = "('o', 'https://o/'), ('o', 'https://o/private/x'), ('o', 'https://o/private/open/y'), ('o', 'https://o/a.pdf'), ('o', 'https://o/a.pdf?x=1'), ('o', 'https://o/tmpfile'), ('o', 'https://o/bot'), ('p', 'https://p/private/')"


def robots_allow(spark, d):
    rules = web.robots_rules(fixture(spark, "origin, line_no, line", ROBOTS))
    urls = fixture(spark, "origin, url", PROBES)
    return web.robots_allowed(urls, rules).select("url", "allowed").withColumn("agent", F.lit("*")).unionByName(web.robots_allowed(urls, rules, "bot").select("url", "allowed").withColumn("agent", F.lit("bot")))


SITEMAP = """('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://h/a</loc><lastmod>2024-01-01</lastmod></url><url><loc>https://h/b</loc><lastmod>2024-01-02</lastmod></url></urlset>')"""


def sitemap_urls(spark, d):
    return fixture(spark, "xml", SITEMAP).select(F.explode(web.sitemap_entries(F.col("xml"))).alias("e")).select("e.loc", "e.lastmod")


def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", web.html_to_text("html").alias("text"))


LD = """(1, '<script type="application/ld+json">{"@type": "Product", "name": "Lamp", "brand": {"name": "Lux"}, "aggregateRating": {"ratingValue": 4.5, "reviewCount": 12}, "offers": {"price": "9.90", "priceCurrency": "EUR", "availability": "https://schema.org/InStock"}}</script><p>buy</p>'),
    (2, '<script type="application/ld+json">{"@graph": [{"@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "Why?", "acceptedAnswer": {"text": "So."}}]}]}</script>'), (3, '<p>none</p>')"""


def jsonld_entities(spark, d):
    return fixture(spark, "id, html", LD).select("id", F.array_join(web.json_ld_entities("html"), "\n").alias("entities"))


def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(web.extract_links("html", "url")).alias("link"))


def site_frontier(spark, d):
    """URLs that a host's own pages link to, inside the host: the next step of a crawl."""
    links = table(spark, d, "pages").select(F.lower("url").alias("src"), F.explode(web.extract_links("html", "url")).alias("dst"))
    host = lambda c: web.base_domain(F.col(c))
    same = links.where(host("src") == host("dst")).select(host("src").alias("host"), "dst").distinct()
    return same.groupBy("host").agg(F.count("*").alias("n_urls"))


def robots_urls(spark, d):
    """The pages' URLs that the rules allow, as a set of URLs without those that are not."""
    rules = web.robots_rules(fixture(spark, "origin, line_no, line", "('o', 1, 'User-agent: *'), ('o', 2, 'Disallow: /fr/'), ('o', 3, 'Allow: /fr/1*'), ('o', 4, 'Disallow: /*.html$')"))
    urls = table(spark, d, "pages").select(F.lit("o").alias("origin"), "url").distinct()
    return web.robots_allowed(urls, rules).where("allowed").select("url")


QUERIES = {f.__name__: f for f in (
    page_title, date_cascade, content_type, content_type_pages, spa_flag, base_domain, url_rank, section_urls, robots_allow, robots_urls, sitemap_urls, html_text, jsonld_entities,
    page_links, site_frontier)}


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _days() -> list[tuple[str, str]]:
    """(day, confidence) of each source of a page's date, as SQL, in order."""
    day = r"(\d{4}-\d{2}-\d{2})"
    out = [(f"nullif(regexp_extract(regexp_extract(html, {_text('(?i)' + p)}, 1), '{day}', 1), '')", c) for p, c in web.META_DATES]
    out += [(f"nullif(regexp_extract(html, {_text('(?i)' + t + chr(92) + 's*' + day)}, 1), '')", "high") for t in web.TEXT_DATES]
    y = r"'/(20\d{2})/(0[1-9]|1[0-2])(?:/([0-3]\d))?/'"
    out.append((f"CASE WHEN regexp_matches(url, {y}) THEN regexp_extract(url, {y}, 1) || '-' || regexp_extract(url, {y}, 2) || '-' || coalesce(nullif(regexp_extract(url, {y}, 3), ''), '01') END", "url_pattern"))
    return [*out, ("http_date", "http_header"), ("'2030-01-01'", "crawl_timestamp")]


_CLASS = ("CASE WHEN " + " OR ".join(f"regexp_matches(html, {_text('(?i)' + p)})" for p in web.BOT_PHRASES) + " THEN 'Blocked by Anti-Bot Firewall (Captcha)' "
          + " ".join("WHEN " + " OR ".join(f"contains(lower(url), '{x}')" for x in xs) + f" THEN '{n}'" for n, xs in web.URL_CLASSES)
          + " WHEN " + " OR ".join(f"contains(html, {_text(m)})" for m in web.PRODUCT_MARKS) + " THEN 'E-Commerce Product Page' ELSE 'Web Documentation' END")
_PATH = r"regexp_extract(regexp_replace({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '^([^?#]*)', 1)"
_RANKED = rf"""u AS (SELECT *, lower({_PATH.format('url')}) AS path, list_filter(string_split(regexp_replace({_PATH.format('start')}, '\.(html|htm|php|asp|aspx)$', ''), '/'), lambda x: x <> '') AS parts FROM (VALUES {URLS}) t(start, url, linked)),
    v AS (SELECT *, '/' || lower(array_to_string(parts, '/')) AS prefix, list_transform(list_filter(parts, lambda x: length(x) > 2), lambda x: lower(x)) AS terms FROM u),
    w AS (SELECT *, starts_with(path, prefix || '/') OR path = prefix OR path = prefix || '.html' AS inside, len(list_filter(terms, lambda x: contains(path, x) OR contains(lower(url), x))) AS hits FROM v),
    scored AS (SELECT *, CASE WHEN url = start THEN 10000 ELSE CASE WHEN inside THEN 2000 WHEN starts_with(path, prefix) THEN 1500 ELSE 0 END + 300 * hits + CASE WHEN linked THEN 500 ELSE 0 END END AS score,
        inside OR url = start OR len(list_filter(terms, lambda x: length(x) >= 5 AND contains(path, x))) > 0 AS in_section FROM w),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY url <> start, score DESC, length(path), url DESC)::INT AS rank FROM scored)"""


def _rules(values: str) -> str:
    """Rules of robots files: agents' lines one after the other share the rules that follow them."""
    return rf"""l AS (SELECT origin, line_no, lower(trim(split_part(split_part(line, '#', 1), ':', 1))) AS k, trim(substr(split_part(line, '#', 1), instr(split_part(line, '#', 1), ':') + 1)) AS v FROM (VALUES {values}) t(origin, line_no, line)),
    g AS (SELECT *, sum(CASE WHEN k = 'user-agent' AND coalesce(p, '') <> 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY origin ORDER BY line_no) AS grp FROM (SELECT *, lag(k) OVER (PARTITION BY origin ORDER BY line_no) AS p FROM l)),
    rules AS (SELECT a.origin, lower(a.v) AS agent, r.v AS pattern, r.k = 'allow' AS is_allow,
        '^' || replace(regexp_replace(regexp_replace(r.v, '\$$', ''), '([.+?()\[\]{{}}^|$\\])', '\\\1', 'g'), '*', '.*') || CASE WHEN r.v LIKE '%$' THEN '$' ELSE '.*' END AS rx
        FROM g a JOIN g r ON a.origin = r.origin AND a.grp = r.grp AND a.k = 'user-agent' WHERE r.k = 'allow' OR (r.k = 'disallow' AND r.v <> ''))"""


_LINES = ROBOTS
_HOST = r"regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower({0}), '^[a-z][a-z0-9+.-]*://', ''), '^([^/?#]*)', 1), ':\d+$', ''), '^www\.', '')"
_LINKS = r"""raw AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
    links AS (SELECT DISTINCT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) || CASE WHEN length(split_part(href, '#', 1)) > 1 THEN regexp_replace(split_part(href, '#', 1), '/+$', '') ELSE '/' END AS link FROM raw WHERE starts_with(href, '/'))"""
ORACLE = {
    "page_title": "SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title>.*?</title>') THEN trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) ELSE url END AS title FROM pages",
    "date_cascade": f"SELECT id, coalesce({', '.join(x for x, _ in _days())}) AS last_modified, CASE {' '.join(f'WHEN {x} IS NOT NULL THEN {_text(c)}' for x, c in _days())} END AS date_confidence FROM (VALUES {PAGES}) t(id, url, html, http_date)",
    "content_type": f"SELECT id, {_CLASS} AS content_type FROM (VALUES {KINDS}) t(id, url, html)",
    "content_type_pages": f"SELECT {_CLASS} AS content_type, count(*) AS n FROM pages GROUP BY 1",
    "spa_flag": f"SELECT id, ({' OR '.join(f'contains(lower(html), {_text(m.lower())})' for m in web.SPA_MARKERS)}) AND (length(clean) / greatest(length(html), 1) < 0.05 OR length(clean) < 2500) AS is_spa FROM (VALUES {SPA}) t(id, html, clean)",
    "base_domain": f"SELECT page_id, {_HOST.format('url')} AS domain FROM pages",
    "url_rank": f"WITH {_RANKED} SELECT url, score::INT AS score, rank FROM ranked",
    "section_urls": f"WITH {_RANKED} SELECT url, rank FROM ranked WHERE in_section",
    "robots_allow": rf"""WITH {_rules(_LINES)}, asked AS (SELECT * FROM (VALUES {PROBES}) p(origin, url), (VALUES ('*'), ('bot')) a(agent)),
        used AS (SELECT q.*, r.pattern, r.is_allow FROM (SELECT *, EXISTS (SELECT 1 FROM rules r WHERE r.origin = asked.origin AND r.agent = asked.agent) AS own FROM asked) q
            JOIN rules r ON r.origin = q.origin AND r.agent = CASE WHEN own THEN q.agent ELSE '*' END AND regexp_matches(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1), r.rx))
        SELECT asked.url, coalesce(arg_max(is_allow, 2 * length(pattern) + is_allow::INT), true) AS allowed, asked.agent FROM asked LEFT JOIN used USING (origin, url, agent) GROUP BY asked.url, asked.agent""",
    "robots_urls": rf"""WITH u AS (SELECT DISTINCT url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS path FROM pages)
        SELECT url FROM u WHERE CASE WHEN starts_with(path, '/fr/1') THEN NOT (length('/*.html$') > length('/fr/1*') AND path LIKE '%.html') WHEN path LIKE '%.html' THEN false ELSE NOT starts_with(path, '/fr/') END""",
    "sitemap_urls": f"SELECT regexp_extract(x, '<loc>(.*?)</loc>', 1) AS loc, regexp_extract(x, '<lastmod>(.*?)</lastmod>', 1) AS lastmod FROM (SELECT unnest(regexp_extract_all(xml, '<url>.*?</url>')) AS x FROM (VALUES {SITEMAP}) t(xml))",
    "jsonld_entities": f"""WITH j AS (SELECT id, nullif(regexp_extract(html, 'ld\\+json">(.*)</script>', 1), '')::JSON AS j FROM (VALUES {LD}) t(id, html)),
        e AS (SELECT id, CASE WHEN j ->> '$."@type"' = 'Product' THEN concat_ws(' | ', 'Product: ' || (j ->> '$.name'), 'Brand: ' || (j ->> '$.brand.name'), 'Rating: ' || (j ->> '$.aggregateRating.ratingValue') || ' / ' || coalesce(j ->> '$.aggregateRating.bestRating', '5') || ' stars' || coalesce(' (' || (j ->> '$.aggregateRating.reviewCount') || ' reviews)', ''),
            'Price: ' || (j ->> '$.offers.priceCurrency') || ' ' || (j ->> '$.offers.price'), 'Status: ' || CASE WHEN contains(j ->> '$.offers.availability', 'InStock') THEN 'In Stock' ELSE 'Out of Stock' END)
            WHEN j ->> '$."@graph"[0]."@type"' = 'FAQPage' THEN 'FAQ: ' || (j ->> '$."@graph"[0].mainEntity[0].name') || chr(10) || 'Answer: ' || (j ->> '$."@graph"[0].mainEntity[0].acceptedAnswer.text') ELSE '' END AS entities FROM j) SELECT * FROM e""",
    "page_links": f"WITH {_LINKS} SELECT page_id, link FROM links",
    "site_frontier": f"WITH {_LINKS} SELECT host, count(*) AS n_urls FROM (SELECT DISTINCT {_HOST.format('url')} AS host, lower(regexp_extract(link, '^(https?://[^/?#]*)', 1)) || regexp_replace(link, '^https?://[^/?#]*', '') AS link FROM links) GROUP BY host",
}
