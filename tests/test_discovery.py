"""Sites and their maps against a plain walk over a dictionary of pages."""

import re
import xml.etree.ElementTree as ET
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from skein.functions import web
from skein.operators import discover

HOST = "https://a.org"


def page(*links):
    return "<html><body>" + "".join(f'<a href="{x}">x</a>' for x in links) + "</body></html>"


def urlset(*locs):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc>" + (f"<lastmod>{d}</lastmod>" if d else "") + "</url>" for u, d in locs) + "</urlset>"


def index(*locs):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in locs) + "</sitemapindex>"


def maps_of(spark, rows, start=HOST + "/guide/my-part.html", **more):
    maps = spark.createDataFrame([(u, x, "clash") for u, x in rows], "url string, xml string, place string")
    starts = spark.createDataFrame([(start,), (start,), (None,), ("https://empty.org/",)], "start string")
    urls, broken = discover.nested_sitemaps(starts, maps, **more)
    return [(r.loc, r.lastmod) for r in urls.orderBy("start", "pos").collect()], sorted(r.url for r in broken.collect())


def test_a_map_and_the_place_that_counts(spark):
    flat = urlset((HOST + "/1", "2024-01-01"), (HOST + "/2", None), ("https://b.org/3", None), ("ftp://a.org/4", None), (HOST + "/1", "2024-02-02"), (HOST + "/2", None))
    assert maps_of(spark, [(HOST + "/sitemap_index.xml", flat), (HOST + "/sitemap/sitemap.xml", urlset((HOST + "/9", None)))]) == ([(HOST + "/1", "2024-02-02"), (HOST + "/2", None)], [])
    # an empty or broken first place leads on to the next
    rows = [(HOST + "/sitemap.xml", "<urlset><url>"), (HOST + "/sitemap_index.xml", urlset()), (HOST + "/sitemap/sitemap.xml", flat), (None, flat), ("https://empty.org/sitemap.xml", None)]
    assert maps_of(spark, rows) == ([(HOST + "/1", "2024-02-02"), (HOST + "/2", None)], [HOST + "/sitemap.xml", "https://empty.org/sitemap.xml"])
    loose = f"<x><loc>{HOST}/7</loc><y><loc> {HOST}/8 </loc></y></x>"
    assert maps_of(spark, [(HOST + "/sitemap.xml", loose)])[0] == [(HOST + "/7", None), (HOST + "/8", None)]
    assert maps_of(spark, []) == ([], [])


def test_an_index_is_read_two_levels_deep_with_the_starts_own_maps_first(spark):
    subs = [f"{HOST}/sitemap-{i:02d}.xml" for i in range(14)] + [f"{HOST}/part-map.xml", f"{HOST}/guide-sitemap"]
    rows = [(HOST + "/sitemap.xml", index(*subs, HOST + "/lone"))]
    rows += [(u, urlset((f"{HOST}/of{i}", f"2024-01-{i + 1:02d}"), (HOST + "/deep/sitemap-x.xml", None))) for i, u in enumerate(subs)] + [(HOST + "/deep/sitemap-x.xml", urlset((HOST + "/never", None)))]
    got, broken = maps_of(spark, rows)
    assert [u for u, _ in got] == [HOST + "/lone"] + [f"{HOST}/of{i}" for i in [14, 15, *range(10)]] and broken == []  # 12 maps, the matched two first
    assert [u for u, _ in maps_of(spark, rows, max_urls=3)[0]] == [HOST + "/lone", HOST + "/of14", HOST + "/of15"]
    assert maps_of(spark, [(HOST + "/sitemap.xml", index(HOST + "/a.xml", HOST + "/b.xml")), (HOST + "/a.xml", "no xml"), (HOST + "/b.xml", urlset((HOST + "/c", None)))]) == ([(HOST + "/c", None)], [HOST + "/a.xml"])


def rank(start, url, linked):
    path = lambda u: urlsplit(u).path
    parts = [x for x in re.sub(r"\.(html|htm|php|asp|aspx)$", "", path(start)).split("/") if x]
    prefix, terms, p = "/" + "/".join(parts).lower(), [x.lower() for x in parts if len(x) > 2], path(url).lower()
    inside = p.startswith(prefix + "/") or p in (prefix, prefix + ".html")
    score = 2000 if inside else 1500 if p.startswith(prefix) else 0
    score += 300 * sum(t in p or t in url.lower() for t in terms) + 500 * linked
    return 10_000 if url == start else score


def plain(starts, pages, mapped, barred, levels, few, sample, most):
    answers = {}
    for u, h, i in pages:
        if u and h is not None and (u not in answers or i < answers[u][1]):
            answers[u] = (h, i)
    out = []
    for s in sorted({s for s in starts if s}):
        host = urlsplit(s).netloc
        links = lambda u: {x for x in web._links(answers[u][0], u) if urlsplit(x).netloc == host}  # noqa: E731, B023
        found = {s: (False, 0)}
        if s in answers:
            for u in mapped.get(s, ()):
                found.setdefault(u, (False, 1))
            for u in links(s):
                found[u] = (True, 1) if u != s else (True, 0)
            read = {s}
            for level in range(levels):
                if len(found) >= few:
                    break
                order = sorted(sorted(found, reverse=True), key=lambda u: (u != s, -rank(s, u, found[u][0]), len(urlsplit(u).path)))  # noqa: B023
                front = [u for u in order if u not in read][:sample]
                read |= set(front)
                new = sorted({x for u in front if u in answers for x in links(u)} - found.keys())
                for u in new[: max(most - len(found), 0)]:
                    found[u] = (False, level + 2)
        kept = [u for u in found if u not in barred]
        kept.sort(reverse=True)
        kept.sort(key=lambda u: (u != s, -rank(s, u, found[u][0]), len(urlsplit(u).path)))  # noqa: B023
        out += [(s, u, *found[u], rank(s, u, found[u][0]), i + 1) for i, u in enumerate(kept)]
    return out


def test_a_walk_equals_a_plain_one(spark):
    pages = [(f"{HOST}/docs/p{i}", page(*(f"/docs/p{(i * k + k) % 60}" for k in (2, 3, 5)), f"/x{i}?q=1#f", "https://b.org/z", "mailto:me", f"/private/{i}"), i) for i in range(60)]
    pages += [(f"{HOST}/docs/p3", page("/later"), 900), (f"{HOST}/docs/p4", page("/first"), -1), (None, page("/n"), 1), (f"{HOST}/docs/p5", None, 0), ("https://b.org/", page("/q/", "/q", "//b.org/r", "https://B.org/S/"), 7), ("https://b.org/q", page(*(f"/t{i}" for i in range(40))), 8)]
    pages += pages[:10]
    starts = [f"{HOST}/docs/p1", f"{HOST}/docs/p1", "https://b.org/", "https://gone.org/a", None]
    mapped = {f"{HOST}/docs/p1": [f"{HOST}/docs/p1/in", f"{HOST}/x7"], "https://gone.org/a": ["https://gone.org/b"]}
    df = spark.createDataFrame([(*p, 1, "s", 0.5) for p in pages], "url string, html string, page_id long, rank int, start string, score double")
    st, mp = spark.createDataFrame([(s,) for s in starts], "start string"), spark.createDataFrame([(s, u) for s, v in mapped.items() for u in v], "start string, loc string")
    rules = web.robots_rules(spark.createDataFrame([(HOST, 0, "User-agent: *"), (HOST, 1, "Disallow: /private/")], "origin string, line_no int, line string"))
    barred = {f"{HOST}/private/{i}" for i in range(60)}
    for levels, few, sample, most in ((1, 300, 20, 2500), (1, 300, 3, 20), (3, 300, 2, 2500), (1, 2, 20, 2500), (0, 300, 20, 2500)):
        got = discover.site_urls(st, df, mp, rules, levels=levels, few=few, sample=sample, most=most).select("start", "url", "linked", "depth", F.col("score").cast("int"), "rank").orderBy("start", "rank").collect()
        assert [tuple(r) for r in got] == plain(starts, pages, mapped, barred, levels, few, sample, most)
    assert discover.site_urls(st.limit(0), df).count() == 0
    assert [r.url for r in discover.site_urls(st, df.limit(0), mp).orderBy("url").collect()] == sorted({s for s in starts if s})


def test_unclosed_tags_take_time_in_proportion():
    import time

    def took(n):
        t = time.perf_counter()
        p = web._parsed("<b>" * n + "<p>x" * n + "</i></b>" * n)
        assert len([x for x in p.pieces if x == "x"]) == n
        return time.perf_counter() - t

    took(1000)
    assert min(took(16_000) for _ in range(2)) < 12 * max(min(took(4000) for _ in range(2)), 0.01)
    hidden = web._parsed("<nav><div>a</nav>b<footer>c</footer>d<script>e</script></div>f")
    assert [x for x in hidden.pieces if x.strip()] == ["b", "d", "f"]


def test_broken_xml_is_told_apart():
    assert web._map("<a><loc>x</loc>") == (False, []) and web._map(None) == (False, []) and web._map("<a/>") == (True, [])
    assert ET.fromstring(urlset(("u", None))).tag == "urlset"
