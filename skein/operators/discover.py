"""Which URLs a site has: sitemaps over two levels, and a bounded walk along links, both with the web as a table (url, html).

Defined results: URLs are compared as the links of a page are written (`web.canonical`); of several rows of one URL the one
that comes first by `id` answers. A start that no page answers gives itself alone. A null URL or page is no page. Repeated
starts count once, extra columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import web
from ..sources.scratch import Scratch, scratch, small

#: Places of a site's map, in the order in which they are tried (fixed values).
MAP_PLACES = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml")
MAX_MAPS, MAX_MAP_URLS = 12, 5000
#: A site with fewer URLs than this is walked on, from as many of its pages, up to so many URLs (fixed values).
FEW_URLS, SAMPLE, MAX_URLS = 300, 20, 2500


class Web:
    """Pages (url, html, id_col) that answer for their canonical URLs; of several the one with the least id."""

    def __init__(self, s: Scratch, pages: DataFrame, id_col: str):
        self.s = s
        self.pages = pages.where("url IS NOT NULL AND html IS NOT NULL").select(web.canonical(F.col("url")).alias("url"), F.col(id_col).alias("id"), "html")
        self.known = s.written(self.pages.groupBy("url").agg(F.min("id").alias("id")), "web-known")

    def links(self, wanted: DataFrame) -> DataFrame:
        """(start, url, links) of wanted (start, url): the links of each page, null where none answers.

        Which rows answer is settled on URLs alone; then pages are read once and only those are parsed, none of them shuffled.
        """
        asked = self.s.written(self.known.join(wanted.select("url").distinct(), "url", "left_semi"), "web-asked")
        one = small(asked, 160)
        rows = self.pages.join(one, (self.pages["url"] == one["url"]) & self.pages["id"].eqNullSafe(one["id"]), "left_semi")
        answers = rows.select("url", web.extract_links("html", "url").alias("links")).dropDuplicates(["url"])
        return wanted.join(answers, "url", "left").select("start", "url", "links")


def nested_sitemaps(starts: DataFrame, maps: DataFrame, max_maps: int = MAX_MAPS, max_urls: int = MAX_MAP_URLS) -> tuple[DataFrame, DataFrame]:
    """starts: start; maps: url, xml. (start, loc, lastmod, pos) of the pages that a start's maps name, and (start, url) of maps that are no XML.

    The first of MAP_PLACES that leads to any page counts. Maps that it names are read too, those first whose URL has a part of
    the start's path, max_maps at most; maps that these name are not. The last date given for a page is its date.
    """
    spark = starts.sparkSession
    with scratch(spark) as s:
        starts = starts.where("start IS NOT NULL").select("start").distinct()
        maps = maps.where("url IS NOT NULL").groupBy("url").agg(F.min("xml").alias("xml"))
        root, host = web.origin(F.col("start")), web.netloc(F.col("start"))
        places = F.array(*(F.struct(F.lit(i).alias("place"), F.concat(root, F.lit(p)).alias("url")) for i, p in enumerate(MAP_PLACES)))
        asked = starts.withColumn("host", host).select("start", "host", F.inline(places))
        parsed = s.written(asked.join(maps, "url").withColumn("map", web.sitemap("xml")).drop("xml"), "sitemap-tops")
        listed = _entries(parsed, "start", "host", "place").withColumn("is_map", web.names_map(F.col("loc")))
        parts = web.path_parts(F.col("start"))
        wanted = listed.where("is_map").withColumn("hit", F.exists(parts, lambda p: F.lower("loc").contains(p)))
        turn = Window.partitionBy("start", "place").orderBy(F.desc("hit"), "pos")
        wanted = wanted.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= max_maps).select("start", "host", "place", "turn", F.col("loc").alias("url"))
        below = s.written(wanted.join(maps, "url").withColumn("map", web.sitemap("xml")).drop("xml"), "sitemap-subs")
        more = _entries(below, "start", "host", "place", "turn").where(~web.is_map_file(F.col("loc")))
        pages = listed.where("NOT is_map").select("start", "place", F.lit(0).alias("turn"), "pos", "loc", "lastmod").unionByName(more.select("start", "place", "turn", "pos", "loc", "lastmod"))
        pages = s.written(pages, "sitemap-pages")
        best = pages.groupBy("start").agg(F.min("place").alias("place"))
        order = F.struct("turn", "pos")
        named = pages.join(best, ["start", "place"]).groupBy("start", "loc").agg(F.max_by("lastmod", F.when(F.col("lastmod").isNotNull(), order)).alias("lastmod"), F.min(order).alias("at"))
        ranked = named.withColumn("pos", F.row_number().over(Window.partitionBy("start").orderBy("at", "loc"))).where(F.col("pos") <= max_urls).drop("at")
        broken = parsed.select("start", "url", "map").unionByName(below.select("start", "url", "map")).where("NOT map.whole").select("start", "url").distinct()
        return s.written(ranked, "sitemap-urls", keep=True), s.written(broken, "sitemap-broken", keep=True)


def _entries(parsed: DataFrame, *keys: str) -> DataFrame:
    rows = parsed.select(*keys, F.posexplode("map.entries").alias("pos", "e")).select(*keys, "pos", "e.loc", "e.lastmod")
    return rows.where(F.col("loc").startswith("http") & F.col("loc").contains(F.col("host")))


def site_urls(
    starts: DataFrame, pages: DataFrame, mapped: DataFrame | None = None, rules: DataFrame | None = None, id_col: str = "page_id",
    levels: int = 1, few: int = FEW_URLS, sample: int = SAMPLE, most: int = MAX_URLS) -> DataFrame:
    """(start, url, linked, depth, score, in_section, rank) of the URLs found for each start, best first.

    starts: start; pages: url, html, id_col; mapped: start, loc; rules: robots rules by origin.
    A site is its start, its maps' pages and the links of its start page to its own host; while it has fewer than `few` URLs,
    it is walked on for `levels` levels, each from the `sample` best pages that were not read before, up to `most` URLs in all.
    What robots rules forbid is left out at the end. depth: 0 the start, 1 its links and maps, then a level each.
    """
    spark = starts.sparkSession
    with scratch(spark) as s:
        starts = s.written(starts.where("start IS NOT NULL").select(web.canonical(F.col("start")).alias("start")).distinct(), "site-starts")
        answering = Web(s, pages, id_col)
        read = s.written(answering.links(starts.select("start", F.col("start").alias("url"))), "site-first")
        alive = read.where("links IS NOT NULL").select("start").distinct()
        first = starts.select("start", F.col("start").alias("url"), F.lit(False).alias("linked"), F.lit(0).alias("depth"))
        first = first.unionByName(_own(read).select("start", "url", F.lit(True).alias("linked"), F.lit(1).alias("depth")))
        if mapped is not None:
            own = mapped.select("start", F.col("loc").alias("url")).where("url IS NOT NULL").join(alive, "start", "left_semi")
            first = first.unionByName(own.withColumns({"linked": F.lit(False), "depth": F.lit(1)}))
        found = s.written(first.groupBy("start", "url").agg(F.max("linked").alias("linked"), F.min("depth").alias("depth")), "site-found")
        visited = s.written(starts.select("start", F.col("start").alias("url")), "site-read")
        for level in range(levels):
            held = found.groupBy("start").agg(F.count("*").alias("held")).where(F.col("held") < few)
            waiting = found.join(held, "start").join(visited, ["start", "url"], "left_anti").join(alive, "start", "left_semi")
            order = Window.partitionBy("start").orderBy("rank")
            frontier = web.ranked_urls(waiting).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= sample).select("start", "url")
            frontier = s.written(frontier, "site-frontier")
            new = s.written(_own(answering.links(frontier)).join(found, ["start", "url"], "left_anti").distinct(), "site-new")
            room = Window.partitionBy("start").orderBy("url")
            new = new.join(held, "start").withColumn("at", F.row_number().over(room) + F.col("held")).where(F.col("at") <= most)
            found = s.written(found.unionByName(new.select("start", "url", F.lit(False).alias("linked"), F.lit(level + 2).alias("depth"))), "site-found")
            visited = s.written(visited.unionByName(frontier), "site-read")
        if rules is not None:
            asked = found.select(web.origin(F.col("url")).alias("origin"), "url").distinct()
            barred = s.written(web.robots_allowed(asked, rules).where("NOT allowed").select("url"), "site-barred")
            found = found.join(small(barred, 128), "url", "left_anti")
        return s.written(web.ranked_urls(found), "site-urls", keep=True)


def _own(read: DataFrame) -> DataFrame:
    """(start, url): links to the start's own host."""
    links = read.select("start", F.explode("links").alias("url"))
    return links.where(web.netloc(F.col("url")) == web.netloc(F.col("start"))).distinct()


