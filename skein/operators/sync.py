"""Incremental synchronisation: what changed between two snapshots, renames, crawl states, ledgers."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, scratch, small

MTIME_TOLERANCE = 0.001


def stat_diff(disk: DataFrame, cache: DataFrame) -> DataFrame:
    """Both: workspace, file_path, mtime, size. (workspace, file_path, status, size) of files new, modified, deleted or unchanged."""
    a, b = disk.alias("d"), cache.alias("c")
    changed = (F.abs(F.col("d.mtime") - F.col("c.mtime")) > MTIME_TOLERANCE) | (F.col("d.size") != F.col("c.size"))
    status = F.when(F.col("c.file_path").isNull(), "new").when(F.col("d.file_path").isNull(), "deleted").when(changed, "modified").otherwise("unchanged")
    joined = a.join(b, (F.col("d.workspace") == F.col("c.workspace")) & (F.col("d.file_path") == F.col("c.file_path")), "full_outer")
    return joined.select(F.coalesce("d.workspace", "c.workspace").alias("workspace"), F.coalesce("d.file_path", "c.file_path").alias("file_path"), status.alias("status"), F.coalesce("d.size", "c.size").alias("size"))


PAIRS = "workspace string, old_path string, new_path string"


def rename_pairs(diff: DataFrame) -> DataFrame:
    """(workspace, old_path, new_path): each deleted file, in path order, with the first new one left that it can have become.

    A new file of the same workspace, size and ending is one if it has the same name, or the same folder, or if the workspace
    has one deleted or one new file only. Where files of a name (or of a folder) have no choice besides it, the order means that
    the first deleted goes with the first new one, the second with the second: one window over all such keys, however large.
    Files that could match both by name and by folder, and those that share a key with one, are gone through in order, in
    groups of workspace, size and ending. The files that moved are written once; all else reads them. Null sizes match nothing.
    """
    with scratch(diff.sparkSession) as s:
        return _paired(s, s.written(diff.where("status IN ('new', 'deleted')").select("workspace", "file_path", "status", "size"), "moved"))


def _paired(s: Scratch, changed: DataFrame) -> DataFrame:
    """The pairs of changed, a written table of files with their status, as a written table."""
    name = F.element_at(F.split("file_path", "/"), F.lit(-1))
    ext = F.lower(F.regexp_extract(F.regexp_replace(name, r"^\.+", ""), r"(\.[^.]*)$", 1))
    above = F.regexp_replace("file_path", r"[^/]*$", "")
    folder = F.coalesce(F.nullif(F.regexp_replace(above, r"/+$", ""), F.lit("")), above)
    gone = F.col("status") == "deleted"
    moved = changed.where("status IN ('new', 'deleted') AND size IS NOT NULL").select("workspace", "file_path", gone.alias("gone"), "size", name.alias("name"), ext.alias("ext"), folder.alias("folder"))
    counts = moved.groupBy(F.col("workspace").alias("_w")).agg(((F.sum(F.col("gone").cast("int")) == 1) | (F.sum((~F.col("gone")).cast("int")) == 1)).alias("lone"))
    by_name, by_folder = Window.partitionBy("workspace", "size", "name"), Window.partitionBy("workspace", "size", "ext", "folder")
    meets = lambda w: F.max("gone").over(w) & F.max(~F.col("gone")).over(w)
    rows = moved.join(counts, F.col("workspace").eqNullSafe(F.col("_w"))).drop("_w").withColumn("n", meets(by_name)).withColumn("f", meets(by_folder))
    rows = rows.where("lone OR n OR f").withColumn("both", F.col("n") & F.col("f") & ~F.col("lone"))
    coupled = (F.col("n") & F.max("both").over(by_name)) | (F.col("f") & F.max("both").over(by_folder))
    rows = s.written(rows.withColumn("coupled", coupled).drop("both"), "moved-keys")
    key = F.when(F.col("lone"), F.struct(F.lit("all").alias("kind"), F.lit("").alias("of"))).when(F.col("n"), F.struct(F.lit("name").alias("kind"), F.col("name").alias("of"))).otherwise(F.struct(F.lit("folder").alias("kind"), F.col("folder").alias("of")))
    keys = ["workspace", "size", "ext", "key"]
    turn = F.row_number().over(Window.partitionBy(*keys, "gone").orderBy("file_path"))
    ranked = rows.where("NOT coupled").withColumn("key", key).withColumn("turn", turn)
    path = lambda x: F.max(F.when(F.col("gone") == x, F.col("file_path")))
    pairs = ranked.groupBy(*keys, "turn").agg(path(True).alias("old_path"), path(False).alias("new_path")).where("old_path IS NOT NULL AND new_path IS NOT NULL")
    held = rows.where("coupled").groupBy("workspace", "size", "ext").applyInArrow(_greedy, PAIRS)
    return s.written(pairs.select("workspace", "old_path", "new_path").unionByName(held), "renames", keep=True)


def _greedy(group: pa.Table) -> pa.Table:
    """Deleted files in order, each with the first new one that is left under its name or in its folder."""
    rows = group.sort_by("file_path").select(["workspace", "file_path", "gone", "name", "folder"]).to_pylist()
    new = [r for r in rows if not r["gone"]]
    queues: dict[tuple[str, str], deque[int]] = {}
    for i, r in enumerate(new):
        for kind in ("name", "folder"):
            queues.setdefault((kind, r[kind]), deque()).append(i)
    taken, out = set(), []
    for r in rows:
        if not r["gone"]:
            continue
        heads = []
        for kind in ("name", "folder"):
            q = queues.get((kind, r[kind]), ())
            while q and q[0] in taken:
                q.popleft()
            heads += [q[0]] if q else []
        if heads:
            taken.add(min(heads))
            out.append({"workspace": r["workspace"], "old_path": r["file_path"], "new_path": new[min(heads)]["file_path"]})
    return pa.Table.from_pylist(out, pa.schema([("workspace", pa.string()), ("old_path", pa.string()), ("new_path", pa.string())]))


def change_summary(diff: DataFrame, renames: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Counts of each status in a workspace, whether it is up to date, and a line that says so.

    A renamed file is neither new nor deleted. sources: workspace, n_folders, n_web, web_pages, n_drives; where given, the line
    of a workspace without changes names its kinds of sources. A workspace whose files are all new was never read.
    """
    n = lambda s: F.sum((F.col("status") == s).cast("long")).alias(f"n_{s}")
    out = diff.groupBy("workspace").agg(n("new"), n("modified"), n("deleted"), n("unchanged"))
    moved = renames.groupBy("workspace").agg(F.count("*").alias("n_renamed")) if renames is not None else None
    out = out.join(moved, "workspace", "left").fillna(0, ["n_renamed"]) if moved is not None else out.withColumn("n_renamed", F.lit(0).cast("long"))
    virgin = (F.col("n_modified") + F.col("n_deleted") + F.col("n_unchanged") == 0) & (F.col("n_new") > 0)
    out = out.withColumn("_virgin", virgin).withColumns({"n_new": F.col("n_new") - F.col("n_renamed"), "n_deleted": F.col("n_deleted") - F.col("n_renamed")})
    kinds = ("new", "modified", "deleted", "renamed")
    part = lambda s: F.when(F.col(f"n_{s}") > 0, F.concat(F.col(f"n_{s}"), F.lit(f" {s} file"), F.when(F.col(f"n_{s}") > 1, "s").otherwise("")))
    none = F.lit("Up to date (0 changes)")
    if sources is not None:
        out = out.join(sources, "workspace", "full_outer").fillna(0).fillna(False, ["_virgin"])
        web = F.concat(F.lit("All "), "n_web", F.lit(" web sources ("), "web_pages", F.lit(" pages) up to date."))
        drives = F.concat(F.lit("All "), "n_drives", F.lit(" cloud drives connected."))
        none = F.when(F.col("n_folders") + F.col("n_web") + F.col("n_drives") == 0, "No sources configured.").when((F.col("n_folders") == 0) & (F.col("n_web") > 0), web).when((F.col("n_folders") == 0) & (F.col("n_drives") > 0), drives).otherwise(none)
    total = sum((F.col(f"n_{k}") for k in kinds[1:]), F.col("n_new"))
    said = F.concat_ws(", ", *map(part, kinds))
    out = out.withColumns({"up_to_date": (total == 0) & ~F.col("_virgin"), "message": F.when(total > 0, said).otherwise(none)})
    return out.select("workspace", *(f"n_{k}" for k in (*kinds, "unchanged")), "up_to_date", "message")


def change_scan(disk: DataFrame, cache: DataFrame, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(diff, renames, summary) of a workspace's files against its stat cache."""
    diff = stat_diff(disk, cache)
    renames = rename_pairs(diff)
    return diff, renames, change_summary(diff, renames, sources)


def index_folders(chunks: DataFrame, disk: DataFrame, cache: DataFrame, read: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(chunks, cache) after an incremental index: renamed files keep their chunks under the new path, chunks of deleted and
    modified files go, and modified and new files are read.

    chunks: workspace, file_path and more; disk and cache: workspace, file_path, mtime, size; read: files (workspace,
    file_path) to chunks. An unchanged workspace reads nothing.
    """
    on = ["workspace", "file_path"]
    with scratch(chunks.sparkSession) as s:
        changed = s.written(stat_diff(disk, cache).where("status <> 'unchanged'"), "folder-changes", keep=True)
        renames = small(_paired(s, changed), 256)
        old = renames.select("workspace", F.col("old_path").alias("file_path"), "new_path")
        told = renames.select("workspace", F.inline(F.array(F.struct(F.lit("deleted").alias("status"), F.col("old_path").alias("file_path")), F.struct(F.lit("new").alias("status"), F.col("new_path").alias("file_path")))))
        todo = changed.join(told, [*on, "status"], "left_anti")
    gone, fresh = todo.where("status IN ('deleted', 'modified')").select(on), todo.where("status IN ('new', 'modified')").select(on)
    kept = chunks.join(gone, on, "left_anti").join(old, on, "left").withColumn("file_path", F.coalesce("new_path", "file_path")).drop("new_path")
    return kept.unionByName(read(fresh)), disk


def cache_upsert(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The stat cache with rows in place of those of their files."""
    return cache.join(rows.select("workspace", "file_path"), ["workspace", "file_path"], "left_anti").unionByName(rows)


def cache_rename(cache: DataFrame, renames: DataFrame) -> DataFrame:
    """The stat cache with files under their new paths; what was cached there before goes."""
    to = renames.select("workspace", F.col("new_path").alias("file_path"))
    moved = cache.join(to, ["workspace", "file_path"], "left_anti").join(renames.withColumnRenamed("old_path", "file_path"), ["workspace", "file_path"], "left")
    return moved.withColumn("file_path", F.coalesce("new_path", "file_path")).select(*cache.columns)


def sync_kind(page_count: Column, scope: Column) -> Column:
    """How a registered URL is synchronised: as a portal that is crawled, or as one page."""
    return F.when((F.coalesce(F.nullif(page_count, F.lit(0)), F.lit(1)) > 1) | scope.isin("domain", "section", "custom"), "portal").otherwise("single_page")


def crawl_status(pages: DataFrame, ledger: DataFrame) -> DataFrame:
    """pages: url, lastmod, http_status, content_hash, n_chars; ledger: url, lastmod, content_hash. Why each page is read or not."""
    led = ledger.select("url", F.col("lastmod").alias("_lm"), F.col("content_hash").alias("_h"))
    status = (
        F.when(F.col("lastmod").isNotNull() & (F.col("lastmod") == F.col("_lm")), "skipped_lastmod")
        .when((F.col("http_status") == 304) & F.col("_h").isNotNull(), "skipped_304")
        .when(F.col("n_chars") <= 30, "error")
        .when(F.col("content_hash") == F.col("_h"), "skipped_hash")
        .when(F.col("_h").isNull(), "new").otherwise("changed"))
    return pages.join(led, "url", "left").withColumn("status", status).drop("_lm", "_h")


def crawl_counters(status: DataFrame) -> DataFrame:
    got = F.col("status").isin("new", "changed")
    skipped = F.col("status").startswith("skipped")
    out = status.agg(F.sum(got.cast("long")).alias("indexed"), F.sum(skipped.cast("long")).alias("skipped"), F.sum((F.col("status") == "error").cast("long")).alias("errors"),
                     F.sum(F.when(got, F.col("n_chars")).otherwise(0)).alias("chars"), F.sum((got & F.col("is_spa")).cast("long")).alias("spa"))
    return out.withColumn("is_spa_site", (F.col("spa") > 0) & (F.col("spa") >= 0.05 * (F.col("indexed") + F.col("skipped"))))


def upsert_latest(ledger: DataFrame, incoming: DataFrame, keys: list[str], keep_first: list[str], order: str = "updated_at") -> DataFrame:
    """The latest row of each key; columns of keep_first come from the earliest."""
    both = ledger.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    latest, first = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order)), Window.partitionBy(*keys).orderBy("_new", order)
    out = both.withColumns({c: F.first(c).over(first) for c in keep_first} | {"_r": F.row_number().over(latest)})
    return out.where("_r = 1").drop("_r", "_new")


def due(sources: DataFrame, now: Column) -> DataFrame:
    """Sources never read, or read longer ago than their interval in hours."""
    return sources.where(F.col("last_scraped_at").isNull() | (F.col("last_scraped_at") + F.make_interval(hours=F.col("polling_interval_hours")) <= now))


def progress(rows: DataFrame, width: Column | int = 8) -> DataFrame:
    """Adds pct and bar to current, total, stage; the bar's fill is rounded half to even, its number cut."""
    w = F.lit(width) if isinstance(width, int) else width
    share = F.col("current") / F.col("total")
    pct = F.when(F.col("total") > 0, F.round(100.0 * share, 1)).otherwise(F.lit(0.0))
    full = F.least(w, F.greatest(F.lit(0), F.bround(w * share).cast("int")))
    stage = F.when(F.col("stage").isin("files", "pages", "drives"), F.concat(F.lit(" "), "stage")).otherwise("")
    bar = F.concat(F.lit("["), F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), w - full), F.lit("] "), pct.cast("int"), F.lit("% ("), "current", F.lit("/"), "total", stage, F.lit(")"))
    idle = F.when(F.col("stage") == "scanning", "[scanning...]").otherwise("[calculating...]")
    return rows.withColumns({"pct": pct, "bar": F.when(F.col("total") > 0, bar).otherwise(idle)})
