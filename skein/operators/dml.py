"""Changes of the chunk table as functions from the old table to the new one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_workspace(old: DataFrame, workspace: str) -> DataFrame:
    return old.where(F.col("workspace") != workspace)


def delete_local_docs(old: DataFrame, workspace: str) -> DataFrame:
    return old.where(~((F.col("workspace") == workspace) & (F.col("content_type") == "Local Document")))


def delete_file(old: DataFrame, path: str, workspace: str | None = None) -> DataFrame:
    hit = F.col("file_path") == path.replace("\\", "/")
    return old.where(~(hit & (F.col("workspace") == workspace) if workspace else hit))


def delete_ids(old: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return old.join(ids.select(key), key, "left_anti")


def rename_workspace(old: DataFrame, name: str, to: str) -> DataFrame:
    return old.withColumn("workspace", F.when(F.col("workspace") == name, to).otherwise(F.col("workspace")))


def transfer(old: DataFrame, source: str, name: str, to: str) -> DataFrame:
    """Rows of a workspace whose path is a source, lies below it or holds it anywhere move to another workspace."""
    hit = F.col("file_path").contains(source.replace("\\", "/"))
    return old.withColumn("workspace", F.when((F.col("workspace") == name) & hit, to).otherwise(F.col("workspace")))


def replace_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """A changed page or file: all its rows go, then the new ones come, by workspace and path."""
    on = ["workspace", "file_path"]
    return old.join(new.select(on).distinct(), on, "left_anti").unionByName(new)


def put(old: DataFrame, new: DataFrame, keys: list[str], replace: bool = True) -> DataFrame:
    """Insert or replace by keys; with replace=False, rows whose keys are there already do not come."""
    if replace:
        return old.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new)
    return old.unionByName(new.dropDuplicates(keys).join(old.select(keys), keys, "left_anti"))


def removed(old: DataFrame, changes: dict[str, DataFrame]) -> DataFrame:
    """(change, n): how many rows each change took away, in one aggregation over the old rows and those that each change keeps."""
    kept = [new.select(F.lit(name).alias("change"), F.lit(-1).alias("d")) for name, new in changes.items()]
    rows = old.select(F.explode(F.array(*map(F.lit, changes))).alias("change"), F.lit(1).alias("d"))
    for k in kept:
        rows = rows.unionByName(k)
    return rows.groupBy("change").agg(F.sum("d").alias("n"))


def consolidate_root(sources: DataFrame, workspace: str, root: str, title: str, page_count: int) -> DataFrame:
    """In one workspace, URLs below a root and those registered under it give way to one row of the root with this page count."""
    mine = F.col("workspace") == workspace
    below = mine & (F.col("url") != root) & (F.coalesce(F.col("root_url") == root, F.lit(False)) | F.col("url").startswith(root.rstrip("/") + "/"))
    there = sources.where(mine & (F.col("url") == root)).limit(1)
    one = sources.sparkSession.range(1).select(F.lit(workspace).alias("workspace"), F.lit(root).alias("url"), F.lit(root).alias("root_url"), F.lit(title).alias("title"), F.lit(page_count).alias("page_count"))
    kept = sources.where(~below).withColumns({"title": F.when(mine & (F.col("url") == root), title).otherwise(F.col("title")), "page_count": F.when(mine & (F.col("url") == root), page_count).otherwise(F.col("page_count"))})
    return kept.unionByName(one.join(there.select("workspace"), "workspace", "left_anti").select(*sources.columns))


def transfer_folder(paths: DataFrame, cache: DataFrame, chunks: DataFrame, folder: str, name: str, to: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A folder moves: in the workspaces' path lists (workspace, paths), in the stat cache and with its chunks. Nothing moves within one workspace or from or to one that is not there."""
    folder = folder.strip().strip("'\"").rstrip("/")
    there = {r["workspace"] for r in paths.where(F.col("workspace").isin(name, to)).select("workspace").distinct().collect()}
    if name == to or not {name, to} <= there:
        return paths, cache, chunks
    clean = lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), "^['\"]+|['\"]+$", ""), "/+$", "")
    lost = F.filter("paths", lambda p: clean(p) != folder)
    won = F.array_union(F.transform("paths", clean), F.array(F.lit(folder)))
    moved = paths.withColumn("paths", F.when(F.col("workspace") == name, lost).when(F.col("workspace") == to, won).otherwise(F.col("paths")))
    below = (F.col("workspace") == name) & ((F.col("file_path") == folder) | F.col("file_path").startswith(folder + "/"))
    return moved, cache.withColumn("workspace", F.when(below, to).otherwise(F.col("workspace"))), transfer(chunks, folder, name, to)


def transfer_web(urls: DataFrame, pages: DataFrame, target: str, name: str, to: str) -> tuple[DataFrame, DataFrame]:
    """A web source moves with its ledger rows: the one of this URL or root, else the first whose URL holds it."""
    if name == to:
        return urls, pages
    mine = urls.where(F.col("workspace") == name)
    rank = F.when((F.col("url") == target) | (F.col("root_url") == target), 0).otherwise(1)
    hit = mine.where(F.col("url").contains(target) | (F.col("root_url") == target)).withColumn("_r", rank).orderBy("_r", "url").first()
    root = (hit["root_url"] or hit["url"]) if hit else target
    match = lambda df: (F.col("workspace") == name) & (F.col("url").contains(root) | (F.coalesce(F.col("root_url"), F.lit("")) == root))
    in_ledger = match(pages) | ((F.col("workspace") == name) & F.coalesce(F.col("root_url"), F.lit("")).contains(root))
    return (urls.withColumn("workspace", F.when(match(urls), to).otherwise(F.col("workspace"))), pages.withColumn("workspace", F.when(in_ledger, to).otherwise(F.col("workspace"))))


def link(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links of sources to workspaces, each (workspace, source_type, identifier) once; a new title replaces the old one."""
    return put(links, new, ["workspace", "source_type", "identifier"])


def unlink(links: DataFrame, workspace: str, source_type: str, identifier: str) -> DataFrame:
    return links.where(~((F.col("workspace") == workspace) & (F.col("source_type") == source_type) & (F.col("identifier") == identifier)))


def delete_root(ledger: DataFrame, workspace: str, root: str) -> DataFrame:
    """The page ledger without a root and its pages."""
    return ledger.where(~((F.col("workspace") == workspace) & ((F.col("url") == root) | F.coalesce(F.col("root_url") == root, F.lit(False)))))
