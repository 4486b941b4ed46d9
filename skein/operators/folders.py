"""Which files are under which workspace's folders: a path belongs to a workspace if it starts with one of its folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, small


def _prefixes(path: Column, lengths: list[int]) -> Column:
    """The path's own beginnings of the given lengths."""
    return F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))


def outermost(folders: DataFrame) -> DataFrame:
    """(workspace, folder), each once, without folders that start with another of their workspace."""
    f = folders.where("workspace IS NOT NULL AND folder IS NOT NULL").select("workspace", "folder").distinct()
    lengths = _lengths(f)
    if not lengths:
        return f
    inner = f.select("workspace", "folder", F.explode(_prefixes(F.col("folder"), lengths)).alias("outer")).where("outer != folder")
    return f.join(inner.join(f.select("workspace", F.col("folder").alias("outer")), ["workspace", "outer"]), ["workspace", "folder"], "left_anti")


def _lengths(folders: DataFrame) -> list[int]:
    """Lengths that folders have: no more than a path has letters."""
    return sorted(r[0] for r in folders.select(F.length("folder")).distinct().collect())


def under(files: DataFrame, folders: DataFrame, path_col: str) -> DataFrame:
    """Rows of files with the workspace of each workspace whose folder (workspace, folder) their path starts with, once each.

    A path's own beginnings are the keys of an equi-join. Of a workspace's folders only the outermost take part, so a path
    meets at most one of them and no rows need be told apart afterwards. An empty folder holds every path; null paths and
    folders match nothing.
    """
    few = Scratch(files.sparkSession).written(outermost(folders), "folders-outer", keep=True)
    lengths = _lengths(few)
    if not lengths:
        return files.withColumn("workspace", F.lit(None).cast("string")).limit(0)
    keyed = files.where(F.col(path_col).isNotNull()).withColumn("_folder", F.explode(_prefixes(F.col(path_col), lengths)))
    return keyed.join(small(few, 256).withColumnRenamed("folder", "_folder"), "_folder").drop("_folder")
