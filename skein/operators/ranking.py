"""Operators on scored rows of a batch of queries: q, pos (from 0, best first), score, src, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BUDGET_FREE, BUDGET_LEAST, TRUNCATED


def positioned(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with pos, their place among those of their query."""
    return rows.withColumn("pos", (F.row_number().over(Window.partitionBy("q").orderBy(*order)) - 1).cast("long"))


def threshold(rows: DataFrame, least: float) -> DataFrame:
    """Rows of score >= least; of a query that has none, the first row."""
    w = Window.partitionBy("q")
    passed = F.max(F.col("score") >= least).over(w)
    return rows.withColumn("_any", passed).where((F.col("score") >= least) | (~F.col("_any") & (F.col("pos") == 0))).drop("_any")


def round_robin(rows: DataFrame, k: int, per_source: int) -> DataFrame:
    """k rows a query: sources take turns in order of first appearance, then what is left, by place; pos is anew."""
    src = Window.partitionBy("q", "src")
    turn = F.row_number().over(src.orderBy("pos"))
    first = F.min("pos").over(src)
    r = rows.withColumns({"_turn": turn, "_first": first}).withColumn("_late", F.col("_turn") > per_source)
    order = Window.partitionBy("q").orderBy("_late", F.when(F.col("_late"), 0).otherwise(F.col("_turn")), F.when(F.col("_late"), F.col("pos")).otherwise(F.col("_first")), "pos")
    out = r.withColumn("_ord", F.row_number().over(order)).where(F.col("_ord") <= k)
    return out.withColumn("pos", (F.col("_ord") - 1).cast("long")).drop("_turn", "_first", "_late", "_ord")


def distinct_first(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each key in a query; pos is anew."""
    w = Window.partitionBy("q", key).orderBy("pos")
    kept = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return kept.withColumn("pos", (F.row_number().over(Window.partitionBy("q").orderBy("pos")) - 1).cast("long"))


def char_budget(rows: DataFrame, most: int) -> DataFrame:
    """Rows until the running length passes most; from the fourth on, the one that passes is cut if enough room is left."""
    w = Window.partitionBy("q").orderBy("pos")
    n = F.length("text").cast("long")
    r = rows.withColumn("_cum", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.min(F.when((F.col("_cum") > most) & (F.col("pos") >= BUDGET_FREE), F.col("pos"))).over(Window.partitionBy("q"))
    r = r.withColumns({"_stop": stop, "_room": F.greatest(F.lit(0), F.lit(most) - (F.col("_cum") - n))})
    kept = r.where(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")) | ((F.col("pos") == F.col("_stop")) & (F.col("_room") > BUDGET_LEAST)))
    cut = F.concat(F.substring("text", F.lit(1), F.col("_room").cast("int")), F.lit(TRUNCATED))
    return kept.withColumn("text", F.when(F.col("pos") == F.col("_stop"), cut).otherwise(F.col("text"))).drop("_cum", "_stop", "_room")


def rendered(rows: DataFrame) -> DataFrame:
    """(q, rendered): the chunks of each query as one text, each under its header."""
    part = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
    head = F.concat_ws(" | ", F.concat(F.lit("Source: "), "file_name"), F.concat(F.lit("Workspace: "), "workspace"), part("Last Modified", "last_modified"), part("Type", "content_type"), part("Keywords", "keywords"))
    block = F.concat(F.lit("--- [Document Chunk "), F.col("pos") + 1, F.lit(" | "), head, F.lit("] ---\nPath: "), "file_path", F.lit("\nContent:\n"), "text")
    listed = F.sort_array(F.collect_list(F.struct("pos", block.alias("b"))))  # top-k rows a query
    return rows.groupBy("q").agg(F.array_join(F.transform(listed, lambda x: x["b"]), "\n\n").alias("rendered"))
