"""Conversation memory and history pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PRIOR_TURN, TURN_CUT

META_LEAST, META_BATCH = 30, 10
OLD_TOOL_CHARS, TURN_BUDGET, TURN_FLOOR = 300, 40_000, 4000


def history(turns: DataFrame) -> DataFrame:
    """conv_id and one text of its user and assistant turns, in order."""
    said = turns.where(F.col("role").isin("user", "assistant"))
    line = F.concat(F.upper("role"), F.lit(": "), "text", F.lit("\n"))
    listed = F.sort_array(F.collect_list(F.struct("turn", line.alias("l"))))  # one conversation
    return said.groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda x: x["l"]), "").alias("history"))


def by_level(memory: DataFrame) -> DataFrame:
    return memory.groupBy("workspace", "level").agg(F.count("*").alias("n"))


def meta_batch(memory: DataFrame, least: int = META_LEAST, batch: int = META_BATCH) -> DataFrame:
    """The oldest session summaries of each workspace that has enough of them; memory: id, workspace, level, ts.

    The first of each workspace are ranked in every task before they are shuffled, so no task sorts a whole workspace.
    """
    s = memory.where("level = 'session_summary'")
    enough = s.groupBy("workspace").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("workspace")
    first = s.withColumn("rank", F.row_number().over(Window.partitionBy("workspace").orderBy("ts", "id"))).where(F.col("rank") <= batch)
    return first.join(enough, "workspace", "left_semi")


def consolidated(memory: DataFrame, least: int = META_LEAST, batch: int = META_BATCH) -> DataFrame:
    """memory (id, workspace, level, ts, content) after one round: each oldest batch gives way to one meta summary.

    The summary is a provider's stand-in: the first sentence of each text, in order; its id names its first text, its time is its last one's.
    """
    oldest = meta_batch(memory, least, batch)
    first = F.regexp_extract("content", r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    line = F.when(first != "", first).otherwise(F.col("content"))
    listed = F.sort_array(F.collect_list(F.struct("rank", line.alias("l"))))  # a batch of a workspace
    merged = oldest.groupBy("workspace").agg(F.concat(F.lit("meta_"), F.min_by("id", "rank")).alias("id"), F.max("ts").alias("ts"), F.array_join(F.transform(listed, lambda x: x["l"]), " ").alias("content"))
    return memory.join(oldest.select("id"), "id", "left_anti").unionByName(merged.withColumn("level", F.lit("meta_summary")).select(*memory.columns))


def stored(memory: DataFrame, summaries: DataFrame, ts: Column) -> DataFrame:
    """memory with a session summary of each thread: summaries: conv_id, workspace, summary."""
    new = summaries.where("summary <> ''").select(F.concat(F.lit("s_"), F.col("conv_id")).alias("id"), "workspace", F.lit("session_summary").alias("level"), ts.alias("ts"), F.col("summary").alias("content"))
    return memory.unionByName(new.select(*memory.columns))


def reset(memory: DataFrame, workspace: str | None = None) -> DataFrame:
    """memory without a workspace's entries, or without any."""
    return memory.where(F.col("workspace") != workspace) if workspace else memory.limit(0)


def pruned_history(turns: DataFrame) -> DataFrame:
    """Long tool texts of a conversation of more than two turns give way to a marker."""
    n = F.count("*").over(Window.partitionBy("conv_id"))
    long = (F.col("role") == "tool") & (F.length("text") > OLD_TOOL_CHARS) & (n > 2)
    return turns.withColumn("text", F.when(long, PRIOR_TURN).otherwise(F.col("text")))


def turn_budget(turns: DataFrame) -> DataFrame:
    """Tool texts after the last user turn share a budget; every earlier one gives way to a marker."""
    conv = Window.partitionBy("conv_id")
    last = F.coalesce(F.max(F.when(F.col("role") == "user", F.col("turn"))).over(conv), F.lit(-1))
    t = turns.withColumn("_now", F.col("turn") > last)
    tools = F.sum(((F.col("role") == "tool") & F.col("_now")).cast("int")).over(conv)
    share = F.greatest(F.lit(TURN_FLOOR), F.floor(F.lit(TURN_BUDGET) / F.greatest(tools, F.lit(1))))
    cut = F.when(F.length("text") > share, F.concat(F.substring("text", F.lit(1), share.cast("int")), F.lit(TURN_CUT))).otherwise(F.col("text"))
    return t.withColumn("text", F.when(F.col("role") != "tool", F.col("text")).when(F.col("_now"), cut).otherwise(F.lit(PRIOR_TURN))).drop("_now")


def summarised(turns: DataFrame, sentences: int = 3) -> DataFrame:
    """conv_id and a summary: a provider's stand-in that takes the first sentences said."""
    h = history(turns)
    parts = F.filter(F.split(F.regexp_replace("history", r"(?m)^(USER|ASSISTANT): ", ""), r"(?<=[.!?])\s+"), lambda x: F.length(F.trim(x)) > 20)
    return h.select("conv_id", F.array_join(F.slice(parts, 1, sentences), " ").alias("summary"))
