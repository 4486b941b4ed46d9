"""Operator 10, exact deduplication: 128-bit content hash groups, bytes compared inside each group.

Defined results: null text counts as the empty text; texts are equal when their bytes are; of equal rows the largest
(keep="max") or smallest id stays; a row repeated with the same id and text is reported as often as it occurs, and
`drop_copies` returns it once; an empty table gives an empty result; other columns, whatever their names, are ignored.
A null id takes part in its group's size, is never the kept row while another id is there, and stays if it is alone:
of each text that only null ids have, one row stays, and an id's rows of several texts are judged text by text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, small, table, temporary


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", hash128: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    pick = {"max": F.max, "min": F.min}[keep]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = materialise(base.select("doc_id", hash128(F.col("t")).alias("h"), F.sha2("t", 256).alias("text_sha256")), "exact-rows")
    groups = materialise(rows.groupBy("h").agg(F.count("*").alias("group_size"), pick("doc_id").alias("keep_id")), "exact-groups")

    # Byte comparison: a group is of one text exactly when the least and the greatest of its texts are the same bytes.
    # Both are combined before the shuffle, so a group of any size sends two texts per task.
    several = small(groups.where("group_size > 1").select("h"), 48)
    texts = base.withColumn("h", hash128(F.col("t"))).join(several, "h", "left_semi")
    mixed = materialise(texts.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo != hi").select("h"), "exact-mixed")
    out = rows.join(groups, "h")
    if not mixed.isEmpty():
        exact = texts.join(mixed, "h", "left_semi").withColumn("text_sha256", F.sha2("t", 256))
        split = exact.groupBy("h", "t", "text_sha256").agg(F.count("*").alias("group_size"), pick("doc_id").alias("keep_id"))
        out = out.join(mixed, "h", "left_anti").select("doc_id", "text_sha256", "group_size", "keep_id").unionByName(
            exact.join(split, ["h", "t", "text_sha256"]).select("doc_id", "text_sha256", "group_size", "keep_id"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """docs without the rows that exact_groups does not keep; all columns stay. A row is known by its id and its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    with temporary(docs.sparkSession):
        found = exact_groups(docs, id_col, text_col, keep).select("doc_id", F.unhex("text_sha256").alias("sha"), "kept")
        found = materialise(found, "exact-kept")
        gone = found.where("not kept").select(F.col("doc_id").alias("_gone"), F.col("sha").alias("_sha")).distinct()
        again = found.where("kept").groupBy("doc_id", "sha").count().where("count > 1").select(F.col("doc_id").alias("_again"), F.col("sha").alias("_sha"))
        gone, again = materialise(gone, "exact-gone", keep=True), materialise(again, "exact-again", keep=True)
    own_id, own_sha, own_text = (fresh(docs, f"_exact_{x}") for x in ("id", "sha", "text"))
    rows = docs.withColumns({own_id: F.col(id_col).cast("long"), own_sha: F.unhex(F.sha2(text, 256))})

    def join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        r = small(right.toDF(fresh(left, "_r_id"), fresh(left, "_r_sha")), 64)
        return left.join(r, left[own_id].eqNullSafe(r[r.columns[0]]) & (left[own_sha] == r[r.columns[1]]), how)

    out = join(rows, gone, "left_anti")
    if not again.isEmpty():
        once = join(out, again, "left_semi").withColumn(own_text, text)
        once = once.dropDuplicates([own_id, own_text]).drop(own_text)
        out = join(out, again, "left_anti").unionByName(once)
    return out.drop(own_id, own_sha)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLE = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
}
