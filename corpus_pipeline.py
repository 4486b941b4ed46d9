"""A training corpus from `documents`: quality, exact copies, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the last
return the columns of documents. A runner may write each stage's rows as Parquet and read them again for the next. Tables that
a stage makes on its way are deleted before it returns, but for what its result still reads.

Defined results: a null text is the empty text, which the quality stage judges like any other; rows of one id and one text
count once after the exact stage, and of the copies of a text the smallest id stays, a null id only where no other is there;
documents without words have no near copies; a row with a null id is kept by the near and mixing stages; of ties, the smaller
id; other columns, whatever their names, pass through to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import exact_dedup, mixing, ngram_join, packing, quality
from skein.llm.common import fresh, materialise, small, table, temporary

#: Shares of clean and toxic tokens wanted in the mix; clean documents stay whole, the others give way.
MIX_TARGETS = {"clean": 0.97, "toxic": 0.03}
MIX_FLOORS = {"clean": 1.0}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs, keep="min")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets that link at a similarity of 0.8 stays: the smallest id."""
    with temporary(spark):
        found = ngram_join.jaccard_components(docs, k=5, percent=80)
        gone = materialise(found.where("doc_id != component_id").select(F.col("doc_id").alias("gone")), "near-gone", keep=True)
    gone = small(gone.toDF(fresh(docs, "_near_gone")), 16)
    return docs.join(gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an unwanted domain are thinned to their target; labels of poor quality are what stage 1 went by."""
    labelled = mixing.label_domains(table(spark, sf_dir, "labels")).where("domain in ('clean', 'toxic')")
    return mixing.mix(docs, labelled, MIX_TARGETS, MIX_FLOORS, keep="clean")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Classifiers and tokens cannot be written in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that every stage keeps."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
