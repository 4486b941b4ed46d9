"""The chunk table, and how the driver's tables stand in for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = (
    "id string, vector array<float>, text string, file_name string, file_path string, workspace string, last_modified string, "
    "content_type string, document_summary string, keywords string, content_hash string")  # fmt: skip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks, with their embedding where they have one: the language is the workspace, the source the path."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    joined = docs.join(vectors, docs.doc_id == vectors.vec_id, "left")
    digest = F.sha2("text", 256)
    return joined.select(
        "doc_id", F.concat("lang", F.lit("_"), F.substring(digest, 1, 20)).alias("id"), F.col("embedding").alias("vector"), "text",
        F.concat("source", F.lit(".md")).alias("file_name"), F.col("source").alias("file_path"), F.col("lang").alias("workspace"),
        F.lit("").alias("last_modified"), F.lit("Local Document").alias("content_type"), digest.alias("content_hash"))


#: The same as SQL for the oracle.
CHUNKS_SQL = """chunks AS (
    SELECT d.doc_id, d.lang || '_' || substr(sha256(d.text), 1, 20) AS id, e.embedding AS vector, d.text, d.source || '.md' AS file_name,
           d.source AS file_path, d.lang AS workspace, '' AS last_modified, 'Local Document' AS content_type, sha256(d.text) AS content_hash
    FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, workspace, vector): every embedded document whose id is divisible by 20, as a batch of queries."""
    c = chunks(spark, sf_dir)
    return c.where("doc_id % 20 = 0 AND vector IS NOT NULL").select(F.col("doc_id").alias("q"), "workspace", "vector")


def fixture(spark: SparkSession, columns: str, values: str) -> DataFrame:
    """An inline table; columns: comma-separated names."""
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")
