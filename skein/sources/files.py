"""Folder discovery and loading of local or shared documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never read, and file endings that are (fixed values).
IGNORED_FOLDERS = (".git", ".svn", "node_modules", "__pycache__", ".venv", "venv", "env", ".vs", ".idea", ".vscode", "$recycle.bin", ".tmp")
EXTENSIONS = (
    "pdf", "docx", "doc", "txt", "md", "rtf", "odt", "pages", "epub", "eml", "msg", "csv", "tsv", "json", "jsonl", "xlsx", "xls", "ods", "pptx", "ppt", "key",
    "py", "js", "ts", "tsx", "jsx", "html", "htm", "css", "xml", "yaml", "yml", "toml", "sql", "c", "cpp", "cs", "java", "go", "rs", "sh", "ps1", "bat", "cmd",
    "png", "jpg", "jpeg", "webp")
#: Endings of files that are not text; they are found and listed, and their text is null.
BINARY = ("pdf", "docx", "doc", "rtf", "odt", "pages", "epub", "msg", "xlsx", "xls", "ods", "pptx", "ppt", "key", "png", "jpg", "jpeg", "webp")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size, content) of the documents under root; hidden, temporary and ignored ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.expr("regexp_replace(path, '^[a-z]+:/*', '/')")
    base = root.removeprefix("file://").rstrip("/")
    parts = F.split(F.substring(rel, len(base) + 2, 1 << 30), "/")
    name = F.element_at(parts, F.lit(-1))
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad = F.exists(folders, lambda x: x.startswith(".") | F.lower(x).isin(*IGNORED_FOLDERS))
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kept = files.where(~bad & ~name.startswith("~$") & ~name.startswith("._") & ext.isin(*EXTENSIONS))
    return kept.select(rel.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def load_text(files: DataFrame) -> DataFrame:
    """discover()'s files with text; files of binary formats and bytes that are not UTF-8 text give a null text and corrupt = true."""
    binary = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*BINARY)
    text = F.when(~binary, F.try_validate_utf8(F.col("content").cast("string")))
    out = files.withColumn("text", text)
    return out.select("path", F.element_at(F.split("path", "/"), F.lit(-1)).alias("file_name"), "text", F.date_format("mtime", "yyyy-MM-dd").alias("last_modified"), F.lit("Local Document").alias("content_type"),
                      F.lit("filesystem_timestamp").alias("date_confidence"), "size", F.col("text").isNull().alias("corrupt"))
