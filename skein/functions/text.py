"""Text expressions: hashes, title, summary, keywords, context header."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

#: Words that are never keywords (fixed values; Portuguese and English, of four letters or more).
STOP_WORDS = (
    "umas", "pelo", "pela", "pelos", "pelas", "para", "sobre", "como", "mais", "muito", "seus", "suas", "este", "esta", "estes", "estas", "esse", "essa",
    "with", "from", "about", "into", "like", "through", "after", "over", "between", "were", "been", "being", "have", "does", "could", "should", "would",
    "might", "must", "will")
_STOP = frozenset(STOP_WORDS)
WORD, SPACES = re.compile(r"\b[a-zA-ZÀ-ÿ]{4,}\b"), re.compile(r"[ \t\n\v\f\r]+")
TITLE_BOOST, TOP_KEYWORDS = 5, 7


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank_to(x: Column, default: str) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def normal_path(x: Column) -> Column:
    return F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("/"))


def content_hash(text: Column) -> Column:
    return F.sha2(strip(text), 256)


def chunk_id(workspace: Column, text: Column) -> Column:
    return F.concat(workspace, F.lit("_"), F.substring(F.sha2(text, 256), 1, 20))


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), strip), lambda x: x != "")


def title(text: Column, file_name: Column) -> Column:
    """The first of a text's first eight lines that reads as a title, without heading marks; else the file's name."""
    good = F.filter(F.slice(lines(text), 1, 8), lambda x: x.startswith("#") | (F.length(x) < 120))
    clean = F.filter(F.transform(good, lambda x: strip(F.regexp_replace(x, r"^[#*\-\s]+", ""))), lambda x: F.length(x) > 3)
    return F.coalesce(F.get(clean, F.lit(0)), file_name)


def summary(text: Column, file_name: Column) -> Column:
    """The title and up to three sentences of the first twelve lines, 450 characters at most."""
    lead = F.array_join(F.slice(lines(text), 1, 12), " ")
    sentences = F.filter(F.transform(F.split(lead, r"(?<=[.!?])\s+"), strip), lambda x: F.length(x) > 20)
    body = F.when(F.size(sentences) > 0, F.array_join(F.slice(sentences, 1, 3), " ")).otherwise(F.substring(strip(text), 1, 400))
    full = F.concat(F.lit("Document '"), title(text, file_name), F.lit("': "), body)
    return F.when(F.length(full) > 450, F.concat(F.substring(full, 1, 447), F.lit("..."))).otherwise(full)


@F.arrow_udf(Ty.ArrayType(Ty.StructType([Ty.StructField("keyword", Ty.StringType()), Ty.StructField("freq", Ty.LongType())])))
def top_keywords(text: pa.Array, head: pa.Array) -> pa.Array:
    """The most frequent words of each text, a title's counted five times more; ties by first place, a title's words after the text's."""

    def one(body: str | None, title_: str | None) -> list[dict]:
        n = Counter(w for w in WORD.findall((body or "").lower()) if w not in _STOP)
        for w in WORD.findall((title_ or "").lower()):
            if w not in _STOP:
                n[w] += TITLE_BOOST
        return [{"keyword": w, "freq": c} for w, c in sorted(n.items(), key=lambda x: -x[1])[:TOP_KEYWORDS]]

    kind = pa.list_(pa.struct([("keyword", pa.string()), ("freq", pa.int64())]))
    return pa.array([one(t.as_py(), h.as_py()) for t, h in zip(text, head)], kind)


def keywords(docs: DataFrame) -> DataFrame:
    """docs: text, file_name. Adds top: (keyword, freq) of the most frequent words, computed in the row."""
    return docs.withColumn("top", top_keywords(F.col("text"), title(F.col("text"), F.col("file_name"))))


def envelope(summary_: Column, keyword_text: Column, chunk: Column) -> Column:
    return F.concat(F.lit("[Context: "), summary_, F.lit(" | Keywords: "), blank_to(keyword_text, "general"), F.lit("]\n---\n"), chunk)


def chunk_words(text: Column, size: int, overlap: int) -> Column:
    """Array of (ord, text): windows of `size` words that overlap by `overlap`; the splitter is ours and counts words. Linear in the text."""

    @F.arrow_udf(Ty.ArrayType(Ty.StructType([Ty.StructField("ord", Ty.IntegerType()), Ty.StructField("text", Ty.StringType())])))
    def windows(col: pa.Array) -> pa.Array:
        def one(t: str | None) -> list[dict]:
            words = [w for w in SPACES.split((t or "").strip()) if w]
            last = max(-(-(len(words) - overlap) // (size - overlap)), 1) if words else 0
            return [{"ord": i, "text": " ".join(words[i * (size - overlap) : i * (size - overlap) + size])} for i in range(last)]

        return pa.array([one(t.as_py()) for t in col], pa.list_(pa.struct([("ord", pa.int32()), ("text", pa.string())])))

    return windows(text)
