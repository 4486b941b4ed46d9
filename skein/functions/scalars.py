"""Small expressions of the settings and command layers: versions, names, delays, errors, commands."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

#: Kinds of a provider's errors with the texts that tell them, in order; of the first three, a number too (fixed values).
ERRORS = [
    ("model", ("model_not_found", "does not exist or you do not have access", "404")),
    ("key", ("invalid_api_key", "authentication", "401", "unauthorized")),
    ("quota", ("insufficient_quota", "quota", "credit", "billing")),
    ("rate", ("rate_limit", "429", "too many requests")),
    ("connection", ("connection", "timeout", "refused")),
    ("tools", ("reasoning_effort", "function tools")),
    ("stream", ("decompress", "truncated stream", "error -5", "zlib")),
]
CUTOFF = 0.45


def version_tuple(x: Column) -> Column:
    """Array of the numbers of a version; text after its first word and letters after a number are left out."""
    clean = F.regexp_replace(F.element_at(F.split(F.trim(F.regexp_replace(x, "^v+", "")), r"\s+"), F.lit(-1)), "^v+", "")
    parts = F.filter(F.transform(F.split(clean, r"\."), lambda p: F.regexp_extract(p, "^([0-9]+)", 1)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts.cast("array<int>")).otherwise(F.array(F.lit(0), F.lit(0), F.lit(0)))


def version_tag(x: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.trim(x), "^@", ""))
    return F.when(F.lower(clean).isin("latest", "current", "head"), "latest").when(clean.startswith("v"), clean).otherwise(F.concat(F.lit("v"), clean))


def safe_name(x: Column) -> Column:
    """A file name: what is no letter, digit, dash or underscore becomes an underscore."""
    return F.regexp_replace(x, r"[^\p{L}\p{N}_-]", "_")


def quoted(x: Column) -> Column:
    """A text inside a SQL literal."""
    return F.replace(x, F.lit("'"), F.lit("''"))


def retry_delay(attempt: Column, jitter: Column) -> Column:
    return 1.5 * F.pow(F.lit(2.0), attempt) + jitter


def error_kind(x: Column) -> Column:
    low = F.lower(x)
    out = F.when(F.lit(False), "")
    for kind, parts in ERRORS:
        hit = F.lit(False)
        for p in parts:
            hit = hit | low.contains(p)
        out = out.when(hit | (low.contains("tool") & low.contains("not supported")) if kind == "tools" else hit, kind)
    return out.otherwise("other")


def command_words(x: Column) -> Column:
    """Words of a command line; a quoted part is one word, without its quotes."""
    found = F.regexp_extract_all(x, F.lit(r"\"[^\"]*\"|'[^']*'|[^\s\"']+"), F.lit(0))
    return F.filter(F.transform(found, lambda w: F.regexp_replace(w, "^['\"]|['\"]$", "")), lambda w: w != "")


def suggested(typed: Column, known: list[str]) -> Column:
    """The command most like the first word typed, or null where none is like enough."""

    @F.arrow_udf(Ty.StringType())
    def run(col: pa.Array) -> pa.Array:
        near = [difflib.get_close_matches(((t or "").split() or [""])[0].lower(), known, n=1, cutoff=CUTOFF) for t in col.to_pylist()]
        return pa.array([n[0] if n else None for n in near], pa.string())

    return run(typed)
