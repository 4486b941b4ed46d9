"""Vectors of texts from a provider that is called with batches: equal texts once, whole batches, failures told apart.

A provider takes a list of texts and returns a vector for each; it is called in the tasks, with `batch` texts at a time whatever
the sizes of Arrow's batches. A call that is refused for its rate is made again after a growing pause; a call that fails
otherwise is split in two until the texts that cannot be embedded stand alone, and these get an error in place of a vector.

Defined results: null and blank texts are not sent and have the error "empty"; a vector of another width than `width` (or, where
that is not given, than the most common one) is an error too; rows of equal text have equal vectors. Queries go through the
same code, so that they are embedded as the chunks are.
"""

from __future__ import annotations

import random
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workers import give_back
from ..sources.scratch import scratch, small

BATCH, TRIES, PAUSE = 50, 4, 1.5
Provider = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class HashedWords:
    """A provider that needs no network: signed counts of hashed words, of length one."""

    width: int = 64

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.width))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.width] += 1 if (h // self.width) % 2 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1)).tolist()


def refused(error: Exception) -> bool:
    """Whether a provider asks to wait."""
    said = str(error).lower()
    return "429" in said or "tpm" in said or ("rate" in said and "limit" in said)


def called(provider: Provider, texts: list[str], tries: int = TRIES, pause: float = PAUSE) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text. A batch that fails is split, so one bad text costs a few more calls and no other text its vector."""
    error: Exception | None = None
    for attempt in range(tries):
        try:
            got = provider(texts)
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
            return [(v, None) if v is not None and len(v) else (None, "no vector") for v in got]
        except Exception as e:  # noqa: BLE001  whatever a provider raises
            error = e
            if not refused(e):
                break
            if attempt + 1 < tries:
                time.sleep(pause * 2**attempt + random.uniform(0, pause / 3))
    if len(texts) == 1 or refused(error):
        return [(None, str(error) or type(error).__name__)] * len(texts)
    half = len(texts) // 2
    return called(provider, texts[:half], tries, pause) + called(provider, texts[half:], tries, pause)


def embedded(rows: DataFrame, text_col: str, provider: Provider, batch: int = BATCH, width: int | None = None, pause: float = PAUSE) -> DataFrame:
    """rows with vector (array of floats, null where there is none) and error (null where there is one)."""
    blank = F.coalesce(F.trim(F.regexp_replace(text_col, r"\s+", " ")), F.lit("")) == ""
    key = F.unhex(F.sha2(text_col, 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, str]] = []

        def sent(some: list[tuple[bytes, str]]) -> pa.RecordBatch:
            got = called(provider, [t for _, t in some], pause=pause)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.binary()), pa.array([v for v, _ in got], pa.list_(pa.float32())), pa.array([e for _, e in got], pa.string())], ["_key", "vector", "error"])

        try:
            for b in batches:
                at = 0
                while at < len(b):  # no more rows become objects than one call takes
                    some = b.slice(at, batch - len(held))
                    at += len(some)
                    held += zip(some.column(0).to_pylist(), some.column(1).to_pylist())
                    if len(held) == batch:
                        yield sent(held)
                        held = []
            if held:
                yield sent(held)
        finally:
            give_back()

    with scratch(rows.sparkSession) as s:
        texts = rows.where(~blank).groupBy(key.alias("_key")).agg(F.first(text_col).alias("_text"))  # equal texts, equal keys
        found = s.written(texts.mapInArrow(run, "_key binary, vector array<float>, error string"), "embedded", keep=True)
    common = width or (found.where("vector IS NOT NULL").groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first() or [None])[0]
    fits = F.size("vector") == F.lit(common)
    checked = found.select("_key", F.when(fits, F.col("vector")).alias("vector"), F.when(F.col("vector").isNotNull() & ~fits, F.concat(F.lit("width "), F.size("vector").cast("string"))).otherwise(F.col("error")).alias("error"))
    out = rows.withColumn("_key", F.when(~blank, key)).join(small(checked, 64 + 4 * (common or 0)), "_key", "left").drop("_key")
    return out.withColumn("error", F.when(F.col("vector").isNull() & F.col("error").isNull(), "empty").otherwise(F.col("error")))
