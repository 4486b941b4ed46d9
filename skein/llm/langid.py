"""Operator 2, language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Subwords are the byte 3- and 4-grams inside a word and its two edges, ASCII letters lower-cased, hashed into buckets. A text
is the mean of its buckets' embeddings under a linear softmax; both are trained by stochastic gradient descent in numpy on a
bounded sample of the labelled rows that are not held out, whose whole texts become bucket counts where they are read. A temperature and the least confidence at which the accepted
calibration rows reach the wanted precision are fitted on rows of the sample that training did not see.

Defined results: null text and text without a letter get `und` and score 0; so does every text when no row is labelled;
every other text gets a learned language, whole texts being read whatever their length, and `accepted` tells whether the
calibrated score passes the rejection threshold; repeated rows get equal results; ties go to the language first in order;
a null id is not held out; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, materialise, released, slices, small, table
from .shingles import text_buffers

BUCKETS, DIM, ORDERS = 1 << 14, 12, (3, 4)
#: Labelled rows of each language that a fit may read, and of all; a column of very many languages gives fewer rows of each.
SAMPLE_ROWS, SAMPLE_TOTAL = 600, 20_000
PRECISION = 0.99
LETTER = re.compile(r"[^\W\d_]")
PIECE = 1 << 20

_FOLD = np.arange(256, dtype="uint8")
_FOLD[:128] = 32
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket at each byte of consecutive texts; 0 where no subword starts."""
    b = _FOLD[data[offsets[0] : offsets[-1]]].astype("uint32")
    ends = offsets[1:] - offsets[0]
    gap = b == 32
    for n in ORDERS:
        m = max(0, len(b) - n + 1)
        h = np.zeros(m, dtype="uint32")
        for j in range(n):
            h = h * np.uint32(0x01000193) + b[j : j + m]
        h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 14)
        h = np.where(h == 0, np.uint32(1), h)
        for j in range(1, n - 1):
            h[gap[j : j + m]] = 0
        over = (ends[:-1, None] - np.arange(1, n)).ravel()
        h[over[(over >= 0) & (over < m)]] = 0
        yield h


def sums_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Column sums of values (a row a byte) for each of consecutive texts; values may lack the last bytes."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype="float64")
    starts = offsets[:-1] - offsets[0]
    some = np.flatnonzero((offsets[1:] > offsets[:-1]) & (starts < len(values)))
    if len(some):
        out[some] = np.add.reduceat(values, starts[some], axis=0)
    return out


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # of each bucket for each language: its embedding through the softmax layer
    bias: np.ndarray
    temperature: float
    least: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of consecutive texts; a text longer than PIECE is summed in overlapping pieces."""
        total, count = np.zeros((len(offsets) - 1, len(self.langs))), np.zeros(len(offsets) - 1)
        spans = [(offsets, None)]
        if len(offsets) == 2 and offsets[1] - offsets[0] > 2 * PIECE:
            lap = max(ORDERS) - 1
            spans = [(np.array([a, min(a + PIECE + lap, offsets[1])]), PIECE if a + PIECE + lap < offsets[1] else None) for a in range(offsets[0], offsets[1], PIECE) if a == offsets[0] or offsets[1] - a > lap]
        for at, keep in spans:
            for h in subwords(data, at):
                h = h[:keep]
                total += sums_by_text(self.weights[h], at)
                count += sums_by_text((h > 0).astype("float32"), at)
        return total / np.maximum(count, 1)[:, None] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a text's subwords, a text longer than PIECE in overlapping pieces; of bounded size for any text."""
    data, n = np.frombuffer(text, "uint8"), np.zeros(BUCKETS, dtype="int64")
    lap = max(ORDERS) - 1
    for a in range(0, max(1, len(data) - lap), PIECE):
        z = min(len(data), a + PIECE + lap)
        for h in subwords(data, np.array([a, z])):
            n += np.bincount(h[: PIECE if z < len(data) else None], minlength=BUCKETS)
    n[0] = 0
    ids = np.flatnonzero(n)
    return ids, (n[ids] / max(1, n.sum())).astype("float32")


def fit(texts: list[str], labels: list[str], **how) -> Model | None:
    return fit_counted([counted(t.encode()) for t in texts], labels, **how)


def fit_counted(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 6, rate: float = 4.0, seed: int = 7) -> Model | None:
    """SGD over mini-batches of counted texts; every fifth text is kept for calibration."""
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(x) for x in labels])
    kept = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype("float32")
    emb[0] = 0
    soft, bias = rng.normal(0, 0.3, (DIM, len(langs))).astype("float32"), np.zeros(len(langs), "float32")
    train = np.flatnonzero(~kept & np.array([len(r[0]) > 0 for r in rows]))
    weight = 1.0 / np.bincount(y[train], minlength=len(langs)).clip(1)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 16)):
            if not len(part):
                continue
            ids, val = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            doc = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            hidden = np.zeros((len(part), DIM), "float32")
            np.add.at(hidden, doc, emb[ids] * val[:, None])
            g = softmax(hidden @ soft + bias)
            g[np.arange(len(part)), y[part]] -= 1
            w = weight[y[part]]
            g *= (w / w.mean() / len(part))[:, None]
            back = (g @ soft.T).astype("float32")
            soft -= step * (hidden.T @ g)
            bias -= 0.1 * step * g.sum(axis=0)
            np.add.at(emb, ids, -step * 16 * val[:, None] * back[doc])
    emb[0] = 0
    model = Model(langs, (emb @ soft).astype("float32"), bias, 1.0, 0.0)
    held = np.flatnonzero(kept)
    if len(held):
        z = np.stack([(model.weights[rows[i][0]] * rows[i][1][:, None]).sum(axis=0) + bias for i in held])
        # one row in a hundred counts as mislabelled, or a clean split would drive the temperature to zero
        target = np.full(z.shape, 0.01 / max(1, len(langs) - 1))
        target[np.arange(len(held)), y[held]] = 0.99
        nll = {t: -(target * np.log(softmax(z / t) + 1e-12)).sum(axis=1).mean() for t in np.geomspace(0.02, 20, 61)}
        model.temperature = float(min(nll, key=nll.get))
        p = softmax(z / model.temperature)
        best, right = p.max(axis=1), p.argmax(axis=1) == y[held]
        order = np.argsort(-best)
        good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
        model.least = float(best[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, total: int = SAMPLE_TOTAL) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """Counted texts and languages of at most `rows` labelled rows a language, picked by a hash of their id, none held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold() != 0))
    sizes = materialise(known.groupBy("lang").agg(F.count("*").alias("n")), "lang-sizes")
    rows = max(1, min(rows, total // max(1, sizes.count())))
    least = F.least(F.lit(1_000_000), F.ceil(1_000_000.0 * (1.5 * rows + 6) / F.col("n"))).alias("_share")
    picked = known.join(small(sizes.select("lang", least), 64), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("_share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, share = zip(*(counted(t.as_buffer().to_pybytes()) for t in batch.column(2))) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([i.astype("<u2").tobytes() for i in ids], pa.binary()), pa.array([x.astype("<f4").tobytes() for x in share], pa.binary())],
                ["doc_id", "lang", "ids", "share"])

    got = picked.select("doc_id", "lang", "text").mapInArrow(released(run), "doc_id long, lang string, ids binary, share binary").orderBy(F.xxhash64("doc_id"), "doc_id", "ids", "share").limit(8 * total).toPandas()
    got = got.sort_values(["doc_id", "ids", "share"]).groupby("lang", sort=True).head(rows)
    return [(np.frombuffer(i, "<u2").astype("int64"), np.frombuffer(x, "<f4")) for i, x in zip(got["ids"], got["share"])], got["lang"].tolist()


RESULT = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs: doc_id, text. The language of each text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, z in slices(batch, 1, PIECE):
                part = batch.slice(a, z - a)
                letters = np.array([t is not None and LETTER.search(t) is not None for t in part.column(1).to_pylist()])
                if m is None:
                    letters[:] = False
                    lang, score = np.full(z - a, "und", object), np.zeros(z - a)
                else:
                    p = softmax(m.logits(*text_buffers(part.column(1))) / m.temperature)
                    lang, score = np.array(m.langs, object)[p.argmax(axis=1)], p.max(axis=1)
                lang[~letters], score[~letters] = "und", 0.0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(letters & (score >= (m.least if m else 1)), pa.bool_())],
                    ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_fold() == 0).alias("held_out")).mapInArrow(released(run), RESULT)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_counted(*sample(docs)))


QUERIES = {"op2_langid": op2_langid}
ORACLE: dict[str, str] = {}
