"""Operator 8, quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are rows labelled 1; the unlabelled set is web text whose labels are not looked at. With the class prior
p, the classifier minimises  p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)])  for the logistic loss, by mini-batches whose
negative part is stepped back whenever it falls below zero. The prior is always estimated, from positives and unlabelled text:
the least ratio of the share of unlabelled rows to the share of positive ones among rows that a classifier of one against the
other scores low is what cannot be positive. Scores are made probabilities by a line through the raw score, set by where the
unlabelled rows part below the positives and by their mean, which should be the prior. No row labelled 0 is read. Features are statistics of the whole text; none is taken from
ids, sources or languages.

The fit reads at most about LABELLED_ROWS trusted positives, picked by a hash of their id, which is a parameter. Of unlabelled
text it reads every row: random planes part the features into 2^PLANES cells, and each task sends the counts and sums of its
cells, in whole numbers, so that the order of tasks changes nothing. A cell stands in the risk and the prior for its rows, at their
mean and as often as its count says, in DRAWS draws spread evenly over the counts; trusted rows stand at their cells' means too,
so that both are alike. The line is set by the raw scores of all rows, counted in bins.

Defined results: null text is the empty text and gets a score like any other; repeated rows get equal scores; with no
labelled positives every score is 0.5; a row labelled several times counts with its least label; a null id is not held out;
ties at the threshold count as accepted; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, materialise, released, slices, table, temporary
from .shingles import text_buffers, words

#: Labelled rows that a fit may read; planes that part unlabelled rows into cells, draws from the cells, units of a sum's whole numbers.
LABELLED_ROWS, PLANES, DRAWS, UNIT = 6000, 16, 24_000, 1 << 20
CUT = 0.3
#: Width and number (to each side of zero) of the bins in which all rows' raw scores are counted.
BIN, BINS = 1 / 256, 1 << 15
LEAST_STEPS = 1000
PIECE = 1 << 20

_KIND = np.full(256, 6, dtype="uint8")  # other bytes: of letters outside ASCII
_KIND[:128] = 5  # symbols
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[ord(c) for c in ".,;:'\"?()-"]] = 4  # punctuation of prose
KINDS = 7


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of text statistics for each of consecutive texts."""
    h, bound = words(data, offsets)
    same = np.zeros(len(h) + 1, dtype="int64")
    same[1:-1] = (h[1:] == h[:-1]) if len(h) else same[1:-1]
    repeats = np.concatenate(([0], np.cumsum(same)))
    out = np.zeros((len(offsets) - 1, KINDS + 9))
    for i, (a, z, u, v) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), bound[:-1].tolist(), bound[1:].tolist())):
        n, w = z - a, v - u
        if not n:
            out[i, -1] = 1
            continue
        b = data[a:z]
        kinds = np.zeros(KINDS)
        for s in range(0, n, PIECE):
            kinds += np.bincount(_KIND[b[s : s + PIECE]], minlength=KINDS)
        letters = max(1.0, kinds[0] + kinds[1] + kinds[6])
        lines = [x for x in b.tobytes().split(b"\n") if x]
        own = np.unique(h[u:v])
        inner = repeats[v] - repeats[u + 1] if w > 1 else 0
        many = max(1, len(lines) - 1)
        out[i, :KINDS] = np.sqrt(kinds / n)
        out[i, KINDS:] = (
            kinds[1] / letters, inner / max(1, w - 1), (len(lines) - len(set(lines))) / many, len(own) / max(1, w),
            np.log1p(w) / 8, np.log1p(n / max(1, w)) / 3, min(1.0, len(own) / (3.0 * w**0.75 + 1)), w < 8, 0)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    out: np.ndarray
    line: tuple[float, float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.concatenate((z, np.ones((len(z), 1))), axis=1)
        return np.concatenate((np.tanh(z @ self.hidden), z), axis=1) @ self.out

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b = self.line
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -40, 40)))


def estimated_prior(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from how positive-against-unlabelled classifiers score rows they did not learn from.

    Among rows scored above any level, unlabelled ones are at least the prior's share of what positives are; the level at
    which that bound is least, allowing for the chance of few rows, is where negatives no longer mix in.
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    p, u = np.zeros(len(positive)), np.zeros(len(unlabelled))
    for half in (0, 1):
        m = train(x, positive[half::2], unlabelled[half::2], None, epochs=30, units=4)
        p[1 - half :: 2], u[1 - half :: 2] = m.raw(x[positive[1 - half :: 2]]), m.raw(x[unlabelled[1 - half :: 2]])
    levels = np.quantile(p, np.linspace(0.01, 0.9, 90))
    above_p, above_u = ((v[:, None] >= levels).mean(axis=0) for v in (p, u))
    slack = np.sqrt(1 / len(u)) + np.sqrt(1 / len(p))
    best = int(np.argmin((above_u + slack) / np.maximum(above_p - slack, 1e-9)))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def train(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int = 60, units: int = 12, seed: int = 3) -> Model:
    """Non-negative PU risk; without a prior plain logistic regression of positive against unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.concatenate((positive, unlabelled))
    mean, scale = x[both].mean(axis=0), x[both].std(axis=0) + 1e-3
    d = x.shape[1] + 1
    m = Model(mean, scale, rng.normal(0, d**-0.5, (d, units)), np.zeros(units + d), (1.0, 0.0))
    m.out[:units] = rng.normal(0, 0.1, units)
    z = np.concatenate((np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))), axis=1)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (m.hidden, m.out)]
    t, parts = 0, max(1, len(both) // 512)
    epochs = max(epochs, LEAST_STEPS // parts)  # few rows are gone through more often
    for epoch in range(epochs):
        for pos, unl in zip(np.array_split(rng.permutation(positive), parts), np.array_split(rng.permutation(unlabelled), parts)):
            if not len(pos) or not len(unl):
                continue
            at = np.concatenate((pos, unl))
            act = np.tanh(z[at] @ m.hidden)
            g = np.concatenate((act, z[at]), axis=1) @ m.out
            s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
            k = len(pos)
            if prior is None:
                dg = np.concatenate(((s[:k] - 1) / k, s[k:] / len(unl)))
            else:
                soft = np.logaddexp(0, g)  # l(-g)
                negative = soft[k:].mean() - prior * soft[:k].mean()
                if negative >= 0:
                    dg = np.concatenate((prior * (s[:k] - 1) / k - prior * s[:k] / k, s[k:] / len(unl)))
                else:  # back towards zero
                    dg = np.concatenate((prior * s[:k] / k, -s[k:] / len(unl)))
            out_grad = np.concatenate((act, z[at]), axis=1).T @ dg + 1e-4 * m.out
            hid_grad = z[at].T @ (dg[:, None] * m.out[:units] * (1 - act**2)) + 1e-4 * m.hidden
            t += 1
            for w, grad, mo in ((m.hidden, hid_grad, moments[0]), (m.out, out_grad, moments[1])):
                mo[0] = 0.9 * mo[0] + 0.1 * grad
                mo[1] = 0.99 * mo[1] + 0.01 * grad**2
                w -= 0.02 * (1 - epoch / epochs) * (mo[0] / (1 - 0.9**t)) / (np.sqrt(mo[1] / (1 - 0.99**t)) + 1e-6)
    return m


def calibrated(m: Model, x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """(slope, offset) of the raw score from trusted positives and unlabelled rows alone.

    Below the lower edge of the positives' scores, the widest gap of the unlabelled ones, near that edge, parts the classes: its
    middle becomes CUT. The slope is what brings the mean probability of unlabelled rows nearest to the prior.
    """
    return line(np.sort(m.raw(x[unlabelled])), float(np.quantile(m.raw(x[positive]), 0.005)), prior)


def line(g: np.ndarray, edge: float, prior: float) -> tuple[float, float]:
    """The same from the unlabelled rows' raw scores in order and the lower edge of the positives'."""
    low = np.append(g[g < edge], edge)
    w = max(1, len(low) // 100)
    mid, wide = (low[w:] + low[:-w]) / 2, low[w:] - low[:-w]
    middle = edge
    if len(wide):
        reach = max(1e-6, edge - float(np.median(low))) / 2
        middle = float(mid[np.argmax(wide * np.exp(-0.5 * ((edge - mid) / reach) ** 2))])
    z = g - middle
    mean = lambda a: (1 / (1 + np.exp(-np.clip(a * z + np.log(CUT / (1 - CUT)), -40, 40)))).mean()
    slope = float(min(np.geomspace(0.5, 20, 40), key=lambda a: (abs(mean(a) - prior), a)))
    return slope, float(np.log(CUT / (1 - CUT)) - slope * middle)


def table_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs (text and the columns of keep) with a feature array in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in slices(batch, 0, PIECE):
                part = batch.slice(a, z - a)
                x = features(*text_buffers(part.column(0)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="int32") * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([flat, *part.columns[1:]], ["x", *keep])

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("text", *keep).mapInArrow(released(run), f"x array<double>{kinds}")


def cells_of(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, planes: int) -> np.ndarray:
    """The cell of each row: on which side it is of each of some planes, the same ones in every task."""
    rng = np.random.default_rng(11)
    normal, offset = rng.normal(size=(x.shape[1], planes)), 2 * rng.normal(size=planes) * np.sqrt(x.shape[1])
    offset[: planes // 2] /= 8
    side = np.clip((x - mean) / scale, -6, 6) @ normal > offset
    return side @ (1 << np.arange(planes))


def unlabelled_cells(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, planes: int = PLANES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, mean features, rows) of the cells of all of rows (x), at most 2^planes of them; each task sends its cells' sums."""
    d = len(mean)
    names = [f"s{i}" for i in range(d)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _matrix(batch)
            whole = np.concatenate((np.ones((len(x), 1), "int64"), np.rint(x * UNIT).astype("int64")), axis=1)
            at, of = np.unique(cells_of(x, mean, scale, planes), return_inverse=True)
            sums = np.zeros((len(at), d + 1), "int64")
            np.add.at(sums, of, whole)
            for c, row in zip(at.tolist(), sums):
                held[c] = held[c] + row if c in held else row
        if held:
            out = np.stack(list(held.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), *(pa.array(out[:, i]) for i in range(d + 1))], ["cell", "n", *names])

    each = rows.mapInArrow(released(run), "cell long, n long, " + ", ".join(f"{s} long" for s in names))
    got = each.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", *names))).orderBy("cell").toPandas()
    n = got["n"].to_numpy("int64")
    return got["cell"].to_numpy(), got[names].to_numpy("float64") / UNIT / np.maximum(n, 1)[:, None], n


def score_counts(rows: DataFrame, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(raw score, rows) of all of rows (x), in order: counts by bins of BIN, at most 2 * BINS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(2 * BINS + 1, "int64")
        for batch in batches:
            held += np.bincount((np.clip(np.rint(m.raw(_matrix(batch)) / BIN), -BINS, BINS) + BINS).astype("int64"), minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at - BINS), pa.array(held[at])], ["bin", "n"])

    got = rows.mapInArrow(released(run), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toPandas()
    return got["bin"].to_numpy() * BIN, got["n"].to_numpy("int64")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, KINDS + 9))


def _drawn(n: np.ndarray) -> np.ndarray:
    """Places by their counts: each as often as its share of DRAWS draws, or of all rows where they are fewer."""
    total = int(n.sum())
    draws = min(DRAWS, total)
    return np.searchsorted(np.cumsum(n), (np.arange(draws) + 0.5) * total / max(draws, 1), side="right")


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, planes: int = PLANES) -> Model | None:
    """docs: doc_id, text; labels: doc_id, quality. Rows held out are read neither as labelled nor as unlabelled text."""
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    trusted = labels.where(F.col("quality").isNotNull() & (crc_fold() != 0)).groupBy("doc_id").agg(F.min("quality").alias("y")).where("y = 1")
    share = int(1_000_000 * min(1.0, 1.3 * labelled_rows / max(1, trusted.count())))
    chosen = trusted.where(dealt < share).select("doc_id", dealt.alias("h")).orderBy("h", "doc_id").limit(2 * labelled_rows)
    known = docs.select("doc_id", "text").where(crc_fold() != 0)
    got = table_features(known.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "h"), ["doc_id", "h"]).orderBy("h", "doc_id", "x").limit(4 * labelled_rows).toPandas()
    if not len(got):
        return None
    trusted_x = np.stack(got["x"].to_numpy())
    mean, scale = trusted_x.mean(axis=0), trusted_x.std(axis=0) + 0.05
    with temporary(docs.sparkSession):
        rows = materialise(table_features(known.select("text"), []), "quality-features")
        cells, x, n = unlabelled_cells(rows, mean, scale, planes)
        unlabelled = _drawn(n)
        positive = np.searchsorted(cells, cells_of(trusted_x, mean, scale, planes))  # the same cells: trusted rows are web text too
        prior = estimated_prior(x, positive, unlabelled)
        model = train(x, positive, unlabelled, prior)
        raw, count = score_counts(rows, model)
    model.line = line(raw[_drawn(count)], float(np.quantile(model.raw(trusted_x), 0.005)), prior)
    return model


RESULT = "doc_id long, held_out boolean, score double, predicted int"


def assess(docs: DataFrame, model: Model | None, cut: float = CUT) -> DataFrame:
    """docs: doc_id, text. Score and prediction of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, z in slices(batch, 1, PIECE):
                part = batch.slice(a, z - a)
                s = m.score(features(*text_buffers(part.column(1)))) if m else np.full(z - a, 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s), pa.array((s >= cut).astype("int32"))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_fold() == 0).alias("held_out")).mapInArrow(released(run), RESULT)


def keep_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns, that the classifier accepts; the score is taken where the text is read, with no join."""
    model = fit(docs.select("doc_id", "text"), labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, z in slices(batch, at, PIECE):
                part = batch.slice(a, z - a)
                s = m.score(features(*text_buffers(part.column(at)))) if m else np.full(z - a, 0.5)
                yield part.filter(pa.array(s >= cut, pa.bool_()))

    return docs.mapInArrow(released(run), schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assess(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op8_quality": op8_quality}
ORACLE: dict[str, str] = {}
