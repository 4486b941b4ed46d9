"""Operator 4, mixing sources to target weights by soft membership. DataFrame functions only.

A classifier fitted on a labelled table gives every document a posterior over domains: softmax regression on the presence
of hashed words and of marks of a text's shape, kept to the buckets that tell the domains apart best. Rates, nonnegative and one for each document, start at 1 and
follow the projected gradient of the squared distance between the expected domain token totals and their targets, scaled
by the curvature between domains. A step moves a document by the dot product of its posterior with one vector over the
domains, so a step needs only one distributed sum for each domain and pair of domains, and the rate of any document is a
closed expression of its posterior and the few steps made. Targets that cannot be met are listed in `Rates.unmet` and logged.

Defined results: tokens are the words between white space of any kind; null text is the empty text, which has no tokens
and the prior as its posterior; a null label is no label, and of several labels the least domain counts; a domain that no
labelled row has is left out and the other targets are scaled up; with no labelled rows every rate is 1; repeated rows get
equal rates; other columns are ignored by the fit and kept by `mix`; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, small, table, temporary

log = logging.getLogger(__name__)

#: Hash buckets for words, and how many of them at most make up the classifier.
BUCKETS, MARKERS, LEAST_Z = 1 << 16, 256, 6.0
#: Labelled rows a fit may read.
LABELLED_ROWS = 6000
#: Token shares wanted for each domain; rates have no upper bound.
TARGETS = {"clean": 0.90, "low": 0.07, "toxic": 0.03}
STEPS, SHORTER, TOLERANCE, PROTECT = 12, 6, 1e-4, 0.1
#: A domain's target counts as met within TOLERANCE of the budget and this share of the target.
NEAR = 0.01
#: White space besides the space itself, as Unicode has it: in ASCII, and beyond it.
ASCII_SPACES = "\t\n\v\f\r"
OTHER_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table of quality and toxicity labels."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", kind.alias("domain"))


def spaced(text: Column, spaces: str) -> Column:
    """text with a space for each of the given characters, by literal replacements: they read bytes, not characters."""
    for c in spaces:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """The lower-case words of a text: what white space of any kind sets apart."""
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.when(F.octet_length(low) == F.length(low), low).otherwise(spaced(low, OTHER_SPACES))
    return F.filter(F.split(spaced(low, ASCII_SPACES), " "), lambda w: w != "")


def marks(w: Column) -> Column:
    """The words w of a text, and words that stand for its shape: symbols at words' ends and repetition, on coarse scales."""
    n = F.greatest(F.size(w), F.lit(1))
    scale = lambda k, x: F.concat(F.lit(f"\x01{k}"), F.floor(x / n * 8).cast("string"))
    symbols = F.size(F.filter(w, lambda x: F.substring(x, -1, 1).isin(*"&%$#*!|=<>~^")))
    return F.concat(w, F.array(scale("s", symbols), scale("d", F.size(F.array_distinct(w)))))


def bucket(w: Column) -> Column:
    """The hash bucket of a word without the punctuation it ends with."""
    return F.xxhash64(F.rtrim(w, F.lit(".,;:!?)\""))).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


@dataclass
class Classifier:
    domains: list[str]
    slots: list[int]  # of each bucket: its marker's number from 1, or 0
    weights: list[list[float]]  # of each domain: the weight of each marker
    bias: list[float]

    def add_posterior(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with _n (words), _p (array of the domains' probabilities) and _d (the likeliest one's place from 1).

        Each step is a projection of its own and reads the one before more than once, so none is computed twice.
        """
        k = range(len(self.domains))
        literal = lambda xs, kind: F.split(F.lit(",".join(map(repr, xs or [0]))), ",").cast(f"array<{kind}>")
        slots = literal(self.slots, "int")
        out = docs.withColumn("_w", words(F.col(text_col)))
        hit = F.array_distinct(F.filter(F.transform(marks(F.col("_w")), lambda w: F.element_at(slots, bucket(w) + 1)), lambda s: s > 0))
        out = out.withColumns({"_h": hit, "_n": F.size("_w").cast("long")})
        ratios = [literal(w, "double") for w in self.weights]
        score = [F.aggregate("_h", F.lit(float(b)), (lambda r: lambda a, s: a + F.element_at(r, s))(r)) for r, b in zip(ratios, self.bias)]
        out = out.withColumns({f"_s{d}": score[d] for d in k})
        top = F.greatest(*(F.col(f"_s{d}") for d in k)) if len(k) > 1 else F.col("_s0")
        out = out.withColumns({f"_e{d}": F.exp(F.greatest(F.col(f"_s{d}") - top, F.lit(-60.0))) for d in k})
        total = sum((F.col(f"_e{d}") for d in k[1:]), F.col("_e0"))
        out = out.withColumn("_p", F.array(*(F.col(f"_e{d}") / total for d in k)))
        out = out.withColumn("_d", F.array_position("_p", F.array_max("_p")).cast("int"))
        return out.drop("_w", "_h", *(f"_{x}{d}" for x in "se" for d in k))


def fit_classifier(docs: DataFrame, labelled: DataFrame, rows: int = LABELLED_ROWS) -> Classifier | None:
    """docs: doc_id, text; labelled: doc_id, domain. The labelled rows read are at most about `rows`, picked by a hash."""
    known = labelled.where(F.col("domain").isNotNull())
    share = int(1_000_000 * min(1.0, 1.2 * rows / max(1, known.count())))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows)
    seen = docs.join(F.broadcast(chosen), "doc_id").select("domain", words(F.col("text")).alias("w")).select("domain", F.array_distinct(F.transform(marks(F.col("w")), bucket)).alias("b"))
    seen = materialise(seen, "mix-labelled")
    size = {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").collect()}
    if not size:
        return None
    rows_seen = sum(size.values())
    # per bucket and domain, bounded by their number
    per_bucket = seen.select("domain", F.explode("b").alias("bucket")).groupBy("bucket").pivot("domain", list(size)).count()
    n = {d: F.coalesce(F.col(f"`{d}`"), F.lit(0)) for d in size}
    p = (sum(n.values(), F.lit(0.5))) / F.lit(rows_seen + 1.0)
    z = [F.abs(n[d] - F.lit(k) * p) / F.sqrt(F.lit(k) * p * (1 - p) + 1) for d, k in size.items()]
    best = F.greatest(*z) if len(z) > 1 else z[0]
    markers = per_bucket.select("bucket", best.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "bucket").limit(MARKERS).collect()
    slots = [0] * BUCKETS
    for i, m in enumerate(markers, 1):
        slots[m["bucket"]] = i
    held = F.array(*(F.lit(m["bucket"]) for m in markers)) if markers else F.array().cast("array<int>")
    hits = seen.select("domain", F.array_intersect("b", held).alias("h")).groupBy("domain", F.sort_array("h").alias("h")).agg(F.count("*").alias("n")).orderBy("domain", "h").collect()
    x = np.zeros((len(hits), len(markers) + 1))
    for i, r in enumerate(hits):
        x[i, [slots[b] - 1 for b in r["h"]]] = 1
    x[:, -1] = 1
    w = softmax_regression(x, np.array([list(size).index(r["domain"]) for r in hits]), np.array([r["n"] for r in hits], dtype="float64"), len(size))
    return Classifier(list(size), slots, w[:-1].T.tolist(), w[-1].tolist())


def softmax_regression(x: np.ndarray, y: np.ndarray, n: np.ndarray, k: int, steps: int = 1500) -> np.ndarray:
    """Weights of features by classes for rows that occur n times each, by gradient steps with adaptive rates."""
    w, m, v = (np.zeros((x.shape[1], k)) for _ in range(3))
    target, share = np.eye(k)[y], (n / n.sum())[:, None]
    for t in range(1, steps + 1):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ ((p - target) * share) + 3e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        w -= 0.2 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


@dataclass
class Rates:
    """Rates as made by a sequence of projected steps."""

    domains: list[str]
    floors: list[float]  # least rate of documents that are of a domain with probability PROTECT at least
    steps: list[list[float]] = field(default_factory=list)
    unmet: dict[str, tuple[float, float]] = field(default_factory=dict)  # share reached and share wanted of the budget

    def column(self, p: Column) -> Column:
        kept = [F.when(p[d] >= PROTECT, F.lit(f)).otherwise(F.lit(0.0)) for d, f in enumerate(self.floors) if f]
        low = F.greatest(F.lit(0.0), *kept) if kept else F.lit(0.0)
        r = F.lit(1.0)
        for e in self.steps:
            move = sum((p[d] * F.lit(e[d]) for d in range(1, len(e))), p[0] * F.lit(e[0]))
            r = F.greatest(r - move, low)
        return r


def with_posteriors(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, p (array by domain) and domain (its place from 1) of each document."""
    scored = model.add_posterior(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return scored.select("doc_id", F.col("_n").alias("n_tokens"), F.col("_p").alias("p"), F.col("_d").alias("domain"))


def fit_rates(post: DataFrame, domains: list[str], targets: dict[str, float], floors: dict[str, float] | None = None, keep: str | None = None) -> Rates:
    """Projected gradient on a materialised table of posteriors. The budget is all tokens, or, with keep, what gives that domain's tokens their share as they are."""
    rates = Rates(domains, [float((floors or {}).get(d, 0.0)) for d in domains])
    mass = sum(targets.get(d, 0.0) for d in domains)
    if not mass:
        return rates
    share = [targets.get(d, 0.0) / mass for d in domains]

    k = range(len(domains))
    sums = [F.sum(F.col("t") * F.col("p")[d] * F.col("r")).alias(f"s{d}") for d in k]
    gram = [F.sum(F.when(F.col("free"), F.col("t") * F.col("p")[d] * F.col("p")[j])).alias(f"m{d}_{j}") for d in k for j in k]

    def totals() -> tuple[np.ndarray, np.ndarray]:
        """Domain totals under the rates so far, and the Gram matrix of the posteriors of documents off their bounds."""
        r = post.select(F.col("n_tokens").alias("t"), "p", rates.column(F.col("p")).alias("r"))
        row = r.withColumn("free", F.col("r") > 0).agg(*sums, *gram).first()
        got = np.array([float(x or 0.0) for x in row])
        return got[: len(k)], got[len(k) :].reshape(len(k), len(k))

    now, m = totals()
    if now.sum() == 0:
        return rates
    keep_at = domains.index(keep) if keep in domains else None
    budget = now[keep_at] / share[keep_at] if keep_at is not None and share[keep_at] else now.sum()
    goal = budget * np.array(share)
    def far(gap: np.ndarray) -> np.ndarray:
        return np.abs(gap) > np.where(goal > 0, np.minimum(TOLERANCE * budget, NEAR * goal), TOLERANCE * budget)

    for _ in range(STEPS):
        gap = now - goal
        if not far(gap).any():
            break
        # the gradient's direction, scaled by the curvature over the documents that can still move; domains count alike, however rare
        scale = 1 / np.sqrt(np.maximum(m.diagonal(), 1e-12 * budget))
        move = scale * np.linalg.lstsq(m * np.outer(scale, scale), scale * gap, rcond=1e-9)[0]
        weight = 1 / np.maximum(goal, TOLERANCE * budget)
        for shorter in range(SHORTER):  # a shorter step is tried where one comes no nearer
            rates.steps.append((move / 4**shorter).tolist())
            after, m_after = totals()
            if np.square((after - goal) * weight).sum() < np.square(gap * weight).sum() * (1 - 1e-9):
                break
            rates.steps.pop()
        else:
            break
        now, m = after, m_after
    rates.unmet = {domains[d]: (float(now[d] / budget), share[d]) for d in k if far(now - goal)[d]}
    if rates.unmet:
        log.warning("mixing targets not met, as shares reached and wanted: %s", rates.unmet)
    return rates


def copies(rate: Column, doc_id: Column) -> Column:
    """The rate rounded up or down by a hash of the id, so that the expected copies are the rate."""
    u = F.pmod(F.xxhash64(doc_id, F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("int")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, floors: dict[str, float] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, domain, posterior (by domain name), rate, copies."""
    model = fit_classifier(docs.select("doc_id", "text"), labelled)
    if model is None:
        model = Classifier(["all"], [0] * BUCKETS, [[]], [0.0])
    post = materialise(with_posteriors(docs, model), "mix-posteriors")
    rates = fit_rates(post, model.domains, targets or TARGETS, floors)
    names = F.array(*map(F.lit, model.domains))
    out = post.withColumn("rate", rates.column(F.col("p")))
    return out.select("doc_id", "n_tokens", F.element_at(names, F.col("domain")).alias("domain"), F.map_from_arrays(names, "p").alias("posterior"), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], floors: dict[str, float], keep: str) -> DataFrame:
    """docs, each row as often as its copies say. Only ids whose copies are not 1 are joined; an id that is null or missing there stays as it is, and one of several texts takes the least copies."""
    with temporary(docs.sparkSession):
        model = fit_classifier(docs.select("doc_id", "text"), labelled)
        if model is None:
            return docs
        post = materialise(with_posteriors(docs, model), "mix-posteriors")
        rates = fit_rates(post, model.domains, targets, floors, keep=keep)
        dealt = post.where("doc_id IS NOT NULL").select("doc_id", copies(rates.column(F.col("p")), F.col("doc_id")).alias("n"))
        other = materialise(dealt.groupBy(F.col("doc_id").alias("_mix_id")).agg(F.min("n").alias("_mix_n")).where("_mix_n <> 1"), "mix-copies", keep=True)
    names = [fresh(docs, x) for x in ("_mix_id", "_mix_n", "_mix_i")]
    gone, more = (small(other.where(w).toDF(*names[:2]), 24) for w in ("_mix_n = 0", "_mix_n > 1"))
    kept = docs.join(gone, docs["doc_id"] == gone[names[0]], "left_anti")
    again = docs.join(more, docs["doc_id"] == more[names[0]]).withColumn(names[2], F.explode(F.sequence(F.lit(2), F.col(names[1]))))
    return kept.unionByName(again.select(*(docs[c] for c in docs.columns)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = mixed(table(spark, sf_dir, "documents").select("doc_id", "text"), label_domains(table(spark, sf_dir, "labels")))
    return post.withColumn("posterior", F.col("posterior")[F.col("domain")])


QUERIES = {"op4_mixing": op4_mixing}
ORACLE: dict[str, str] = {}
