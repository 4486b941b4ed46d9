"""Operator 3, personal data by a skip-chain conditional random field.

Base matches of four kinds come from fixed patterns. Nodes of the field are those matches and other tokens: groups of digits
with the separators of numbers, all tokens with a digit or an at sign, tokens near a base match and tokens that are an
address's local part; its labels are the kinds and "none". Node potentials are linear in shape features, neighbours in the
text share a chain potential, and distant nodes with equal or similar values share a skip potential: the same digits, digits
of which one ends with the other, the same letters, or an address's local part. Base matches are evidence; loopy
sum-product messages settle the labels of the others, so that a value once seen as personal is marked wherever it returns
in the document, and a number that has the shape of a base match is marked where the patterns' own rules lose it.

All weights are trained together, by pseudo-likelihood: each node's label given its shape, the label before it and the label
of its value's anchor. The counts that this needs, one for each shape code and labels, are taken over all documents, so
there is no sample. Base matches are labelled by their kind; a token that shares a value with one is left out; others are
"none". Evidence is masked: each base match is also shown in a form that the patterns do not know, beside an anchor of each
kind, as that kind, and alone and beside a "none", as "none"; shape cannot tell these apart, and the skip weights are learned
from them.

Defined results: null text is the empty text and has no spans; spans are in code points, end exclusive; base spans always
stay, and spans the field adds never overlap a base one; ties keep "none"; texts of any length are read whole and
each value has edges to its last occurrence and to its anchor (its first base match, else its first occurrence) only, so
the field is linear in the text, and evidence is one hop away; connected parts of a document are settled some at a time;
rounds go on until messages settle; repeated rows get equal results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, slices, table

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
#: Base patterns, fixed by the contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT, MARK = re.compile("[0-9]"), re.compile("[0-9@]")
#: IP's matches, found without going back over a run of digits: a match starts where its run does.
IP_RUN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
#: Other nodes: groups of at most eight digits with the separators of numbers, or one token. Both read long runs once.
TOKEN = re.compile(r"\(?\+?(?<![0-9])[0-9]{1,8}(?![0-9])(?:[().\x20-]{1,3}[0-9]{1,8}(?![0-9])){0,12}+(?![^\s.,;:!?)])|\S++")

MARGIN = 0.8
#: Code points from a base match within which every token is a node, and between neighbours of a chain.
NEAR, CHAIN = 24, 40
#: Messages settle when none moves by SETTLED; from round EASE on steps shrink, so that messages that swing settle too.
SETTLED, EASE, SHRINK = 1e-3, 200, 0.97
#: Nodes settled at a time, but for a connected part that has more.
PART_NODES = 50_000
#: Sizes of the parts of a shape code: digits, at sign, plus, letters, four dotted numbers, brackets, dash, space, Luhn, long.
SHAPES = (9, 3, 2, 3, 2, 2, 2, 2, 2, 2)
FEATURES, CODES = 1 + sum(SHAPES), int(np.prod(SHAPES))
DIGIT_CLASSES = (1, 7, 9, 10, 12, 13, 16, 20)
#: A neighbour that is not there, or whose label is not known.
ABSENT = NONE + 1
PIECE = 4 << 20


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of EMAIL, found from each at sign back to the start of its run of local characters."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all base matches, by kind and start."""
    out = [(0, *s) for s in emails(text)]
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP_RUN.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(d) <= 19 and luhn(d):
                    out.append((2, *m.span()))
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start: base matches, and other tokens that overlap none, whose kind is -1."""
    taken = sorted((s, e, k) for k, s, e in base)
    found, i, reach = [], 0, -1
    ends: list[list[int]] = []
    for s, e, _ in taken:  # merged cover, for the overlap test
        if s <= reach and ends:
            ends[-1][1] = reach = max(reach, e)
        else:
            ends.append([s, e])
            reach = e
    locals_ = {text[s:e].lower().split("@")[0] for k, s, e in base if k == 0}
    for m in TOKEN.finditer(text) if MARK.search(text) else ():
        s, e = m.span()
        while s < e and not (text[s].isalnum() or text[s] in "+(@"):
            s += 1
        while e > s and not text[e - 1].isalnum():
            e -= 1
        while i < len(ends) and ends[i][1] <= s:
            i += 1
        if s < e and (i == len(ends) or ends[i][0] >= e):
            near = (i < len(ends) and ends[i][0] - e <= NEAR) or (i and s - ends[i - 1][1] <= NEAR)
            if near or MARK.search(text, s, e) or (locals_ and text[s:e].lower() in locals_):
                found.append((s, e, -1))
    return sorted(taken + found)


def shape(v: str) -> int:
    """The code of a node's shape; no part of it is a base pattern."""
    digits = "".join(c for c in v if "0" <= c <= "9")
    d, a = len(digits), sum(c.isalpha() for c in v)
    at = v.count("@")
    parts = (
        sum(d >= x for x in DIGIT_CLASSES), 0 if not at else 1 if at == 1 and "." in v[v.find("@") :] else 2, v.startswith("+"), 0 if not a else 1 if a <= d else 2,
        v.count(".") == 3 and a == 0, "(" in v or ")" in v, "-" in v, " " in v, d >= 13 and luhn(digits), len(v) > 24)
    code = 0
    for x, n in zip(parts, SHAPES):
        code = code * n + int(x)
    return code


def expanded(codes: np.ndarray) -> np.ndarray:
    """Shape codes as rows of features: a constant and one indicator for each part's value."""
    x = np.zeros((len(codes), FEATURES), dtype="float32")
    x[:, 0] = 1
    at, rest, rows = FEATURES, codes.astype("int64"), np.arange(len(codes))
    for n in reversed(SHAPES):
        at -= n
        x[rows, at + rest % n] = 1
        rest = rest // n
    return x


def masked(kind: int, v: str) -> str:
    """A base match in a form that the patterns do not know."""
    if kind == 0:
        return v.split("@")[0]
    if kind == 1:
        return v.replace(".", "-")
    digits = "".join(c for c in v if "0" <= c <= "9")
    if kind == 2:
        return digits[-max(10, len(digits) - 4) :]
    return re.sub(r"^\+[0-9]{1,3}[\x20.-]*", "", v) or digits


def values(v: str) -> list[str]:
    """Values by which a node is found again; nodes that share one are linked."""
    out = []
    digits = "".join(c for c in v if "0" <= c <= "9")
    if len(digits) >= 7:
        out.append("d" + digits)
        if len(digits) >= 10:
            out.append("e" + digits[-10:])
    low = v.lower()
    if "@" in low:
        out.append("l" + low.split("@")[0])
    if any(c.isalpha() for c in low) and len(low) >= 4:
        out += ["w" + low, "l" + low]
    return out


def edges(text: str, found: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[int]]:
    """(chain, skip, anchors): nodes next to each other within CHAIN code points; each value's occurrence with the one before
    and the anchor; the anchor of each node's values, or -1.

    A value's anchor is its first base match, else its first occurrence; a node of several values has that of the first one
    with a base match, else of its first value.
    """
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] <= CHAIN]
    held = [values(text[s:e]) for s, e, _ in found]
    anchor: dict[str, int] = {}
    for i, (_, _, kind) in enumerate(found):
        for v in held[i]:
            if v not in anchor or (kind >= 0 and found[anchor[v]][2] < 0):
                anchor[v] = i
    last: dict[str, int] = {}
    skip: dict[tuple[int, int], None] = {}
    anchors = []
    for i, vs in enumerate(held):
        own = -1
        for v in vs:
            for j in (last.get(v, i), anchor[v]):
                if j != i:
                    skip[min(i, j), max(i, j)] = None
            last[v] = i
            if (j := anchor[v]) != i and (own < 0 or (found[j][2] >= 0 > found[own][2])):
                own = j
        anchors.append(own)
    return chain, list(skip), anchors


def parts(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least node of each node's connected part."""
    label = np.arange(n)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, pairs.ravel(), np.repeat(low, 2))
        np.minimum.at(new, label[pairs.ravel()], np.repeat(low, 2))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


@dataclass
class Field:
    unary: np.ndarray  # features by labels
    chain: np.ndarray  # labels by labels: the one before by the one after
    skip: np.ndarray  # labels by labels, where one end is evidence
    echo: np.ndarray  # labels by labels, where neither is

    def labels(self, text: str, found: list[tuple[int, int, int]]) -> np.ndarray:
        """Marginals of each node after loopy sum-product, over some of the connected parts at a time."""
        n = len(found)
        codes = np.array([shape(text[s:e]) for s, e, _ in found], dtype="int32")
        kinds = np.array([k for _, _, k in found])
        chain, skip, _ = edges(text, found)
        pairs = np.array(chain + skip, dtype="int64").reshape(-1, 2)
        skips = np.arange(len(pairs)) >= len(chain)
        if n <= PART_NODES:
            return self.settled(codes, kinds, pairs, skips)
        part = parts(n, pairs)
        order = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.diff(part[order], prepend=-1))
        place = np.empty(n, dtype="int64")
        place[order] = np.arange(n)
        out = np.empty((n, NONE + 1))
        a = 0
        while a < n:
            z = int(starts[max(np.searchsorted(starts, a, "right"), np.searchsorted(starts, a + PART_NODES, "right") - 1)]) if a + PART_NODES < n and starts[-1] > a else n
            mine = (place[pairs[:, 0]] >= a) & (place[pairs[:, 0]] < z)
            out[order[a:z]] = self.settled(codes[order[a:z]], kinds[order[a:z]], place[pairs[mine]] - a, skips[mine])
            a = z
        return out

    def settled(self, codes: np.ndarray, kinds: np.ndarray, pairs: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """Marginals of nodes of these shapes; kinds: of evidence, else -1; pairs that are skip edges, else chain ones."""
        k = NONE + 1
        own = expanded(codes).astype("float64") @ self.unary
        sure = kinds >= 0
        own[sure] = -50.0
        own[sure, kinds[sure]] = 0
        if not len(pairs):
            return soft(own)
        told = sure[pairs].any(axis=1)
        pot = np.where(skips[:, None, None], np.where(told[:, None, None], self.skip, self.echo), self.chain)
        src = np.concatenate((pairs[:, 0], pairs[:, 1]))
        dst = np.concatenate((pairs[:, 1], pairs[:, 0]))
        pot = np.concatenate((pot, pot.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))))

        def sent(out: np.ndarray) -> np.ndarray:
            new = np.logaddexp.reduce(out[:, :, None] + pot, axis=1)
            return new - np.logaddexp.reduce(new, axis=1, keepdims=True)

        # evidence speaks first and in full, so that many unsure occurrences do not outvote it before it is heard
        msg = np.where(sure[src, None], sent(own[src]), -np.log(k))
        belief = own.copy()
        np.add.at(belief, dst, msg)
        step, rounds = 0.5, 0
        while True:
            new = sent(belief[src] - msg[back])
            moved = step * np.abs(new - msg).max()
            msg += step * (new - msg)
            belief = own.copy()
            np.add.at(belief, dst, msg)
            if moved < SETTLED:
                break
            rounds += 1
            if rounds > EASE:
                step *= SHRINK
        return soft(belief)


def soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def find(text: str, model: Field | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans), each (kind, start, end) by kind and start."""
    base = base_spans(text)
    if model is None or not MARK.search(text):
        return base, []
    found = nodes(text, base)
    if all(k >= 0 for _, _, k in found):
        return base, []
    p = model.labels(text, found)
    added = sorted((int(q.argmax()), s, e) for (s, e, k), q in zip(found, p) if k < 0 and q.argmax() != NONE and q.max() >= MARGIN)
    return base, added


def examples(text: str) -> list[tuple[int, int, int, int]]:
    """(shape code, label, label before, label of the anchor) for training, from one text; ABSENT where there is none."""
    base = base_spans(text)
    found = nodes(text, base)
    if not found:
        return []
    chain, _, anchors = edges(text, found)
    before = {j: i for i, j in chain}
    # a token whose value some base match has is of that kind or not: nobody knows
    label = [k if k >= 0 else -1 if anchors[i] >= 0 and found[anchors[i]][2] >= 0 else NONE for i, (_, _, k) in enumerate(found)]
    seen = lambda i: label[i] if i is not None and i >= 0 and label[i] >= 0 else ABSENT
    out = [(shape(text[s:e]), label[i], seen(before.get(i)), seen(anchors[i])) for i, (s, e, _) in enumerate(found) if label[i] >= 0]
    for k, s, e in base:
        code = shape(masked(k, text[s:e]))
        out += [(code, j, ABSENT, j) for j in range(NONE)] + [(code, NONE, ABSENT, ABSENT), (code, NONE, ABSENT, NONE)]
    return out


def fit_counts(rows: list[tuple[int, int, int, int, int]], steps: int = 1500) -> Field:
    """rows: an example and how often it is met. All potentials by gradient steps on the regularised pseudo-likelihood."""
    code, y, left, anchor, n = (np.array(c) for c in zip(*sorted(rows)))
    k = NONE + 1
    x = np.concatenate((expanded(code).astype("float64"), np.eye(ABSENT + 1)[left][:, :k], np.eye(ABSENT + 1)[anchor][:, :k]), axis=1)
    share = n / np.sqrt(np.bincount(y, weights=n, minlength=k))[y]
    share = (share / share.sum())[:, None]
    target = np.eye(k)[y]
    w, m, v = (np.zeros((x.shape[1], k)) for _ in range(3))
    decay = np.full((x.shape[1], 1), 1e-4)
    for t in range(1, steps + 1):
        g = x.T @ ((soft(x @ w) - target) * share) + decay * w
        g[-k:] = (g[-k:] + g[-k:].T) / 2  # equal either way
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        w -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    skip = (w[-k:] + w[-k:].T) / 2
    return Field(w[:FEATURES], w[FEATURES : FEATURES + k], skip, balanced(skip))


def balanced(s: np.ndarray) -> np.ndarray:
    """A symmetric potential scaled so that all its rows' exponentials sum to one: a neighbour that knows nothing then says nothing.

    Else unsure occurrences of a value would talk each other into the kind whose potential is greatest.
    """
    for _ in range(200):
        s = s - np.logaddexp.reduce(s, axis=1, keepdims=True) / 2
        s = s - np.logaddexp.reduce(s, axis=0, keepdims=True) / 2
    return (s + s.T) / 2


def fit(docs: DataFrame) -> Field | None:
    """docs: text. Trained on counts over all documents, of which there are at most CODES by the labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0):
                if (t := text.as_py()) and MARK.search(t):
                    seen.update(examples(t))
            cols = list(zip(*((*e, n) for e, n in seen.items()))) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:4]), pa.array(cols[4], pa.int64())], ["code", "y", "l", "a", "n"])

    got = docs.select("text").mapInArrow(released(run), "code int, y int, l int, a int, n long").groupBy("code", "y", "l", "a").agg(F.sum("n").alias("n"))
    rows = [tuple(r) for r in got.collect()]
    return fit_counts(rows) if any(r[1] != NONE for r in rows) else None


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def personal_data(docs: DataFrame, model: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts and digest, and all spans, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, z in slices(batch, 1, PIECE):
                rows = []
                for doc, text in zip(batch.column(0).slice(a, z - a).to_pylist(), batch.column(1).slice(a, z - a)):
                    base, added = find(text.as_py() or "", m)
                    n = [sum(k == i for k, _, _ in base) for i in range(NONE)]
                    rows.append((doc, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added)), len(added), len(base) + len(added)))
                cols = list(zip(*rows))
                kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [c.split()[0] for c in RESULT.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), RESULT)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal_data(docs, fit(docs))


QUERIES = {"op3_pii": op3_pii}
ORACLE: dict[str, str] = {}
