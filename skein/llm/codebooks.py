"""Operator 11, vector code compression: product quantisation by Yinyang Lloyd rounds in whole numbers.

Vectors are cut into equal parts and each part is coded by the nearest entry of that part position's codebook. Entries are put
into groups once; a row keeps, for each part, its entry, an upper bound of that distance and a lower bound for each group. In a
later round the bounds are widened by how far the entries have moved since they were taken, a part whose upper bound stays
below all its lower bounds keeps its entry unseen, and of the other parts only groups whose bound fails are scanned. Bounds
taken against one codebook hold for all later ones, so rows are written again only when too much of the last pass was scanned;
other passes read the rows and return sums alone. Distances near a tie are compared as whole numbers.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are dropped, and so are rows whose
vector has not the width of the kept row with the smallest vec_id; a width that the parts do not divide is filled up with zeros.
The first entries are those of the smallest vec_ids, null ids last, of equal ids the lesser vector first; with fewer rows there
are fewer entries. Repeated rows count as often as they occur. Components of any finite size are exact (beyond 2^22 in slower
arithmetic); an error beyond a long is the greatest long. Other columns, whatever their names, are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, released, small, table

#: Rows are written again, with fresh bounds, after a pass that computed more than this share of all distances.
REWRITE = 0.25
#: Whole numbers below this are exact in all steps of 64-bit arithmetic, floating or not.
PLAIN = 1 << 22
MOST = (1 << 63) - 1
LIMB = 30
SUMS = "array<struct<part:int,entry:int,place:int,limb:int,total:bigint>>"


def scaled(vectors: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """floor(scale * x) of rows of vectors as rows x parts x width of whole floats; scale is a power of two, so they are exact."""
    x = np.floor(vectors.astype("float64") * scale)
    short = -x.shape[1] % parts
    if short:
        x = np.concatenate((x, np.zeros((len(x), short))), axis=1)
    return x.reshape(len(x), parts, -1)


def whole(x: np.ndarray) -> np.ndarray:
    """The same whole numbers as 64-bit integers, or as Python's where their squares could be too large for that."""
    if not x.size or np.abs(x).max() < PLAIN:
        return x.astype("int64")
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """A group for each entry: a few Lloyd rounds from entries that are far apart."""
    k = len(entries)
    at = [0]
    near = ((entries - entries[0]) ** 2).sum(axis=1)
    while len(at) < min(groups, k):
        at.append(int(near.argmax()))
        near = np.minimum(near, ((entries - entries[at[-1]]) ** 2).sum(axis=1))
    centres = entries[at]
    for _ in range(5):
        of = ((entries[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([entries[of == g].mean(axis=0) if (of == g).any() else c for g, c in enumerate(centres)])
    return of


@dataclass(frozen=True)
class Codebooks:
    """Entries of all parts: as Python integers (parts x entries x width), and as floats."""

    exact: list[list[list[int]]]

    @property
    def floats(self) -> np.ndarray:
        return np.array(self.exact, dtype="float64")

    def moved(self, totals: dict[tuple[int, int, int], int]) -> Codebooks:
        """Every entry at the floor of its parts' mean; totals by part, entry and place, the count at place -1."""
        out = []
        for p, entries in enumerate(self.exact):
            out.append([])
            for e, old in enumerate(entries):
                n = totals.get((p, e, -1), 0)
                out[-1].append([totals.get((p, e, i), 0) // n for i in range(len(old))] if n else old)
        return Codebooks(out)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for p in self.exact for e in p for v in e).encode()).hexdigest()


def nearest(x: np.ndarray, entries: np.ndarray, exact: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The entry with the least of d (rows x entries of squared distances, infinite where ruled out), ties to the lower index.

    Rows with several entries within rounding of the least are decided by whole numbers.
    """
    at, least = d.argmin(axis=1), d.min(axis=1)
    top = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    slack = least * 1e-12 + (0 if top < PLAIN else 1e-12 * top * top * x.shape[1])
    close = d <= (least + slack)[:, None]
    rows = np.nonzero(close.sum(axis=1) > 1)[0]
    if len(rows):
        if top < PLAIN:
            each = ((x[rows].astype("int64")[:, None] - exact[None].astype("int64")) ** 2).sum(axis=2)
            at[rows] = np.where(close[rows], each, MOST).argmin(axis=1)
        else:
            for r in rows:
                own = [int(v) for v in x[r]]
                at[r] = min((sum((a - b) ** 2 for a, b in zip(own, exact[e])), e) for e in np.nonzero(close[r])[0].tolist())[1]
    return at


class Bounds:
    """What a row keeps of one part: its entry, and bounds of distances as floats of four bytes, rounded outwards."""

    def __init__(self, groups: int):
        self.kind = np.dtype([("entry", "u1"), ("upper", "<f4"), ("lower", "<f4", (groups,))])

    def pack(self, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        out = np.empty(entry.shape, dtype=self.kind)
        big = float(np.finfo("f4").max)
        with np.errstate(over="ignore"):
            out["entry"] = entry
            out["upper"] = np.nextafter(upper.astype("f4"), np.float32(np.inf))
            out["lower"] = np.nextafter(np.clip(lower, -big, big).astype("f4"), np.float32(-np.inf))
        return out


def first_bounds(x: np.ndarray, c: np.ndarray, exact: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, upper and lower bounds of all rows of one part from all distances."""
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    at = nearest(x, c, exact, d)
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, at])
    d[rows, at] = np.inf
    lower = np.stack([np.sqrt(d[:, group == g].min(axis=1, initial=np.inf)) for g in range(groups)], axis=1)
    return at, upper, lower


def next_bounds(x: np.ndarray, kept: np.ndarray, drift: np.ndarray, c: np.ndarray, exact: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same from bounds kept, entries having drifted since; and how many distances it took."""
    at = kept["entry"].astype("int64")
    upper = kept["upper"].astype("float64") + drift[at]
    most = np.array([drift[group == g].max(initial=0) for g in range(groups)])
    lower = kept["lower"].astype("float64") - most[None]
    rows = np.nonzero(upper >= lower.min(axis=1))[0]
    if not len(rows):
        return at, upper, lower, 0
    own, xs = at[rows], x[rows]
    held = ((xs - c[own]) ** 2).sum(axis=1)
    upper[rows] = np.sqrt(held) * (1 + 1e-12)
    fails = upper[rows][:, None] >= lower[rows]
    d = np.full((len(rows), len(c)), np.inf)
    taken = len(rows)
    for g in range(groups):
        members, r = np.nonzero(group == g)[0], np.nonzero(fails[:, g])[0]
        if len(r) and len(members):
            d[np.ix_(r, members)] = ((xs[r][:, None] - c[members][None]) ** 2).sum(axis=2)
            taken += len(r) * len(members)
    d[np.arange(len(rows)), own] = held
    new = nearest(xs, c, exact, d)
    at = at.copy()
    at[rows] = new
    upper[rows] = np.sqrt(d[np.arange(len(rows)), new])
    d[np.arange(len(rows)), new] = np.inf
    for g in range(groups):
        # a scanned group's bound is exact; another's stays, but for the entry just left, which it did not count
        low = np.sqrt(d[:, group == g].min(axis=1, initial=np.inf))
        lower[rows, g] = np.where(fails[:, g], low, np.minimum(lower[rows, g], low))
    return at, upper, lower, taken


class Sums:
    """Totals of parts by entry, as whole numbers of any size."""

    def __init__(self) -> None:
        self.by: dict[tuple[int, int, int], int] = {}
        self.taken = 0

    def add(self, p: int, x: np.ndarray, at: np.ndarray, k: int, sign: int = 1) -> None:
        w = whole(x)
        if w.dtype == object:
            for row, e in zip(w.tolist(), at.tolist()):
                for i, v in [(-1, 1), *enumerate(row)]:
                    self.by[p, e, i] = self.by.get((p, e, i), 0) + sign * v
            return
        counts = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, weights=x[:, i], minlength=k) for i in range(x.shape[1])], axis=1)  # below 2^53
        for e in np.nonzero(counts)[0].tolist():
            for i, v in [(-1, counts[e]), *enumerate(sums[e])]:
                self.by[p, e, i] = self.by.get((p, e, i), 0) + sign * int(v)

    def rows(self) -> list[dict]:
        """Totals in limbs, so that sums of sums stay within a long."""
        out = [{"part": -1, "entry": 0, "place": 0, "limb": 0, "total": self.taken}]
        for (p, e, i), v in self.by.items():
            sign, v, limb = (-1 if v < 0 else 1), abs(v), 0
            while v:
                out.append({"part": p, "entry": e, "place": i, "limb": limb, "total": sign * (v & ((1 << LIMB) - 1))})
                v, limb = v >> LIMB, limb + 1
        return out


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(n, -1)


def _kept(column: pa.Array, kind: np.dtype, parts: int) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "u1")[ends[0] : ends[-1]].view(kind).reshape(len(column), parts)


class Lloyd:
    """Passes over the rows. groups: a group for each entry, by part."""

    def __init__(self, start: Codebooks, groups: int, parts: int, scale: int):
        self.parts, self.scale, self.groups = parts, scale, min(groups, len(start.exact[0]))
        self.group = np.stack([grouped(c, self.groups) for c in start.floats])
        self.bounds = Bounds(self.groups)

    def assign(self, batch: pa.RecordBatch, now: Codebooks, base: Codebooks | None, sums: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scaled rows, entries, packed bounds) of a batch; moves between entries since the bounds were taken go into sums."""
        n, c, k = batch.num_rows, now.floats, len(now.exact[0])
        x = scaled(_matrix(batch.column("embedding"), n), self.parts, self.scale)
        kept = None if base is None else _kept(batch.column("bounds"), self.bounds.kind, self.parts)
        entry, packed = np.empty((n, self.parts), dtype="int64"), np.empty((n, self.parts), dtype=self.bounds.kind)
        for p in range(self.parts):
            xs, exact = x[:, p], np.array(now.exact[p], dtype=object)
            if kept is None:
                at, upper, lower = first_bounds(xs, c[p], exact, self.group[p], self.groups)
                sums.taken += n * k
                sums.add(p, xs, at, k)
            else:
                drift = np.sqrt(((c[p] - base.floats[p]) ** 2).sum(axis=1)) * (1 + 1e-12)
                at, upper, lower, taken = next_bounds(xs, kept[:, p], drift, c[p], exact, self.group[p], self.groups)
                sums.taken += taken
                gone = np.nonzero(at != kept["entry"][:, p])[0]
                if len(gone):
                    sums.add(p, xs[gone], kept["entry"][gone, p].astype("int64"), k, -1)
                    sums.add(p, xs[gone], at[gone], k)
            entry[:, p], packed[:, p] = at, self.bounds.pack(at, upper, lower)
        return x, entry, packed

    def write(self, rows: DataFrame, now: Codebooks, base: Codebooks | None) -> DataFrame:
        """The rows with bounds taken against now, written; the last row of each task holds the task's sums."""
        kind = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("limb", pa.int32()), ("total", pa.int64())]))
        size = self.bounds.kind.itemsize * self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, held = Sums(), None

            def out(last: bool) -> pa.RecordBatch:
                batch, packed = held
                ends = np.arange(len(packed) + 1, dtype="<i4") * size
                bounds = pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(packed.tobytes())])
                told = pa.array([None] * (len(packed) - 1) + [sums.rows() if last else None], kind)
                return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("embedding"), bounds, told], ["vec_id", "label", "embedding", "bounds", "sums"])

            for batch in batches:
                if batch.num_rows:
                    if held:
                        yield out(False)
                    held = (batch, self.assign(batch, now, base, sums)[2])
            if held:
                yield out(True)

        types = dict(rows.dtypes)
        return materialise(rows.mapInArrow(released(run), f"vec_id bigint, label {types['label']}, embedding {types['embedding']}, bounds binary, sums {SUMS}"), "codebooks-rows")

    def sums(self, rows: DataFrame, now: Codebooks, base: Codebooks) -> DataFrame:
        """Sums of what moved between entries, a few rows for each task; nothing is written."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums()
            for batch in batches:
                if batch.num_rows:
                    self.assign(batch, now, base, sums)
            yield pa.RecordBatch.from_pylist(sums.rows(), pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("limb", pa.int32()), ("total", pa.int64())]))

        return rows.select("embedding", "bounds").mapInArrow(released(run), "part int, entry int, place int, limb int, total bigint")

    def codes(self, rows: DataFrame, now: Codebooks, base: Codebooks) -> DataFrame:
        """(vec_id, label, code, error) of all rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, entry, _ = self.assign(batch, now, base, Sums())
                text = entry.astype("u1").tobytes().hex()
                step = 2 * self.parts
                plain = np.abs(x).max() < PLAIN and np.abs(now.floats).max() < PLAIN
                if plain:
                    error = sum(((x[:, p] - now.floats[p][entry[:, p]]) ** 2).sum(axis=1) for p in range(self.parts)).astype("int64").tolist()
                else:
                    error = [min(MOST, sum((int(v) - c) ** 2 for p in range(self.parts) for v, c in zip(x[r, p], now.exact[p][entry[r, p]]))) for r in range(len(x))]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([text[i * step : (i + 1) * step] for i in range(len(x))], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

        return rows.select("vec_id", "label", "embedding", "bounds").mapInArrow(released(run), f"vec_id bigint, label {dict(rows.dtypes)['label']}, code string, error bigint")


def _told(sums: DataFrame) -> tuple[dict[tuple[int, int, int], int], int]:
    """Totals by part, entry and place over all tasks, and the distances taken: as many rows as the codebooks have numbers."""
    totals, taken = {}, 0
    for r in sums.groupBy("part", "entry", "place", "limb").agg(F.sum("total").alias("total")).toLocalIterator():
        if r["part"] < 0:
            taken = r["total"]
        else:
            key = (r["part"], r["entry"], r["place"])
            totals[key] = totals.get(key, 0) + (r["total"] << (LIMB * r["limb"]))
    return totals, taken


def _added(a: dict, b: dict) -> dict:
    return {k: a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()}


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of rows whose vector is whole."""
    x = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    return rows.where(x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))


def encode(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, groups: int = 4, log: list | None = None) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row of vectors (vec_id, embedding, label) that is kept.

    entries: at most 256. log: gets, for each pass, the share of all distances that it computed and whether it wrote the rows.
    """
    spark = vectors.sparkSession
    rows = valid(vectors)
    order = [F.asc_nulls_last("vec_id"), "embedding"]
    first = rows.orderBy(*order).limit(entries).collect()
    if not first:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    width = len(first[0]["embedding"])
    rows = rows.where(F.size("embedding") == width)
    if any(len(r["embedding"]) != width for r in first):
        first = rows.orderBy(*order).limit(entries).collect()
    start = scaled(np.array([r["embedding"] for r in first], dtype="float64"), parts, scale)
    now = Codebooks([[[int(v) for v in e] for e in start[:, p]] for p in range(parts)])
    lloyd = Lloyd(now, groups, parts, scale)

    # a pass assigns all parts and then moves the entries; the last assignment makes the codes
    held, base, base_totals, share, n = rows, None, {}, 1.0, None
    for _ in range(rounds):
        write = share > REWRITE
        if write:
            fresh = lloyd.write(held, now, base)
            told = fresh.where("sums IS NOT NULL").select(F.inline("sums"))
        else:
            told = lloyd.sums(held, now, base)
        more, taken = _told(told)
        totals = _added(base_totals, more)
        if write:
            if base is not None:
                discard(held)
            held, base, base_totals = fresh, now, totals
        if n is None:
            n = sum(v for (p, _, i), v in totals.items() if p == 0 and i == -1)
        share = taken / (n * parts * len(now.exact[0]))
        if log is not None:
            log.append((share, write))
        now = now.moved(totals)
    if base is None:  # no rounds
        held, base = lloyd.write(held, now, None), now
    codes = materialise(lloyd.codes(held, now, base), "codebooks-codes", keep=True)
    discard(held)
    by_label = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(MOST).cast("decimal(20,0)")).cast("long").alias("label_error"))
    by_label = materialise(by_label, "codebooks-labels", keep=True).withColumnRenamed("label", "of_label")
    out = codes.join(small(by_label, 32), F.col("label").eqNullSafe(F.col("of_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(now.digest()).alias("codebooks_sha256"))


def op11_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """All rounds as common table expressions: a row for each vector, part and entry."""
    out = [
        f"""rows AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)""",
        f"parts AS MATERIALIZED (SELECT vec_id, p, list_slice(x, CAST(p * len(x) / {parts} AS BIGINT) + 1, CAST((p + 1) * len(x) / {parts} AS BIGINT)) AS x FROM rows, range({parts}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, rn - 1 AS e, x AS c FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS rn FROM parts) WHERE rn <= {entries})",
    ]
    for r in range(rounds + 1):
        out.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
                SELECT vec_id, q.p, x, e, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d FROM parts q JOIN c{r} USING (p)) GROUP BY vec_id, p)""")
        if r < rounds:
            out.append(
                f"""m{r} AS MATERIALIZED (SELECT p, e, list(m ORDER BY i) AS c FROM (
                    SELECT p, e, i, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY p, e, i) GROUP BY p, e)""")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (p, e))")
    return f"""WITH {", ".join(out)},
        coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} JOIN rows USING (vec_id) GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256 FROM coded"""


QUERIES = {"op11_codebooks": op11_codebooks}
ORACLE = {"op11_codebooks": _sql()}
