"""Vector code compression: a codebook for each part of a vector, fitted by Lloyd's rounds with Elkan's bounds.

A component x is the integer floor(1024 x); a vector is cut into ``PARTS`` equal consecutive parts. The codebook of a part
starts as that part of the ``ENTRIES`` least ids (rows of one id by their components). A round assigns every part to the
nearest entry (ties to the lower index) and then moves each entry to the floor of its parts' mean; unused entries stay.

What a round knows about a part is written with its row for the next one: the entry, an upper bound of the distance to it,
and one lower bound for each entry (a byte each, rounded down, in units of a 255th of the largest). When entries move,
upper bounds grow by the way of the own entry and lower bounds shrink by the way of each. An entry is left out only if
its lower bound, or half its distance to the own entry, is strictly larger than the upper bound; all others are compared
by integer distances, so that ties are decided exactly. Bounds are rounded outwards and can only save work, never change a
code. Components for which doubles are not exact (beyond some 8,000 in a part of 16) are compared with Python's
integers and without bounds.

Rows are read once and each round rewrites them in place, without a shuffle; only sums of each entry's parts (added up in
the task first, so an entry that holds a third of all parts makes no hot task) reach the driver: parts x entries rows.

* Rows whose vector is null, or holds a null, a NaN or an infinite component, are dropped. A vector of no components is
  kept: its code is of entry 0 (or the first entry), its error 0. Vectors whose length is not a multiple of ``PARTS``, or
  that differ in length, raise an error.
* Null ids come after all others when the codebooks start. Rows that share an id are coded each; equal vectors get equal codes.
* With fewer rows than ``ENTRIES`` a codebook has as many entries as there are rows; equal entries share the lowest index.
* Without rows the result is empty. Errors beyond 64 bits are given as the largest long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.llm.common import discard, lean, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = (1 << 63) - 1
#: Rows that are compared at once; rows of distances x entries is the largest array.
CHUNK = 2048
#: Outward rounding of bounds, far above that of a square root.
ROOM = 1e-9
#: Up to this sum of squares every product and sum in doubles is an exact integer.
EXACT = float(1 << 52)
#: Integers are summed in pieces of 40 bits, so that sums of any number of rows fit 64 bits.
LIMB = 40
#: Salts of the join that brings the sums of labels back.
SALTS = 16

STATE = "code binary, upper array<double>, unit array<double>, lower binary, error decimal(38,0), compared long"


class Books(NamedTuple):
    """Entries of each part as Python's integers, and as doubles where these are exact."""

    entries: list[list[tuple[int, ...]]]

    @property
    def size(self) -> int:
        return len(self.entries[0])

    def doubles(self, part: int) -> np.ndarray:
        return np.array([[_double(x) for x in e] for e in self.entries[part]], float).reshape(self.size, self.width)

    @property
    def width(self) -> int:
        return len(self.entries[0][0])

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()


def _double(x: int) -> float:
    try:
        return float(x)
    except OverflowError:
        return math.inf


def floored(x: float) -> int:
    """floor(1024 x) of a finite double, also where 1024 x is none."""
    return int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)


def usable(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def kept(table: DataFrame, key: str, vector: str, label: str | None) -> DataFrame:
    own = F.col(label) if label is not None else F.lit(None).cast("int")
    return table.where(usable(vector)).select(F.col(key).cast("long").alias("vec_id"), own.alias("label"), F.col(vector).cast("array<double>").alias("vector"))


def start(rows: DataFrame, parts: int, entries: int) -> Books:
    """The first codebooks; ``entries`` rows come to the driver."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    width = len(first[0][0]) // parts if first else 0
    ints = [[floored(x) for x in r[0]] for r in first]
    return Books([[tuple(v[p * width : (p + 1) * width]) for v in ints] for p in range(parts)])


# --- one part of some rows --------------------------------------------------------------------


class Known(NamedTuple):
    code: np.ndarray  # n
    upper: np.ndarray  # n
    lower: np.ndarray  # n x entries
    error: np.ndarray  # n, objects where doubles aren't exact
    compared: np.ndarray  # n


def square_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All squared distances of rows and entries; exact where ``exact`` holds."""
    d = x @ c.T
    d *= -2
    d += (c * c).sum(1)
    d += (x * x).sum(1)[:, None]
    return d


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rows whose distances to all of c, and all terms of them, are integers that doubles hold."""
    far = np.abs(c).max(initial=0.0)
    with np.errstate(over="ignore"):
        return x.shape[1] * (np.abs(x).max(axis=1, initial=0.0) + far) ** 2 < EXACT


def all_compared(x: np.ndarray, c: np.ndarray) -> Known:
    d = square_distances(x, c)
    code = d.argmin(1)  # the first of equal ones
    error = d[np.arange(len(x)), code]
    lower = np.sqrt(d) * (1 - ROOM)
    return Known(code, np.sqrt(error) * (1 + ROOM), lower, error, np.full(len(x), len(c)))


def some_compared(x: np.ndarray, c: np.ndarray, between: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> Known:
    """Elkan's step: only entries that no bound rules out are compared."""
    n, row = len(x), np.arange(len(x))
    half = between[code] / 2
    open_ = (lower <= upper[:, None]) & (half <= upper[:, None])
    open_[row, code] = False
    some = np.flatnonzero(open_.any(1))
    error = ((x - c[code]) ** 2).sum(1)
    compared = np.ones(n, np.int64)
    upper = np.sqrt(error) * (1 + ROOM)  # tight from here on
    lower[row, code] = np.sqrt(error) * (1 - ROOM)
    open_[some] &= (lower[some] <= upper[some, None]) & (half[some] <= upper[some, None])
    at, entry = np.nonzero(open_[some])
    at = some[at]
    code, error, upper = code.copy(), error.copy(), upper.copy()
    for a in range(0, len(at), 1 << 18):
        i, j = at[a : a + (1 << 18)], entry[a : a + (1 << 18)]
        d = ((x[i] - c[j]) ** 2).sum(1)
        lower[i, j] = np.sqrt(d) * (1 - ROOM)
        compared += np.bincount(i, minlength=n)
        # the best of each row: by distance, then by entry
        by = np.lexsort((j, d, i))
        first = by[np.concatenate([[True], i[by][1:] != i[by][:-1]])]
        i, j, d = i[first], j[first], d[first]
        better = (d < error[i]) | ((d == error[i]) & (j < code[i]))
        i, j, d = i[better], j[better], d[better]
        code[i], error[i], upper[i] = j, d, np.sqrt(d) * (1 + ROOM)
    return Known(code, upper, lower, error, compared)


def by_integers(vectors: np.ndarray, entries: list[tuple[int, ...]]) -> Known:
    """The same with Python's integers, a row at a time, and no bounds."""
    n, k = len(vectors), len(entries)
    code, error = np.zeros(n, np.int64), np.zeros(n, object)
    c = np.array(entries, dtype=object).reshape(k, -1)
    for r, v in enumerate(vectors):
        d = ((c - np.array([floored(x) for x in v], dtype=object)) ** 2).sum(1)
        code[r] = min(range(k), key=d.__getitem__)
        error[r] = d[code[r]]
    return Known(code, np.full(n, np.inf), np.zeros((n, k)), error, np.full(n, k))


def moved(old: Books, new: Books, part: int) -> np.ndarray:
    """How far each entry went, rounded up."""
    way = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for x, y in zip(old.entries[part], new.entries[part], strict=True)]
    return np.array([_root(w) for w in way])


def _root(square: int) -> float:
    try:
        return math.sqrt(square) * (1 + ROOM)
    except OverflowError:
        return math.inf


# --- rounds -----------------------------------------------------------------------------------


def assigned(rows: DataFrame, books: Books, before: Books | None, last: bool) -> DataFrame:
    """``rows`` with the state of one assignment; bounds of ``before`` are used where there are any, and none are kept at the ``last``."""
    parts, k = len(books.entries), books.size
    ways = None if before is None else [moved(before, books, p) for p in range(parts)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doubles = [books.doubles(p) for p in range(parts)]
        width = doubles[0].shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            between = [np.sqrt(square_distances(c, c).clip(0)) * (1 - ROOM) if exact(c, c).all() else np.zeros((k, k)) for c in doubles]
        for whole in batches:
            for a in range(0, whole.num_rows, CHUNK):
                b = whole.slice(a, CHUNK)
                n = b.num_rows
                column = b.column("vector")
                if (np.diff(column.offsets.to_numpy()) != width * parts).any():
                    raise ValueError(f"vectors must all have {width * parts} components, a multiple of {parts}")
                x = column.flatten().to_numpy(zero_copy_only=False).reshape(n, width * parts)
                if ways is not None:
                    old = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                    upper = b.column("upper").flatten().to_numpy().reshape(n, parts)
                    unit = b.column("unit").flatten().to_numpy().reshape(n, parts)
                    lower = np.frombuffer(b"".join(b.column("lower").to_pylist()), np.uint8).reshape(n, parts, k)
                code, up = np.zeros((n, parts), np.uint8), np.zeros((n, parts))
                units, low = np.zeros((n, parts)), np.zeros((n, parts, k), np.uint8)
                error, compared = np.zeros(n, object), np.zeros(n, np.int64)
                for p in range(parts):
                    v, c = x[:, p * width : (p + 1) * width], doubles[p]
                    with np.errstate(over="ignore"):
                        ints = np.floor(v * float(SCALE))
                    fine = exact(ints, c)
                    for which, found in (
                        (np.flatnonzero(fine), lambda w: all_compared(ints[w], c) if ways is None else some_compared(  # noqa: B023
                            ints[w], c, between[p], old[w, p], upper[w, p] + ways[p][old[w, p]],  # noqa: B023
                            np.maximum(unit[w, p][:, None] * lower[w, p] * (1 - ROOM) - ways[p], 0.0),  # noqa: B023
                        )),
                        (np.flatnonzero(~fine), lambda w: by_integers(v[w], books.entries[p])),  # noqa: B023
                    ):
                        if len(which):
                            got = found(which)
                            code[which, p], up[which, p] = got.code, got.upper
                            top = got.lower.max(1, initial=0.0)
                            units[which, p] = top / 255
                            with np.errstate(divide="ignore", invalid="ignore"):
                                low[which, p] = np.where(top[:, None] > 0, np.floor(got.lower / (top / 255)[:, None] * (1 - ROOM)), 0)
                            error[which] += [int(e) for e in got.error]
                            compared[which] += got.compared
                error = [min(int(e), LARGEST) for e in error]
                keep = n if not last else 0
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("vec_id"), b.column("label"), column if not last else pa.array([[]] * n, column.type),
                        pa.array([r.tobytes() for r in code], pa.binary()),
                        pa.array(list(up) if keep else [[]] * n, pa.list_(pa.float64())), pa.array(list(units) if keep else [[]] * n, pa.list_(pa.float64())),
                        pa.array([r.tobytes() for r in low] if keep else [b""] * n, pa.binary()),
                        pa.array(error, pa.decimal128(38, 0)), pa.array(compared + (b.column("compared").to_numpy() if ways is not None else 0)),
                    ],
                    ["vec_id", "label", "vector", "code", "upper", "unit", "lower", "error", "compared"],
                )

    kind = dict(rows.dtypes)["label"]
    return rows.mapInArrow(lean(work), f"vec_id long, label {kind}, vector array<double>, {STATE}")


def averaged(rows: DataFrame, books: Books) -> Books:
    """Each entry at the floor of its parts' mean."""
    parts, k = len(books.entries), books.size
    width = books.width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, k), np.int64)
        total: dict[int, np.ndarray] = {}  # of each limb
        small = np.zeros((parts, k, width), np.int64)
        for whole in batches:
            for a in range(0, whole.num_rows, CHUNK):
                b = whole.slice(a, CHUNK)
                n = b.num_rows
                x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, parts, width)
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, parts)
                with np.errstate(over="ignore"):
                    plain = (np.abs(x).max(axis=(1, 2), initial=0.0) < 2.0**20)
                    ints = np.floor(x[plain] * float(SCALE)).astype(np.int64)
                for p in range(parts):
                    np.add.at(small[p], code[plain, p], ints[:, p])
                    counts[p] += np.bincount(code[:, p], minlength=k)
                for r in np.flatnonzero(~plain):
                    for p in range(parts):
                        for q in range(width):
                            value = floored(float(x[r, p, q]))
                            sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
                            while value:
                                if limb not in total:
                                    total[limb] = np.zeros((parts, k, width), np.int64)
                                total[limb][p, code[r, p], q] += sign * (value & ((1 << LIMB) - 1))
                                value, limb = value >> LIMB, limb + 1
        some = [(0, small, counts), *((limb, t, counts * 0) for limb, t in total.items())]
        for limb, t, c in some:
            p, e = np.nonzero((c > 0) | t.any(2))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(np.full(len(p), limb)), pa.array(c[p, e]), pa.array(list(t[p, e]), pa.list_(pa.int64()))], ["part", "entry", "limb", "n", "total"])

    found = rows.select("vector", "code").mapInArrow(lean(sums), "part long, entry long, limb long, n long, total array<long>")
    adding = [F.sum(F.col("total")[q].cast("decimal(38,0)")).alias(f"t{q}") for q in range(width)]
    got = found.groupBy("part", "entry", "limb").agg(F.sum("n").alias("n"), *adding).collect()  # a row for each entry, and few limbs
    count = {}
    total = {}
    for r in got:
        at = r["part"], r["entry"]
        count[at] = count.get(at, 0) + r["n"]
        for q in range(width):
            total[*at, q] = total.get((*at, q), 0) + (int(r[f"t{q}"]) << (LIMB * r["limb"]))
    entry = lambda p, e: tuple(total[p, e, q] // count[p, e] for q in range(width)) if count.get((p, e)) else books.entries[p][e]
    return Books([[entry(p, e) for e in range(k)] for p in range(parts)])


def fitted(table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """(vec_id, label, code, error, compared of every row; the codebooks). ``compared`` is the number of distances computed."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: there are 1 to 256 entries")
    rows = written(kept(table, key, vector, label), "vectors")
    books = start(rows, parts, entries)
    if not books.size:
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("decimal(38,0)").alias("error"), F.lit(0).cast("long").alias("compared")), books
    before = None
    for r in range(rounds + 1):
        found = written(assigned(rows, books, before, r == rounds), "codes")
        discard(rows)
        rows = found
        if r < rounds:
            before, books = books, averaged(rows, books)
    return rows.select("vec_id", "label", "code", "error", "compared"), books


def encoded(table: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row."""
    rows, books = fitted(table, **options)
    key = F.struct("label")  # a struct of a null is no null
    capped = lambda c: F.least(c, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = rows.groupBy(key.alias("key")).agg(F.sum("error").alias("label_error"))
    spread = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("key", key).withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["key", "salt"]).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), capped(F.col("error")).alias("error"), capped(F.col("label_error")).alias("label_error"), F.lit(books.digest()).alias("codebooks_sha256")
    )


def decoded(codes: DataFrame, books: Books) -> DataFrame:
    """vec_id, vector: the entries that the codes (vec_id, code as bytes) name, over 1024."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doubles = [books.doubles(p) / SCALE for p in range(len(books.entries))]
        for b in batches:
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, len(doubles))
            vectors = np.concatenate([c[code[:, p]] for p, c in enumerate(doubles)], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(list(vectors), pa.list_(pa.float64()))], ["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(lean(work), "vec_id long, vector array<double>")
