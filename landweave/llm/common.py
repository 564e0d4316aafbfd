"""Shared helpers: batches of whole texts, word hashes, written intermediate tables."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.plans.stages import discard, keep, scope, scratch, written  # noqa: F401

#: A word is a run of bytes other than these; ``bytes.split()`` splits on the same six.
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def plain(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: ``mapInArrow`` takes a dot in a name for a field. ``toDF(*df.columns)`` names them back."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: str | Column) -> Column:
    """The text as bytes; null as an empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("binary"), F.lit(b""))


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(joined(*parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def joined(*parts: Column | str) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.concat_ws(":", *cols)


@functools.lru_cache(maxsize=1)
def _malloc_trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: nothing to do
        return lambda _: 0


def trim() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def lean(f: Callable) -> Callable:
    """``f`` for mapInArrow; a worker that waits for its next task gives its free memory back first."""

    def run(batches):
        yield from f(batches)
        trim()

    return run


def lean_group(f: Callable) -> Callable:
    """The same for applyInArrow on one group or a pair of groups."""

    if f.__code__.co_argcount == 2:

        def run(left, right):
            out = f(left, right)
            trim()
            return out
    else:

        def run(table):
            out = f(table)
            trim()
            return out

    return run


# --- Arrow batches -----------------------------------------------------------------------


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes in ``column`` (one row at least)."""
    for batch in batches:
        lengths = batch.column(column)
        sizes = np.diff(offsets(lengths))
        at = 0
        ends = np.cumsum(sizes)
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def offsets(array: pa.Array) -> np.ndarray:
    """Offsets of a binary array, from its own first byte on."""
    kind = np.int64 if pa.types.is_large_binary(array.type) else np.int32
    raw = np.frombuffer(array.buffers()[1], dtype=kind, count=len(array) + 1 + array.offset)[array.offset :]
    return raw.astype(np.int64)


def data(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows in one array, offsets from 0)."""
    at = offsets(array)
    buffer = array.buffers()[2]
    if buffer is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(buffer, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


# --- words -------------------------------------------------------------------------------


class WordHashes(dict):
    """word -> 64-bit hash, remembered for at most ``limit`` words."""

    def __init__(self, limit: int = 1 << 17, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh64_intdigest(word, self.seed)
        self[word] = h
        return h


def hashed(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


#: Odd 64-bit multiplier of the rolling polynomial (the golden ratio).
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that high and low bits of polynomial hashes are alike."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def rolling(h: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """Polynomial hash of every run of ``n`` entries, by doubling; len(h) - n + 1 values."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have = None, 0  # hash of the first `have` of the n entries
    power, width = h, 1
    left = n
    while left:
        if left & 1:
            if out is None:
                out, have = power, width
            else:
                size = len(h) - have - width + 1
                shift = np.uint64(pow(base, width, 1 << 64))
                out = out[:size] * shift + power[have : have + size]
                have += width
        left >>= 1
        if left:
            size = len(power) - width
            power = power[:size] * np.uint64(pow(base, width, 1 << 64)) + power[width : width + size]
            width *= 2
    return mixed(out[: len(h) - n + 1])


def in_one(counts: np.ndarray, n: int) -> np.ndarray:
    """Starts (in concatenated words) of windows of ``n`` that lie within one document."""
    total = int(counts.sum())
    if total < n:
        return np.zeros(0, np.int64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)  # words from here to the document's end
    return np.flatnonzero(left >= n)


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """True for each of ``total`` words in a window of ``n`` that starts at one of ``starts``."""
    steps = np.zeros(total + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + n, total), -1)
    return np.cumsum(steps[:-1]) > 0


def sums(flags: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each document's entries."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
