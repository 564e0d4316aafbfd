"""Phrase collocations from count tries: per shard, serialised in order, merged by prefix ranges.

A task counts the runs of up to ``LONGEST`` words of its documents in tries (one for each language; a node is a run of words,
its count the number of times that it occurs within pieces). A trie is grown level by level with arrays: the nodes of level
d + 1 are the distinct pairs of a node of level d and the word behind it. When the documents at hand have ``SHARD_WORDS``
words, their tries are serialised in pre-order, with words in byte order, cut at the common bounds of the prefix ranges, and
leave the task as compressed pieces. A piece begins with the path to its first node, with counts of 0.

All pieces of a range meet in one task, which merges them in the same order. Walking the merged trie gives the counts of each
phrase's first parts, which are its ancestors; of those before the range's beginning only the path is known, and
their counts (``LONGEST`` - 1 for each range at most) are looked up afterwards. Only nodes of at least ``least`` occurrences leave, as no
part of a phrase is rarer than the phrase. The counts of last parts come over suffix links: a node's link is the
phrase without its first word, found by a join, and hands on its own link's counts.

Bounds are quantiles of the distinct runs in a sample of about ``SAMPLE_BYTES`` of text; they only decide how much a task gets, never
a count. A frequent word's subtrie is cut like any other, and a phrase that occurs everywhere is one node of each shard, so no key makes a hot task.

* A null or empty text has no words, and counts for nothing; a null language is ``und``.
* Texts are taken whole, very long ones a stretch at a time (a phrase over the seam is counted once).
* Rows that repeat count each time; ids are not read. Ties are ranked by the phrase's bytes.
* Without documents, or phrases of ``least`` occurrences, the result is empty. Other columns are not read.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landweave.llm.common import lean, slices, utf8, written

LONGEST, LEAST, TOP = 3, 10, 2000
SHARD_WORDS = 1_500_000
#: Bytes of one text that are taken apart at once.
STRETCH = 4 << 20
#: Bytes of text that stand behind one prefix range, and bytes of text from which their bounds are taken.
RANGE_BYTES, SAMPLE_BYTES = 8 << 20, 16 << 20
SAMPLE_STEP = 61
#: Nodes that a merge holds before it adds up equal ones.
MERGE_NODES = 4 << 20
SALTS = 64
#: Lower case, and one mark for all that ends a piece; no word holds the mark.
MARK = b"."
FOLD = bytes(MARK[0] if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words, with a mark wherever a piece ends."""
    return text.translate(FOLD).replace(MARK, b" . ").split(b" ")


class Ids(dict):
    """word -> number from 1; empty strings and marks are 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


def fresh() -> Ids:
    return Ids({b"": -1, MARK: 0})


def stretches(text: bytes, most: int = STRETCH) -> Iterator[bytes]:
    """``text`` in parts of about ``most`` bytes that end at a space."""
    a = 0
    while len(text) - a > most:
        b = text.rfind(b" ", a, a + most) + 1 or text.find(b" ", a + most) + 1 or len(text)
        yield text[a:b]
        a = b
    yield text[a:]


class Trie(NamedTuple):
    """Nodes in pre-order: the root, then depth first, words in byte order."""

    words: list[bytes]  # in order
    path: np.ndarray  # n x longest: 1 + place of each word, 0 where a node is less deep
    count: np.ndarray  # n

    @property
    def depth(self) -> np.ndarray:
        return (self.path > 0).sum(1)

    def key(self, i: int) -> tuple[bytes, ...]:
        return tuple(self.words[w - 1] for w in self.path[i].tolist() if w)


def grown(ids: np.ndarray, words: list[bytes], longest: int, ghost: np.ndarray | None = None) -> Trie:
    """The trie of a sequence of word places (0: a mark), level by level. Runs that end at a ``ghost`` don't count."""
    n = len(ids)
    here = np.flatnonzero(ids)
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # parent, word, count
    node = np.zeros(n, np.int64)
    for d in range(longest):
        if d:
            here = here[(here + d < n)]
            here = here[ids[here + d] > 0]
        keys, inverse, count = np.unique(node[here] << 32 | ids[here + d].astype(np.int64), return_inverse=True, return_counts=True)
        if ghost is not None:
            count = np.bincount(inverse[~ghost[here + d]], minlength=len(keys))
        levels.append((keys >> 32, keys & 0xFFFFFFFF, count))
        node[here] = inverse
    sizes = [np.ones(len(w), np.int64) for _, w, _ in levels]
    for d in range(longest - 1, 0, -1):
        sizes[d - 1] += np.bincount(levels[d][0], weights=sizes[d], minlength=len(sizes[d - 1])).astype(np.int64)
    total = 1 + int(sizes[0].sum())
    path, counts = np.zeros((total, longest), np.uint32), np.zeros(total, np.int64)
    counts[0] = levels[0][2].sum()
    at = np.zeros(1, np.int64)  # places of the level above
    above = np.zeros((1, longest), np.uint32)
    for d, (parent, word, count) in enumerate(levels):
        before = np.cumsum(sizes[d]) - sizes[d]
        first = np.searchsorted(parent, np.arange(len(at)))  # of each parent's children
        start = before[np.minimum(first, max(len(before) - 1, 0))] if len(before) else before
        place = at[parent] + 1 + before - (start[parent] if len(before) else 0)
        rows = above[parent]
        rows[:, d] = word
        path[place], counts[place] = rows, count
        at, above = place, rows
    return Trie(words, path, counts)


# --- pieces -----------------------------------------------------------------------------------


def written_piece(t: Trie, a: int, b: int) -> bytes:
    """Nodes a to b (exclusive) with the path to the first, counts of the path 0."""
    path, count = t.path[a:b], t.count[a:b]
    depth = int((path[0] > 0).sum())
    if depth > 1:
        stubs = np.repeat(path[:1], depth - 1, axis=0)
        for k in range(depth - 1):
            stubs[k, k + 1 :] = 0
        path, count = np.concatenate([stubs, path]), np.concatenate([np.zeros(depth - 1, np.int64), count])
    depths = (path > 0).sum(1)
    last = path[np.arange(len(path)), np.maximum(depths - 1, 0)]
    used, small = np.unique(last, return_inverse=True)
    words = [t.words[w - 1] if w else b"" for w in used.tolist()]
    kinds = [next(k for k in "BHIQ" if top < 1 << 8 * struct.calcsize(k)) for top in (len(used), int(count.max()))]
    raw = b"".join([
        struct.pack("<QQ2s", len(path), len(words), "".join(kinds).encode()), depths.astype("<u1").tobytes(), small.astype(f"<{kinds[0]}").tobytes(), count.astype(f"<{kinds[1]}").tobytes(),
        np.array([len(w) for w in words], "<u4").tobytes(), *words,
    ])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def read_piece(raw: bytes, longest: int) -> Trie:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n, m, kinds = struct.unpack_from("<QQ2s", raw)
    at = struct.calcsize("<QQ2s")

    def array(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, f"<{kind}", count, at)
        at += out.nbytes
        return out

    depth, small, count, lengths = array("B", n), array(chr(kinds[0]), n), array(chr(kinds[1]), n).astype(np.int64), array("I", m)
    ends = at + np.cumsum(lengths.astype(np.int64))
    words = [raw[e - k : e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
    rootless = m and words[0] != b""  # without the root there is no place for no word
    word = small.astype(np.uint32) + (1 if rootless else 0)
    path, row = np.zeros((n, longest), np.uint32), np.arange(n)
    for d in range(1, longest + 1):
        last = np.maximum.accumulate(np.where(depth == d, row, 0))  # the latest node of this depth
        path[:, d - 1] = np.where(depth >= d, word[last], 0)
    return Trie(words if rootless else words[1:], path, count)


def merged(tries: list[Trie]) -> Trie:
    """One trie with the counts of equal nodes added up."""
    if len(tries) == 1:
        return tries[0]
    words = sorted(set().union(*[t.words for t in tries]))
    number = {w: k for k, w in enumerate(words, 1)}
    paths = np.concatenate([np.array([0, *map(number.__getitem__, t.words)], np.uint32)[t.path] for t in tries])
    counts = np.concatenate([t.count for t in tries])
    bits = len(words).bit_length()
    if bits * paths.shape[1] <= 63:
        key = np.zeros(len(paths), np.int64)
        for d in range(paths.shape[1]):
            key = key << bits | paths[:, d]
        by = np.argsort(key, kind="stable")
        fresh_ = np.concatenate([[True], key[by][1:] != key[by][:-1]])
    else:
        by = np.lexsort(paths.T[::-1])
        fresh_ = np.concatenate([[True], (paths[by][1:] != paths[by][:-1]).any(1)])
    first = np.flatnonzero(fresh_)
    return Trie(words, paths[by[first]], np.add.reduceat(counts[by], first))


# --- tasks ------------------------------------------------------------------------------------

Bound = tuple[bytes, tuple[bytes, ...]]


def shards(bounds: list[Bound], longest: int, shard_words: int, stretch: int):
    """A function for mapInArrow: (lang, text) -> (range, lang, piece)."""

    def flushed(ids: Ids, found: dict[bytes, list[tuple[np.ndarray, int]]]) -> Iterator[pa.RecordBatch]:
        words = sorted(w for w, k in ids.items() if k > 0)
        place = np.zeros(len(words) + 1, np.uint32)
        place[[ids[w] for w in words]] = np.arange(1, len(words) + 1)
        for lang in sorted(found):
            parts = found.pop(lang)
            ghost = None
            if any(g for _, g in parts):
                ghost = np.concatenate([np.arange(len(x)) < g for x, g in parts])
            t = grown(place[np.concatenate([x for x, _ in parts])], words, longest, ghost)
            lo, hi = bisect.bisect_right(bounds, (lang, ())), bisect.bisect_left(bounds, (lang + b"\0", ()))
            inside = range(len(t.count))
            cuts = [0, *(bisect.bisect_left(inside, key, key=t.key) for _, key in bounds[lo:hi]), len(t.count)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a < b:
                    yield pa.RecordBatch.from_arrays([pa.array([lo + k], pa.int64()), pa.array([lang], pa.binary()), pa.array([written_piece(t, a, b)], pa.binary())], ["range", "lang", "piece"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, held = fresh(), {}, 0
        for b in slices(batches, "text"):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                tail: list[bytes] = []  # the words before a stretch that runs on
                for part in stretches(text, stretch):
                    words = tail + words_of(part)
                    numbers = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
                    numbers = np.append(numbers[numbers >= 0], 0).astype(np.uint32)
                    found.setdefault(lang, []).append((numbers, len(tail)))
                    held += len(numbers)
                    tail = [w for w in words if w][-(longest - 1) :] if longest > 1 and len(part) < len(text) else []
                    if held >= shard_words:
                        yield from flushed(ids, found)
                        ids, found, held = fresh(), {}, 0
        if held:
            yield from flushed(ids, found)

    return work


def merging(longest: int, least: int, most: int):
    """A function for mapInArrow: sorted (range, lang, piece) -> lang, phrase, depth, f, rest, heads."""

    def nodes(lang: bytes, t: Trie) -> Iterator[pa.RecordBatch]:
        depth, row = t.depth, np.arange(len(t.count))
        keep = np.flatnonzero((t.count >= least) & (depth > 0) | (depth == 0) & (t.count > 0))
        heads = np.zeros((len(keep), max(longest - 1, 1)), np.int64)
        for d in range(1, longest):
            last = np.maximum.accumulate(np.where(depth == d, row, 0))
            heads[:, d - 1] = np.where(depth[keep] > d, t.count[last[keep]], 0)
        for a in range(0, len(keep), 1 << 16):
            some = keep[a : a + (1 << 16)]
            keys = [t.key(i) for i in some.tolist()]
            lists = [[x or None for x in h[: max(len(k) - 1, 0)]] for h, k in zip(heads[a : a + (1 << 16)].tolist(), keys, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.binary()), pa.array([b" ".join(k) for k in keys], pa.binary()), pa.array([len(k) for k in keys], pa.int32()), pa.array(t.count[some]),
                 pa.array([b" ".join(k[1:]) for k in keys], pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
                ["lang", "phrase", "depth", "f", "rest", "heads"],
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tries, held = None, [], 0
        for b in batches:
            for number, lang, raw in zip(b.column("range").to_pylist(), b.column("lang").to_pylist(), b.column("piece"), strict=True):
                if (number, lang) != now:
                    if tries:
                        yield from nodes(now[1], merged(tries))
                    now, tries, held = (number, lang), [], 0
                t = read_piece(raw.as_py(), longest)
                tries.append(t)
                held += len(t.count)
                if held >= most:
                    tries = [merged(tries)]
                    held = len(tries[0].count) // 2  # no merge of little with much
        if tries:
            yield from nodes(now[1], merged(tries))

    return work


def sampled(rows: DataFrame, fraction: float, longest: int) -> list[Bound]:
    """Distinct runs at even steps through a sample of texts, in order; their number is bounded by SAMPLE_BYTES."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = [w for w in words_of(text) if w]
                keys = []
                for i in range(len(text) % SAMPLE_STEP, len(words), SAMPLE_STEP):
                    run = words[i : i + longest]
                    run = run[: run.index(MARK)] if MARK in run else run
                    if run:
                        keys.append(b" ".join(run))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.binary()), pa.array(keys, pa.binary())], ["lang", "key"])

    some = rows if fraction >= 1 else rows.sample(fraction, seed=1)
    found = some.mapInArrow(lean(work), "lang binary, key binary").distinct().toArrow()
    pairs = zip(found.column("lang").to_pylist(), found.column("key").to_pylist(), strict=True)
    return sorted((lang, tuple(key.split(b" "))) for lang, key in pairs)


# --- the operator -----------------------------------------------------------------------------


def counted(docs: DataFrame, *, longest: int = LONGEST, least: int = LEAST, range_bytes: int = RANGE_BYTES, shard_words: int = SHARD_WORDS, stretch: int = STRETCH, merge_nodes: int = MERGE_NODES) -> DataFrame:
    """lang, phrase, depth, f, rest (the phrase without its first word), heads (counts of its first 1, 2, ... words).

    Every run of up to ``longest`` words that occurs ``least`` times or more, and for each language a row of depth 0 whose f is its number of words.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary").alias("lang"), utf8("text").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // range_bytes))
    keys = sampled(rows, min(1.0, SAMPLE_BYTES / max(size, 1)), longest) if ranges > 1 else []
    bounds = sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []
    pieces = rows.mapInArrow(lean(shards(bounds, longest, shard_words, stretch)), "range long, lang binary, piece binary")
    ranged = pieces.repartition(len(bounds) + 1, "range").sortWithinPartitions("range", "lang")
    found = ranged.mapInArrow(lean(merging(longest, least, merge_nodes)), "lang binary, phrase binary, depth int, f long, rest binary, heads array<long>")
    text = lambda c: F.col(c).cast("string").alias(c)
    nodes = written(found.select(text("lang"), text("phrase"), "depth", "f", text("rest"), "heads"), "nodes")
    for d in range(1, longest):  # ancestors in an earlier range: longest - 1 for each range at most
        head = F.substring_index("phrase", " ", d)
        cut = nodes.where((F.col("depth") > d) & F.get("heads", F.lit(d - 1)).isNull()).select("lang", head.alias("head")).distinct()
        known = written(cut.join(nodes.where(F.col("depth") == d).select("lang", F.col("phrase").alias("head"), F.col("f").alias("known")), ["lang", "head"]), "heads")
        open_ = F.transform("heads", _filled(d - 1))
        nodes = nodes.withColumn("head", head).join(known, ["lang", "head"], "left").withColumn("heads", open_).drop("head", "known")
    return written(nodes, "nodes")


def _filled(at: int):
    return lambda x, k: F.coalesce(x, F.when(k == at, F.col("known")))


def linked(nodes: DataFrame, longest: int) -> DataFrame:
    """Phrases of two words or more, with tails: counts of what is left after 1, 2, ... words, over suffix links."""
    level = nodes.where("depth = 1").withColumn("tails", F.array().cast("array<long>"))
    out = None
    for d in range(2, longest + 1):
        link = level.select("lang", F.col("phrase").alias("rest"), F.concat(F.array("f"), "tails").alias("tails"))
        level = nodes.where(F.col("depth") == d).join(link, ["lang", "rest"])
        if d < longest:
            level = written(level, "links")
        out = level if out is None else out.unionByName(level)
    return out


def inner(phrase: Column, words: int, longest: int) -> Column:
    """The runs of two words or more that lie inside a phrase of so many words and aren't the whole."""
    split = F.split(phrase, " ")
    return F.array(*[F.array_join(F.slice(split, i + 1, n), " ") for n in range(2, words) for i in range(words - n + 1)])


def collocations(docs: DataFrame, *, longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = 50, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases.

    The score of a cut into a first part (l occurrences) and a last one (r) is floor(10^6 a^2 / (l r)), in decimals of 38 digits (exact up to 10^15
    occurrences); a phrase's is that of its weakest cut. Phrases of which ``share`` percent or more lie in one longer phrase are dropped.
    """
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    nodes = counted(docs, longest=longest, least=least, **options)
    found = written(linked(nodes, longest), "phrases")
    big = lambda c: c.cast("decimal(15,0)")
    whole = lambda c: c.cast("long")
    a = big(F.col("f"))
    cut = lambda x, k: F.struct(F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), big(x["heads"]) * big(x["tails"])).alias("score"), k.alias("k"), x["heads"].alias("l"), x["tails"].alias("r"))
    scored = found.withColumn("cut", F.array_min(F.transform(F.arrays_zip("heads", "tails"), cut)))
    for d in range(3, longest + 1):
        inside = found.where(F.col("depth") == d).select("lang", F.explode(inner(F.col("phrase"), d, longest)).alias("phrase"), "f")
        longer = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        scored = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("f"), F.lit(True))).drop("longer")
    flat = scored.select("lang", "phrase", F.col("f").alias("a"), whole(F.col("cut.l")).alias("l"), whole(F.col("cut.r")).alias("r"), whole(F.col("cut.score")).alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = flat.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))  # a language may hold most phrases
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = nodes.where("depth = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
