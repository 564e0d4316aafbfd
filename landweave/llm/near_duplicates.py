"""MinHash near-duplicates with sequential Bayesian verification.

A document is the set of its distinct 5-word shingles. Two are linked if the Jaccard similarity of the
full sets is 0.75 or more; a group is what links connect.

1. Equal sets are one class, known by a digest of the set and numbered.
2. 128 MinHash values in 32 bands of 4: two sets of similarity 0.75 share no band with probability
   (1 - 0.75**4)**32 = 5e-6, less above it.
3. Rounds of stars. Every member of a band's bucket is a candidate with one member only, the bucket's
   centre, unless they are in one group already. The first round's centre is the member with most
   neighbours over all its buckets, later rounds draw it by a hash. Signatures are compared in batches of
   32 values; with a uniform prior the similarity's posterior after m of n equal values is
   Beta(m + 1, n - m + 1), and a pair is dropped once P(similarity >= 0.75) < ``MISS``. Each member's best
   survivor is verified on the full sets. These links join nearly all copies, at a cost linear in buckets.
4. Buckets whose members still lie in different groups get the rest: every member outside the bucket's
   largest group is compared with every member of another group, in cells of at most about ``CHUNK`` by
   ``PIECE``. A pair counts in the first band it shares. Of each cell only the members of surviving pairs go
   on; they meet again with their full sets, and verified links leave the task. So no link between groups
   is lost to step 3, and pairs are never rows.

Large buckets are split into chunks, a star's centre with many members into salted parts. Links and
components stay on the executors. The miss probability is per pair and batch; a pair can also be joined
through others.

* Null and empty texts, and texts without words, have an empty set, link with nothing and are kept.
  Fewer than five words are one shingle. Repeated rows are one group. Rows of one id with different texts are one
  document with the links of all of them. Rows without an id link like others; their component is the least id that
  they reach, null (and kept) if there is none. Any id is allowed, texts of any length too; ties of links don't matter,
  as components don't depend on which links are found first.
* ``one_of_each`` goes by texts, not ids: see there.

Memory: verification streams sets past one set (a star's centre) or past the side of a cell, of CELL_BYTES or one
set. Hot keys (copies of one text, members of one bucket or star) are dealt in parts. In step 4 a bucket of n members
that are all in different groups costs about n * m / 256 rows, m being the members of fitting sizes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.llm.common import WordHashes, discard, free, hashed, in_one, lean, partitions, plain, rolling, slices, utf8, written
from landweave.llm.components import components

SIZE = 5
PERMS, BANDS = 128, 32
ROWS = PERMS // BANDS
PERCENT = 75
MISS = 1e-6
BATCH = 32
CHUNK, PIECE = 256, 1024
ROUNDS = 3
#: Members of one star, their bytes, and bytes of the sets on a side of a cell, that are verified together at most.
STAR, STAR_BYTES, CELL_BYTES = 256, 4 << 20, 4 << 20
#: Bytes aimed at for one task, and rows of one key aimed at for one part of it.
TASK_BYTES, HOT = 128 << 20, 512

_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)


def shingle_sets(texts: list[bytes], memo: WordHashes) -> list[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text."""
    split = [t.lower().split() for t in texts]  # bytes.lower() changes A-Z only
    counts = np.fromiter(map(len, split), np.int64, len(split))
    words = np.concatenate([hashed(w, memo) for w in split]) if split else np.zeros(0, np.uint64)
    h = rolling(words, SIZE)[in_one(counts, SIZE)] if len(words) >= SIZE else np.zeros(0, np.uint64)
    out, at = [], 0
    for n, w in zip(counts.tolist(), split, strict=True):
        if n >= SIZE:
            out.append(distinct(h[at : at + n - SIZE + 1]))
            at += n - SIZE + 1
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(w), SIZE)] if n else [], np.uint64))
    return out


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    keep = np.empty(len(h), bool)
    keep[:1] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of PERMS 32-bit MinHash values for each set that isn't empty."""
    out = np.zeros((len(sets), PERMS), np.uint32)
    at = 0
    while at < len(sets):  # as many sets at once as stay in the processor's cache
        to, size = at + 1, len(sets[at])
        while to < len(sets) and size + len(sets[to]) <= 32_768:
            size += len(sets[to])
            to += 1
        every = np.concatenate(sets[at:to])
        begin = np.cumsum([0, *map(len, sets[at : to - 1])])
        for k in range(PERMS):
            out[at:to, k] = np.minimum.reduceat(every * MULTIPLY[k] + ADD[k], begin) >> np.uint64(32)
        at = to
    return out


def keys(docs: DataFrame) -> tuple[Column, Column]:
    """64-bit hashes of the text and of all columns, which tell rows apart by their content."""
    hashable = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64("text"), F.xxhash64(F.lit(1), *hashable)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, a, b, spot (a running number), n_shingles, digest of the set and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, spot = WordHashes(), 0
        for b in slices(batches, "text"):
            sets = shingle_sets(b.column("text").to_pylist(), memo)
            some = [s for s in sets if len(s)]
            found = iter(signatures(some))
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sig = [next(found).tobytes() if len(s) else None for s in sets]
            numbers = pa.array(np.arange(spot, spot + b.num_rows))
            spot += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "a", "b")), numbers, pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
                ["doc_id", "a", "b", "spot", "n_shingles", "digest", "sig"],
            )

    a, b = keys(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), a.alias("a"), b.alias("b"), utf8("text").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, a long, b long, spot long, n_shingles long, digest binary, sig binary")


def least_matches(n: int, share: float = PERCENT / 100, miss: float = MISS) -> int:
    """The fewest equal values of ``n`` with which P(similarity >= share) is still ``miss`` or more.

    The posterior's upper tail is the chance that a binomial of n + 1 trials at ``share`` is at most m.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * share**m * (1 - share) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


LEAST = [(n, least_matches(n)) for n in range(BATCH, PERMS + 1, BATCH)]


def surviving(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in i and j of the pairs that no batch drops, their equal values)."""
    alive, matches, done = np.arange(len(i)), np.zeros(len(i), np.int64), 0
    for n, least in LEAST:
        matches = matches + (a[i[alive], done:n] == b[j[alive], done:n]).sum(1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive, matches


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, PERMS)


def parts_of(n: str) -> Column:
    """Into how many parts a key of ``n`` rows is split."""
    return F.ceil(F.col(n) / HOT).cast("int")


def spread(rows: DataFrame, facts: DataFrame, on: str, total: int, salt: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` (one row for each key, n of them in ``rows``), keys of many rows in several parts.

    A key is split if it holds more than HOT rows and 1 in 16,384 of ``total``, so fewer keys than that are broadcast.
    """
    most = max(HOT, total // 16_384)
    many = F.when(F.col("n") > most, F.ceil(F.col("n") / most)).otherwise(1).cast("int")
    hot = facts.where(F.col("n") > most).select(on, many.alias("_parts"))
    left = rows.join(F.broadcast(hot), on, "left").withColumn("_part", F.pmod(salt, F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    right = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), many - 1)))
    return left.join(right.drop("n"), [on, "_part"], how).drop("_part")


def plausible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """u, v, matches, size (shingles of u) of the pairs whose signatures survive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "a", 8 << 20):
            at = np.arange(b.num_rows)
            keep, matches = surviving(matrix(b.column("a")), matrix(b.column("b")), at, at)
            rows = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in ("u", "v", "size")), pa.array(matches)], ["u", "v", "size", "matches"])

    pairs = written(pairs, "met")
    centres = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")).join(reps.select(F.col("rep").alias("v"), F.col("sig").alias("b")), "v")
    both = spread(pairs, centres, "v", pairs.count(), F.xxhash64("u")).join(reps.select(F.col("rep").alias("u"), F.col("sig").alias("a"), "size"), "u")
    return both.select("u", "v", "size", "a", "b").mapInArrow(lean(run), "u long, v long, size long, matches long")


def once(a: str, b: str, text: str = "text") -> Callable:
    """For mapInArrow: rows whose keys a task meets again are dropped before the shuffle, as long as they are remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches, text):
            keep = []
            for k in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True):
                keep.append(k not in seen)
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(k)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return lean(run)


def tasks_for(df: DataFrame, size: Column) -> int:
    """Tasks for rows of ``size`` bytes each: all of the session's partitions for little, TASK_BYTES each for much."""
    total = df.agg(F.sum(size)).first()[0] or 1
    return int(max(-(-total // TASK_BYTES), min(partitions(df.sparkSession), -(-total // (TASK_BYTES >> 6)))))


def shingle_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, set: the full sets of the classes ``ids`` (rep, a, b). This is the one place where texts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in slices(batches, "text"):
            found = [s.tobytes() for s in shingle_sets(b.column("text").to_pylist(), memo)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.binary())], ["id", "set"])

    a, b = keys(docs)
    texts = docs.select(a.alias("a"), b.alias("b"), utf8("text").alias("text"))
    mine = texts.mapInArrow(once("a", "b"), texts.schema).join(ids.select(F.col("rep").alias("id"), "a", "b").hint("merge"), ["a", "b"])
    # rows that are alike but were read by different tasks
    one = mine.dropDuplicates(["a", "b"]).select("id", "text")
    return written(one.mapInArrow(lean(run), "id long, set binary"), "sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v; size: shingles of u) whose full shingle sets reach the similarity.

    Pairs are stars around v, cut into parts by the number and the bytes of their sets. The sets of a part stream past
    that of the centre, which is sent to each part once, so a task holds one set and one batch.
    """
    pairs = written(pairs, "pairs")
    parts = pairs.groupBy("v").agg(F.greatest(F.ceil(F.count(F.lit(1)) / STAR), F.ceil(F.sum("size") * 8 / STAR_BYTES)).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"))
    arms = spread(pairs, parts, "v", pairs.count(), F.xxhash64("u")).select(
        F.col("u").alias("id"), F.col("v").alias("star"), F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("arm")
    )
    centres = parts.select(F.col("v").alias("id"), F.col("v").alias("star"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("arm"))
    tasks = tasks_for(pairs, 16 * F.col("size"))
    rows = arms.unionByName(centres).join(sets, "id").repartition(tasks, "star", "part").sortWithinPartitions("star", "part", "arm")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, middle = None, None
        for b in slices(batches, "set", 8 << 20):
            u, v = [], []
            for s, p, arm, k, x in zip(*(b.column(c).to_pylist() for c in ("star", "part", "arm", "id", "set")), strict=True):
                if not arm:
                    open_, middle = (s, p), np.frombuffer(x, np.uint64)
                elif open_ == (s, p) and similar(np.frombuffer(x, np.uint64), middle):
                    u.append(k)
                    v.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.mapInArrow(lean(compare), "u long, v long")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= PERCENT * union, for sorted distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < PERCENT * len(b):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def placed(buckets: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The bucket rows with their group's root."""
    if groups is None:
        return buckets.withColumn("root", F.col("rep"))
    return buckets.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def meeting(rows: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``facts`` (one row a key); both hold n, by which a key is split."""
    left = rows.withColumn("_part", F.pmod(F.xxhash64("rep"), parts_of("n")).cast("int"))
    right = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), parts_of("n") - 1))).drop("n")
    return left.join(right, [*on, "_part"]).drop("_part")


def stars(rows: DataFrame, turn: int) -> DataFrame:
    """u, v: each bucket's members with its centre, where their groups differ."""
    weight = F.struct("neighbours", (-F.col("rep")).alias("less")) if turn == 0 else F.struct(F.xxhash64("rep", "key", F.lit(turn)).alias("drawn"), F.col("rep"))
    centre = rows.groupBy("key").agg(F.max(F.struct(weight.alias("weight"), "rep", "root")).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("n").alias("n")).where("lo < hi")
    met = meeting(rows, centre.select("key", "n", F.col("c.rep").alias("v"), F.col("c.root").alias("v_root")), ["key"]).where("root <> v_root")
    return met.select(F.col("rep").alias("u"), "v").distinct()


CELL = ["key", "cls", "i", "j"]


def pieces_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[str, pa.RecordBatch | None]]:
    """The rows of each cell in turn: ("left" or "right", rows), then ("end", None)."""
    open_ = None
    for b in slices(batches, column, 4 << 20):
        if not b.num_rows:
            continue
        cells = np.stack([b.column(c).to_numpy().astype(np.int64) for c in (*CELL, "side")])
        cuts = np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(0)) + 1
        for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            if (cell := tuple(cells[:-1, at].tolist())) != open_:
                if open_ is not None:
                    yield "end", None
                open_ = cell
            yield ("right" if cells[-1, at] else "left"), b.slice(at, to - at)
    if open_ is not None:
        yield "end", None


class Side:
    """Rows of one side of a cell as arrays."""

    def __init__(self, rows: list[pa.RecordBatch]):
        get = lambda c: np.concatenate([b.column(c).to_numpy() for b in rows])
        self.rep, self.root, self.size, self.band = get("rep"), get("root"), get("size"), int(rows[0].column("band")[0].as_py())
        self.sig = np.concatenate([matrix(b.column("sig")) for b in rows])
        self.full = [np.frombuffer(x, np.uint64) for b in rows if "set" in b.schema.names for x in b.column("set").to_pylist()]

    def pairs(self, other: Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of both sides whose signatures survive, if no earlier band has had the pair."""
        bands = lambda s: s.sig.reshape(len(s.sig), BANDS, ROWS)
        for at in range(0, len(self.rep), 32):
            p, q = (m.ravel() for m in np.meshgrid(np.arange(at, min(at + 32, len(self.rep))), np.arange(len(other.rep)), indexing="ij"))
            a, b = self.size[p], other.size[q]
            keep = (self.root[p] != other.root[q]) & (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b))
            p, q = p[keep], q[keep]
            alive, _ = surviving(self.sig, other.sig, p, q)
            p, q = p[alive], q[alive]
            if self.band and len(p):
                fresh = ~(bands(self)[p, : self.band] == bands(other)[q, : self.band]).all(2).any(1)
                p, q = p[fresh], q[fresh]
            if len(p):
                yield p, q


def across(rows: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v of verified links between groups, one for each member, cell and group at least."""
    parts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("most")).where("roots > 1")
    mixed = mixed.select("key", "n", F.col("most.root").alias("major"))
    # In large buckets members meet only those whose sizes fit: linked sizes differ by 4 / 3 at most, less than a class
    wide = F.col("n") > PIECE
    mine = meeting(rows, mixed, ["key"]).withColumn("cls", F.when(wide, F.floor(F.log("size") / math.log(1.34))).otherwise(0).cast("int"))
    mine = written(mine.select("rep", "root", "band", "key", "size", "n", "cls", "major"), "mixed")
    minor = mine.where("root <> major").drop("major")
    every = mine.withColumn("cls", F.explode(F.when(wide, F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)).otherwise(F.array("cls")))).drop("major")
    count = lambda df, name, most: df.groupBy("key", "cls").agg(F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("size") * 8 / CELL_BYTES)).cast("int").alias(name), F.max("n").alias("n"))
    cuts = written(count(minor, "chunks", CHUNK).join(count(every, "pieces", PIECE).drop("n"), ["key", "cls"]), "cuts")
    # cell (key, cls, i, j) compares chunk i of the members outside the largest group with piece j of all members
    chunk, piece = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"), F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("pieces")).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = meeting(minor, cuts, ["key", "cls"]).withColumns({"i": chunk, "side": F.lit(0)}).withColumn("j", to("pieces"))
    right = meeting(every, cuts, ["key", "cls"]).withColumns({"j": piece, "side": F.lit(1)}).withColumn("i", to("chunks"))
    names = ["rep", "root", "band", "size", *CELL, "side"]
    cells = written(left.select(names).unionByName(right.select(names)), "cells")

    def ordered(rows: DataFrame, tasks: int) -> DataFrame:
        return rows.join(reps.select("rep", "sig"), "rep").repartition(tasks, *CELL).sortWithinPartitions(*CELL, "side")

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, side, used = [], None, np.zeros(0, bool)
        for kind, rows in pieces_of(batches, "sig"):
            if kind == "left":
                left.append(rows)
                side = None
            elif kind == "right" and left:
                if side is None:
                    side = Side(left)
                    used = np.zeros(len(side.rep), bool)
                mine = np.zeros(rows.num_rows, bool)
                for p, q in side.pairs(Side([rows])):
                    used[p] = mine[q] = True
                if mine.any():
                    yield rows.select(names).filter(pa.array(mine))
            elif kind == "end":
                if side is not None and used.any():
                    at = 0
                    for rows_ in left:
                        yield rows_.select(names).filter(pa.array(used[at : at + rows_.num_rows]))
                        at += rows_.num_rows
                left, side = [], None

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, side = [], None
        for kind, rows in pieces_of(batches, "set"):
            if kind == "left":
                left.append(rows)
                side = None
            elif kind == "right" and left:
                side = side or Side(left)
                other, u, v = Side([rows]), [], []
                have: set[tuple[int, int]] = set()
                for p, q in side.pairs(other):
                    for x, y in zip(p.tolist(), q.tolist(), strict=True):
                        if (x, other.root[y]) not in have and similar(side.full[x], other.full[y]):
                            have.add((x, other.root[y]))
                            u.append(side.rep[x])
                            v.append(other.rep[y])
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
            elif kind == "end":
                left, side = [], None

    schema = "rep long, root long, band int, size long, key long, cls int, i int, j int, side int"
    some = written(ordered(cells, tasks_for(cells, F.lit(600))).mapInArrow(lean(survive), schema), "survivors")
    full = some.join(sets.withColumnRenamed("id", "rep"), "rep")
    return ordered(full, tasks_for(some, 600 + 8 * F.col("size"))).mapInArrow(lean(link), "u long, v long")


def merged(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, root after the links (u, v) between nodes join groups."""
    if groups is None:
        return written(components(links), "groups")
    links = written(links, "links")
    of = lambda side: groups.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    raised = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    new = components(raised).select(F.col("node").alias("root"), F.col("root").alias("new"))
    moved = groups.join(new, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    fresh = new.join(groups.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("new").alias("root"))
    out = written(moved.unionByName(fresh), "groups")
    discard(groups)
    discard(links)
    return out


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed rows; classes of equal sets: rep, digest, sig, size, n, row; groups of linked classes: node, root).

    ``row`` is the least (no id, doc_id, a, b) of the class.
    """
    signs = written(signed(docs), "signs")
    found = signs.where("digest is not null").groupBy("digest")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "a", "b")
    each = found.agg(F.max("sig").alias("sig"), F.max("n_shingles").alias("size"), F.count(F.lit(1)).alias("n"), F.min(row).alias("row"))
    reps = written(each.withColumn("rep", F.monotonically_increasing_id()), "reps")  # unique, and fixed once written

    bands = reps.select("rep", "size", F.posexplode(F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)])).alias("band", "key"))
    shared = written(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("members", F.col("n")), "shared")
    rows = written(spread(bands, shared, "key", BANDS * reps.count(), F.xxhash64("rep")).withColumnRenamed("members", "n"), "bands")
    buckets = written(rows.join(rows.groupBy("rep").agg(F.sum("n").alias("neighbours")), "rep").select("key", "band", "rep", "size", "n", "neighbours"), "buckets")
    discard(rows)
    sets = shingle_table(docs, reps.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", "row.a", "row.b"))

    groups = None
    for turn in range(ROUNDS):
        best = plausible(stars(placed(buckets, groups), turn), reps).groupBy("u").agg(F.max(F.struct("matches", (-F.col("v")).alias("less"), "size")).alias("best"))
        groups = merged(groups, verified(best.select("u", (-F.col("best.less")).alias("v"), F.col("best.size").alias("size")), sets))
    return signs, reps, merged(groups, across(placed(buckets, groups), reps, sets))


def rooted(reps: DataFrame, groups: DataFrame) -> DataFrame:
    """The classes with the root of their group."""
    return reps.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    signs, reps, groups = classes(docs)
    # an id with several texts links them
    seen = F.xxhash64("digest")
    several = written(signs.where("doc_id is not null").groupBy("doc_id").agg(F.min(seen).alias("lo"), F.max(seen).alias("hi")).where("lo <> hi").select("doc_id"), "several")
    some = not several.isEmpty()
    if some:
        own = signs.where("digest is not null").join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct()
        pairs = written(own.join(rooted(reps, groups).select("digest", "root"), "digest").select("doc_id", "root").distinct(), "several")
        groups = merged(groups, pairs.join(pairs.groupBy("doc_id").agg(F.min("root").alias("v")), "doc_id").select(F.col("root").alias("u"), "v").where("u <> v"))
    of = rooted(reps, groups).select("digest", "n", "root", F.col("row.doc_id").alias("least"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = written(of.join(least, "root").select("digest", "n", "root", "component_id"), "components")

    out = ["doc_id", "n_shingles", "component_id"]
    linked = spread(signs.where("digest is not null").select("doc_id", "n_shingles", "digest", "spot"), facts.drop("root"), "digest", signs.count(), F.col("spot"), "left").select(out)
    empty = signs.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    if some:
        reached = facts.select("root", F.col("component_id").alias("reached")).distinct()
        moved = groups.select(F.col("node").alias("root"), F.col("root").alias("new"))
        byid = pairs.join(moved, "root", "left").select("doc_id", F.coalesce("new", "root").alias("root")).join(reached, "root").select("doc_id", "reached").distinct()
        empty = empty.join(byid, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("reached", "component_id").alias("component_id"))
    return linked.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the least id, of rows that share it the least by hash.

    It goes by texts, so different texts under one id both stay, and rows without an id are judged like others (rows
    with an id come first). Texts without words are nobody's copies and all stay.
    """
    _, reps, groups = classes(docs)
    winners = rooted(reps, groups).groupBy("root").agg(F.min("row").alias("row")).select("row.a", "row.b")
    worded = F.coalesce(F.expr("text rlike '[^\\\\x20\\\\x09-\\\\x0D]'"), F.lit(False))
    a, b = free(docs, "near_a"), free(docs, "near_b")
    keyed = docs.where(worded).withColumns(dict(zip((a, b), keys(docs), strict=True)))
    rows = plain(keyed)
    a, b = rows.columns[-2:]
    mine = winners.select(F.col("a").alias(a), F.col("b").alias(b)).hint("merge")
    rows = rows.mapInArrow(once(a, b, f"c{docs.columns.index('text')}"), rows.schema).join(mine, [a, b], "left_semi").dropDuplicates([a, b])
    return rows.select(*[f"c{k}" for k in range(len(docs.columns))]).toDF(*docs.columns).unionByName(docs.where(~worded))
