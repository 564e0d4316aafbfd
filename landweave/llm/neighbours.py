"""Approximate nearest neighbours by counting collisions on single projections.

The largest inner product with a query is the least distance once each vector, scaled by the largest
norm, gets one more component that makes its length 1. Of these vectors ``PROJECTIONS`` Gaussian
projections are taken, each kept as a sorted array. A query's window on each array is centred at its own
projection and WIDTH * R wide to both sides: it holds a vector at distance R with the probability
P(|N(0, 1)| < WIDTH). Vectors that lie in at least ``THRESHOLD`` of the windows are verified on the original
vectors in double precision; a vector at distance R or less does so with probability 0.9 or more.

1. Every query is searched in the block of vectors that it belongs to. Its windows are widened level by level
   (virtual rehashing: a level's windows hold the last one's), until ``k`` verified vectors lie within R.
2. The k-th best then bounds the radius everywhere, so the other blocks are searched once, with the windows of
   that radius, and only what is no worse is sent on.

So the threshold alone decides what is verified, by one rule at every size.

* Vectors are dealt into blocks of about ``BLOCK`` rows by a hash; a block's arrays are its index, and every row
  is in one. In step 2 a block's rows come first in its task and queries stream past them, so a task holds one
  block and one batch. Each query is sent to each block: the work grows with queries times rows, as it must where
  distances to near and far vectors differ by so little that windows reach everywhere.
* Vectors that are null, zero, of another length than most, or that hold null or non-finite components
  take no part, nor do rows without an id. Rows that repeat an id and a vector count once. A query's
  candidates are all rows of other ids. Ties go to the smaller id. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landweave.llm.common import lean, lean_group, written

PROJECTIONS = 128
WIDTH = 1.5
#: Windows that a vector must lie in: the mean for one at distance R less 1.28 standard deviations.
_P = math.erf(WIDTH / math.sqrt(2))
THRESHOLD = math.ceil(PROJECTIONS * _P - 1.28 * math.sqrt(PROJECTIONS * _P * (1 - _P)))
BLOCK = 16_384
#: Radius of the first level (no two points are more than 2 apart), and the factor between levels at most.
FIRST, WIDER = 0.6, 1.2
K = 20
SEED = 11


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, key (hash of the vector) and the vector of every row that takes part, each once."""
    fine = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = vectors.where(F.col("vec_id").isNotNull() & fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("_size"))
    found = rows.groupBy("_size").count().orderBy(F.col("count").desc(), "_size").first()
    size = found[0] if found else 0
    return rows.where(F.col("_size") == size).drop("_size").withColumn("key", F.xxhash64("embedding")).dropDuplicates(["vec_id", "key"])


class Index:
    """The sorted projections of a block of vectors."""

    def __init__(self, ids: np.ndarray, block: np.ndarray, top_norm: float):
        self.ids, self.block, self.top = ids, block, top_norm
        n, dim = block.shape
        self.directions = np.random.default_rng(SEED).standard_normal((dim + 1, PROJECTIONS))
        scaled = block / top_norm
        tail = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", scaled, scaled)))
        placed = scaled @ self.directions[:dim] + tail[:, None] * self.directions[dim]
        order = np.argsort(placed, axis=0, kind="stable").T
        self.arrays = np.take_along_axis(placed.T, order, axis=1)
        self.order = order.astype(np.intp)

    def centre(self, query: np.ndarray) -> np.ndarray:
        return (query / math.sqrt(float(query @ query))) @ self.directions[:-1]

    def edges(self, centre: np.ndarray, radius: float) -> tuple[list[int], list[int]]:
        half = WIDTH * radius
        left = [int(a.searchsorted(c - half, "left")) for a, c in zip(self.arrays, centre, strict=True)]
        return left, [int(a.searchsorted(c + half, "right")) for a, c in zip(self.arrays, centre, strict=True)]

    def colliding(self, centre: np.ndarray, radius: float) -> np.ndarray:
        """Rows with THRESHOLD collisions at ``radius``, counted by the windows that they miss."""
        missed = np.zeros(len(self.ids), np.uint8)
        for rows, a, b in zip(self.order, *self.edges(centre, radius), strict=True):
            missed[rows[:a]] += 1
            missed[rows[b:]] += 1
        return np.flatnonzero(missed <= PROJECTIONS - THRESHOLD)

    def widened(self, query: np.ndarray, own: int, k: int) -> np.ndarray:
        """Rows to verify once ``k`` of them lie within the level's radius."""
        n, centre = len(self.ids), self.centre(query)
        scale = self.top * math.sqrt(float(query @ query))
        counts, near = np.zeros(n, np.uint8), np.full(n, np.inf)  # near: squared distance of verified rows
        lo = hi = None
        radius = FIRST
        while radius < 2.0:
            left, right = self.edges(centre, radius)
            if lo is None:
                for rows, a, b in zip(self.order, left, right, strict=True):
                    counts[rows[a:b]] += 1
            else:
                for rows, a, b, c, d in zip(self.order, left, lo, hi, right, strict=True):
                    counts[rows[a:b]] += 1
                    counts[rows[c:d]] += 1
            lo, hi = left, right
            found = np.flatnonzero((counts >= THRESHOLD) & (self.ids != own))
            if len(found) >= k:
                new = found[np.isinf(near[found])]
                near[new] = np.maximum(0.0, 2.0 - 2.0 * (self.block[new] @ query) / scale)
                reach = math.sqrt(np.partition(near[found], k - 1)[k - 1])
                if reach <= radius:
                    return found
                radius = min(radius * WIDER, max(reach, radius))  # at ``reach`` k vectors are within it
            else:
                radius *= WIDER
        return np.flatnonzero(self.ids != own)  # fewer than k within reach: all rows


def best_of(index: Index, query: np.ndarray, found: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` of ``found`` by inner product in double precision, ``least`` at least, ties to the smaller id."""
    if len(found) > 4 * k:
        rough = index.block[found] @ query  # summed in another order, so with room for rounding
        room = 1e-12 * float(np.abs(query).sum()) * float(np.abs(index.block[found]).max()) + 1e-300
        if math.isfinite(room) and np.isfinite(rough).all():
            found = found[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - room]
    rows = index.block[found]
    score = np.zeros(len(found))
    for d in range(rows.shape[1]):  # summed from the first component on, whatever the number of rows
        score += rows[:, d] * query[d]
    found, score = found[score >= least], score[score >= least]
    best = np.lexsort((index.ids[found], -score))[:k]
    return found[best], score[best]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


FOUND = "query_id long, query_key long, vec_id long, score double, verified long"
_NAMES = [f.split()[0] for f in FOUND.split(", ")]


def answers(rows: list[tuple[int, int, np.ndarray, np.ndarray, int]]) -> pa.Table:
    """Rows of FOUND of (query's id, its key, ids, scores, number of verified vectors)."""
    sizes = [len(r[2]) for r in rows]
    join = lambda k, kind: np.concatenate([np.zeros(0, kind), *(r[k] for r in rows)])
    each = lambda k: np.repeat(np.array([r[k] for r in rows], np.int64), sizes)
    return pa.table(dict(zip(_NAMES, (each(0), each(1), join(2, np.int64), join(3, np.float64), each(4)), strict=True)))


def found(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, query_key, vec_id, score, verified: the best of each block, with the number of vectors verified there."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors")
    query = F.col("vec_id") % every == 0
    facts = rows.agg(F.count(F.lit(1)), F.max(F.expr("aggregate(embedding, 0d, (s, x) -> s + x * x)"))).first()
    total, top = facts[0] or 0, math.sqrt(facts[1] or 1.0)
    blocks = max(1, -(-total // BLOCK))
    # with few blocks several tasks have the rows of one, each for a part of the queries
    chunks = max(1, -(-2 * spark.sparkContext.defaultParallelism // blocks))
    block = F.pmod(F.xxhash64("vec_id", "key"), F.lit(blocks)).cast("int")
    chunk = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(chunks)).cast("int")
    spread = rows.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), chunk.alias("own"), "vec_id", "key", "embedding")

    def home(t: pa.Table) -> pa.Table:
        index = Index(t.column("vec_id").to_numpy(), matrix(t.column("embedding")), top)
        keys, mine, c = t.column("key").to_numpy(), t.column("own").to_numpy(), t.column("chunk")[0].as_py()
        out = []
        for q in np.flatnonzero((index.ids % every == 0) & (mine == c)).tolist():
            rows_ = index.widened(index.block[q], int(index.ids[q]), k)
            got, score = best_of(index, index.block[q], rows_, k, -math.inf)
            out.append((int(index.ids[q]), int(keys[q]), index.ids[got], score, len(rows_)))
        return answers(out)

    first = spread.groupBy("block", "chunk").applyInArrow(lean_group(home), FOUND)
    if blocks == 1:
        return first
    first = written(first, "first")
    bound = first.groupBy("query_id", "query_key").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    asked = rows.where(query).join(bound.withColumnsRenamed({"query_id": "vec_id", "query_key": "key"}), ["vec_id", "key"], "left")
    others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b != block)
    sent = asked.select(F.explode(others).alias("block"), chunk.alias("chunk"), F.lit(1).alias("kind"), "vec_id", "key", "embedding", "least")
    data = spread.select("block", "chunk", F.lit(0).alias("kind"), "vec_id", "key", "embedding", F.lit(None).cast("double").alias("least"))
    spot: Column = F.col("block") * chunks + F.col("chunk")
    dealt = data.unionByName(sent).withColumn("spot", spot.cast("int")).repartitionById(blocks * chunks, "spot").sortWithinPartitions("spot", "kind")

    def others_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        index, open_ = None, None
        for b in batches:
            cuts = b.column("spot").to_numpy() * 2 + b.column("kind").to_numpy()
            ends = [0, *(np.flatnonzero(cuts[1:] != cuts[:-1]) + 1).tolist(), b.num_rows]
            for at, to in zip(ends, ends[1:], strict=False):
                if at == to:
                    continue
                part = b.slice(at, to - at)
                if part.column("spot")[0].as_py() != open_:
                    open_, held, index = part.column("spot")[0].as_py(), [], None
                if not part.column("kind")[0].as_py():
                    held.append(part)
                    continue
                if index is None:
                    if not held:
                        continue
                    t = pa.Table.from_batches(held)
                    index, held = Index(t.column("vec_id").to_numpy(), matrix(t.column("embedding")), top), []
                queries, out = matrix(part.column("embedding")), []
                for q, own, key, least in zip(queries, *(part.column(c).to_pylist() for c in ("vec_id", "key", "least")), strict=True):
                    if least is None:
                        rows_ = np.arange(len(index.ids))
                    else:
                        reach = math.sqrt(max(0.0, 2.0 - 2.0 * least / (top * math.sqrt(float(q @ q)))))
                        rows_ = index.colliding(index.centre(q), reach)
                    rows_ = rows_[index.ids[rows_] != own]
                    got, score = best_of(index, q, rows_, k, -math.inf if least is None else least)
                    out.append((own, key, index.ids[got], score, len(rows_)))
                yield from answers(out).to_batches()

    return first.unionByName(dealt.mapInArrow(lean(others_of), FOUND))


def nearest(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each row whose id is divisible by ``every``."""
    best = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return found(vectors, every, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
