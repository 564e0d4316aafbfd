"""Quality rules by a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are fitted: one on trusted target documents, one
on the whole raw corpus. A document's score is the mean, over its n-grams, of the logarithm of
their ratio, so that it does not depend on the length. A document is kept if no base rule
rejects it and the score reaches a threshold that is the same for all documents.

* Raw counts cover every n-gram of every document. The target documents are the labelled
  good rows; of these at most ``max_target`` are used, those with the smallest MD5 of their id.
* The only data that leaves the executors are the two count vectors, ``buckets`` long, and the
  ids of the target sample; both sizes are parameters.
* A null or empty text has no words, fails the base rule of 20 words and scores 0. Repeated rows
  are scored each; a score depends on the row's bytes and the ratio alone, however long the text. A score equal to
  the threshold is kept. An id whose labels contradict each other is no target.
* With few target n-grams the target is mixed with the raw distribution, so that what it lacks isn't held against a
  document: under some 18,000 n-grams (18 kB of labelled good text) no score reaches the threshold, without any the
  ratio is 0 for all, and only the base rules decide. ``ratio_applies`` is false in every row then, and ``filtered`` warns.
* Columns other than the id and the text are passed through untouched by ``filtered``, whatever their names.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.llm.common import WordHashes, covered, data, hashed, in_one, joined, lean, plain, rolling, slices, sums, utf8

NGRAM = 4
BUCKETS = 1 << 15
MAX_TARGET = 20_000
#: Mean log ratio per n-gram under which a document is rejected. On labelled rows good
#: documents lie above -0.1, bad ones below -0.5.
THRESHOLD = -0.3
#: Share of the raw distribution in the target's, at least, and the n-grams that it counts as besides.
FLOOR, PRIOR = 0.02, 50_000.0
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, score double, kept boolean, ratio_applies boolean"
)


def buckets_of(raw: np.ndarray, at: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams that lie within one row, and their number per row."""
    lengths = np.diff(at)
    grams = np.maximum(lengths - n + 1, 0)
    if len(raw) < n:
        return np.zeros(0, np.int64), grams
    g = np.zeros(len(raw) - n + 1, np.uint32)
    for k in range(n):
        g = g * np.uint32(257) + raw[k : len(raw) - n + 1 + k]
    g ^= g >> np.uint32(15)
    g *= np.uint32(0x2C1B3C6D)
    g ^= g >> np.uint32(12)
    starts = in_one(lengths, n)
    return (g[starts] % np.uint32(size)).astype(np.int64), grams


def fit(docs: DataFrame, labels: DataFrame, *, n: int = NGRAM, size: int = BUCKETS, max_target: int = MAX_TARGET) -> np.ndarray:
    """log(target / raw) for each bucket.

    The raw counts get one added. The target's share is mixed with the raw one, FLOOR of it at least and more
    with few target n-grams, so that what is unseen in the target is bounded and no target means no verdict.
    """
    good = (F.coalesce(F.col("quality") == 1, F.lit(False)) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good")
    sure = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), good).groupBy("id").agg(F.every("good").alias("good")).where("good")
    ids = sure.select("id", F.md5(joined("target", F.col("id"))).alias("hash")).orderBy("hash").limit(max_target)
    chosen = pa.array([r[0] for r in ids.select("id").collect()], pa.int64())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, size), np.int64)
        for b in slices(batches, "text"):
            raw, at = data(b.column("text"))
            found, grams = buckets_of(raw, at, n, size)
            both[0] += np.bincount(found, minlength=size)
            mine = pc.is_in(b.column("doc_id"), chosen).to_numpy(zero_copy_only=False)  # no id is in it that is null
            if mine.any():
                both[1] += np.bincount(found[np.repeat(mine, grams)], minlength=size)
        some = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(both[0][some]), pa.array(both[1][some])], ["bucket", "raw", "target"])

    counted = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
        .mapInArrow(lean(count), "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw"), F.sum("target"))
    )
    raw, target = np.ones(size), np.zeros(size)
    for bucket, r, t in counted.collect():  # one row for each of `size` buckets at most
        raw[bucket] += r
        target[bucket] += t
    return log_ratio(raw, target)


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    total = target.sum()
    share = FLOOR + (1 - FLOOR) * PRIOR / (PRIOR + total)
    p = raw / raw.sum()
    return np.log(share * p + (1 - share) * target / max(total, 1.0)) - np.log(p)


def applies(ratio: np.ndarray, threshold: float) -> bool:
    """Whether some document could be rejected by its score."""
    return bool(ratio.min() < threshold)


def means(b: pa.RecordBatch, ratio: np.ndarray, n: int) -> np.ndarray:
    """The mean log ratio of each row's n-grams, summed for each row alone, so that its neighbours don't matter."""
    raw, at = data(b.column("text"))
    found, grams = buckets_of(raw, at, n, len(ratio))
    out = np.zeros(len(grams))
    some = np.flatnonzero(grams)
    if len(some):
        out[some] = np.add.reduceat(ratio[found], (np.cumsum(grams) - grams)[some]) / grams[some]
    return out


def verdict(got: dict[str, np.ndarray], mean: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    failed = (got["n_words"] < 20) | (100 * got["n_repeat_words"] > 30 * got["n_words"])
    return failed, ~failed & (mean >= threshold)


def measured(b: pa.RecordBatch, memo: WordHashes) -> dict[str, np.ndarray]:
    """The base statistics of each row."""
    raw, at = data(b.column("text"))
    lengths = np.diff(at)
    kind = np.ones(256, np.uint8)  # 1: starts a code point of a word; 2: symbol; 0: neither
    kind[0x80:0xC0] = 0
    kind[list(b" \t\n\x0b\x0c\r")] = 0
    kind[list(SYMBOLS)] = 2
    kinds = kind[raw]
    texts = b.column("text").to_pylist()
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    words = np.concatenate([hashed(w, memo) for w in split]) if split else np.zeros(0, np.uint64)
    repeated = np.zeros(len(words), bool)
    starts = in_one(counts, 8)
    if len(starts):
        owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)[starts]
        key = rolling(words, 8)[starts] ^ (owner * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        if twice.any():
            # windows never cross documents, so neither does what they cover
            repeated = covered(starts[twice], 8, len(words))
    dup = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        if b"\n" in t:
            lines = t.split(b"\n")
            if len(set(lines)) < len(lines):
                seen: set[bytes] = set()
                for line in lines:
                    if line in seen:
                        dup[k] += bool(line.strip())
                    else:
                        seen.add(line)
    return {
        "n_words": counts, "word_chars": sums(kinds > 0, lengths), "n_symbols": sums(kinds == 2, lengths),
        "n_dup_lines": dup, "n_repeat_words": sums(repeated, counts),
    }


def scored(docs: DataFrame, ratio: np.ndarray, *, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: base statistics, score and verdict."""
    shared, sure = docs.sparkSession.sparkContext.broadcast(ratio), applies(ratio, threshold)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, ratio = WordHashes(), shared.value
        for b in slices(batches, "text"):
            got = measured(b, memo)
            mean = means(b, ratio, n)
            failed, kept = verdict(got, mean, threshold)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(got[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                 pa.array(failed), pa.array(mean), pa.array(kept), pa.array([sure] * b.num_rows)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept", "ratio_applies"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(lean(score), SCHEMA)


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit the ratio on ``docs`` and ``labels``, then score every document."""
    threshold = options.pop("threshold", THRESHOLD)
    return scored(docs, fit(docs, labels, **options), n=options.get("n", NGRAM), threshold=threshold)


def filtered(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with all their columns, without a join."""
    threshold = options.pop("threshold", THRESHOLD)
    ratio = fit(docs, labels, **options)
    if not applies(ratio, threshold):
        logging.getLogger(__name__).warning("too few labelled good texts: only the base rules decide")
    n = options.get("n", NGRAM)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    rows = plain(docs)
    names, body = rows.columns, F.col(rows.columns[docs.columns.index("text")])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, ratio = WordHashes(), shared.value
        for b in slices(batches, "body"):
            text = pa.RecordBatch.from_arrays([b.column("body")], ["text"])
            _, kept = verdict(measured(text, memo), means(text, ratio, n), threshold)
            yield b.select(names).filter(pa.array(kept))

    return rows.withColumn("body", utf8(body)).mapInArrow(lean(keep), rows.schema).toDF(*docs.columns)
