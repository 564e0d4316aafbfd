"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash and ranked there; the fractional rank
(2 * rank + 1) / (2 * rows of the source) puts the sources on one scale. Sorting by it interleaves
them in proportion, and cutting the order into pieces of equal length gives shards that each hold
every source within one row or so of its share. The law is ``rows``: shard sizes differ by one at most.

Only DataFrame functions are used. A hot source is ranked in buckets of the hash, so it is spread
over many tasks, and the global order is numbered in buckets of the fractional rank.

* A null source is a source of its own; null ids and texts are allowed (a null text has no bytes).
* Ties of the hash (repeated rows) are ordered by id, size and checksum; rows that also tie there are
  interchangeable. An empty table gives an empty result. Other columns are dropped by ``sharded``.
* Very long texts are hashed where they are read; only their size and checksum are shuffled. Under the law ``rows``
  equal texts are rows like others and may fall into different shards: keeping such a group together would break the
  law as soon as it is larger than a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.llm.common import joined
from landweave.llm.ranks import bucket_count, hash_bucket, ranked

SEED = "shard-1"
SHARDS = 24


def sharded(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(joined(seed, F.col("doc_id"))).alias("hash"),
    )
    total = docs.count()
    buckets = bucket_count(total)
    # 1. rank within the source, in buckets of the hash (its first 32 bits)
    spread = rows.withColumn("bucket", hash_bucket("hash", buckets))
    tie = [F.col("hash"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    within = ranked(spread, ["source"], "bucket", tie, "rank").drop("bucket")
    sizes = rows.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("of"))
    scaled = within.join(sizes, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    # 2. one order over all sources, by fractional rank (2 * rank + 1) / (2 * of), numbered in buckets of it
    scaled = scaled.withColumn("bucket", F.expr(f"(2 * rank + 1) * {buckets} div (2 * of)")).withColumn(
        "fraction", (2 * F.col("rank") + 1).cast("decimal(19,0)") / (2 * F.col("of")).cast("decimal(19,0)")
    )
    order = [F.col("fraction"), F.col("hash"), F.col("source"), *tie[1:]]
    placed = ranked(scaled, [], "bucket", order, "place")
    # shard k begins at the first place of which place * shards >= k * total
    shard = f"(place * {shards} div {max(total, 1)})"
    first = f"(({shard} * {total} + {shards - 1}) div {shards})"
    return placed.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), F.expr(shard).cast("int").alias("shard"),
        F.expr(f"place - {first}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

