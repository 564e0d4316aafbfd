"""Mixing sources to target weights by Poisson replication.

A source with ``n`` rows, weight ``w`` and a wanted total of ``T`` rows has the mean repetition rate
``T * w / n``. Each document draws its number of copies from the Poisson distribution of that rate:
a hash of seed and id gives a uniform number, and the distribution function is inverted at it. So the
number depends on nothing but the seed, the id and the rate. Documents are exploded by their count,
and the copies are put into one global order by a second hash.

A rate above ``PART`` is drawn as a sum: the document is first exploded into parts of equal rates of at
most PART, each of which draws by a hash of its own (sums of Poisson numbers are Poisson). So the table of
a source's distribution function stays short, and a huge rate makes many rows but no long array.

Only DataFrame functions are used. The table of rates has one row for each source.

* ``weights`` maps sources to weights (a null source by None); sources that aren't named get weight 0.
  Without weights each source present weighs the same. Weights are scaled to sum 1.
* Rows that repeat (same id) draw the same number of copies each. A null id is an id of its own. Ties of the
  order's hash are broken by id, source and text; rows that also tie there are interchangeable.
* Null, empty and very long texts are rows like others; texts move in one shuffle and are never compared but for ties.
* An empty table gives an empty result. All columns are kept, whatever their names: they travel in a struct. The
  columns that are added (mix_part, mix_copy, mix_place) get underscores at their end until they clash with none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landweave.llm.common import free, joined, partitions, unit_hash, written
from landweave.llm.ranks import bucket_count, hash_bucket, ranked

SEED = "mix-1"
#: The largest rate that is drawn at once.
PART = 256
#: Sources up to which the table of rates is broadcast, of 4 KB each at most; with more it is joined by a shuffle.
SOURCES = 10_000


def rates(docs: DataFrame, weights: dict[str | None, float] | None, total: int | None) -> DataFrame:
    """mix_source, mix_rate: the mean number of copies of a document of each source."""
    sizes = docs.groupBy(F.col("source").cast("string").alias("mix_source")).agg(F.count(F.lit(1)).alias("mix_n"))
    if weights is None:
        weight: Column = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for source, w in weights.items():
            if w < 0:
                raise ValueError("weights can't be negative")
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(weight)
    everything = Window.partitionBy(F.lit(0))  # over one row for each source
    wanted = F.sum("mix_n").over(everything) if total is None else F.lit(total)
    share = F.col("mix_w") / F.sum("mix_w").over(everything)
    return sizes.withColumn("mix_w", weight).select("mix_source", F.when(F.col("mix_w") > 0, wanted * share / F.col("mix_n")).otherwise(0.0).alias("mix_rate"))


def thresholds(rate: str) -> Column:
    """The Poisson distribution function at 0, 1, 2, ... up to where 1 - F is far below 2**-52; for rates up to PART."""
    return F.expr(f"""
        case when {rate} <= 0 then array(1.0d) else
            aggregate(
                sequence(1, cast(ceil({rate} + 12 * sqrt({rate}) + 40) as int)),
                named_struct('p', -{rate}, 'f', exp(-{rate}), 'all', array(exp(-{rate}))),
                (s, k) -> named_struct(
                    'p', s.p + ln({rate}) - ln(cast(k as double)),
                    'f', s.f + exp(s.p + ln({rate}) - ln(cast(k as double))),
                    'all', array_append(s.all, s.f + exp(s.p + ln({rate}) - ln(cast(k as double)))))
            ).all end""")


def replicated(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: str = SEED) -> DataFrame:
    """Copies, not yet shuffled: row (a struct of all columns), doc_id and source as strings, part, copy (from 1), key."""
    table = rates(docs, weights, total)
    table = table.select("mix_source", F.greatest(F.ceil(F.col("mix_rate") / PART), F.lit(1)).cast("long").alias("parts"), "mix_rate")
    table = table.select("mix_source", "parts", (F.col("mix_rate") / F.col("parts")).alias("rate")).withColumn("cdf", thresholds("rate"))
    table = written(table, "rates")
    if table.limit(SOURCES + 1).count() <= SOURCES:
        table = F.broadcast(table)
    packed = docs.select(F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    drawn = (
        packed.join(table, packed["source"].eqNullSafe(table["mix_source"]), "inner")
        .select("id", packed["source"], "row", "cdf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        .withColumn("u", unit_hash(seed, F.col("id"), F.col("part")))
        .withColumn("copies", F.expr("size(filter(cdf, c -> c <= u))"))
        .where("copies > 0")
    )
    return drawn.select("id", "source", "row", "part", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).withColumn("key", F.md5(joined(seed + "-order", F.col("id"), F.col("part"), F.col("copy"))))


def _named(rows: DataFrame, docs: DataFrame, extra: list[str]) -> DataFrame:
    return rows.select("row.*", *[F.col(c).alias(free(docs, f"mix_{c}")) for c in extra])


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The replicated documents with all their columns, mix_part, mix_copy and mix_place, the row's place in the global order."""
    rows = replicated(docs, **options)
    # the number of copies is near the wanted total; it only sizes the buckets
    wanted = options.get("total") or docs.count()
    spread = rows.withColumn("bucket", hash_bucket("key", bucket_count(wanted)))
    order = [F.col("key"), F.col("id"), F.col("source"), *([F.col("row.text")] if "text" in docs.columns else [])]
    return _named(ranked(spread, [], "bucket", order, "place"), docs, ["part", "copy", "place"])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The replicated documents with all their columns, written in the global order.

    The order is that of the second hash; the output's partitions are equal ranges of it, in order.
    """
    rows = replicated(docs, **options)
    n = partitions(docs.sparkSession)
    # hashes are uniform, so equal ranges of them are equal shares: no sampling pass is needed
    ranges = rows.withColumn("slot", hash_bucket("key", n).cast("int")).repartitionById(n, "slot")
    return _named(ranges.sortWithinPartitions("key", "id", "source"), docs, [])
