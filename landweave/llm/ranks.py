"""Gapless global ranks without bringing a group, or all rows, into one task.

Rows fall into many buckets of their order key. Bucket sizes are summed up in two levels (buckets within
runs of ``PER_RUN`` buckets, and runs), and rows are numbered only within their bucket. Nothing depends on
how rows are dealt to tasks, so a task that runs again gives the same ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landweave.llm.common import written

#: Rows aimed at for one bucket, and buckets for one run: 10^11 rows make 50,000 runs.
PER_BUCKET, PER_RUN = 512, 4096


def bucket_count(rows: int) -> int:
    return max(1, -(-rows // PER_BUCKET))


def hash_bucket(key: str, buckets: int) -> Column:
    """The bucket of a hexadecimal key, by its first 32 bits; in the order of the key."""
    return F.expr(f"cast(cast(conv(substring({key}, 1, 8), 16, 10) as bigint) * {buckets} div 4294967296 as bigint)")


def running(sizes: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """``sizes`` (group, bucket, _n) with _start: the sum of _n over the earlier buckets of the group."""
    run = F.expr(f"{bucket} div {PER_RUN}")
    runs = sizes.groupBy(*group, run.alias("_run")).agg(F.sum("_n").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*[F.col(c).alias(f"_g{c}") for c in group], F.col("_run").alias("_of"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*group, "_run").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    here = sizes.withColumn("_run", run).withColumn("_within", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    on = F.col("_run") == F.col("_of")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_g{c}"))
    return here.join(runs, on).withColumn("_start", F.col("_base") + F.col("_within")).select(*group, bucket, "_start")


def ranked(df: DataFrame, group: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: rank from 0 by (``bucket``, ``order``) within ``group``.

    ``bucket`` (a number) must not fall where ``order`` rises. Null groups are a group of their own. Names that begin
    with an underscore are used inside.
    """
    sizes = written(df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n")), "sizes")  # read twice below
    starts = running(sizes, group, bucket).select(*[F.col(c).alias(f"_k{c}") for c in (*group, bucket)], "_start")
    own = Window.partitionBy(*group, bucket).orderBy(*order)
    # a plain equality of the buckets, so that without a group the window's partitioning serves the join too
    on = F.col(bucket) == F.col(f"_k{bucket}")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_k{c}"))
    local = df.withColumn("_row", F.row_number().over(own) - 1)
    return (
        local.join(starts, on, "left")
        .withColumn(name, (F.col("_start") + F.col("_row")).cast("long"))
        .drop("_row", "_start", *[f"_k{c}" for c in (*group, bucket)])
    )
