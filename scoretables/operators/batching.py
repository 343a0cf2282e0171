"""Batches of training rows: length buckets, padding, plans for several ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoretables.sources.files import put_aside

BOUNDS = (1500, 2000, 2500, 3000)
#: Rows of a bucket that one task numbers; fuller ones are dealt out.
ONE_TASK = 100_000


def bucketed(rows: DataFrame, length: str, bounds=BOUNDS) -> DataFrame:
    """``bucket``: the number of bounds that the length reaches."""
    return rows.withColumn("bucket", sum(((F.col(length) >= b).cast("int") for b in bounds), F.lit(0)))


def numbered(rows: DataFrame, order: Column, key: str) -> DataFrame:
    """``_at`` (from 0) of each row in its bucket, by ``order`` and then ``key``, and ``_n``, the rows of the bucket.

    Rows are dealt out by ranges of (bucket, order, key), so that each task holds a run of neighbours, and written;
    rows are numbered within bucket and range and moved on by the sizes of the ranges before. A bucket that holds most
    rows is many ranges, and the ranges are as few as the tasks. Where no bucket has more than ONE_TASK rows, each is
    numbered by one task, with the same result.
    """
    most = rows.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
    if most <= ONE_TASK:
        own = Window.partitionBy("bucket")
        return rows.withColumn("_order", order).withColumns({"_at": F.row_number().over(own.orderBy("_order", key)) - 1, "_n": F.count("*").over(own)}).drop("_order")
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_order", order).repartitionByRange(ranges, "bucket", "_order", key).withColumn("_range", F.spark_partition_id())
    dealt = put_aside(dealt, "ranges")
    sizes = dealt.groupBy("bucket", "_range").agg(F.count("*").alias("_size"))
    of_bucket = Window.partitionBy("bucket")
    start = F.coalesce(F.sum("_size").over(of_bucket.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("bucket", "_range", start.alias("_start"), F.sum("_size").over(of_bucket).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("bucket", "_range").orderBy("_order", key)) - 1
    return dealt.join(sizes, ["bucket", "_range"]).withColumn("_at", F.col("_start") + inside).drop("_order", "_range", "_start")


def batched(rows: DataFrame, key: str, size: int, order: str | None = None, drop_last: bool = False) -> DataFrame:
    """``batch`` within each bucket, in the order of ``order`` (or a hash of the key, which shuffles)."""
    out = numbered(rows, F.col(order) if order else F.xxhash64(key), key).withColumn("batch", F.floor(F.col("_at") / size))
    out = out.where((F.col("batch") + 1) * size <= F.col("_n")) if drop_last else out
    return out.drop("_at", "_n")


def ranked(rows: DataFrame, key: str, size: int, ranks: int) -> DataFrame:
    """A plan for ``ranks`` readers: each bucket is filled up to whole global batches by repeating its own rows from
    the head, as often as needed; each global batch is dealt out in runs of ``size``."""
    whole = size * ranks
    rows = numbered(rows, F.col(key), key)
    filled = F.ceil(F.col("_n") / whole) * whole
    rows = rows.withColumn("at", F.explode(F.sequence(F.col("_at").cast("long"), (filled - 1).cast("long"), F.col("_n").cast("long"))))
    return rows.withColumns({"batch": F.floor(F.col("at") / whole), "rank": F.floor(F.col("at") % whole / size)}).drop("_at", "_n")


def padded(rows: DataFrame, *batch: str, multiple: int = 32) -> DataFrame:
    """Lengths after padding to the batch's longest, widths to a multiple, and the share of each row that is not padding."""
    frames = (F.ceil(F.max("n_frames") / multiple) * multiple).cast("long")
    longest = rows.groupBy(*batch).agg(F.max("n_tokens").alias("padded_tokens"), frames.alias("padded_frames"))
    return rows.join(longest, list(batch)).withColumn("valid_ratio", F.col("n_frames") / F.col("padded_frames"))


def shifted(rows: DataFrame, ids: str, most: int) -> DataFrame:
    """Ids cut to ``most``; inputs are all but the last, labels all but the first."""
    cut = F.slice(F.col(ids), 1, most)
    return rows.withColumns({"inputs": F.slice(cut, F.lit(1), F.greatest(F.lit(0), F.size(cut) - 1)), "labels": F.slice(cut, F.lit(2), F.greatest(F.lit(0), F.size(cut) - 1))})


def standardised(rows: DataFrame, key: str, value: str) -> DataFrame:
    w = Window.partitionBy(key)
    return rows.withColumn("z", (F.col(value) - F.avg(value).over(w)) / (F.stddev_samp(value).over(w) + 1e-9))
