"""Metric summaries of scored chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("multi_pitch", "voice", "meter", "value", "harmony")
#: The metrics of the custom mean; meter is left out.
CUSTOM = ("multi_pitch", "voice", "value", "harmony")
# Inclusive chunk positions of each bin.
BINS = ((1, 25), (26, 50), (51, 75), (76, 100), (101, 150), (151, 200), (201, 300))


def succeeded() -> Column:
    return F.col("status") == "success"


def custom_mean() -> Column:
    return sum((F.col(m) for m in CUSTOM), F.lit(0.0)) / len(CUSTOM)


def official_mean() -> Column:
    return sum((F.col(m) for m in METRICS), F.lit(0.0)) / len(METRICS)


def status_of(metrics: Column, error: Column) -> Column:
    """The status of a scored task from a struct of its metrics: null when scoring failed, an error with a message."""
    total = sum((metrics[m] for m in METRICS), F.lit(0.0)) / len(METRICS)
    return F.when(error.isNotNull(), "error").when(metrics.isNull(), "mv2h_failed").when((total == 0) & (metrics["multi_pitch"] == 0), "zero_score").otherwise("success")


def overall(results: DataFrame, *keys: str) -> DataFrame:
    """Per system (and further keys): the mean of each metric over successes, and strictly with failures as zero."""
    ok = succeeded()
    total = F.count("*")
    return results.groupBy("system", *keys).agg(
        total.alias("n_total"),
        F.count_if(ok).alias("n_success"),
        F.round(F.count_if(ok) / total, 9).alias("success_rate"),
        *(F.round(F.avg(F.when(ok, F.col(m))), 9).alias(f"{m}_mean") for m in METRICS),
        *(F.round(F.coalesce(F.sum(F.when(ok, F.col(m))), F.lit(0.0)) / total, 9).alias(f"{m}_strict") for m in METRICS),
    )


def against_defined(results: DataFrame, defined: DataFrame) -> DataFrame:
    """Means over successes and over all defined chunks, scored or not; the success rate is over scored ones."""
    ok = succeeded()
    scored = results.groupBy("system").agg(F.count("*").alias("n_scored"), F.count_if(ok).alias("n_success"), *(F.coalesce(F.sum(F.when(ok, F.col(m))), F.lit(0.0)).alias(m) for m in METRICS))
    total = defined.agg(F.count("*").alias("n_defined"))
    return scored.crossJoin(F.broadcast(total)).select(
        "system", "n_scored", "n_success", "n_defined",
        F.round(F.try_divide("n_success", "n_scored"), 9).alias("success_rate"),
        *(F.round(F.coalesce(F.try_divide(m, "n_success"), F.lit(0.0)), 9).alias(f"{m}_mean") for m in METRICS),
        *(F.round(F.coalesce(F.try_divide(m, "n_defined"), F.lit(0.0)), 9).alias(f"{m}_strict") for m in METRICS),
    )


def plain_means(results: DataFrame, *keys: str) -> DataFrame:
    """Number of rows, mean of each metric (0 without rows), and the custom and official means of the rows."""
    named = {"custom": custom_mean(), "official": official_mean(), **{m: F.col(m) for m in METRICS}}
    return results.groupBy(*keys).agg(F.count("*").alias("n"), *(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9).alias(f"mean_{k}") for k, c in named.items()))


def status_shares(results: DataFrame) -> DataFrame:
    """Rows of each status and its per cent of the system's rows."""
    counts = results.groupBy("system", "status").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("system")), 9))


def position_bins(results: DataFrame, bins=BINS) -> DataFrame:
    """Success and metric means by bin of the chunk index. Rows outside every bin are left out."""
    name = F.lit(None).cast("string")
    for a, b in bins:
        name = F.when(F.col("chunk_index").between(a, b), f"{a}-{b}").otherwise(name)
    ok = succeeded()
    return results.withColumn("bin", name).where("bin is not null").groupBy("system", "bin").agg(
        F.count("*").alias("n"),
        F.count_if(ok).alias("n_success"),
        F.round(F.count_if(ok) / F.count("*"), 9).alias("success_rate"),
        *(F.round(F.avg(F.when(ok, F.col(m))), 9).alias(f"{m}_mean") for m in METRICS),
    )


def index_by_status(results: DataFrame) -> DataFrame:
    """Mean and median chunk index of each status."""
    return results.groupBy("system", "status").agg(F.count("*").alias("n"), F.round(F.avg("chunk_index"), 9).alias("mean_index"), F.percentile("chunk_index", 0.5).alias("median_index"))


def fair_subset(results: DataFrame, system: str) -> DataFrame:
    """Every system's rows on the task ids that ``system`` has."""
    return results.join(results.where(F.col("system") == system).select("task_id").distinct(), "task_id", "left_semi")


def remaining(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks without a successful result."""
    return tasks.join(done.where(succeeded()).select("task_id"), "task_id", "left_anti")


def latest(old: DataFrame, new: DataFrame, key: str = "task_id") -> DataFrame:
    """Stored and new results, the new one where a task has both."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("system", key).orderBy("_age"))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_age")


def with_missing(results: DataFrame, tasks: DataFrame, status: str) -> DataFrame:
    """Results and, for tasks of no result, rows of the given status without metrics."""
    skipped = tasks.join(results.select("task_id").distinct(), "task_id", "left_anti").withColumn("status", F.lit(status))
    return results.unionByName(skipped, allowMissingColumns=True)


def grouped_chunks(chunks: DataFrame) -> DataFrame:
    """The chunk indexes of each piece and performance, in order."""
    return chunks.groupBy("piece_id", "performance").agg(F.count("*").alias("n_chunks"), F.array_sort(F.collect_list("chunk_index")).alias("indexes"))


def failures(results: DataFrame) -> DataFrame:
    """One row a system: failed by time and failed otherwise."""
    return results.groupBy("system").agg(F.count_if(F.col("status") == "timeout").alias("n_timeout"), F.count_if(~F.col("status").isin("timeout", "success")).alias("n_error"))
