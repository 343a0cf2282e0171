"""Curves over positions: measures covered by chunks, equal-width bins, bootstrap bands."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def covering(results: DataFrame, n: int = 5) -> DataFrame:
    """A row for each measure that a chunk of ``n`` measures covers, so that no band join is needed."""
    return results.withColumn("measure", F.explode(F.sequence(F.col("chunk_index"), F.col("chunk_index") + n - 1)))


def measure_success(results: DataFrame, n: int = 5) -> DataFrame:
    """Mean success of the chunks that cover each measure of each song."""
    success = (F.col("status") == "success").cast("double")
    return covering(results, n).groupBy("system", "piece_id", "performance", "measure").agg(F.count("*").alias("n_chunks"), F.round(F.avg(success), 9).alias("success_rate"))


def equal_bins(rows: DataFrame, column: str, bins: int, *keys: str) -> DataFrame:
    """``bin`` (from 0) of equal width over the observed range, closed on the right, the lowest value in the first."""
    # One row a group, joined back: no task holds all rows of a key.
    ends = rows.groupBy(*keys).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    at = F.ceil((F.col(column) - F.col("_low")) * bins / F.nullif(F.col("_high") - F.col("_low"), F.lit(0))) - 1
    bin_ = F.coalesce(F.least(F.lit(bins - 1), F.greatest(F.lit(0), at)), F.lit(0)).cast("int")
    return rows.join(ends, list(keys)).withColumn("bin", bin_).drop("_low", "_high")


def _columns(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def bootstrap(rows: DataFrame, value: str, *keys: str, resamples: int = 1000, least: int = 5, seed: int = 0) -> DataFrame:
    """Mean of ``value`` and its 95 % band by Poisson bootstrap, for groups of at least ``least`` rows.

    Every row counts in every resample as often as a Poisson(1) number says. Rows of a group with one value count
    together, and the sum of n such numbers is a Poisson(n) number: so one number is drawn for each value and resample,
    of the same law, from a generator seeded by (seed, keys, value). The draws are the same in any partitioning.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n")).withColumn("stream", F.xxhash64(F.lit(seed), *keys, value))

    def draws(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                n, stream = (part.column(c).to_numpy() for c in ("n", "stream"))
                drawn = [np.random.Generator(np.random.Philox(int(s) % (1 << 64))).poisson(m, resamples) for m, s in zip(n, stream, strict=True)]
                weights = pa.ListArray.from_arrays(np.arange(len(drawn) + 1, dtype=np.int32) * resamples, pa.array(np.concatenate(drawn)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*keys, value)), weights], names=[*keys, value, "weights"])

    drawn = counts.mapInArrow(draws, f"{_columns(rows, *keys, value)}, weights array<bigint>").select(*keys, value, F.posexplode("weights").alias("resample", "weight"))
    means = drawn.groupBy(*keys, "resample").agg(F.try_divide(F.sum(F.col(value) * F.col("weight")), F.sum("weight")).alias("mean"))
    band = means.groupBy(*keys).agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= least).join(band, list(keys))


#: A prime below 2^31, and odd multipliers, of the draws.
_PRIME, _ROUNDS = 2_147_483_647, 3
#: Draws of a row that is dealt out, of one numpy pass, and tasks that the rows are dealt to.
_BLOCK, _SLICE, _TASKS = 1 << 22, 1 << 15, 192


def draw(resample: Column, j: Column, seed: int = 0) -> Column:
    """A whole number below 2^31 - 1 for draw ``j`` of a resample: squares modulo a prime, in exact arithmetic."""
    u = (resample * 48_271 + j * 69_621 + 12_345 + seed) % _PRIME
    for k in range(_ROUNDS):
        u = (u * u + 40_692 * (j + k) + resample) % _PRIME
    return u


def _modulo_prime(u: np.ndarray, high: np.ndarray) -> None:
    """Numbers below 2^63 modulo 2^31 - 1, as 2^31 is 1 there; in place, but for the last multiple."""
    for _ in range(2):
        np.right_shift(u, 31, out=high)
        np.bitwise_and(u, _PRIME, out=u)
        u += high


def _drawn_counts(resample: int, first: int, last: int, n: int, upto: np.ndarray, seed: int) -> np.ndarray:
    """How many of the draws ``first`` to ``last`` fall on each value; the same numbers as ``draw``."""
    counts = np.zeros(len(upto), dtype=np.int64)
    places = np.arange(min(_SLICE, last + 1 - first), dtype=np.int64)
    buffers = [np.empty_like(places) for _ in range(3)]
    # Draws are below 2^31, so that a larger n changes none.
    size = np.uint32(min(n, (1 << 32) - 1))
    for start in range(first, last + 1, _SLICE):
        here = min(_SLICE, last + 1 - start)
        j, (u, high, step) = places[:here], (x[:here] for x in buffers)
        np.multiply(j, 69_621, out=u)
        u += resample * 48_271 + start * 69_621 + 12_345 + seed
        _modulo_prime(u, high)
        np.multiply(j, 40_692, out=step)
        step += 40_692 * start + resample
        for _ in range(_ROUNDS):
            np.multiply(u, u, out=u)
            u += step
            _modulo_prime(u, high)
            step += 40_692
        u[u >= _PRIME] -= _PRIME
        place = u.astype(np.uint32)
        place -= place // size * size
        if len(upto) <= 8:
            counts += np.diff([np.count_nonzero(place < x) for x in upto], prepend=0)
        else:
            counts += np.bincount(np.searchsorted(upto, place, side="right"), minlength=len(upto))
    return counts


def resampled(rows: DataFrame, value: str, *keys: str, resamples: int = 1000, least: int = 5, seed: int = 0) -> DataFrame:
    """Mean of ``value`` and its 95 % band by resampling with replacement, for groups of at least ``least`` rows.

    A group of n rows is resampled by n draws of a place from 0 to n - 1 among its rows in the order of their values.
    Where the values are few (a rate, a success), a place is found by the number of rows up to each value, which stands
    in one short array for each group; so no draw is joined to a row. All n draws of all resamples are made, in blocks
    that are dealt out over tasks, and only their counts by value are kept.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    ends = F.sort_array(F.collect_list(F.struct(F.col(value).cast("double").alias("value"), "n")))
    groups = counts.groupBy(*keys).agg(F.sum("n").alias("n"), ends.alias("values")).where(F.col("n") >= least)
    long = lambda n: F.lit(n).cast("long")
    # Few groups: they are dealt out with their resamples and blocks, so that all tasks have some. The number of tasks is given, as the rows are few and their work is not.
    drawn = groups.withColumn("resample", F.explode(F.sequence(long(1), long(resamples)))).withColumn("first", F.explode(F.sequence(long(1), F.col("n"), long(_BLOCK)))).repartition(_TASKS, *keys, "resample", "first")

    def draws(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, known = [], []
            for resample, first, n, ends in zip(*(batch.column(c).to_pylist() for c in ("resample", "first", "n", "values")), strict=True):
                found = _drawn_counts(resample, first, min(n, first + _BLOCK - 1), n, np.cumsum([e["n"] for e in ends]), seed)
                hit = [(c, e["value"]) for c, e in zip(found.tolist(), ends, strict=True) if c and e["value"] is not None]
                totals.append(sum(c * v for c, v in hit))
                known.append(sum(c for c, _ in hit))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "resample")), pa.array(totals, pa.float64()), pa.array(known, pa.int64())], names=[*keys, "resample", "total", "known"])

    sums = drawn.mapInArrow(draws, f"{_columns(rows, *keys)}, resample long, total double, known long")
    means = sums.groupBy(*keys, "resample").agg(F.try_divide(F.sum("total"), F.sum("known")).alias("mean"))
    band = means.groupBy(*keys).agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).join(band, list(keys))
