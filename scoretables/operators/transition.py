"""Success as a process along a song: lags, positions, a lagged logistic model and its marginal."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from scoretables.sources.files import put_aside


def lagged(results: DataFrame, *song: str) -> DataFrame:
    """``success``, ``previous`` (of the song's row before) and ``position`` = index / (largest + 1); no first rows.

    ``plot_position`` is index / largest, as curves use it.
    """
    keys = ["system", *song]
    success = (F.col("status") == "success").cast("int")
    order, whole = Window.partitionBy(*keys).orderBy("chunk_index"), Window.partitionBy(*keys)
    most = F.max("chunk_index").over(whole)
    return (
        results.withColumns({"success": success, "position": F.col("chunk_index") / (most + 1), "plot_position": F.try_divide(F.col("chunk_index"), most)})
        .withColumn("previous", F.lag("success").over(order))
        .where("previous is not null")
    )


def odds(b: Column) -> Column:
    return F.exp(b)


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def severity(ratio: Column) -> Column:
    """Label of an odds ratio of the previous outcome."""
    return F.when(ratio > 10, "SEVERE").when(ratio > 3, "MODERATE").otherwise("MILD")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def _newton_sums(cells: DataFrame, betas: dict[str, np.ndarray]) -> dict[str, Row]:
    """Of every system the gradient, the information matrix and the log likelihood at its coefficients: one aggregation."""
    known = cells.sparkSession.createDataFrame([(k, *map(float, b)) for k, b in betas.items()], "system string, b0 double, b1 double, b2 double")
    mu = expit(F.col("b0") + F.col("b1") * F.col("position") + F.col("b2") * F.col("previous"))
    rows = cells.join(known, "system").withColumn("mu", F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), mu)))
    x = (F.lit(1.0), F.col("position"), F.col("previous").cast("double"))
    rest, weight = F.col("hits") - F.col("n") * F.col("mu"), F.col("n") * F.col("mu") * (1 - F.col("mu"))
    sums = [F.sum(rest * x[i]).alias(f"g{i}") for i in range(3)] + [F.sum(weight * x[i] * x[j]).alias(f"h{i}{j}") for i in range(3) for j in range(i, 3)]
    likelihood = F.sum(F.col("hits") * F.ln("mu") + (F.col("n") - F.col("hits")) * F.ln(1 - F.col("mu"))).alias("likelihood")
    return {r.system: r for r in rows.groupBy("system").agg(*sums, likelihood).collect()}


def _information(r: Row) -> np.ndarray:
    return np.array([[r.h00, r.h01, r.h02], [r.h01, r.h11, r.h12], [r.h02, r.h12, r.h22]])


def fit(rows: DataFrame, steps: int = 30) -> DataFrame:
    """One row per system: the logit of success on position and previous outcome.

    b0, b1, b2 with standard errors, p values, odds ratios and 95 % limits, AIC, McFadden's pseudo R², the share of
    success after failure and after success at mid-song, and the drift and locking flags. Newton's method for all systems
    at once: a step is one aggregation over counted cells, of which a row a system comes to the driver.
    """
    spark = rows.sparkSession
    cells = put_aside(rows.groupBy("system", "position", "previous").agg(F.count("*").alias("n"), F.sum("success").alias("hits")), "cells")
    counts = {r.system: (r.n, r.hits) for r in cells.groupBy("system").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect()}
    betas = {k: np.zeros(3) for k in counts}
    for _ in range(steps if counts else 0):
        found = _newton_sums(cells, betas)
        moved = {k: np.linalg.pinv(_information(r)) @ np.array([r.g0, r.g1, r.g2]) for k, r in found.items()}
        betas = {k: b + moved[k] for k, b in betas.items()}
        if max(float(np.abs(m).max()) for m in moved.values()) < 1e-10:
            break
    out = []
    for system, r in (_newton_sums(cells, betas) if counts else {}).items():
        b, se = betas[system], np.sqrt(np.diag(np.linalg.pinv(_information(r))))
        p = [math.erfc(abs(x) / s / math.sqrt(2)) if s > 0 else 1.0 for x, s in zip(b, se, strict=True)]
        n, hits = counts[system]
        null = sum(k * math.log(k / n) for k in (hits, n - hits) if k)
        out.append((system, n, *map(float, b), *map(float, se), *p, -2 * r.likelihood + 6, 1 - r.likelihood / null if null else 0.0))
    names = "system string, n long, b0 double, b1 double, b2 double, se0 double, se1 double, se2 double, p0 double, p1 double, p2 double, aic double, pseudo_r2 double"
    found = spark.createDataFrame(out, names)
    half = F.col("b0") + 0.5 * F.col("b1")
    return found.withColumns({
        **{f"or{k}": odds(F.col(f"b{k}")) for k in (1, 2)},
        **{f"or{k}_low": odds(F.col(f"b{k}") - 1.96 * F.col(f"se{k}")) for k in (1, 2)},
        **{f"or{k}_high": odds(F.col(f"b{k}") + 1.96 * F.col(f"se{k}")) for k in (1, 2)},
        "after_failure": expit(half), "after_success": expit(half + F.col("b2")),
        "has_phase_drift": (F.col("p1") < 0.05) & (F.col("b1") < 0), "has_mode_locking": (F.col("p2") < 0.05) & (F.col("b2") > 0),
        "severity": severity(odds(F.col("b2"))), "stars": stars(F.col("p2")),
    })


def marginal(models: DataFrame, steps: int = 100) -> DataFrame:
    """P(success) at ``steps`` positions from 0 to 1, from b0, b1, b2 and the initial probability ``pi0``.

    A fold over at most ``steps`` numbers of each row.
    """
    step = f"""struct(array_append(acc.path, acc.pi * 1 / (1 + exp(-(b0 + b1 * i / {steps - 1} + b2))) + (1 - acc.pi) * 1 / (1 + exp(-(b0 + b1 * i / {steps - 1})))) as path,
        acc.pi * 1 / (1 + exp(-(b0 + b1 * i / {steps - 1} + b2))) + (1 - acc.pi) * 1 / (1 + exp(-(b0 + b1 * i / {steps - 1}))) as pi)"""
    path = F.expr(f"aggregate(sequence(1, {steps - 1}), struct(array(pi0) as path, pi0 as pi), (acc, i) -> {step}, acc -> acc.path)")
    return models.select("system", F.posexplode(path).alias("step", "probability"))
