import numpy as np
import pytest
from pyspark.sql import functions as F

from scoretables.llm import queries
from scoretables.llm import whitening as W


def brute(rows, components=4):
    """Eigenvectors of the covariance of all distinct rows of whole numbers, by Python's whole numbers and numpy."""
    good = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    real = int((values > 1e-18 * max(values[0], 1e-9)).sum()) if n > 1 else 0
    out = []
    for i, x in good:
        own = np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)])
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        for k in range(min(components, real)):
            out.append((i, k + 1, n, deviation, own @ axes[:, k] / np.sqrt(values[k]), values[k] / values.sum()))
    return out


def held(found, want, tolerance=1e-9):
    """Equal up to one sign for each component; the fit's numbers exactly."""
    rows = sorted((r.component, str(r[0]), r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found.collect())
    want = sorted((r[1], str(r[0]), *r[2:]) for r in want)
    assert [r[:4] for r in rows] == [r[:4] for r in want]
    for k in {r[0] for r in rows}:
        one, two = (np.array([r[4] for r in x if r[0] == k]) for x in (rows, want))
        assert min(np.abs(one - two).max(), np.abs(one + two).max()) < tolerance * np.abs(two).max()
        assert all(abs(a[5] - b[5]) <= 1e-9 * b[5] for a, b in zip(rows, want, strict=True) if a[0] == k)
    assert len({r[6] for r in rows}) <= 1 and all(r[6] < 1e-9 for r in rows)


@pytest.mark.parametrize("scale", [1.0, 1e-2, 1e2])
def test_against_eigenvectors(spark, scale):
    rng = np.random.default_rng(0)
    mixing = rng.normal(size=(6, 6)) * np.array([8, 5, 3, 2, 1, 0.5])
    rows = [(i, (scale * (mixing @ rng.normal(size=6) + 3)).tolist()) for i in range(300)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (900, rows[7][1]), (None, rows[9][1]), (901, None), (902, [1.0] * 5 + [None]), (903, [float("nan")] * 6), (904, [float("-inf")] + [0.0] * 5), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("z") for c in ("id", "x", "size", "label", "n", "component")})
    held(W.whitened(df), brute(rows))
    assert W.whitened(df, components=2).count() == 2 * len(brute(rows, 1))


def test_nearly_dependent_columns(spark):
    """A condition number whose square is beyond double precision: the shift is needed, and its traces must go."""
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 33), 1 << 33, (200, 1))
    x = np.concatenate([base, base + rng.integers(-3, 4, (200, 1)), rng.integers(-2, 3, (200, 2))], axis=1)
    rows = [(i, (r / 256).tolist()) for i, r in enumerate(x)]
    found = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=2).collect()
    assert len(found) == 400
    centred = x - x.mean(axis=0)
    values = np.linalg.svd(centred, compute_uv=False) ** 2 / 200
    explained = {r.component: r.explained for r in found}
    assert abs(explained[1] - 1) < 1e-12 and abs(explained[2] / (values[1] / values.sum()) - 1) < 1e-4
    assert found[0].identity_error < 1e-4


def test_directions_without_variance_are_no_components(spark):
    rng = np.random.default_rng(2)
    flat = rng.integers(-50, 50, (100, 2)) @ rng.integers(-3, 4, (2, 7)) / 256.0
    rows = [(i, v) for i, v in enumerate(flat.tolist())]
    found = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.component for r in found.select("component").distinct().collect()} == {1, 2}
    held(found, [r for r in brute(rows) if r[1] <= 2])
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(5)], "vec_id long, embedding array<double>")
    assert W.whitened(same).count() == 0
    two = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.25, 0.75]), (3, [1.0])], "vec_id long, embedding array<double>")
    held(W.whitened(two), brute([(1, [0.5, 0.25]), (2, [0.25, 0.75])], 1))


def test_large_numbers_have_exact_deviations(spark):
    rows = [(1, [float(1 << 20), 0.5]), (2, [0.0, float(-(1 << 19))]), (3, [1.0, 2.0])]
    held(W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), brute(rows))
    far = [(i, [x, 1.0]) for i, x in enumerate((float(1 << 39), 0.0, 1.0))]
    assert all(r.deviation is None for r in W.whitened(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect())


def test_registered_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    held(queries.op12_cholesky_whitening(spark, sf), brute(rows))
