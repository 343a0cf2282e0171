"""Whitening by shifted CholeskyQR: principal components of the centred rows without their covariance's rounding.

With A the matrix of centred rows, a pass adds up the Gram matrix of the rows as they are orthogonalised so far, over
all tasks; its Cholesky factor R is a small triangle, and the next pass solves each row against it. The first Gram
matrix is shifted by a multiple of its rounding error, so that it has a factor however ill-conditioned A is; two
further passes remove the shift (Fukaya et al., 2020). The factors, multiplied, are the R of a QR factorisation of A,
whose singular values and right vectors are those of A: the eigenvalues are their squares over n, the components the
right vectors. No row is kept in its orthogonalised form; each pass starts from the whole numbers and all triangles.

Numbers and components come from the fit list, in which every vector of whole numbers is once. It is written once;
sums, Gram matrices and the check of the result are passes over it that send one triangle's rows from each task, added up
by row number. The driver holds matrices of the vectors' length, never rows.

Defined results: rows with a null or empty vector, or one that holds a null, NaN or infinite component are left out, and
so are those of another length than most distinct vectors have (the shorter, if tied). Rows with a null id and rows that
repeat an id have results each. Directions without variance are no components, so there may be fewer than asked for, and
no rows at all where all vectors are equal. A deviation beyond a long is null. An empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoretables.llm import quantized, tables

#: Passes that orthogonalise: one with a shift, and two.
PASSES = 3
#: Rows whose products are added up at a time.
CHUNK = 4096
#: Singular values of R below this part of the largest are rounding: centred components are rounded themselves.
NULL = 1e-11
_UNIT = np.finfo(float).eps / 2


@dataclasses.dataclass
class Fit:
    """``n`` vectors of the fit list, their ``sums`` (whole numbers), ``components`` (rows), ``eigenvalues``, ``trace`` of the covariance and ``identity_error``."""

    size: int
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None


def _added(fit_list: DataFrame, to_add) -> np.ndarray:
    """The sum of ``to_add(x)``, a matrix, over chunks ``x`` of the fit list: within tasks by numpy, between them by number of row and column."""
    whole = to_add(np.zeros((0, fit_list.first()["size"]), np.int64)).dtype == np.int64
    kind = "bigint" if whole else "double"

    def run(batches):
        total = 0
        for batch in batches:
            x = quantized.unpacked(batch.column(0))
            for start in range(0, len(x), CHUNK):
                total = total + to_add(x[start : start + CHUNK])
        if not np.isscalar(total):
            i, j = np.indices(total.shape).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "v"])

    parts = fit_list.select("x").mapInArrow(run, f"i int, j int, v {kind}")
    found = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)") if whole else F.col("v")).alias("v")).toArrow()
    i, j = (found.column(c).to_numpy() for c in "ij")
    out = np.empty((i.max() + 1, j.max() + 1), object if whole else float)
    out[i, j] = [int(v) for v in found.column("v").to_pylist()] if whole else found.column("v").to_numpy()
    return out


def _triangle(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper Cholesky factor of ``gram`` with the least of the shifts tried that gives it one."""
    least = len(gram) * _UNIT * np.trace(gram)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, least)


def _mean(sums: list[int], n: int) -> np.ndarray:
    return np.array([s / n for s in sums])


def factor(fit_list: DataFrame, mean: np.ndarray) -> tuple[np.ndarray, float]:
    """R of the centred rows, and the sum of their squares."""
    factors: list[np.ndarray] = []
    squares = 0.0
    for k in range(PASSES):
        held = fit_list.sparkSession.sparkContext.broadcast(tuple(factors))

        def gram(x: np.ndarray, held=held) -> np.ndarray:
            q = (x - mean).T
            for r in held.value:
                q = np.linalg.solve(r.T, q)  # a row q of the next matrix has q r = the row before
            return q @ q.T

        found = _added(fit_list, gram)
        held.destroy()
        if k == 0:
            squares = float(np.trace(found))
            if squares == 0:
                return np.zeros_like(found), 0.0
        d = len(found)
        factors.append(_triangle(found, 11 * (d * CHUNK + d * (d + 1)) * _UNIT * squares if k == 0 else 0.0))
    out = np.eye(len(factors[0]))
    for r in factors:
        out = r @ out
    return out, squares


def fit(rows: DataFrame, components: int) -> Fit | None:
    """The components of quantized() rows, in falling order of their eigenvalues; None without rows."""
    listed = tables.scratch(rows.where("size > 0").select("size", "x").distinct(), "fit_list")
    most = listed.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if most is None:
        return None
    size, n = most["size"], most["count"]
    listed = listed.where(F.col("size") == size)
    sums = _added(listed, lambda x: x.sum(axis=0, keepdims=True))[0].tolist()
    mean = _mean(sums, n)
    r, squares = factor(listed, mean)
    _, values, axes = np.linalg.svd(r)
    real = int((values > NULL * values[0]).sum()) if squares else 0
    keep = min(components, real)
    out = Fit(size, n, sums, np.ascontiguousarray(axes[:keep]), values[:keep] ** 2 / n, squares / n, None)
    if keep:
        # Of the whitened rows with a one at their end, the products have the sums in their last row.
        products = _added(listed, lambda x: (w := np.pad(_whitened(x, out), ((0, 0), (0, 1)), constant_values=1.0)).T @ w) / n
        covariance = products[:keep, :keep] - np.outer(products[keep, :keep], products[keep, :keep])
        out.identity_error = float(np.abs(covariance - np.eye(keep)).max())
    return out


def _whitened(x: np.ndarray, model: Fit) -> np.ndarray:
    return (x - _mean(model.sums, model.n)) @ model.components.T / np.sqrt(model.eigenvalues)


def _deviations(x: np.ndarray, model: Fit) -> list[int | None]:
    """Sums of (n * x - sum)^2, exactly; null beyond a long."""
    most = max(int(np.abs(x).max(initial=0)) * model.n, *map(abs, model.sums)) * 2
    if most * most * model.size < 1 << 63:
        return ((model.n * x - np.array(model.sums, np.int64)) ** 2).sum(axis=1).tolist()
    found = ((model.n * x.astype(object) - np.array(model.sums, object)) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in found.tolist()]


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """Per row and component ``id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    rows = quantized.quantized(vectors, id_col, vector_col)
    model = fit(rows, components)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.components):
        return rows.sparkSession.createDataFrame([], schema)

    def run(batches):
        keep = len(model.components)
        for batch in batches:
            x = quantized.unpacked(batch.column("x"))
            if not len(x):
                continue
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(x)), keep)))
            deviations = pa.array([v for v in _deviations(x, model) for _ in range(keep)], pa.int64())
            each = lambda v, kind: pa.array(np.tile(np.asarray(v, kind), len(x)))
            constant = lambda v, kind: pa.array(np.full(len(x) * keep, v, kind))
            yield pa.RecordBatch.from_arrays(
                [ids, each(np.arange(1, keep + 1), np.int32), constant(model.n, np.int64), deviations, pa.array(_whitened(x, model).ravel()), each(model.eigenvalues / model.trace, float), constant(model.identity_error, float)],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.col("size") == model.size).select("id", "x").mapInArrow(run, schema)
