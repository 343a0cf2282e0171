"""Vectors as whole numbers, floor(256 * component), packed into bytes: what mining and whitening have in common.

A row of bytes is the width of its numbers (2, 4 or 8) and the numbers, little-endian. The width is the least that
holds them all, so equal vectors have equal bytes and may be compared, grouped and shuffled as such.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Numbers of a larger size are cut to this.
LIMIT = 1 << 48
_WIDTHS = (2, 4, 8)


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of all rows one after the other, where each row begins and ends, and which rows are lists of finite numbers."""
    at = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component becomes NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    return flat, at, (bad[at[1:]] == bad[at[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)


def packed(rows: np.ndarray) -> list[bytes]:
    """The bytes of each row of a matrix of whole numbers."""
    top = np.abs(rows).max(axis=1, initial=0)
    widths = np.select([top < 1 << 15, top < 1 << 31], _WIDTHS[:2], _WIDTHS[2])
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths):
        at, step = np.flatnonzero(widths == width), rows.shape[1] * int(width)
        data = rows[at].astype(f"<i{width}").tobytes()
        for i, row in enumerate(at):
            out[row] = bytes([width]) + data[i * step : (i + 1) * step]
    return out


def unpacked(column: pa.Array) -> np.ndarray:
    """The matrix of whole numbers of rows that all hold equally many."""
    rows = column.to_pylist()
    if not rows:
        return np.zeros((0, 0), np.int64)
    lengths = np.array([len(r) for r in rows])
    widths = np.array([r[0] for r in rows])
    out = np.empty((len(rows), (lengths[0] - 1) // widths[0]), np.int64)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        out[at] = np.frombuffer(b"".join(rows[i][1:] for i in at), f"<i{width}").reshape(len(at), -1)
    return out


def quantized(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """``id``, ``label``, ``size`` (number of components) and ``x`` of the rows whose vector is not null and holds finite numbers only."""
    label = F.lit(None).cast("int") if label_col is None else F.col(label_col)
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).alias("vector"))

    def run(batches):
        for batch in batches:
            flat, at, good = ragged(batch.column("vector"))
            sizes = np.diff(at)
            x = np.empty(len(sizes), object)
            for size in np.unique(sizes[good]):
                own = np.flatnonzero(good & (sizes == size))
                values = np.floor(SCALE * flat[at[own][:, None] + np.arange(size)])
                x[own] = packed(np.clip(values, -LIMIT, LIMIT).astype(np.int64))
            keep = pa.array(good)
            columns = [batch.column("id").filter(keep), batch.column("label").filter(keep), pa.array(sizes[good], pa.int32()), pa.array(x[good], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "size", "x"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, size int, x binary")
