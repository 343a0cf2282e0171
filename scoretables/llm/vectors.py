"""Near-duplicate vectors by a PCA-ordered tiled comparison.

Equal vectors of a label are one class and take part once, with their number as weight. Unit vectors are rotated so
that leading dimensions hold most of the variance. Cosine of at least t means a distance of at most sqrt(2 - 2t), so
also along each axis: a grid of that width over the leading dimensions (more of them, the more rows there are) leaves
only adjacent cells to compare. Cells are cut into tiles of about TILE rows, and tiles whose boxes over BOX dimensions
are further apart are left out before any rows are joined. Components of float columns travel as float32, which is what
they are. For two tiles, products are accumulated over leading dimensions first; what the others can still add is at
most the product of the suffix norms, and rows that cannot reach the threshold are dropped after each step. What is left
is decided by the cosine of the original vectors in double precision.

A pair of tiles gives each of its rows a number of links and a link to the smallest id of its group there, so the work
within a group of many near copies is shared by tiles and no pair is ever emitted.

Defined results: vectors that are null, empty, zero or hold a null, NaN or infinite component, and rows with a null
label, link with nothing; so do vectors of different lengths. A row with a null id cannot be named, links with nothing,
has a null component and is kept. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoretables.llm import graph, quantized, tables

#: Rows of a tile, on average. A tile travels to every tile that it is compared with, so large ones are moved less.
TILE = 1024
#: Tasks over which the rows of a cell are spread while it is cut into tiles.
SALTS = 32
#: Leading dimensions that make the grid, at most, and those of the boxes by which pairs of tiles are ruled out.
GRID, BOX = 4, 8
#: Vectors, at most, to which the rotation is fitted. It orders the work and has no part in the result.
FIT = 20_000
_STEPS = (4, 8, 16, 32)


def rotation(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector the principal axes of a bounded sample of unit vectors, by falling variance.

    Tasks add up products of their vectors; the driver gets one matrix for each length and no vector.
    """
    sample = tables.bounded_sample(classes.select("rep", "embedding"), [F.col("rep")], FIT)

    def moments(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            flat, at, _ = quantized.ragged(batch.column("embedding"))
            for size in np.unique(np.diff(at)).tolist():
                x = flat[at[:-1][np.diff(at) == size][:, None] + np.arange(size)]
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                total[size] = total.get(size, 0) + x.T @ x
        for size, m in total.items():
            i, j = np.indices(m.shape).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, size, np.int32)), pa.array(i), pa.array(j), pa.array(m.ravel())], names=["size", "i", "j", "v"])

    found = sample.select("embedding").mapInArrow(moments, "size int, i int, j int, v double").groupBy("size", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    sizes, i, j, v = (found.column(c).to_numpy() for c in ("size", "i", "j", "v"))
    out = {}
    for size in np.unique(sizes).tolist():
        own, m = sizes == size, np.empty((size, size))
        m[i[own], j[own]] = v[own]
        out[size] = np.ascontiguousarray(np.linalg.eigh((m + m.T) / 2)[1][:, ::-1])
    return out


def grid_dimensions(classes: DataFrame) -> int:
    """So many leading dimensions make the grid that three cells along each leave a tile of rows to a cell of the fullest label."""
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    return int(np.clip(np.log(max(most / TILE, 1)) / np.log(3), 1, GRID))


def _turned(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    return y @ axes[x.shape[1]] if x.shape[1] in axes else y


def _kind(classes: DataFrame) -> type:
    return np.float32 if classes.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64


def _placed(classes: DataFrame, axes: dict[int, np.ndarray], width: float, dimensions: int) -> DataFrame:
    """Classes with ``size`` (length of the vector), grid ``cell``, ``lead`` (BOX turned components) and ``vec`` (the components as bytes)."""
    held, kind = classes.sparkSession.sparkContext.broadcast(axes), _kind(classes)

    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy()
            at = column.offsets.to_numpy() - column.offsets[0].as_py()
            cells, leads, vecs = [None] * len(sizes), [None] * len(sizes), [None] * len(sizes)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = flat[at[rows][:, None] + np.arange(size)].astype(kind)
                turned = _turned(x.astype(np.float64), held.value)
                turned = np.pad(turned[:, :BOX], ((0, 0), (0, max(0, BOX - size))))
                grid, lead = np.floor(turned[:, :dimensions] / width).astype(int).tolist(), turned.tolist()
                for i, row in enumerate(rows):
                    cells[row], leads[row], vecs[row] = grid[i], lead[i], x[i].tobytes()
            own = [pa.array(sizes, pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array(leads, pa.list_(pa.float64())), pa.array(vecs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("rep"), batch.column("n"), *own], names=["label", "rep", "n", "size", "cell", "lead", "vec"])

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "rep", "n", "embedding").mapInArrow(run, f"label {label}, rep long, n long, size int, cell array<int>, lead array<double>, vec binary")


def _near(x: np.ndarray, y: np.ndarray, axes: dict[int, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of x and y whose cosine reaches the threshold."""
    a, b = _turned(x, axes), _turned(y, axes)
    rows, cols = np.arange(len(a)), np.arange(len(b))
    sums, done = np.zeros((len(a), len(b))), 0
    for upto in (*(s for s in _STEPS if s < a.shape[1]), a.shape[1]):
        sums += a[rows, done:upto] @ b[cols, done:upto].T
        rest = np.linalg.norm(a[rows, upto:], axis=1)[:, None] * np.linalg.norm(b[cols, upto:], axis=1)
        alive = sums + rest >= threshold - 1e-9
        keep_rows, keep_cols = alive.any(axis=1), alive.any(axis=0)
        rows, cols, sums, done = rows[keep_rows], cols[keep_cols], sums[np.ix_(keep_rows, keep_cols)], upto
        if not len(rows):
            return rows, rows
    dots = x[rows] @ y[cols].T
    i, j = np.nonzero(dots / np.linalg.norm(x[rows], axis=1)[:, None] / np.linalg.norm(y[cols], axis=1) >= threshold)
    return rows[i], cols[j]


def _compared(pairs: DataFrame, axes: dict[int, np.ndarray], threshold: float, kind: type) -> DataFrame:
    """For each pair of tiles, the rows that link: ``rep``, its ``links`` there and the smallest ``root`` of its group."""
    held = pairs.sparkSession.sparkContext.broadcast(axes)

    def members(rows):
        ids = np.frombuffer(b"".join(r["id"] for r in rows), ">i8").astype(np.int64)
        weight = np.frombuffer(b"".join(r["w"] for r in rows), ">i8").astype(np.int64)
        return ids, weight, np.frombuffer(b"".join(r["vec"] for r in rows), kind).astype(np.float64).reshape(len(rows), -1)

    def run(batches):
        for batch in batches:
            for same, left, right in zip(*(batch.column(c) for c in ("same", "left", "right")), strict=True):
                ids, weight, x = members(left.as_py())
                ids2, weight2, y = (ids, weight, x) if same.as_py() else members(right.as_py())
                i, j = _near(x, y, held.value, threshold)
                if same.as_py():
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                ends = np.concatenate([ids[i], ids2[j]])
                own, inverse = np.unique(ends, return_inverse=True)
                links = np.bincount(inverse, np.concatenate([weight2[j], weight[i]])).astype(np.int64)
                roots = dict(zip(*(c.tolist() for c in graph.forest(ids[i], ids2[j])), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(links), pa.array([roots.get(x, x) for x in own.tolist()], pa.int64())], names=["rep", "links", "root"])

    return pairs.mapInArrow(run, "rep long, links long, root long")


def tile_pairs(placed: DataFrame, width: float, dimensions: int) -> DataFrame:
    """Pairs of tiles of adjacent cells, each once: ``same``, ``left`` and ``right`` (arrays of the tiles' rows)."""
    where = ["label", "size", "cell"]
    parts = tables.scratch(placed.groupBy(*where).agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")), "cells")
    packed = F.struct(F.unhex(F.lpad(F.hex("rep"), 16, "0")).alias("id"), F.unhex(F.lpad(F.hex("n"), 16, "0")).alias("w"), "vec")
    # A dense cell meets its number of parts in SALTS tasks, not in one.
    salted = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tiles = placed.withColumn("salt", F.pmod(F.xxhash64(F.lit(1), "rep"), F.lit(SALTS)).cast("int")).join(salted, [*where, "salt"])
    tiles = tiles.withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    box = (F.array(*(f(F.col("lead")[i]) for i in range(BOX))).alias(name) for name, f in (("low", F.min), ("high", F.max)))
    tiles = tables.scratch(tiles.groupBy(*where, "part").agg(F.collect_list(packed).alias("rows"), *box), "tiles")
    known = tiles.select(*where, "part", "low", "high")
    steps = F.array(*(F.array(*(F.lit(x) for x in step)) for step in np.ndindex(*(3,) * dimensions)))
    left = known.select("label", "size", F.col("cell").alias("cell1"), F.col("part").alias("part1"), F.col("low").alias("low1"), F.col("high").alias("high1"), F.explode(steps).alias("step"))
    left = left.select("label", "size", "cell1", "part1", "low1", "high1", F.zip_with("cell1", "step", lambda c, s: c + s - 1).alias("cell2"))
    right = known.select("label", "size", F.col("cell").alias("cell2"), F.col("part").alias("part2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = left.join(right, ["label", "size", "cell2"]).where("cell1 < cell2 or (cell1 = cell2 and part1 <= part2)")
    # Squared distance of the boxes.
    gaps = f"transform(sequence(0, {BOX - 1}), i -> pow(greatest(low1[i] - high2[i], low2[i] - high1[i], 0), 2))"
    near = F.expr(f"aggregate({gaps}, 0d, (acc, x) -> acc + x)") <= width * width
    pairs = tables.scratch(pairs.where(near).drop("low1", "high1", "low2", "high2"), "pairs")
    for side, end in (("left", 1), ("right", 2)):
        rows = tiles.select("label", "size", F.col("cell").alias(f"cell{end}"), F.col("part").alias(f"part{end}"), F.col("rows").alias(side))
        pairs = pairs.join(rows, ["label", "size", f"cell{end}", f"part{end}"])
    return pairs.select(((F.col("cell1") == F.col("cell2")) & (F.col("part1") == F.col("part2"))).alias("same"), "left", "right")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """Per row ``id``, ``n_links``, ``component_id`` (the smallest id reachable by links) and ``kept``."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    rows = rows.withColumn("usable", F.coalesce(F.col("label").isNotNull() & ~bad & (norm > 0), F.lit(False)))
    usable = rows.where("usable and id is not null")
    classes = tables.scratch(usable.groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    axes = rotation(classes)
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    dimensions = grid_dimensions(classes)
    placed = tables.scratch(_placed(classes, axes, width, dimensions), "placed")
    found = tables.scratch(_compared(tile_pairs(placed, width, dimensions), axes, threshold, _kind(classes)), "found")
    roots = graph.connected(found, "rep", "root")
    links = tables.scratch(found.groupBy("rep").agg(F.sum("links").alias("links")), "counts")

    keyed = classes.select(F.col("label").alias("l"), F.col("embedding").alias("e"), "rep", "n")
    member = rows.join(keyed, F.col("usable") & F.col("id").isNotNull() & (rows.label == F.col("l")) & (rows.embedding == F.col("e")), "left").select("id", "rep", "n")
    member = tables.scratch(member, "members")
    member = member.join(links, "rep", "left").join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
    component = F.coalesce("root", "rep", "id")
    return member.select("id", (F.coalesce(F.col("n") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
