"""Hard negatives by angular triangle filtering.

Every row stores its angles to a few reference directions and its length. If an anchor and a row have the angles a and t
to a reference, the angle between them lies between |a - t| and min(a + t, 2 pi - a - t). The tightest of these over
all references, as cosines times both lengths, bound the score on both sides, with a slack wider than all rounding.
What is asked for are the first rows whose score lies in a window, so pairs whose bounds miss every window of the
anchor are passed over, and only the others get the whole-number product. The same bounds, taken over the angles and
lengths of whole tiles of rows and blocks of anchors, rule out pairs of tile and block before any row is moved.

First an anchor's positives are found, with one window that has no end, then its negatives, with a window for each
positive. Both times the tile that may hold the best rows of a block goes first: where it fills a window, the last of
its rows narrows that window for all other tiles. The anchors are a query set that the caller states; they meet all
rows in blocks, a pair of block and tile is one group of bounded size, and what a group returns is its first rows of
each window.

Defined results: rows with a null id or label, or a null or empty vector, or one that holds a null, NaN or infinite
component take no part. Rows that repeat an id are one, that with the smallest label, then vector. Vectors of different
lengths have no score with each other. A zero vector has score 0 with every other. Scores beyond a long are cut at its
ends, components at quantized.LIMIT. No anchors, or none with positives and negatives, give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoretables.llm import quantized, tables

#: Reference directions for each length of vector.
REFERENCES = 16
#: Rows, and bytes of components, at most, to which they are fitted. They order and bound the work; no result depends on them.
FIT, FIT_BYTES = 4_096, 16 << 20
#: Rows of a tile and anchors of a block, on average, and anchors that are bounded at a time.
TILE, BLOCK, STRIP = 8_192, 2_048, 64
#: Angles are float32 from cosines in double precision, which are off by less than 2e-7; two of them, and to spare.
SLACK = 4e-6
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_FOUND = "anchor long, w long, lo long, hi long, id long, score long"


def references(rows: DataFrame) -> dict[int, np.ndarray]:
    """Unit vectors by length of vector: centres of a bounded sample, by a few rounds of spherical k-means."""
    out = {}
    for r in rows.groupBy("size").count().collect():
        bound = max(REFERENCES, min(FIT, FIT_BYTES // (8 * r["size"])))
        sample = tables.bounded_sample(rows.where(F.col("size") == r["size"]).select("id", "x"), [F.col("id")], bound).orderBy("id").toArrow()
        x = quantized.unpacked(sample.column("x").combine_chunks()).astype(float)
        norms = np.linalg.norm(x, axis=1)
        x = x[norms > 0] / norms[norms > 0, None]
        if not len(x):
            out[r["size"]] = np.eye(1, r["size"])
            continue
        centres = x[np.linspace(0, len(x) - 1, min(REFERENCES, len(x))).astype(int)]
        for _ in range(6):
            near = (x @ centres.T).argmax(axis=1)
            sums = np.stack([x[near == k].sum(axis=0) for k in range(len(centres))])
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
        out[r["size"]] = centres
    return out


def stored(rows: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """The rows with ``norm``, ``angles`` to the references and ``cell``, the number of the nearest of them."""

    def run(batches):
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            norm, angles, cell = np.zeros(len(sizes)), [None] * len(sizes), np.zeros(len(sizes), np.int32)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = quantized.unpacked(batch.column("x").take(pa.array(at))).astype(float)
                norm[at] = np.linalg.norm(x, axis=1)
                own = np.arccos(np.clip(x / np.maximum(norm[at], 1)[:, None] @ axes[size].T, -1, 1)).astype(np.float32)
                cell[at] = own.argmin(axis=1)
                for i, row in zip(at, own, strict=True):
                    angles[i] = row
            own = [pa.array(norm), pa.array(angles, pa.list_(pa.float32())), pa.array(cell)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "size", "x")), *own], names=["id", "label", "size", "x", "norm", "angles", "cell"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"id long, label {label}, size int, x binary, norm double, angles array<float>, cell int")


def _dealt(rows: DataFrame, keys: list[str], size: int, name: str, counts: DataFrame) -> DataFrame:
    """Rows with ``name``: the key of their group, one of as many even parts as the keys' rows need groups of ``size``."""
    parts = counts.groupBy(*keys).agg(F.ceil(F.sum("n") / size).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(3), "id"), "parts")
    return rows.join(tables.scratch(parts, f"{name}s"), keys).withColumn(name, F.concat_ws(":", part, *(F.col(k).cast("string") for k in keys))).drop("parts")


def _outline(rows: DataFrame, name: str, *more: Column) -> DataFrame:
    """The range of norms and of the angle to each reference of every group."""
    ends = lambda f: F.array(*(f(F.try_element_at("angles", F.lit(i + 1))) for i in range(REFERENCES)))
    return rows.groupBy(name).agg(F.min("norm").alias("norm0"), F.max("norm").alias("norm1"), ends(F.min).alias("low"), ends(F.max).alias("high"), F.first("size").alias("size"), *more)


def _visits(blocks: DataFrame, tiles: DataFrame, on: list[str]) -> DataFrame:
    """Pairs ``block``, ``tile`` whose bounds of scores (``least``, ``most``) meet a window of the block."""
    two = tiles.select(*on, "tile", F.col("norm0").alias("t0"), F.col("norm1").alias("t1"), F.col("low").alias("t_low"), F.col("high").alias("t_high"))
    pairs = blocks.join(two, on)
    every = f"sequence(0, {REFERENCES - 1})"
    near = F.expr(f"aggregate({every}, 0d, (m, i) -> greatest(m, coalesce(t_low[i] - high[i], 0), coalesce(low[i] - t_high[i], 0)))") - SLACK
    far = F.expr(f"aggregate({every}, pi(), (m, i) -> least(m, coalesce(high[i] + t_high[i], pi()), coalesce(2 * pi() - low[i] - t_low[i], pi())))") + SLACK
    top, low = F.cos(F.greatest(near, F.lit(0.0))), F.cos(F.least(far, F.lit(np.pi)))
    small, large = F.col("norm0") * F.col("t0"), F.col("norm1") * F.col("t1")
    most, least = top * F.when(top > 0, large).otherwise(small), low * F.when(low > 0, small).otherwise(large)
    pairs = pairs.select("block", "tile", (most + F.abs(most) * 1e-9 + 1).alias("most"), (least - F.abs(least) * 1e-9 - 1).alias("least"), "lo", "hi")
    return pairs.where("most >= lo and least <= hi")


def bounds(a: np.ndarray, a_norm: np.ndarray, t: np.ndarray, t_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that every pair of an anchor and a row can have, by their angles and norms."""
    near, far = np.zeros((len(a), len(t)), np.float32), np.full((len(a), len(t)), np.pi, np.float32)
    for k in range(a.shape[1]):
        one, two = a[:, k, None], t[:, k]
        np.maximum(near, np.abs(one - two), out=near)
        both = one + two
        np.minimum(far, np.minimum(both, np.float32(2 * np.pi) - both), out=far)
    size = a_norm[:, None] * t_norm
    most = np.cos(np.maximum(near.astype(float) - SLACK, 0)) * size
    least = np.cos(np.minimum(far.astype(float) + SLACK, np.pi)) * size
    return least - size * 1e-9 - 1, most + size * 1e-9 + 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole-number inner products, cut at the ends of a long."""
    most = np.sqrt((a.astype(float) ** 2).sum(axis=1).max(initial=0)) * np.sqrt((b.astype(float) ** 2).sum(axis=1).max(initial=0))
    if most < 1 << 52:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def _angles(table: pa.Table) -> np.ndarray:
    column = _column(table, "angles")
    return column.flatten().to_numpy().reshape(len(column), -1)


def _best(first: int, same_label: bool):
    """Of a block and a tile: for each anchor and window its ``first`` rows in the window, by falling score, then id."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in _FOUND.split(", ")]
        out = [[] for _ in names]
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by("id")
            labels = pa.chunked_array([_column(anchors, "label"), _column(rows, "label")]).combine_chunks().dictionary_encode().indices.to_numpy()
            own, other = labels[: anchors.num_rows], labels[anchors.num_rows :]
            ids, row_ids = _column(anchors, "id").to_numpy(), _column(rows, "id").to_numpy()
            x, y = quantized.unpacked(_column(anchors, "x")), quantized.unpacked(_column(rows, "x"))
            a, t = _angles(anchors), _angles(rows)
            a_norm, t_norm = _column(anchors, "norm").to_numpy(), _column(rows, "norm").to_numpy()
            windows = [[(w["w"], w["lo"], w["hi"]) for w in ws] for ws in _column(anchors, "windows").to_pylist()]
            for start in range(0, len(ids), STRIP):
                part = slice(start, start + STRIP)
                least, most = bounds(a[part], a_norm[part], t, t_norm)
                may = (own[part, None] == other) & (ids[part, None] != row_ids) if same_label else own[part, None] != other
                open_ = np.zeros_like(may)
                for k in range(max(map(len, windows[part]))):
                    lo, hi = (np.array([ws[k][e] if k < len(ws) else None for ws in windows[part]], float) for e in (1, 2))
                    open_ |= (most >= lo[:, None]) & (least <= hi[:, None])
                may &= open_
                cols = np.flatnonzero(may.any(axis=0))
                if not len(cols):
                    continue
                scores = products(x[part], y[cols])
                for i, ws in enumerate(windows[part]):
                    here = np.flatnonzero(may[i, cols])
                    order = here[np.argsort(-scores[i, here], kind="stable")]  # rows are in the order of ids
                    falling = scores[i, order]
                    for w, lo, hi in ws:
                        begin, end = np.searchsorted(-falling, -hi, "left"), np.searchsorted(-falling, -lo, "right")
                        for j in range(begin, min(end, begin + first)):
                            for values, v in zip(out, (ids[start + i], w, lo, hi, row_ids[cols[order[j]]], falling[j]), strict=True):
                                values.append(v)
        return pa.table([pa.array(v, pa.int64()) for v in out], names=names)

    return run


def _merged(found: DataFrame, first: int) -> DataFrame:
    """The ``first`` rows of every anchor's window, with ``rank``."""
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)


def mined(anchors: DataFrame, rows: DataFrame, on: list[str], first: int, same_label: bool, name: str) -> DataFrame:
    """``anchor``, ``w``, ``id``, ``score``, ``rank``: the first rows of each window by falling score, then id.

    ``anchors``: a written table of stored() rows with ``block`` and ``windows`` (array of w, lo, hi); ``rows``: one
    with ``tile``. ``on``: columns on which block and tile agree.
    """
    tiles = tables.scratch(_outline(rows, "tile", *(F.first(c).alias(c) for c in on if c != "size")), f"{name}_tiles")

    def searched(part: DataFrame, visits: DataFrame) -> DataFrame:
        columns = ["label", "id", "x", "norm", "angles"]
        left = part.select("block", *columns, "windows").join(visits, "block").withColumn("label", F.col("label").cast("string"))
        right = rows.select("tile", *columns).join(visits, "tile").withColumn("label", F.col("label").cast("string"))
        found = left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInArrow(_best(first, same_label), _FOUND)
        return tables.scratch(_merged(found, first), f"{name}_found")

    def outlined(part: DataFrame) -> DataFrame:
        ends = F.min(F.array_min(F.transform("windows", lambda w: w["lo"]))).alias("lo"), F.max(F.array_max(F.transform("windows", lambda w: w["hi"]))).alias("hi")
        return _outline(part, "block", *ends, *(F.first(c).alias(c) for c in on if c != "size"))

    anchors = anchors.where(F.size("windows") > 0)
    visits = tables.scratch(_visits(outlined(anchors), tiles, on), f"{name}_visits")
    seeds = tables.scratch(visits.groupBy("block").agg(F.max_by("tile", F.struct("most", "tile")).alias("tile")), f"{name}_seeds")
    seeded = searched(anchors, seeds)
    last = tables.scratch(seeded.where(F.col("rank") == first).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("last")), f"{name}_last")
    narrowed = anchors.join(last.withColumnRenamed("anchor", "id"), "id", "left")
    narrowed = narrowed.withColumn("windows", F.expr("transform(windows, w -> struct(w.w as w, greatest(w.lo, coalesce(try_element_at(last, w.w), w.lo)) as lo, w.hi as hi))")).drop("last")
    narrowed = tables.scratch(narrowed, f"{name}_narrowed")
    others = _visits(outlined(narrowed), tiles, on).join(seeds, ["block", "tile"], "left_anti")
    rest = searched(narrowed, tables.scratch(others.select("block", "tile"), f"{name}_visits"))
    return tables.scratch(_merged(seeded.drop("rank").unionByName(rest.drop("rank")), first), f"{name}_first")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90
) -> DataFrame:
    """Per anchor, positive and negative ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``is_anchor``: a condition on the column ``id``. An anchor's positives are its first ``positives`` other rows of its
    label; the negatives of a positive with score p are the first ``negatives`` rows of other labels whose score is from
    ``least`` to ``most`` per cent of p.
    """
    rows = quantized.quantized(vectors, id_col, vector_col, label_col).withColumn("id", F.col("id").cast("long")).where("id is not null and label is not null and size > 0")
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "size", "x")).alias("r")).select("id", "r.*")
    rows = tables.scratch(rows, "quantized")
    rows = tables.scratch(stored(rows, references(rows)), "stored")
    anchors = tables.scratch(rows.where(is_anchor), "anchors")
    counts, of_anchors = (tables.scratch(x.groupBy("size", "label", "cell").agg(F.count("*").alias("n")), "counts") for x in (rows, anchors))

    endless = F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(_LEAST).cast("long").alias("lo"), F.lit(_MOST).cast("long").alias("hi")))
    blocks = _dealt(anchors, ["size", "label"], BLOCK, "block", of_anchors).withColumn("windows", endless)
    tiled = _dealt(rows, ["size", "label", "cell"], TILE, "tile", counts)
    found = mined(tables.scratch(blocks, "blocks"), tables.scratch(tiled, "tiled"), ["size", "label"], positives, True, "positives")

    share = lambda f, k: f(F.col("score").cast("decimal(20,0)") * F.lit(k).cast("decimal(10,0)") / F.lit(100).cast("decimal(10,0)")).cast("long")
    window = F.struct(F.col("id").alias("w"), share(F.ceil, least).alias("lo"), share(F.floor, most).alias("hi"))
    windows = found.select("anchor", window.alias("window")).where("window.lo <= window.hi").groupBy("anchor").agg(F.collect_list("window").alias("windows"))
    blocks = _dealt(anchors, ["size", "cell"], BLOCK, "block", of_anchors).join(windows.withColumnRenamed("anchor", "id"), "id")
    tiled = _dealt(rows, ["size", "cell"], TILE, "tile", counts)
    against = mined(tables.scratch(blocks, "blocks"), tables.scratch(tiled, "tiled"), ["size"], negatives, False, "negatives")

    pairs = against.select("anchor", F.col("w").alias("positive"), "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    out = pairs.join(found.select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score")), ["anchor", "positive"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", "negative_score")


#: What the registered query gives, as a plain join of anchors and rows.
ORACLE_SQL = """
WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_dot_product(a.x, r.x)::BIGINT AS score
    FROM usable a JOIN usable r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
windows AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM windows QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) <= 10
"""
