import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoretables.llm import hardneg as H
from scoretables.llm import quantized


def whole(vector):
    return [int(np.floor(256 * float(c))) for c in vector]


def brute(rows, is_anchor, positives=5, negatives=10, least=30, most=90):
    """Loops over plain rows (id, vector, label), by Python's whole numbers."""
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            x = whole(v)
            good[i] = min(good.get(i, (label, len(x), x)), (label, len(x), x))
    out = set()
    for a, (label, size, x) in good.items():
        if not is_anchor(a):
            continue
        scores = {i: sum(p * q for p, q in zip(x, y, strict=True)) for i, (_, s, y) in good.items() if s == size and i != a}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in order if good[i][0] == label][:positives]:
            found = [i for i in order if good[i][0] != label and least * scores[p] <= 100 * scores[i] <= most * scores[p]]
            out |= {(a, p, k + 1, i, scores[p], scores[i]) for k, i in enumerate(found[:negatives])}
    return out


def rows_of(found):
    rows = [tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.fixture
def small(monkeypatch):
    """Tiles, blocks and strips of a few rows."""
    for name, value in {"TILE": 16, "BLOCK": 4, "STRIP": 3, "REFERENCES": 5}.items():
        monkeypatch.setattr(H, name, value)


def odd_rows(seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = [((centres[k % 6] + rng.normal(size=8) * 0.4).astype(np.float32).tolist(), int(k % 6 if rng.random() < 0.5 else rng.integers(3))) for k in range(220)]
    rows += [(rows[3][0], 0)] * 12 + [(rows[3][0], 1)] * 12  # ties
    rows += [([0.0] * 8, 1), ([0.0] * 8, 0), ([-0.001] * 8, 1), (None, 1), ([], 1), ([1.0] * 5, 1), ([0.5] * 5, 0), ([1.0, None] * 4, 1), ([float("nan")] * 8, 1), ([float("inf")] * 8, 0), ([1.0] * 8, None)]
    rows = [(i * 7 % 1009, v, label) for i, (v, label) in enumerate(rows)]
    return rows + [(None, [1.0] * 8, 1), rows[0], rows[0], (rows[5][0], [0.25] * 8, 0)]


def test_against_brute_force(spark, small):
    rows = odd_rows()
    plain = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("id", "x", "tile", "block", "size", "norm", "cell", "windows")})
    assert rows_of(H.hard_negatives(df, F.col("id") % 3 == 0)) == brute(plain, lambda i: i % 3 == 0)
    assert rows_of(H.hard_negatives(df, F.col("id") % 5 == 0, positives=2, negatives=3, least=50, most=100)) == brute(plain, lambda i: i % 5 == 0, 2, 3, 50, 100)


def test_one_label_in_a_third_and_labels_as_text(spark, small):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) + (2 if i % 3 == 0 else 0)).tolist(), "a:b" if i % 3 == 0 else f"{i % 7}:a") for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert rows_of(H.hard_negatives(df, F.col("id") % 4 == 0)) == brute(rows, lambda i: i % 4 == 0)


def test_nothing_to_find(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert rows_of(H.hard_negatives(spark.createDataFrame([], schema), F.col("id") % 2 == 0)) == set()
    one = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, None, 1)], schema)
    assert rows_of(H.hard_negatives(one, F.col("id") == 0)) == set()
    assert rows_of(H.hard_negatives(one, F.col("id") == 7)) == set()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(2)
    for spread in (1e-6, 0.01, 1.0):
        axes = rng.normal(size=(7, 12))
        axes /= np.linalg.norm(axes, axis=1, keepdims=True)
        base = rng.integers(-200, 200, 12)
        x = np.concatenate([base + np.round(rng.normal(size=(60, 12)) * 100 * spread), -base[None], np.zeros((1, 12)), 5 * axes[:2].round(1)]).astype(np.int64)
        norm = np.linalg.norm(x, axis=1)
        angles = np.arccos(np.clip(x / np.maximum(norm, 1)[:, None] @ axes.T, -1, 1)).astype(np.float32)
        least, most = H.bounds(angles, norm, angles, norm)
        scores = H.products(x, x)
        assert (scores == x @ x.T).all() and (least <= scores).all() and (scores <= most).all()


def test_products_of_large_numbers_are_exact_and_cut():
    a, b = np.array([[2**40, 3]]), np.array([[2**20, 7], [2**40, 1]])
    assert H.products(a, b).tolist() == [[2**60 + 21, 2**63 - 1]]
    assert H.products(np.array([[2**29 + 1, 1]]), np.array([[2**28 + 1, 1]])).tolist() == [[(2**29 + 1) * (2**28 + 1) + 1]]


def test_packed_numbers_come_back():
    rows = np.array([[1, -1, 0], [40_000, 2, 3], [-(1 << 40), 1, 1], [-32_767, 32_767, 0]])
    out = quantized.packed(rows)
    assert [r[0] for r in out] == [2, 4, 8, 2]
    assert (quantized.unpacked(pa.array(out, pa.binary())) == rows).all()
    assert quantized.packed(rows[3:]) == out[3:]
