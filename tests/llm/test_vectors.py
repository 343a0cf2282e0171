import random

import numpy as np
from pyspark.sql import functions as F

from scoretables.llm import queries
from scoretables.llm import vectors as V


def brute(rows, threshold=0.98):
    good = [(i, np.array(v, float), label) for i, v, label in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, x, k) in enumerate(good):
        for b, y, m in good[n + 1 :]:
            if k == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i), find(i) == i) for i in links}


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(None, 1), ([], 1), ([0.0] * 8, 1), ([float("nan")] * 8, 1), ([1.0, None] * 4, 2), ([float("inf")] * 8, 2), ([1.0] * 8, None), ([1.0] * 8, 1), ([2.0] * 8, 1), ([1.0] * 5, 1)]
    for k in (1, 2):
        for spread in (0.02, 0.06, 0.1):
            base = rng.normal(size=8)
            rows += [((base + rng.normal(size=8) * spread).astype(np.float32).tolist(), k) for _ in range(60)]
        rows += [(rng.normal(size=8).astype(np.float32).tolist(), k) for _ in range(60)]
        rows += [rows[-1]] * 4
    rows = [(i * 7 % 1009, v, k) for i, (v, k) in enumerate(rows)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"cell": F.lit(1), "rep": F.lit("r"), "n": F.lit(0)})
    V.TILE, keep = 16, V.TILE
    try:
        found = {r.id: (r.n_links, r.component_id, r.kept) for r in V.near_vectors(df).collect()}
    finally:
        V.TILE = keep
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]
    assert found == brute(rows)
    assert V.near_vectors(df.where("false")).count() == 0


def test_registered_query_and_null_ids(spark, sf, tmp_path):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op7_pca_tiles(spark, sf).collect()} == brute(rows)
    spark.createDataFrame([(None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (1, [1.0, 0.001], 1)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {tuple(r) for r in queries.op7_pca_tiles(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect()} == {(None, 0, None, True), (2, 1, 1, False), (1, 1, 1, True)}
