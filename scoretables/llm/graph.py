"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoretables.llm import tables


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that aren't the smallest of their group, and that smallest node, for the groups these links form."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    found = [(x, r) for x in parent if (r := find(x)) != x]
    return np.array([x for x, _ in found], np.int64), np.array([r for _, r in found], np.int64)


def _local(batches):
    for b in batches:
        u, v = forest(b.column(0).to_numpy(), b.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _is_done(star: DataFrame) -> bool:
    """Whether every node has one parent, and no parent has a parent."""
    twice = star.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    above = star.join(star.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return twice.unionByName(above).isEmpty()


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``root`` (the smallest id that links reach) of every linked node but the roots themselves.

    Links stay in written tables; a round costs two joins. Every step's link count is at most the one before, plus one
    for a node. Joins are on plain tables, so a node with very many links is split by the adaptive skew join.
    Links with a null end, and of a node with itself, are ignored. The result has no row for a node without links.
    """
    ends = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}")
    star = tables.scratch(ends.mapInArrow(_local, "u long, v long"), "links")
    n = star.count()
    while n and not _is_done(star):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = tables.scratch(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", 2 * n)
        large = tables.scratch(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", 2 * n)
        least = tables.scratch(large.groupBy("u").agg(F.min("v").alias("m")), "least", 2 * n)
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        star = tables.scratch(large.join(least, "u").select(F.explode(pairs).alias("p")).select("p.u", "p.v").where("u > v").distinct(), "links", 2 * n)
    return star.select(F.col("u").alias("id"), F.col("v").alias("root"))


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (as connected() gives them) after further ``links`` (a, b): only links between different components are walked."""
    for end in ("a", "b"):
        links = links.join(roots.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    above = connected(links, "root_a", "root_b")
    moved = roots.join(above.select(F.col("id").alias("root"), F.col("root").alias("upper")), "root", "left").select("id", F.coalesce("upper", "root").alias("root"))
    return tables.scratch(moved.unionByName(above), "roots")
