"""Composite ids: pieces, performances and chunk numbers inside strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_chunk_id(chunk_id: Column) -> Column:
    """``a#b#c#perf.10`` as struct (piece_id, performance, chunk_index), split from the right.

    Without ``#`` the whole id is the piece and there is no performance; without ``.``, or with no number after it, the
    index is 0.
    """
    has_piece = chunk_id.contains("#")
    tail = F.regexp_extract(chunk_id, r"^.*#([^#]*)$", 1)
    dotted = tail.contains(".")
    index = F.coalesce(F.regexp_extract(tail, r"^.*\.([^.]*)$", 1).try_cast("int"), F.lit(0))
    return F.struct(
        F.when(has_piece, F.regexp_extract(chunk_id, r"^(.*)#[^#]*$", 1)).otherwise(chunk_id).alias("piece_id"),
        F.when(has_piece, F.when(dotted, F.regexp_extract(tail, r"^(.*)\.[^.]*$", 1)).otherwise(tail)).otherwise("").alias("performance"),
        F.when(has_piece & dotted, index).otherwise(0).alias("chunk_index"),
    )


def song_of_task(task_id: Column) -> Column:
    """The task id without its chunk number."""
    return F.regexp_replace(task_id, r"\.[^.]*$", "")


def entry_id(piece_id: Column, performance: Column) -> Column:
    return F.concat(F.replace(piece_id, F.lit("#"), F.lit("__")), F.lit("__"), performance)


def base_stem(stem: Column) -> Column:
    """A versioned stem without its sound font and its last version mark."""
    return F.regexp_replace(F.substring_index(stem, "~", 1), r"^(.*)_v.*$", "$1")


def resolve(path: Column, base: str) -> Column:
    """Absolute paths as they are, others under ``base``."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def relative_from(path: Column, names: list[str]) -> Column:
    """The part of a path from its first component among ``names``; the last component if there is none."""
    parts = F.split(path, "/")
    at = F.array_min(F.filter(F.array(*(F.array_position(parts, n) for n in names)), lambda x: x > 0))
    return F.when(at.isNotNull(), F.array_join(F.slice(parts, at.cast("int"), F.size(parts)), "/")).otherwise(F.element_at(parts, -1))


def repair_results(raw: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """A results table of strings with typed columns.

    A missing performance, and an index of 0, are filled from the task id where it has a dot; numbers that are missing
    or cannot be read are 0.
    """
    dotted = F.col("task_id").contains(".")
    parsed = parse_chunk_id(F.col("task_id"))
    index = F.coalesce(F.col("chunk_index").try_cast("int"), F.lit(0))
    blank = F.coalesce(F.col("performance"), F.lit("")) == ""
    return raw.withColumns({
        "performance": F.when(blank & dotted, parsed["performance"]).otherwise(F.coalesce("performance", F.lit(""))),
        "chunk_index": F.when((index == 0) & dotted, parsed["chunk_index"]).otherwise(index),
        **{m: F.coalesce(F.col(m).try_cast("double"), F.lit(0.0)) for m in metrics},
    })
