"""Repeat expansion: sections in playback order, and the map back to original measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def occurrences(order: DataFrame) -> DataFrame:
    """``order`` (doc_id, order_pos, section): how often the section came before, and whether this is a repeat."""
    seen = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("order_pos")) - 1
    return order.withColumn("occurrence", seen).withColumn("is_repeat", F.col("occurrence") > 0)


def endings(order: DataFrame) -> DataFrame:
    """``ending`` of a section named like another with a last 1 or 2: first or second, if its sibling is there."""
    names = order.select("doc_id", "section").distinct()
    base = F.regexp_extract("section", "^(.*)[12]$", 1)
    digit = F.regexp_extract("section", "([12])$", 1)
    sibling = F.concat(base, F.when(digit == "1", "2").otherwise("1"))
    pairs = names.where(digit != "").select("doc_id", "section", sibling.alias("sibling")).join(names.select("doc_id", F.col("section").alias("sibling")), ["doc_id", "sibling"], "left_semi")
    ending = F.when(F.col("section").endswith("1"), "first").otherwise("second")
    return order.join(pairs.select("doc_id", "section", ending.alias("ending")), ["doc_id", "section"], "left")


def expanded(order: DataFrame, sections: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines in playback order: each section's lines as often as it is played. Sections: doc_id, section, first, last."""
    spans = order.join(sections, ["doc_id", "section"]).withColumn("line_no", F.explode(F.sequence("first", "last")))
    rows = spans.join(lines.select("doc_id", "line_no", "line", "kind"), ["doc_id", "line_no"])
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("order_pos", "line_no"))
    return rows.withColumn("expanded_line", at.cast("long")).select("doc_id", "expanded_line", "line_no", "section", "order_pos", "line", "kind")


def glue_lines(order: DataFrame, widths: DataFrame, base: int = 2) -> DataFrame:
    """Lines of joins or splits, one spine at a time, where a section begins with another number of spines than the one
    played before it ends with (``base`` before the first). Widths: doc_id, section, first_width, last_width."""
    rows = order.join(widths, ["doc_id", "section"])
    before = F.coalesce(F.lag("last_width").over(Window.partitionBy("doc_id").orderBy("order_pos")), F.lit(base))
    rows = rows.withColumn("before", before).where("before <> first_width")
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), (F.abs(F.col("before") - F.col("first_width")) - 1).cast("long"))))
    joins = F.concat(F.repeat(F.lit("*\t"), (F.col("before") - F.col("step") - 2).cast("int")), F.lit("*v\t*v"))
    splits = F.concat(F.repeat(F.lit("*\t"), (F.col("before") + F.col("step") - 1).cast("int")), F.lit("*^"))
    return rows.select("doc_id", "order_pos", "section", "step", F.when(F.col("before") > F.col("first_width"), joins).otherwise(splits).alias("line"))


def renumbered(lines: DataFrame, order: str) -> DataFrame:
    """New barline numbers in the new order, from 1; data before the first barline is measure 0."""
    number = F.count_if(F.col("kind") == "bar").over(Window.partitionBy("doc_id").orderBy(order))
    return lines.withColumn("new_measure", number)


def measure_map(order: DataFrame, sections: DataFrame, lines: DataFrame) -> DataFrame:
    """For every measure of the expanded order the original ``measure`` and the ``section`` it is from, with the section's
    ``occurrence`` and ``ending``."""
    is_bar = F.col("kind") == "bar"
    own = lines.select("doc_id", "line_no", F.count_if(is_bar).over(Window.partitionBy("doc_id").orderBy("line_no")).alias("measure"))
    played = renumbered(expanded(order, sections, lines), "expanded_line").join(own, ["doc_id", "line_no"])
    first = played.groupBy("doc_id", "new_measure").agg(F.min_by(F.struct("measure", "order_pos"), "expanded_line").alias("f"))
    at = occurrences(order).join(endings(order).select("doc_id", "order_pos", "ending"), ["doc_id", "order_pos"])
    return first.select("doc_id", "new_measure", "f.measure", "f.order_pos").join(at, ["doc_id", "order_pos"]).select("doc_id", "new_measure", "measure", "section", "occurrence", "ending")


def aligned(mapping: DataFrame, measures: DataFrame, inherit: bool = False) -> DataFrame:
    """Every measure of an expanded score with the entry of the map at its place: ``original`` and ``section``.

    Measures past the map's end have null and no section, or with ``inherit`` the map's last entry. Documents without a
    map are their own originals. Entries past the last measure fall out. ``mapping``: doc_id, pos, original, section;
    ``measures``: doc_id, pos, measure.
    """
    known = mapping.groupBy("doc_id").agg(F.max_by(F.struct("original", "section"), "pos").alias("last"))
    entry = mapping.select("doc_id", "pos", F.struct("original", "section").alias("entry"))
    rows = measures.join(entry, ["doc_id", "pos"], "left").join(known, "doc_id", "left")
    found = F.coalesce("entry", "last") if inherit else F.col("entry")
    original = F.when(F.col("last").isNull(), F.col("measure")).otherwise(found["original"])
    return rows.select("doc_id", "pos", "measure", original.alias("original"), F.coalesce(found["section"], F.lit("")).alias("section"))


def ratio(order: DataFrame, sections: DataFrame) -> DataFrame:
    """Expanded lines over original ones of each document."""
    size = F.col("last") - F.col("first") + 1
    played = order.join(sections, ["doc_id", "section"]).groupBy("doc_id").agg(F.sum(size).alias("expanded_lines"))
    own = sections.groupBy("doc_id").agg(F.sum(size).alias("lines"))
    return own.join(played, "doc_id").withColumn("ratio", F.round(F.col("expanded_lines") / F.col("lines"), 9))
