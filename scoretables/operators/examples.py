"""Training examples from chunks: reasons to drop, text of a chunk, rhythm targets, tied expansions, drawn settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoretables.functions import tokens as T

# By notes of a complete group, its durations and the plain durations that take their place.
TUPLETS = {
    5: {5: 6, 10: 12, 80: 96, 160: 96},
    7: {7: 8, 14: 16, 28: 32, 56: 64},
    9: {18: 20, 36: 40},
    11: {11: 12, 22: 24, 44: 48, 88: 96},
    15: {15: 16, 30: 32, 60: 64},
}


def drop_reason(chunks: DataFrame) -> DataFrame:
    """Why a chunk is left out, or null: no measures (unless it is the first), a range out of bounds, unknown tokens."""
    reason = F.when(F.col("first_m").isNull() & (F.col("chunk_idx") > 0), "no_alignment").when(F.col("last_m") >= F.col("n_measures"), "out_of_range").when(F.col("has_oov"), "unknown_token")
    return chunks.withColumn("reason", reason)


def chunk_lines(chunks: DataFrame, measures: DataFrame, lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines of each chunk: the document's header, an opening barline, then the lines of its measures; the last line says
    whether the piece ends there."""
    first = measures.select("doc_id", F.col("m_idx").alias("first_m"), "line_start")
    last = measures.select("doc_id", F.col("m_idx").alias("last_m"), "line_end")
    spans = chunks.join(first, ["doc_id", "first_m"]).join(last, ["doc_id", "last_m"])
    body = spans.withColumn("line_no", F.explode(F.sequence("line_start", "line_end"))).join(lines.select("doc_id", "line_no", "line"), ["doc_id", "line_no"]).select("doc_id", "chunk_idx", "line_no", "line")
    head = chunks.join(headers, "doc_id").select("doc_id", "chunk_idx", F.lit(-1).cast("long").alias("line_no"), F.col("header").alias("line"))
    bar = chunks.select("doc_id", "chunk_idx", F.lit(0).cast("long").alias("line_no"), F.lit("=").alias("line"))
    end = chunks.select("doc_id", "chunk_idx", F.lit(1 << 40).cast("long").alias("line_no"), F.when(F.col("is_last_chunk"), "<eos>").otherwise("<continue>").alias("line"))
    return head.unionByName(bar).unionByName(body).unionByName(end)


def rhythm(shortest: DataFrame, lines: DataFrame) -> DataFrame:
    """``<bar>`` and the shortest duration of each data line, in order; a bar only where a data line comes next."""
    rows = lines.where(F.col("kind").isin("bar", "data")).select("doc_id", "line_no", "kind")
    following = F.lead("kind").over(Window.partitionBy("doc_id").orderBy("line_no"))
    rows = rows.withColumn("following", following).where("kind = 'data' or following = 'data'")
    return rows.join(shortest, ["doc_id", "line_no"], "left").select("doc_id", "line_no", F.when(F.col("kind") == "bar", "<bar>").otherwise(F.col("dur").cast("string")).alias("target"))


def compact(targets: DataFrame) -> DataFrame:
    """Numbers from 1 for the targets that occur, in their order, joined to the rows."""
    # Targets are durations and the bar: as few as the vocabulary has, whatever the number of rows.
    ids = targets.select("target").distinct().withColumn("target_id", F.row_number().over(Window.orderBy("target")))
    return targets.join(ids, "target")


def tied(tokens: DataFrame, parts: Column) -> DataFrame:
    """A note cut into ``parts`` equal tied ones: the first opens the tie, middle ones go on, the last closes it."""
    rows = tokens.withColumn("parts", parts.cast("int")).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    alone, first, last = F.col("parts") == 1, F.col("part") == 1, F.col("part") == F.col("parts")
    text = F.when(alone, F.col("token")).when(first, F.concat(F.lit("["), "token")).when(last, F.concat("token", F.lit("]"))).otherwise(F.concat("token", F.lit("_")))
    return rows.withColumn("token", text)


def split_breves(tokens: DataFrame) -> DataFrame:
    """Breves (``0``) and longs (``00``) as two or four whole notes, tied; as rests, untied. Other tokens stay one part."""
    pattern = r"^\[?(00|0)([^0-9.].*)$"
    length, rest = F.regexp_extract("token", pattern, 1), F.regexp_extract("token", pattern, 2)
    parts = F.when(length == "00", 4).when(length == "0", 2).otherwise(1)
    text = F.when(length != "", F.concat(F.lit("1"), rest)).otherwise(F.col("token"))
    whole = tokens.withColumns({"token": text, "alone": text, "rests": rest.startswith("r") & (length != ""), "whole": parts})
    return tied(whole, F.col("whole")).withColumn("token", F.when(F.col("rests"), F.col("alone")).otherwise(F.col("token"))).drop("alone", "rests", "whole")


def group_size(dur: Column) -> Column:
    """Notes of a complete group of this duration; null for durations that make none."""
    out = F.lit(None).cast("int")
    for size, table in TUPLETS.items():
        out = F.when(dur.isin(*table), size).otherwise(out)
    return out


def plain_tuplets(groups: DataFrame) -> DataFrame:
    """Members of complete groups in the plain duration of the table, the last one as a tied pair, so that a group of
    ``size`` notes takes the time of ``size`` + 1."""
    table = F.create_map(*(F.lit(x).cast("long") for of_size in TUPLETS.values() for pair in of_size.items() for x in pair))
    marks = F.when(F.col("in_group") == F.col("size") - 1, F.array(F.lit("["), F.lit("]"))).otherwise(F.array(F.lit("")))
    return groups.withColumns({"plain": F.try_element_at(table, F.col("dur")), "tie": F.explode(marks)})


# Dotted tuplet durations and the two plain ones, tied, that take their place.
DOTTED = {5: (5, 10), 10: (10, 20), 14: (14, 28), 18: (18, 36), 20: (20, 40)}


def dotted_pairs(tokens: DataFrame) -> DataFrame:
    """Dotted notes of the table as two tied ones: ``part`` (1 or 2), ``plain`` and ``tie``. ``tokens``: dur, dotted."""
    table = F.create_map(*(x for d, pair in DOTTED.items() for x in (F.lit(d).cast("long"), F.array(*(F.lit(p).cast("long") for p in pair)))))
    rows = tokens.where("dotted").withColumn("pair", F.try_element_at(table, F.col("dur"))).where("pair is not null")
    rows = rows.select("*", F.posexplode("pair").alias("at", "plain")).drop("pair")
    return rows.withColumns({"part": F.col("at") + 1, "tie": F.when(F.col("at") == 0, "[").otherwise("]")}).drop("at")


def has_ratio(text: Column) -> Column:
    """Whether a token is written with a ratio (``X%Y``), which the vocabulary has no name for."""
    return text.rlike(T.RATIO)


def ratio(text: Column) -> Column:
    """``X%Y`` as struct (num, den) of quarter notes: 4 Y / X; null if it is none."""
    x, y = (F.regexp_extract(text, r"([0-9]+)%([0-9]+)", i).try_cast("long") for i in (1, 2))
    return F.when(x > 0, F.struct((4 * y).alias("num"), x.alias("den")))


def drawn(rows: DataFrame, key: str, ranges: dict[str, tuple[float, float]], seed: int = 0) -> DataFrame:
    """A value of each setting, uniform in its range by the first 52 bits of a digest of key, setting and seed."""
    digest = lambda name: F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(name), F.lit(str(seed))))
    unit = lambda name: F.conv(F.substring(digest(name), 1, 13), 16, 10).cast("long") / float(1 << 52)
    return rows.withColumns({name: low + (high - low) * unit(name) for name, (low, high) in ranges.items()})


def paired_tasks(tasks: DataFrame, predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """Tasks with prediction and ground truth; for the others the reason."""
    p = predictions.select("task_id", F.lit(True).alias("predicted")).distinct()
    t = truths.select("task_id", F.lit(True).alias("known")).distinct()
    reason = F.when(F.col("known").isNull(), "no_ground_truth").when(F.col("predicted").isNull(), "no_prediction")
    return tasks.join(p, "task_id", "left").join(t, "task_id", "left").withColumn("reason", reason).drop("predicted", "known")
