"""Measures in a table of score lines, and time along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(*keys: str, order: str = "line_no") -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def measures(lines: DataFrame, final: Column | None = None) -> DataFrame:
    """Measures of each document from ``lines`` (doc_id, line_no, kind, number of a barline or null).

    A measure runs from the line after its barline to the one before the next; interpretation lines at its head are
    left out; without a data line it is none. Data before the first barline is measure 0. A barline without a number
    goes on from the one before. The last measure ends with its last data line and has no ``line_barline``. Of the
    barlines that ``final`` marks the document's last one ends it, with all that comes after; earlier ones are barlines.
    """
    if final is not None:
        end = F.max(F.when(final, F.col("line_no"))).over(Window.partitionBy("doc_id"))
        lines = lines.withColumn("_end", end).where("_end is null or line_no < _end").drop("_end")
    order = _before("doc_id")
    bar = F.col("kind") == "bar"
    rows = lines.withColumn("bar", F.count_if(bar).over(order))
    rows = rows.withColumn("explicit", F.last(F.when(bar, F.col("number")), ignorenulls=True).over(order)).withColumn("explicit_at", F.max(F.when(bar & F.col("number").isNotNull(), F.col("bar"))).over(order))
    inside = ~bar & (F.col("kind") != "interp")
    groups = rows.groupBy("doc_id", "bar").agg(
        F.max("explicit").alias("explicit"), F.max("explicit_at").alias("explicit_at"), F.min(F.when(bar, F.col("line_no"))).alias("line_barline"),
        F.min(F.when(inside, F.col("line_no"))).alias("line_start"), F.max("line_no").alias("last_line"), F.max(F.when(F.col("kind") == "data", F.col("line_no"))).alias("last_data"),
    )
    is_last = F.col("bar") == F.max("bar").over(Window.partitionBy("doc_id"))
    number = F.when(F.col("bar") == 0, 0).otherwise(F.coalesce(F.col("explicit") + F.col("bar") - F.col("explicit_at"), F.col("bar")))
    found = groups.withColumn("is_last", is_last).where("last_data is not null")
    index = F.row_number().over(_before("doc_id", order="bar")) - 1
    return found.select(
        "doc_id", index.cast("long").alias("m_idx"), number.cast("long").alias("measure"), "line_start",
        F.when(F.col("is_last"), F.col("last_data")).otherwise(F.col("last_line")).alias("line_end"), F.when(~F.col("is_last"), F.col("line_barline")).alias("line_barline"),
    )


def beat_offsets(tokens: DataFrame) -> DataFrame:
    """``offset`` of each line: the sum of the longest durations of the lines before it in the document."""
    longest = tokens.groupBy("doc_id", "line_no").agg(F.max("dur").alias("longest"))
    return longest.withColumn("offset", F.coalesce(F.sum("longest").over(_before("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def last_final(lines: DataFrame, final: Column) -> DataFrame:
    """The last line of each document that ``final`` marks."""
    return lines.groupBy("doc_id").agg(F.max(F.when(final, F.col("line_no"))).alias("last_final"))


def header(lines: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """The first line of each kind in every document."""
    return lines.groupBy("doc_id").agg(*(F.min_by(F.when(test, F.col("line")), F.when(test, F.col("line_no"))).alias(name) for name, test in kinds.items()))


# How the first field of a header line of each kind begins.
KINDS = {"key_sig": r"^\*k\[", "clef": r"^\*clef", "staff": r"^\*staff", "instrument": r"^\*I"}


def metadata(lines: DataFrame) -> DataFrame:
    """Of every document the first line of each kind, as written, and ``first_measure``, the first number of a barline.

    ``time_sig``: ``*M`` with a slash. ``tempo``: ``*MM``; one with a slash is a meter where none came before. Lines
    that declare, split or join spines are of no kind; blanks around a line are passed over.
    """
    field = F.get(F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), "\t"), F.lit(0))
    rows = lines.select("doc_id", "line_no", "line", field.alias("field"))
    field = F.col("field")
    slash = field.contains("/")
    is_meter, number = field.startswith("*M") & slash, F.regexp_extract(field, "^=([0-9]+)", 1).try_cast("long")
    meters = F.count_if(is_meter).over(_before("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"is_meter": is_meter, "is_tempo": field.startswith("*MM") & (~slash | (F.coalesce(meters, F.lit(0)) > 0))})
    kinds = {"time_sig": F.col("is_meter")} | {k: field.rlike(p) for k, p in KINDS.items()} | {"tempo": F.col("is_tempo")}
    first = F.min_by(number, F.when(number.isNotNull(), F.col("line_no"))).alias("first_measure")
    return rows.groupBy("doc_id").agg(*(F.min_by(F.when(test, F.col("line")), F.when(test, F.col("line_no"))).alias(name) for name, test in kinds.items()), first)


def key_signature(line: Column) -> Column:
    """Sharps less flats of a ``*k[...]`` line, from -6 to 7."""
    inside = F.regexp_extract(line, r"\*k\[([^\]]*)\]", 1)
    count = F.length(inside) - F.length(F.replace(inside, F.lit("#"), F.lit(""))) - (F.length(inside) - F.length(F.replace(inside, F.lit("-"), F.lit(""))))
    return F.greatest(F.lit(-6), F.least(F.lit(7), count))


def marker_spans(markers: DataFrame, wanted: Column) -> DataFrame:
    """Each wanted marker with the time of the next marker of any kind as its end; the last ends where it starts."""
    following = F.lead("start_ms").over(_before("doc_id", order="m_idx"))
    return markers.withColumn("span_end", F.coalesce(following, F.col("start_ms"))).where(wanted)


def tempo_seconds(points: DataFrame, tempi: DataFrame) -> DataFrame:
    """Seconds at each ``offset`` (beats) of ``points`` under ``tempi`` (offset, bpm): segment lengths times 60 / bpm.

    The tempo of a point is the last one at or before it, or the first. One ordered pass a document over both tables.
    """
    order = Window.partitionBy("doc_id").orderBy("offset")
    lead = F.lead("offset").over(order)
    spans = tempi.withColumn("seconds", (lead - F.col("offset")) * 60 / F.col("bpm"))
    spans = spans.withColumn("start_sec", F.coalesce(F.sum("seconds").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    both = spans.select("doc_id", "offset", F.struct("offset", "start_sec", "bpm").alias("tempo"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("point")).unionByName(
        points.select("doc_id", "offset", F.lit(None).cast("struct<offset:bigint,start_sec:double,bpm:double>").alias("tempo"), F.lit(1).alias("side"), "point")
    )
    merged = Window.partitionBy("doc_id").orderBy("offset", "side")
    both = both.withColumn("tempo", F.coalesce(F.last("tempo", ignorenulls=True).over(merged), F.first("tempo", ignorenulls=True).over(merged.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return both.where("side = 1").select("doc_id", "point", "offset", (F.col("tempo.start_sec") + (F.col("offset") - F.col("tempo.offset")) * 60 / F.col("tempo.bpm")).alias("seconds"))
