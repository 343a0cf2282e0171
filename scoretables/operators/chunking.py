"""Windows over measures and frames, and what falls into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding(measures: DataFrame, bars: int = 5, stride: int = 1) -> DataFrame:
    """Windows of ``bars`` measures, every ``stride``; the index counts windows that are dropped later too."""
    order = Window.partitionBy("doc_id").orderBy("m_idx")
    return (
        measures.withColumns({"last_measure": F.lead("measure", bars - 1).over(order), "window_end": F.lead("end_ms", bars - 1).over(order)})
        .where((F.col("m_idx") % stride == 0) & F.col("last_measure").isNotNull())
        .select("doc_id", F.floor(F.col("m_idx") / stride).alias("chunk_index"), F.col("measure").alias("start_measure"), F.col("last_measure").alias("end_measure"), "start_ms", F.col("window_end").alias("end_ms"))
    )


def frame_chunks(lengths: DataFrame, chunk: int = 24_000, overlap: int = 12_000, ratio: float = 0.5, keep_short: bool = False) -> DataFrame:
    """Overlapping chunks of ``n_frames``: chunk k starts at k * stride and exists while the one before has not reached
    the end and at least ``ratio`` of a chunk is left. A row shorter than that has none, unless ``keep_short``."""
    stride, least = chunk - overlap, int(chunk * ratio)
    by_rest = F.floor((F.col("n_frames") - least) / stride)
    by_reach = F.greatest(F.lit(0), F.ceil((F.col("n_frames") - chunk) / stride))
    last = F.least(by_rest, by_reach)
    last = F.when(F.col("n_frames") >= least, last).otherwise(0 if keep_short else -1)
    rows = lengths.withColumn("last_chunk", last).where("last_chunk >= 0").withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_chunk").cast("long"))))
    start = F.col("chunk_idx") * stride
    return rows.withColumns({"start_frame": start, "end_frame": F.least(start + chunk, F.col("n_frames")), "is_last_chunk": F.col("chunk_idx") == F.col("last_chunk")}).drop("last_chunk")


def with_dense_split(chunks: DataFrame, most_tokens: int, chunk: int = 12_000, overlap: int = 6_000, ratio: float = 0.5) -> DataFrame:
    """Chunks whose ``n_tokens`` (null if unknown) is over the budget are replaced by shorter ones inside their own bounds.

    A dense chunk that is shorter than the least shorter chunk goes without one. ``part`` numbers the parts (0 if whole).
    """
    dense = F.coalesce(F.col("n_tokens") > most_tokens, F.lit(False))
    whole = chunks.where(~dense).withColumn("part", F.lit(0).cast("long"))
    inner = chunks.where(dense).select("doc_id", F.col("chunk_idx").alias("outer"), F.col("start_frame").alias("from"), (F.col("end_frame") - F.col("start_frame")).alias("n_frames"), "n_tokens")
    parts = frame_chunks(inner, chunk, overlap, ratio)
    parts = parts.select("doc_id", F.col("outer").alias("chunk_idx"), (F.col("from") + F.col("start_frame")).alias("start_frame"), (F.col("from") + F.col("end_frame")).alias("end_frame"), "n_tokens", F.col("chunk_idx").alias("part"))
    return whole.select(parts.columns).unionByName(parts)


def recovered(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """``has_oov`` of each chunk from its own lines: a document with unknown tokens loses only the chunks that hold them.

    ``chunks``: doc_id, chunk_idx, line_start, line_end; ``lines``: doc_id, line_no, has_oov.
    """
    spread = chunks.withColumn("line_no", F.explode(F.sequence("line_start", "line_end"))).join(lines, ["doc_id", "line_no"], "left")
    return spread.groupBy("doc_id", "chunk_idx").agg(F.coalesce(F.bool_or("has_oov"), F.lit(False)).alias("has_oov"))


def guidance_bounds(tokens: DataFrame, measures: DataFrame, spans: DataFrame) -> DataFrame:
    """``low`` and ``high`` of each token: the time of its measure as a share of the chunk, from 0 to 1.

    ``tokens``: doc_id, pos, is_bar, is_note; a token is in the measure whose number is the count of bars before it, or in
    the last one. ``measures``: doc_id, m_idx (from 0), start, end; ``spans``: doc_id and the chunk's start and end.
    Tokens that are neither bars nor notes, and those of measures without width, have -1 in both.
    """
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = tokens.withColumn("bars", F.coalesce(F.count_if("is_bar").over(before), F.lit(0)))
    n = measures.groupBy("doc_id").agg(F.max("m_idx").alias("last_m"))
    rows = rows.join(n, "doc_id", "left").withColumn("m_idx", F.least("bars", "last_m"))
    timed = measures.select("doc_id", "m_idx", F.col("start").alias("m_start"), F.col("end").alias("m_end")).join(spans.select("doc_id", F.col("start").alias("c_start"), F.col("end").alias("c_end")), "doc_id").where("c_end > c_start")
    share = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(t) - F.col("c_start")) / (F.col("c_end") - F.col("c_start"))))
    timed = timed.select("doc_id", "m_idx", share("m_start").alias("low"), share("m_end").alias("high")).where("high > low")
    rows = rows.join(timed, ["doc_id", "m_idx"], "left")
    known = (F.col("is_bar") | F.col("is_note")) & F.col("low").isNotNull()
    return rows.select("doc_id", "pos", *(F.when(known, F.col(c)).otherwise(-1.0).alias(c) for c in ("low", "high")))


def measures_in(chunks: DataFrame, measures: DataFrame, width: int = 10_000) -> DataFrame:
    """First and last measure that overlaps each chunk [start, end): an equi-join on time buckets of ``width``."""
    left = chunks.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest("start", F.col("end") - 1)) / width))))
    right = measures.select("doc_id", "m_idx", "start_ms", "end_ms", F.explode(F.sequence(F.floor(F.col("start_ms") / width), F.floor(F.greatest("start_ms", F.col("end_ms") - 1) / width))).alias("bucket"))
    met = left.join(right, ["doc_id", "bucket"]).where((F.col("end_ms") > F.col("start")) & (F.col("start_ms") < F.col("end")))
    return met.groupBy("doc_id", "chunk_idx").agg(F.min("m_idx").alias("first_m"), F.max("m_idx").alias("last_m"))


def chunk_tokens(chunks: DataFrame, measures: DataFrame, tokens: DataFrame, width: int = 10_000) -> DataFrame:
    """Chunks [start, end) with ``n_tokens``: those of all lines of the measures that they overlap. Sums up to each measure
    are made once, so a chunk looks up two of them."""
    per_line = tokens.groupBy("doc_id", "line_no").agg(F.count("*").alias("n"))
    own = measures.withColumn("line_no", F.explode(F.sequence("line_start", "line_end"))).join(per_line, ["doc_id", "line_no"], "left").groupBy("doc_id", "m_idx").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("doc_id").orderBy("m_idx"))
    sums = own.select("doc_id", "m_idx", (upto - F.col("n")).alias("before"), upto.alias("upto"))
    met = measures_in(chunks, measures, width)
    first, last = sums.select("doc_id", F.col("m_idx").alias("first_m"), "before"), sums.select("doc_id", F.col("m_idx").alias("last_m"), "upto")
    found = met.join(first, ["doc_id", "first_m"]).join(last, ["doc_id", "last_m"]).select("doc_id", "chunk_idx", (F.col("upto") - F.col("before")).alias("n_tokens"))
    return chunks.join(found, ["doc_id", "chunk_idx"], "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))


def window_lines(windows: DataFrame, measures: DataFrame) -> DataFrame:
    """Line range of each window by measure number; of measures with one number the last counts; else no row."""
    last = measures.groupBy("doc_id", "measure").agg(F.max_by(F.struct("line_start", "line_end"), "m_idx").alias("at"))
    first = last.select("doc_id", F.col("measure").alias("start_measure"), F.col("at.line_start").alias("line_start"))
    final = last.select("doc_id", F.col("measure").alias("end_measure"), F.col("at.line_end").alias("line_end"))
    return windows.join(first, ["doc_id", "start_measure"]).join(final, ["doc_id", "end_measure"]).select("doc_id", "chunk_index", "start_measure", "end_measure", "line_start", "line_end")


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Measures of two sides by list position."""
    return left.join(right, ["doc_id", "m_idx"])


def unaligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Documents whose two sides are both there but differ in number."""
    a = left.groupBy("doc_id").agg(F.count("*").alias("n_left"))
    b = right.groupBy("doc_id").agg(F.count("*").alias("n_right"))
    return a.join(b, "doc_id").where("n_left <> n_right")


def stitched(chunk_measures: DataFrame, bounds: DataFrame) -> DataFrame:
    """Measures kept of overlapping chunks: each overlap is cut at its middle.

    ``chunk_measures``: doc_id, chunk_idx, j, tokens; ``bounds``: doc_id, chunk_idx, start, end. A measure's end is
    estimated from its share of the chunk's tokens; the cut is before the first measure that ends at or after it.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_idx")
    cuts = bounds.withColumns({"left_cut": (F.col("start") + F.lag("end").over(order)) / 2, "right_cut": (F.lead("start").over(order) + F.col("end")) / 2})
    within = Window.partitionBy("doc_id", "chunk_idx")
    running = F.sum("tokens").over(within.orderBy("j")) / F.sum("tokens").over(within)
    rows = chunk_measures.join(cuts, ["doc_id", "chunk_idx"]).withColumn("end_at", F.col("start") + running * (F.col("end") - F.col("start")))
    n = F.count("*").over(within)
    first_after = lambda cut: F.coalesce(F.min(F.when(F.col("end_at") >= cut, F.col("j"))).over(within), n)
    rows = rows.withColumns({"from": F.when(F.col("left_cut").isNull(), 0).otherwise(first_after(F.col("left_cut"))), "to": F.when(F.col("right_cut").isNull(), n).otherwise(first_after(F.col("right_cut")))})
    return rows.where("j >= `from` and j < `to`").select("doc_id", "chunk_idx", "j", "tokens")
