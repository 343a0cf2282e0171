"""Token tables: vocabularies, counts, sequences, tuplet groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoretables.functions import tokens as T

# The entries of the vocabulary, by kind, in the order in which they are numbered.
SPECIALS = ("<pad>", "<sos>", "<eos>", "<coc>", "<bar>", "<continue>", "<nl>", "<split>", "<merge>", "<*>")
METERS = ("<2>", "<3>", "<4>", "<5>", "<6>", "<7>", "<8>", "<9>", "<10>", "<12>", "<17>")
KEYS = ("<key:0>", "<key:1#>", "<key:2#>", "<key:3#>", "<key:4#>", "<key:5#>", "<key:6#>", "<key:7#>", "<key:1b>", "<key:2b>", "<key:3b>", "<key:4b>", "<key:5b>", "<key:6b>", "<key:7b>")
STRUCTURE = (".", "\t", "\n")
DURATIONS = ("0", "00", "1", "2", "4", "8", "16", "32", "64", "128", "0.", "00.", "1.", "2.", "4.", "8.", "16.", "32.", "64.", "3", "6", "12", "24", "48", "96", "20", "40", "112", "176")
MODIFIERS = ("[", "]", "_", "q", "Q", "P", "(", ")", "{", "}", "L", "J", ";")
ACCIDENTALS = ("-", "", "#")
#: Accidentals of key signatures in the order in which they are added.
SHARPS, FLATS = ("f#", "c#", "g#", "d#", "a#", "e#", "b#"), ("b-", "e-", "a-", "d-", "g-", "c-", "f-")


def pitches() -> list[str]:
    """The letters of nine octaves, from four capitals to five small letters, with each accidental."""
    heads = (letter * (4 - octave) if octave < 4 else letter.lower() * (octave - 3) for octave in range(9) for letter in "CDEFGAB")
    return [head + accidental for head in heads for accidental in ACCIDENTALS]


def vocabulary(spark: SparkSession) -> DataFrame:
    """``token``, ``id`` and ``kind``: specials, meters, keys, structure, durations, pitches and the rest, modifiers."""
    parts = {"special": SPECIALS, "meter": METERS, "key": KEYS, "structure": STRUCTURE, "duration": DURATIONS, "pitch": (*pitches(), "r"), "modifier": MODIFIERS}
    rows = [(t, kind) for kind, names in parts.items() for t in names]
    return spark.createDataFrame([(t, i, kind) for i, (t, kind) in enumerate(rows)], "token string, id int, kind string")


def key_tokens() -> dict[str, str]:
    """The key token of each signature: ``*k[]``, then one to seven sharps or flats in their usual order."""
    made = {"*k[]": KEYS[0]}
    for mark, order in (("#", SHARPS), ("b", FLATS)):
        made |= {f"*k[{''.join(order[:n])}]": f"<key:{n}{mark}>" for n in range(1, 8)}
    return made


def schema_tokens(meter: Column, key: Column) -> Column:
    """Tokens that follow a bar: the meter's beats (if the vocabulary has them) and unit, then the key's token."""
    beats, unit = (F.regexp_extract(meter, r"^\*M([0-9]+)/([0-9]+)", i) for i in (1, 2))
    beats = F.concat(F.lit("<"), beats, F.lit(">"))
    of_meter = F.when(beats.isin(*METERS), F.array(beats, unit)).otherwise(F.array().cast("array<string>"))
    found = T.lookup(T.key_name(key), key_tokens())
    of_key = F.when(found.isNotNull(), F.array(found)).otherwise(F.array().cast("array<string>"))
    return F.concat(of_meter, of_key)


def score_lines(lines: DataFrame) -> DataFrame:
    """The tokens of score lines (doc_id, line_no, line with fields between tabs), with blanks between them in ``text``.

    Notes give their factors, ``<coc>`` stands between fields, ``<nl>`` before a data line (or a line of splits and
    joins) that follows another one, ``<bar>`` and the meter and key in force for a barline. Splits and joins are
    ``<split>``, ``<merge>`` and ``<*>``. Meter and key are the last given before the bar; a bar before any has none.
    """
    fields = F.split(F.col("text"), "\t")
    one = lambda pattern: F.get(F.filter(fields, lambda x: x.rlike(pattern)), F.lit(0))
    rows = lines.select("doc_id", "line_no", F.regexp_replace("line", r"^\s+|\s+$", "").alias("text"))
    # Lines without tokens are dropped after the windows only: a condition that is pushed down makes every line twice.
    control, is_bar, silent = F.col("text").startswith("*"), F.col("text").startswith("="), F.coalesce(F.col("text"), F.lit("")).rlike("^(!|$)")
    move = F.array_join(F.transform(fields, lambda x: F.when(x == "*^", "<split>").when(x == "*v", "<merge>").otherwise("<*>")), " <coc> ")
    notes = T.line_tokens(F.when(~control & ~is_bar & ~silent, F.col("text")))
    rows = rows.select("doc_id", "line_no", is_bar.alias("is_bar"), F.when(control, one(r"^\*M.*/")).alias("meter"), F.when(control, one(r"^\*k\[")).alias("key"), (~silent & (~control | F.exists(fields, lambda x: x.isin("*^", "*v")))).alias("stays"), F.when(control, move).otherwise(notes).alias("text"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    kept = rows.withColumns({c: F.last(c, ignorenulls=True).over(order) for c in ("meter", "key")}).where("stays")
    bar = F.array_join(F.concat(F.array(F.lit("<bar>")), schema_tokens(F.col("meter"), F.col("key"))), " ")
    follows = F.lag(~F.col("is_bar")).over(order)
    data = F.when(follows, F.rtrim(F.concat(F.lit("<nl> "), "text"))).otherwise(F.col("text"))
    return kept.select("doc_id", "line_no", F.when(F.col("is_bar"), bar).otherwise(data).alias("text"))


def score_sequence(lines: DataFrame) -> DataFrame:
    """The token sequence of score lines, with ``<sos>`` and ``<eos>`` around a document: ``doc_id``, ``pos``, ``token``."""
    parts = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", " "))
    return _positions(score_lines(lines).select("doc_id", "line_no", parts.alias("parts")))


def score_bodies(lines: DataFrame) -> DataFrame:
    """The same in one ``body`` a document, with blanks between its ``n_tokens`` tokens; no token is moved alone."""
    text = F.col("text")
    size = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1)
    own = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), lambda x: x != "")
    body = F.array_join(F.concat(F.array(F.lit("<sos>")), own, F.array(F.lit("<eos>"))), " ")
    return score_lines(lines).groupBy("doc_id").agg((F.sum(size) + 2).alias("n_tokens"), body.alias("body"))


def _positions(line: DataFrame) -> DataFrame:
    """``doc_id``, ``pos`` and ``token`` of lines of ``parts``, with ``<sos>`` and ``<eos>`` around each document.

    A line knows how many tokens stand before it, so positions need no second order of single tokens.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    before = F.coalesce(F.sum(F.size("parts")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    rows = line.withColumns({"before": before, "is_first": F.lag("line_no").over(order).isNull(), "is_last": F.lead("line_no").over(order).isNull()})
    edge = lambda here, token: F.when(here, F.array(F.lit(token))).otherwise(F.array().cast("array<string>"))
    whole = F.concat(edge(F.col("is_first"), "<sos>"), "parts", edge(F.col("is_last"), "<eos>"))
    start = F.when(F.col("is_first"), 0).otherwise(F.col("before"))
    return rows.select("doc_id", start.alias("start"), F.posexplode(whole).alias("at", "token")).select("doc_id", (F.col("start") + F.col("at")).cast("int").alias("pos"), "token")


def unknown_durations(tokens: DataFrame) -> DataFrame:
    """Counts of durations that the vocabulary lacks, most frequent first, of tokens that are no ratios (``X%Y``)."""
    duration = F.regexp_extract("token", T.DURATION, 1)
    rows = tokens.where(~F.col("token").rlike(T.RATIO) & ~T.is_control(F.col("token"))).select(duration.alias("duration"))
    return rows.where((F.col("duration") != "") & ~F.col("duration").isin(*DURATIONS)).groupBy("duration").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "duration")


def frequencies(tokens: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent tokens of each document with their counts; ties by token."""
    counts = tokens.groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "token"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def dirty(tokens: DataFrame, top: int) -> DataFrame:
    """The ``top`` dirty tokens of the corpus by count, with their category; ties by token."""
    bad = tokens.where(T.is_dirty(F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))
    return bad.orderBy(F.desc("n"), "token").limit(top).withColumn("category", T.dirt(F.col("token")))


def dirty_categories(tokens: DataFrame) -> DataFrame:
    return tokens.where(T.is_dirty(F.col("token"))).groupBy(T.dirt(F.col("token")).alias("category")).agg(F.count("*").alias("n"), F.count_distinct("token").alias("n_tokens"))


def unknown(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """Counts of tokens that the vocabulary lacks."""
    return tokens.join(known.select("token"), "token", "left_anti").groupBy("token").agg(F.count("*").alias("n"))


def encoded(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Ids of each document in order; ``has_oov`` if any token has none."""
    found = tokens.join(vocab.select("token", "id"), "token", "left")
    pairs = F.array_sort(F.collect_list(F.struct("line_no", "spine", "id")))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.bool_or(F.col("id").isNull()).alias("has_oov"), F.transform(pairs, lambda x: x["id"]).alias("ids"))


def sequence(tokens: DataFrame) -> DataFrame:
    """Tokens with separators, in order: ``<coc>`` between spines, ``<nl>`` before a data line that follows one, ``<bar>``
    for barlines, ``<sos>`` and ``<eos>`` around each document. Long form: doc_id, pos, token."""
    rows = tokens.where(F.col("kind").isin("data", "bar")).groupBy("doc_id", "line_no", "kind")
    return sequence_of_lines(rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("spine", "token"))), lambda x: x["token"]).alias("parts")))


def sequence_of_lines(lines: DataFrame) -> DataFrame:
    """The same of lines (doc_id, line_no, kind) that have their tokens in order in ``parts``, of which none is moved alone."""
    lines = lines.where(F.col("kind").isin("data", "bar"))
    after = F.lag("kind").over(Window.partitionBy("doc_id").orderBy("line_no"))
    data = F.flatten(F.transform("parts", lambda p, i: F.when(i == 0, F.array(p)).otherwise(F.array(F.lit("<coc>"), p))))
    data = F.when(after == "data", F.concat(F.array(F.lit("<nl>")), data)).otherwise(data)
    line = lines.select("doc_id", "line_no", F.when(F.col("kind") == "bar", F.array(F.lit("<bar>"))).otherwise(data).alias("parts"))
    return _positions(line)


def by_bar(rows: DataFrame, is_bar: Column, order: str = "pos") -> DataFrame:
    """``bar_group``: bars before each token, so that a bar closes its group."""
    before = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("bar_group", F.coalesce(F.count_if(is_bar).over(before), F.lit(0)))


def carried(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """The last non-null value at or before each line; lines before the first get the first."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return lines.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w), F.first(value, ignorenulls=True).over(everything)))


def shortest(tokens: DataFrame) -> DataFrame:
    """The shortest token of each line: least duration, then spine."""
    return tokens.groupBy("doc_id", "line_no").agg(F.min_by(F.struct("dur", "spine", "token"), F.struct("dur", "spine")).alias("m")).select("doc_id", "line_no", "m.dur", "m.token")


def shortest_of_lines(lines: DataFrame) -> DataFrame:
    """The same of lines (doc_id, line_no) with an array ``parts`` of structs (dur, spine, token): a token a line is moved."""
    own = lines.select("doc_id", "line_no", F.array_min("parts").alias("m")).where("m is not null")
    return shortest(own.select("doc_id", "line_no", "m.dur", "m.spine", "m.token"))


def complete_tuplets(tokens: DataFrame, size: int | Column, is_tuplet: Column, resets: Column) -> DataFrame:
    """Tuplet tokens in complete runs of ``size`` of one duration in a spine. Anything that resets begins a new run."""
    order = Window.partitionBy("doc_id", "spine").orderBy("line_no")
    size = F.lit(size) if isinstance(size, int) else size
    rows = tokens.withColumns({"island": F.count_if(resets).over(order), "size": size}).where(is_tuplet)
    size = F.col("size")
    own = Window.partitionBy("doc_id", "spine", "island", "dur")
    rank, count = F.row_number().over(own.orderBy("line_no")) - 1, F.count("*").over(own)
    return rows.withColumns({"group_no": F.floor(rank / size), "n_groups": F.floor(count / size), "in_group": rank % size}).where("group_no < n_groups")
