"""Typed spine state of score lines: which type each column has, clocks of split spines, rescaled regions.

``lines`` are ``doc_id``, ``line_no`` and ``line``, fields between tabs. Only the fields of lines that change the state
(declarations, splits, joins, ends) are read in Python, in ordered passes over documents; fields of all other lines are
filtered or rewritten as array expressions.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoretables.functions import tokens as T
from scoretables.operators import passes as P

_MOVES = ("*^", "*v", "*-")


def _order() -> Window:
    return Window.partitionBy("doc_id").orderBy("line_no")


def fields() -> Column:
    return F.split("line", "\t")


def _is_move() -> Column:
    return F.col("line").startswith("*") & F.col("line").contains("\t") & F.exists(fields(), lambda x: x.isin(*_MOVES))


def is_data() -> Column:
    return ~F.col("line").rlike("^[=*!]") & (F.trim("line") != "")


def moved(state: list, row: list[str], joined=lambda group: group[0]) -> list:
    """The state after a line: ``*^`` doubles a column, a run of ``*v`` is one, ``*-`` ends one. Columns past the state's are ignored."""
    out, at = [], 0
    while at < min(len(row), len(state)):
        run = 1
        if row[at] == "*^":
            out += [state[at]] * 2
        elif row[at] == "*v":
            while at + run < min(len(row), len(state)) and row[at + run] == "*v":
                run += 1
            out.append(joined(state[at : at + run]))
        elif row[at] != "*-":
            out.append(state[at])
        at += run
    return out


def _types():
    """A pass over a document's lines: the types before each, from the fields of those that change them."""
    state = None

    def step(row):
        nonlocal state
        before = state
        if row is not None:
            state = row if row[0].startswith("**") else moved(state or [], row)
        return (before,)

    return step


def typed(lines: DataFrame) -> DataFrame:
    """Lines with ``types``: the type of each of their columns; null before a declaration and for lines of one column."""
    declares = F.col("line").startswith("**") & F.col("line").contains("\t")
    rows = lines.withColumn("turn", F.when(F.col("doc_id").isNotNull() & (declares | _is_move()), fields()))
    both = P.scanned(rows, ["turn"], {"before": "array<string>"}, _types)
    return both.withColumn("types", F.when(F.col("line").contains("\t"), F.when(declares, fields()).otherwise(F.col("before")))).drop("turn", "before")


def only_types(lines: DataFrame, *keep: str) -> DataFrame:
    """Lines with their columns of the given types only. Comments on the whole, empty lines, lines of one column and all
    before a declaration stay as they are; lines without a column of these types go."""
    rows = typed(lines)
    kept = F.filter(fields(), lambda x, i: F.coalesce(F.get("types", i), F.lit("")).isin(*keep))
    whole = F.col("types").isNull() | F.col("line").startswith("!!!") | (F.trim("line") == "")
    text = F.when(whole, F.col("line")).when(F.size(kept) > 0, F.array_join(kept, "\t"))
    return rows.withColumn("line", text).where("line is not null").drop("types")


def duration(token: Column) -> Column:
    """Quarter notes of a token's first note as struct (num, den): the number anywhere in it, dots anywhere, grace notes
    0; null for null tokens and those without a number."""
    first = F.get(F.split(token, " "), F.lit(0))
    n = F.regexp_extract(first, "([0-9]+)", 1).try_cast("long")
    up = F.pow(F.lit(2), F.length(F.regexp_replace(first, r"[^.]", ""))).cast("long")
    whole = lambda a, b: F.struct(a.cast("long").alias("num"), b.cast("long").alias("den"))
    num, den = F.when(n == 0, 8).otherwise(4), F.when(n == 0, 1).otherwise(n)
    plain = F.when(n.isNotNull(), whole(num * (2 * up - 1), den * up))
    return F.when(F.coalesce(token, F.lit("")).isin("", ".") | token.rlike("^[!*=]"), None).when(F.lower(token).contains("q"), whole(F.lit(0), F.lit(1))).otherwise(plain)


def _fraction(d) -> Fraction | None:
    return None if d is None else Fraction(int(d["num"]), int(d["den"]))


def _lags(rows: list[tuple]) -> list[tuple]:
    """For each line before which columns fall behind others of their family, by how much: 64ths of a quarter note."""
    out = []
    clocks, family, split, families = [Fraction(0)] * 2, [0, 1], False, 2
    for line_no, kind, row, lengths in rows:
        if kind == "move":
            width = max(len(row), len(clocks))
            clocks, family = [*clocks, *[Fraction(0)] * width][:width], [*family, *range(len(family), width)][:width]
            clocks = moved(clocks, row, max)
            family = moved(family, row, lambda group, new=families: new)
            families, split = families + ("*v" in row), (split or "*^" in row) and len(clocks) > 2
            continue
        steps = [_fraction(d) for d in lengths]
        clocks, family = [*clocks, *[Fraction(0)] * len(steps)][: max(len(steps), len(clocks))], [*family, *range(len(family), len(steps))]
        if split:
            groups = defaultdict(list)
            for j, own in enumerate(family):
                if kind == "bar" or j < len(steps) and steps[j]:
                    groups[own].append(j)
            behind = {}
            for columns in groups.values():
                front = max(clocks[j] for j in columns)
                behind |= {j: front - clocks[j] for j in columns if clocks[j] < front}
                for j in columns:
                    clocks[j] = front
            if behind:
                out.append((line_no, [int(behind[j] * 64) if j in behind else None for j in range(len(clocks))]))
        if kind == "data":
            for j, step in enumerate(steps):
                clocks[j] += step or 0
    return out


def caught_up(lines: DataFrame) -> DataFrame:
    """Lines with rests where columns of a split spine fall behind each other, as lines of ``sub`` 0 before their line.

    Columns that come from one spine by splits are a family and have one clock at barlines and where several of them
    begin notes. A join makes a family of its own, at the latest clock. Only documents with splits take part.
    """
    kind = F.when(F.col("line").contains("\t") & (F.col("line").contains("*^") | F.col("line").contains("*v")), "move").when(F.col("line").startswith("="), "bar").when(is_data(), "data")
    split = lines.where(F.col("line").contains("*^")).select("doc_id").distinct()
    lengths = F.transform(fields(), duration)
    rows = lines.join(split, "doc_id", "left_semi").withColumn("kind", kind).where("kind is not null").select("doc_id", "line_no", "kind", fields().alias("fields"), F.when(F.col("kind") == "data", lengths).otherwise(F.array()).alias("lengths"))
    found = P.grouped(rows, ["doc_id"], ["line_no"], {"line_no": "long", "behind": "array<long>"}, _lags)
    # Less than a 64th of a quarter is still a rest, the shortest.
    rest = lambda n: F.when(n.isNull(), ".").when(n == 0, "64r").otherwise(T.rests(n))
    added = found.select("doc_id", "line_no", F.lit(0).alias("sub"), F.array_join(F.transform("behind", rest), "\t").alias("line"))
    return added.unionByName(lines.select("doc_id", "line_no", F.lit(1).alias("sub"), "line"))


def divided(token: Column, factor: Column) -> Column:
    """A token with the number of every note divided by ``factor`` (at least 1), after opening ties and slurs."""
    number = lambda p: F.regexp_extract(p, r"^[\[({]*([0-9]+)", 1)
    start = lambda p: F.regexp_extract(p, r"^([\[({]*)", 1)
    lower = lambda p: F.greatest(F.lit(1).cast("long"), F.floor(number(p).cast("long") / factor)).cast("string")
    part = lambda p: F.when(number(p) == "", p).otherwise(F.concat(start(p), lower(p), F.substr(p, F.length(start(p)) + F.length(number(p)) + 1)))
    return F.array_join(F.transform(F.split(token, " "), part), " ")


def _slots(rows: list[tuple]) -> list[tuple]:
    """The place of every note of a region among the region's distinct onsets. Clocks of columns start behind what they played since the barline."""
    clocks: dict[int, Fraction] = defaultdict(Fraction)
    onsets = []
    for line_no, inside, column, length in rows:
        if inside:
            onsets.append((clocks[column], line_no, column))
        clocks[column] += _fraction(length) or 0
    place = {t: i for i, t in enumerate(sorted({t for t, _, _ in onsets}))}
    return [(n, c, place[t], len(place)) for t, n, c in onsets]


def _scales_after(rows: list[tuple]) -> list[tuple]:
    """After each line with marks: the factor of every column, the region's number (0: none) and whether it goes on."""
    out: list[tuple] = []
    factors: dict[int, int] = {}
    cues: set[int] = set()
    region, left_alone = 0, set()
    for line_no, row in rows:
        before = bool(factors)
        for column, token in enumerate(row):
            name, _, number = token.partition(":")
            if name == "*rscale" and number.isdigit():
                factors.pop(column, None)
                factors |= {column: int(number)} if int(number) > 1 else {}
            elif name in ("*cue", "*Xcue"):
                (cues.add if name == "*cue" else cues.discard)(column)
        region += bool(factors) and not before
        if cues & set(factors):
            left_alone.add(region)
        out.append((line_no, region if before or factors else 0, bool(factors), [factors.get(c) for c in range(max(factors, default=-1) + 1)]))
    return [(n, 0, False, []) if r in left_alone else (n, r, on, f) for n, r, on, f in out]


def regions(lines: DataFrame) -> DataFrame:
    """Lines with ``region`` and ``factors``: ``*rscale:N`` in force, by column.

    A region is a stretch of lines in which some column has a factor over 1, from the line that opens it to the one that
    ends it, or the document's end. Regions in which such a column is a cue are none: their length is not heard.
    """
    marks = lines.where(F.col("line").rlike(r"^\*(?!\*)") & F.exists(fields(), lambda x: x.rlike(r"^\*(rscale:[0-9]+|cue|Xcue)$")))
    state = P.grouped(marks.select("doc_id", "line_no", fields().alias("fields")), ["doc_id"], ["line_no"], {"line_no": "long", "region": "long", "on": "boolean", "factors": "array<int>"}, _scales_after)
    own = F.struct("region", "on", "factors")
    both = lines.join(state.select("doc_id", "line_no", own.alias("own")), ["doc_id", "line_no"], "left").withColumn("state", F.last("own", ignorenulls=True).over(_order()))
    inside = F.col("state.on") | (F.col("own.region") > 0)
    return both.withColumns({"region": F.when(inside, F.col("state.region")), "factors": F.col("state.factors")}).drop("own", "state")


def reflowed(lines: DataFrame) -> DataFrame:
    """Lines with all regions resolved: notes of rescaled columns have the length that is heard, lines stand where some
    column has an onset, and the marks are gone. In the order of ``line_no``, ``place``, ``sub``.

    Other lines of a region keep their place among its data lines, in proportion. A column keeps the last of several
    notes at one onset.
    """
    rows = regions(lines).withColumns({"is_data": is_data(), "bars": F.count_if(F.col("line").startswith("=")).over(_order())})
    inside = rows.where("region is not null")
    first_data = F.when(F.col("is_data"), F.col("line_no"))
    spans = inside.groupBy("doc_id", "region").agg(F.min("line_no").alias("start"), F.min_by("bars", "line_no").alias("bars"), F.min_by(F.size(fields()), first_data).alias("width"), F.count_if("is_data").alias("old"))
    played = rows.where("is_data").drop("region").join(spans.where("width > 0"), ["doc_id", "bars"]).where("line_no < start").select("doc_id", "region", "line_no", "line", "width", "factors", F.lit(False).alias("inside"))
    own = inside.where("is_data").join(spans.select("doc_id", "region", "width"), ["doc_id", "region"]).select("doc_id", "region", "line_no", "line", "width", "factors", F.lit(True).alias("inside"))
    notes = played.unionByName(own).select("doc_id", "region", "line_no", "inside", "width", "factors", F.posexplode(fields()).alias("column", "token")).where("token not in ('', '.') and column < width")
    factor = F.when(F.col("inside"), F.get("factors", F.col("column")))
    notes = notes.withColumn("token", F.when(factor > 1, divided(F.col("token"), factor)).otherwise(F.col("token"))).withColumn("length", duration(F.col("token")))
    slots = P.grouped(notes.select("doc_id", "region", "line_no", "inside", "column", "length"), ["doc_id", "region"], ["line_no", "column"], {"line_no": "long", "column": "int", "slot": "long", "slots": "long"}, _slots)
    sounding = notes.where("inside").join(slots, ["doc_id", "region", "line_no", "column"]).groupBy("doc_id", "region", "slot", "column", "slots").agg(F.max_by("token", "line_no").alias("token"))
    line = sounding.groupBy("doc_id", "region", "slot").agg(F.map_from_entries(F.collect_list(F.struct("column", "token"))).alias("row"))
    line = line.join(spans.select("doc_id", "region", "start", "width"), ["doc_id", "region"])
    columns = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.coalesce(F.try_element_at("row", c), F.lit(".")))
    data = line.select("doc_id", F.col("start").alias("line_no"), F.col("slot").alias("place"), F.lit(1 << 40).alias("sub"), F.array_join(columns, "\t").alias("line"))

    plain = F.transform(fields(), lambda x: F.when(x.rlike(r"^\*rscale:"), "*").otherwise(x))
    marked = F.col("line").rlike(r"^\*(?!\*)")
    before = F.count_if("is_data").over(Window.partitionBy("doc_id", "region").orderBy("line_no"))
    other = inside.withColumn("before", before).where("not is_data").where(~marked | F.exists(plain, lambda x: x != "*"))
    new = slots.groupBy("doc_id", "region").agg(F.first("slots").alias("new"))
    other = other.join(spans.select("doc_id", "region", "start", "old"), ["doc_id", "region"]).join(new, ["doc_id", "region"], "left")
    place = F.when(F.col("old") > 0, F.ceil(F.col("before") * F.coalesce("new", F.lit(0)) / F.col("old"))).otherwise(0)
    other = other.select("doc_id", F.col("start").alias("line_no"), place.cast("long").alias("place"), (F.col("line_no") - F.col("start")).alias("sub"), F.when(marked, F.array_join(plain, "\t")).otherwise(F.col("line")).alias("line"))
    outside = rows.where("region is null").select("doc_id", "line_no", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("sub"), "line")
    return outside.unionByName(data).unionByName(other)
