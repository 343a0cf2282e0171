"""Durations that the vocabulary has no name for, as ones it has: even spreads, nearest values, runs written with ratios.

All arithmetic is in whole numbers. Values are fractions of a whole note. A distinct problem (a ratio and how often it
comes in a row) is solved once for a slice of a partition.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of the durations that stand in for others, in the order in which ties are decided.
PLAIN = ("0", "1", "2", "4", "8", "16", "32", "64", "128")
WITH_DOT = ("0.", "1.", "2.", "4.", "8.", "16.", "32.", "64.")
TRIPLETS = ("3", "6", "12", "24", "48", "96")
OTHERS = ("20", "40", "112", "176")
#: What a note of 1/44 becomes, and what all others are compared with first.
SHORTEST, SHORTEST_AS = "176", (1, 44)
#: Durations that the vocabulary lacks and that come in groups: cadenzas, nines, thirteens, seventeens, nineteens, stray ones.
GROUPED = ("42", "21", "66", "58", "82", "62", "54", "46", "9", "18", "36", "72", "13", "26", "52", "104", "17", "34", "68", "19", "38", "76", "5", "7", "10", "11", "14", "22", "23", "28")
#: Notes of a group that is solved, at most.
LARGEST_GROUP = 30
#: How a ratio is written.
RATIO = r"([0-9]+)%([0-9]+)"


def value(name: str) -> tuple[int, int]:
    """Numerator and denominator of a duration's name."""
    n, dotted = int(name.rstrip(".")), name.endswith(".")
    num, den = (2, 1) if n == 0 else (1, n)
    num, den = (3 * num, 2 * den) if dotted else (num, den)
    return num // math.gcd(num, den), den // math.gcd(num, den)


def values() -> list[tuple[str, int, int]]:
    return [(name, *value(name)) for name in (*PLAIN, *WITH_DOT, *TRIPLETS, *OTHERS)]


#: A multiple of all denominators, in whose parts all values are whole numbers.
PARTS = math.lcm(*(den for _, _, den in values()), SHORTEST_AS[1])
#: Numbers of undotted durations, longest first, between neighbours of which a run is mixed.
GRID = sorted(int(n) for n in (*PLAIN[1:], *TRIPLETS, *OTHERS))


def table(spark: SparkSession) -> DataFrame:
    """``name``, ``num``, ``den`` (reduced) and ``parts`` of every duration."""
    return spark.createDataFrame([(n, a, b, a * PARTS // b) for n, a, b in values()], "name string, num long, den long, parts long")


def spread(n_long: Column, n_short: Column) -> Column:
    """``n_long`` longs (true) among ``n_short`` shorts, spread evenly: the rarer kind comes when the error that it adds
    at each place has reached the places less the ones of it that stand already."""
    few, all_ = F.least(n_long, n_short), n_long + n_short
    start = F.struct(F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("placed"), F.array().cast("array<boolean>").alias("at"))

    def step(acc, _):
        error = acc["error"] + few
        comes = error >= all_ - acc["placed"]
        return F.struct((error - F.when(comes, all_).otherwise(0)).alias("error"), (acc["placed"] + comes.cast("long")).alias("placed"), F.array_append(acc["at"], comes).alias("at"))

    placed = F.aggregate(F.sequence(F.lit(1).cast("long"), all_), start, step, lambda acc: acc["at"])
    of_one = F.array_repeat(n_short == 0, all_.cast("int"))
    return F.when(few == 0, of_one).when(n_long <= n_short, placed).otherwise(F.transform(placed, lambda x: ~x))


def _options() -> Column:
    return F.array(*(F.struct(F.lit(name).alias("name"), F.lit(a * PARTS // b).cast("long").alias("parts")) for name, a, b in values()))


def _first_least(options: Column, cost) -> Column:
    """The name of the first of the options with the least cost."""
    costs = F.transform(options, lambda o, i: F.struct(cost(o).alias("cost"), i.alias("i"), o["name"].alias("name")))
    return F.array_min(costs)["name"]


def nearest(num: Column, den: Column) -> Column:
    """The duration nearest to num / den of all; of two as near the first of the list."""
    return _first_least(_options(), lambda o: F.abs(num * PARTS - o["parts"] * den))


def _spread(n_long: int, n_short: int) -> list[bool]:
    """The same as ``spread``, of numbers."""
    few, all_, error, placed, at = min(n_long, n_short), n_long + n_short, 0, 0, []
    if few == 0:
        return [n_short == 0] * all_
    for _ in range(all_):
        error += few
        comes = error >= all_ - placed
        error, placed = error - all_ * comes, placed + comes
        at.append(comes == (n_long <= n_short))
    return at


_ORDERED = sorted(((name, p * PARTS // q) for name, p, q in values()), key=lambda v: -v[1])
_NEAR = [(SHORTEST, SHORTEST_AS[0] * PARTS // SHORTEST_AS[1]), *_ORDERED]


def _solution(x: int, y: int, n: int) -> tuple[str, list[str] | None, list[str] | None]:
    """Kind, names and pair of a run."""
    if y == 3 and x in (4, 8, 16, 32, 64, 128):
        return "dotted", [f"{x // 2}."] * n, None
    # 1 / g against y / x: the least of the longer or equal ones, the greatest of the shorter or equal.
    longer, shorter = max((g for g in GRID if g * y <= x), default=None), min((g for g in GRID if g * y >= x), default=None)
    if longer is not None and shorter is not None:
        if longer == shorter:
            return "same", [str(longer)] * n, None
        # n y / x = a / longer + (n - a) / shorter.
        a, rest = divmod(n * longer * (y * shorter - x), x * (shorter - longer))
        if rest == 0 and 0 <= a <= n:
            return "mixed", [str(longer if is_long else shorter) for is_long in _spread(a, n - a)], None
    if n == 1:
        # Both of a pair are durations; of pairs with the sum the one with the least difference, the longer one first.
        pairs = [(abs(p - q), -p, [u, v]) for u, p in _ORDERED for v, q in _ORDERED if (p + q) * x == y * PARTS]
        if pairs:
            return "pair", None, min(pairs)[2]
    return "nearest", [min(_NEAR, key=lambda v: abs(y * PARTS - v[1] * x))[0]] * n, None


def solved(runs: DataFrame) -> DataFrame:
    """For each run of ``n`` notes of ``x%y`` (y / x of a whole note each) ``names``, one for each note, or ``pair``, two
    for the one note. ``kind`` says how: ``dotted`` (exact by name), ``same``, ``mixed`` (exact in sum), ``pair``, ``nearest``.

    Runs are distinct problems, as few as the ratios and lengths that occur; a problem is solved by plain Python, as its
    cases as one expression take the planner longer than the job.
    """

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_solution(*run) for run in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n")), strict=True)]
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.list_(pa.string()), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "kind", "names", "pair"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    return runs.mapInArrow(solve, f"{own}, kind string, names array<string>, pair array<string>")


def group_solutions(groups: DataFrame) -> DataFrame:
    """Groups of ``n`` notes of 1 / ``d`` as ``n_long`` notes of ``long`` and ``n_short`` of ``short``, the neighbours of 1 / d
    among all durations, that take the same time; null where no numbers do, or a group has more than LARGEST_GROUP notes."""
    d, n = F.col("d"), F.col("n")
    longer = F.array_sort(F.filter(_options(), lambda o: o["parts"] * d >= PARTS), lambda a, b: F.when(a["parts"] < b["parts"], -1).when(a["parts"] > b["parts"], 1).otherwise(0))
    shorter = F.array_sort(F.filter(_options(), lambda o: o["parts"] * d <= PARTS), lambda a, b: F.when(a["parts"] > b["parts"], -1).when(a["parts"] < b["parts"], 1).otherwise(0))
    rows = groups.withColumns({"_l": F.get(longer, F.lit(0)), "_s": F.get(shorter, F.lit(0))})
    over, under = n * (PARTS - F.col("_s.parts") * d), d * (F.col("_l.parts") - F.col("_s.parts"))
    count = F.when(under == 0, n).when(over % F.nullif(under, F.lit(0)) == 0, F.floor(over / F.nullif(under, F.lit(0))))
    rows = rows.withColumn("_x", F.when(count.between(0, n) & (n <= LARGEST_GROUP), count))
    known = lambda c: F.when(F.col("_x").isNotNull(), c)
    return rows.withColumns({"long": known(F.col("_l.name")), "short": known(F.col("_s.name")), "n_long": F.col("_x"), "n_short": n - F.col("_x")}).drop("_l", "_s", "_x")


def without_unknown_groups(tokens: DataFrame) -> DataFrame:
    """Tokens of durations of GROUPED, in runs of one duration in a spine, as evenly spread mixtures of durations that the
    vocabulary has: ``doc_id``, ``spine``, ``line_no``, ``token``, ``exact``. Runs without a solution keep their tokens.

    Null tokens and tokens that begin with no number are passed over; a barline or another duration ends a run. All
    problems that can have a solution are known beforehand (durations of GROUPED, up to LARGEST_GROUP notes), so that
    tokens are gone through once; tokens that are dealt out by document are not moved.
    """
    order = Window.partitionBy("doc_id", "spine").orderBy("line_no")
    head, number = r"^([\[({]*)[0-9]+", F.regexp_extract("token", r"^[\[({]*([0-9]+)", 1)
    rows = tokens.withColumn("number", F.when(~F.col("is_bar"), number)).where("is_bar or number <> ''")
    begins = F.coalesce(F.lag("number").over(order) != F.col("number"), F.lit(True))
    rows = rows.withColumn("run", F.count_if(begins).over(order)).where(F.col("number").isin(*GROUPED))
    own = Window.partitionBy("doc_id", "spine", "run")
    rows = rows.withColumns({"at": F.row_number().over(own.orderBy("line_no")) - 1, "n": F.count("*").over(own)})
    problems = tokens.sparkSession.createDataFrame([(d, int(d), n) for d in GROUPED for n in range(1, LARGEST_GROUP + 1)], "number string, d long, n long")
    names = F.transform(spread(F.col("n_long"), F.col("n_short")), lambda is_long: F.when(is_long, F.col("long")).otherwise(F.col("short")))
    answers = group_solutions(problems).where("n_long is not null").select("number", "n", names.alias("names"))
    rows = rows.join(F.broadcast(answers), ["number", "n"], "left")
    renamed = F.concat(F.regexp_extract("token", head, 1), F.get("names", F.col("at")), F.regexp_replace("token", head, ""))
    exact = F.col("names").isNotNull()
    return rows.select("doc_id", "spine", "line_no", F.when(exact, renamed).otherwise(F.col("token")).alias("token"), exact.alias("exact"))


#: Tokens of a slice of a partition that is rewritten at once; lines are not cut.
_SLICE = 250_000
_KINDS = ("dotted", "same", "mixed", "pair", "nearest")
#: What a ratio becomes: a name, or the first or second of a pair.
_NAMED = {(name, place): i for i, (name, place) in enumerate((name, place) for name, _, _ in values() for place in (None, 0, 1))}
_HEAD, _ANYWHERE = re.compile(r"^[\[({]*[0-9]+%[0-9]+\.?"), re.compile(r"[0-9]+%[0-9]+\.?")
_known = functools.lru_cache(maxsize=4_096)(_solution)


def _ratio(token: str | None) -> tuple[int, int] | str | None:
    """The ratio of a token, else ``other`` for what ends a run, else nothing for what is passed over."""
    if token is None or token in (".", ""):
        return None
    found = re.search(RATIO, token)
    # Numbers that are no longs are none.
    x, y = (int(d or "0") if len(d := digits.lstrip("0")) < 20 else 0 for digits in found.groups()) if found else (0, 0)
    return (x, y) if 0 < x < 1 << 63 and 0 < y < 1 << 63 else "other"


def _renamed(token: str, name: str, place: int | None) -> str:
    if place is None:
        return _ANYWHERE.sub(name, token)
    rest = _HEAD.sub("", token)
    tie = "" if rest.startswith("r") else "[]"[place]
    return name + rest + tie if place else tie + name + rest


def _entries(x: int, y: int, n: int) -> tuple[int, list[int]]:
    """Number of the kind of a run's solution, and of what its ratios become: one a note, for a pair two for the note."""
    kind, names, pair = (_known if n <= LARGEST_GROUP else _solution)(x, y, n)
    return _KINDS.index(kind), [_NAMED[name, None] for name in names] if pair is None else [_NAMED[name, i] for i, name in enumerate(pair)]


def _distinct(keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of some whole numbers, and each one's place among these."""
    if below > 1 << 22:
        return np.unique(keys, return_inverse=True)
    occurs = np.zeros(below, bool)
    occurs[keys] = True
    return np.flatnonzero(occurs), (np.cumsum(occurs) - 1)[keys]


def _read(lines: pa.RecordBatch) -> tuple[list, list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens and ratios; by token its line, its place there, its number and that of its ratio (0: ends a run, -1: is passed over)."""
    parts, bar = lines.column("parts"), lines.column("is_bar")
    sizes = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    tokens = parts.flatten().dictionary_encode(null_encoding="encode")
    code, texts = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64), tokens.dictionary.to_pylist()
    ratios: dict[tuple[int, int] | str | None, int] = {None: -1, "other": 0}
    ratio = np.array([ratios.setdefault(r, len(ratios) - 1) for r in map(_ratio, texts)], dtype=np.int64)[code]
    ends, is_data = (pc.fill_null(x, False).to_numpy(zero_copy_only=False)[row] for x in (bar, pc.invert(bar)))
    return texts, list(ratios), row, at, code, np.where(ends | ((ratio > 0) & ~is_data), 0, ratio)


def _rewritten(lines: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Tokens of the runs that end in these lines, and those of runs that may go on, as lines of one token each.

    Lines come by document and in order. A run may go on if it is the last of its spine in the last document.
    """
    texts, ratios, row, at, code, ratio = _read(lines)
    own, first = lines.column("doc_id"), lines.column("first")
    doc = own.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    doc = np.cumsum(np.diff(doc, prepend=doc[:1]) != 0)
    spine = pc.fill_null(first, -1).to_numpy(zero_copy_only=False).astype(np.int64)[row] + at

    kept = np.flatnonzero(ratio >= 0)
    # Small keys are sorted by radix.
    keys = [k.astype(np.uint16) if len(k) and 0 <= k.min() and k.max() < 1 << 16 else k for k in (spine[kept], doc[row[kept]])]
    order = kept[np.lexsort(keys)]
    row, at, code, ratio, spine = row[order], at[order], code[order], ratio[order], spine[order]
    changes = np.ones(len(row), bool)
    changes[1:] = (np.diff(spine) != 0) | (np.diff(doc[row]) != 0)
    begins = changes | (ratio == 0)
    begins[1:] |= np.diff(ratio) != 0
    starts = np.flatnonzero(begins)
    n, ratio = np.diff(starts, append=len(row)), ratio[starts]
    goes_on = np.zeros(len(starts), bool)
    if not last and len(starts):
        goes_on = (ratio > 0) & np.append(changes[starts[1:]], True) & (doc[row[starts]] == doc[-1])
    done = (ratio > 0) & ~goes_on

    def taken(tokens: np.ndarray) -> list[pa.Array]:
        where = pa.array(row[tokens])
        return [own.take(where), lines.column("line_no").take(where), pc.add(first.take(where), pa.array(at[tokens]).cast(first.type))]

    tokens = np.flatnonzero(np.repeat(goes_on, n))
    docs, line_nos, spines = taken(tokens)
    open_runs = [docs, line_nos, pa.array([False] * len(tokens), pa.bool_()), spines, pa.array([[texts[c]] for c in code[tokens]], lines.schema.field("parts").type)]

    length, most = n[done], int(n.max(initial=0)) + 1
    found, problem = _distinct(ratio[done] * most + length, len(ratios) * most)
    solutions = [_entries(*ratios[p // most + 1], p % most) for p in found.tolist()]
    kind, size = np.array([(k, len(entries)) for k, entries in solutions], dtype=np.int64).reshape(-1, 2).T
    entry, before = np.array([e for _, entries in solutions for e in entries], dtype=np.int64), np.cumsum(size) - size
    # A pair is two rows of its one note.
    tokens, problem = np.flatnonzero(np.repeat(done, n)), np.repeat(problem, length)
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(length) - length, length)
    copies = 1 + (kind[problem] == _KINDS.index("pair"))
    tokens, problem, place = (np.repeat(x, copies) for x in (tokens, problem, place))
    sub = np.arange(len(tokens)) - np.repeat(np.cumsum(copies) - copies, copies)
    # Of a token and what its ratio becomes few pairs occur; each is written once.
    found, text = _distinct(code[tokens] * len(_NAMED) + entry[before[problem] + place + sub], len(texts) * len(_NAMED))
    named = list(_NAMED)
    written = pa.array([_renamed(texts[p // len(_NAMED)], *named[p % len(_NAMED)]) for p in found.tolist()], pa.string())
    docs, line_nos, spines = taken(tokens)
    out = [docs, spines, line_nos, pa.array(sub, pa.int32()), written.take(pa.array(text)), pa.array(_KINDS).take(pa.array(kind[problem]))]
    return pa.RecordBatch.from_arrays(out, names=["doc_id", "spine", "line_no", "sub", "token", "kind"]), pa.RecordBatch.from_arrays(open_runs, schema=lines.schema)


def _slices(lines: pa.RecordBatch, tokens: int = _SLICE) -> Iterator[pa.RecordBatch]:
    """Lines in slices of as many tokens at most, or of one line."""
    total, at = np.cumsum(pc.fill_null(pc.list_value_length(lines.column("parts")), 0).to_numpy(zero_copy_only=False)), 0
    while at < lines.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + tokens, "right")))
        yield lines.slice(at, end - at)
        at = end


def _without_ratios(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    still_open = new = 0
    for batch in batches:
        for lines in _slices(batch):
            held.append(lines)
            new += lines.num_rows
            # Runs that stay open are gone through again only with as many new lines.
            if new >= still_open:
                made, runs = _rewritten(pa.concat_batches(held), last=False)
                held, still_open, new = [runs], runs.num_rows, 0
                yield made
    if held:
        yield _rewritten(pa.concat_batches(held), last=True)[0]


def without_ratios_of_lines(lines: DataFrame, parts: Column, is_bar: Column, first: Column) -> DataFrame:
    """Tokens written with ratios as tokens of the vocabulary: ``doc_id``, ``spine``, ``line_no``, ``sub`` (1: of an added
    line after it), ``token``, ``kind``. A run keeps its time unless its ``kind`` is ``nearest``.

    ``lines``: doc_id, line_no and what the other columns are made of once lines are dealt out by document: the line's
    tokens, whether it is a barline and the spine of the first token. The others are of the spines after it.

    A run is of tokens of one ratio in a spine. Null tokens, empty ones and ``.`` are passed over; a barline, another token
    or another ratio ends it. Lines are gone through once where they lie, a slice of a partition at a time, of which only
    runs that may go on are kept; no token is moved or joined.
    """
    rows = lines.repartition("doc_id").sortWithinPartitions("doc_id", "line_no")
    rows = rows.select("doc_id", "line_no", is_bar.alias("is_bar"), first.alias("first"), parts.alias("parts"))
    doc_id, line_no, spine = (rows.schema[c].dataType.simpleString() for c in ("doc_id", "line_no", "first"))
    return rows.mapInArrow(_without_ratios, f"doc_id {doc_id}, spine {spine}, line_no {line_no}, sub int, token string, kind string")


def without_ratios(tokens: DataFrame) -> DataFrame:
    """The same of single tokens: doc_id, line_no, spine, token and ``is_bar``."""
    return without_ratios_of_lines(tokens, F.array("token"), F.col("is_bar"), F.col("spine"))
