"""Queries over scores with several types of spines, splits and joins; laid out by rule, so that SQL knows every state."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoretables.operators import spinestate as S
from scoretables.plans.registry import Family

query = Family()

_TAB = "\t"
#: Types of the columns by line number modulo 12: K(ern), D(ynam), T(ext). Line 3 splits the first, 6 the fourth, 9 and 10 join them.
_STATES = ("KDKT", "KDKT", "KDKT", "KDKT", "KKDKT", "KKDKT", "KKDKT", "KKDKKT", "KKDKKT", "KKDKKT", "KDKKT", "KDKT")
#: Lines that are not data, by line number modulo 12: what stands in each column.
_TURNS = {3: ("*^", "*", "*", "*"), 6: ("*", "*", "*", "*^", "*"), 9: ("*v", "*v", "*", "*", "*", "*"), 10: ("*", "*", "*v", "*v", "*"), 5: ("=",) * 5, 11: ("=",) * 4}
_NAMES = {"K": "**kern", "D": "**dynam", "T": "**text"}


def _typed_score(lines):
    """The first line declares; every other one is data of its words, a barline or a change of spines."""
    r, n = F.col("line_no") % 12, F.length("line")
    state = F.lit(_STATES[0])
    for i, types in enumerate(_STATES):
        state = F.when(r == i, types).otherwise(state)
    rows = lines.select("doc_id", "line_no", F.filter(F.split(state, ""), lambda x: x != "").alias("types"), n.alias("n"), F.get(F.split("line", " "), F.lit(0)).alias("word"))
    spot = lambda i: (F.col("n") + i) % 15
    length = lambda i: F.when(spot(i) % 3 == 0, "4").when(spot(i) % 3 == 1, "8").otherwise("16")
    note = lambda t, i: F.when(t == "D", "f").when(t == "T", F.col("word")).when(spot(i) % 5 == 0, ".").otherwise(F.concat(length(i), F.lit("c")))
    text = F.array_join(F.transform("types", note), _TAB)
    for i, fields in _TURNS.items():
        text = F.when(F.col("line_no") % 12 == i, _TAB.join(fields)).otherwise(text)
    text = F.when(F.col("line_no") == 1, _TAB.join(_NAMES[t] for t in _STATES[0])).otherwise(text)
    return rows.select("doc_id", "line_no", text.alias("line"))


_CASES = " ".join(f"WHEN {i} THEN '{types}'" for i, types in enumerate(_STATES))
_TURN_CASES = " ".join(f"WHEN {i} THEN {list(f)}" for i, f in _TURNS.items())
_NOTE = "CASE t WHEN 'D' THEN 'f' WHEN 'T' THEN word ELSE CASE WHEN (n + i - 1) % 5 = 0 THEN '.' ELSE concat(['4', '8', '16'][(n + i - 1) % 3 + 1], 'c') END END"
_FIELDS = f"""(SELECT doc_id, line_no, n, word, list_transform(range(1, length(CASE line_no % 12 {_CASES} END) + 1), lambda i: substr(CASE line_no % 12 {_CASES} END, i, 1)) AS types FROM
    (SELECT *, length(line) AS n, string_split(line, ' ')[1] AS word FROM lines))"""


@query("lines", sql=f"""SELECT doc_id, line_no, array_to_string(list_transform(list_filter(range(1, len(types) + 1), lambda i: types[i] = 'K'), lambda i: fields[i]), chr(9)) AS line
    FROM (SELECT doc_id, line_no, types, CASE WHEN line_no = 1 THEN ['**kern', '**dynam', '**kern', '**text'] ELSE CASE line_no % 12 {_TURN_CASES} ELSE list_transform(range(1, len(types) + 1), lambda i: {_NOTE.replace('CASE t ', 'CASE types[i] ')}) END END AS fields FROM {_FIELDS})""")
def note_columns(lines):
    """Only the columns of notes, through splits and joins, of scores with dynamics and text."""
    return S.only_types(_typed_score(lines), "**kern")


def _column(i: int) -> str:
    """Ticks (64ths of a quarter) of field ``i`` (from 1) of a data line in SQL."""
    return f"CASE WHEN (n + {i - 1}) % 5 = 0 THEN 0 ELSE [64, 32, 16][(n + {i - 1}) % 3 + 1] END"


_REST = "CASE {} WHEN 16 THEN '16r' WHEN 32 THEN '8r' WHEN 48 THEN '8.r' WHEN 64 THEN '4r' ELSE '.' END"


# Of a line with four and of one with seven (modulo 12) the split columns differ; rests stand before the barline that
# comes next, or the next data line in which both columns of a split have notes.
@query("lines", sql=f"""WITH d AS (SELECT doc_id, line_no, length(line) AS n FROM lines), p AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM d),
    t AS (SELECT doc_id, line_no, line_no % 12 AS r, {_column(1).replace('(n ', '(before ')} AS a, {_column(2).replace('(n ', '(before ')} AS b, {_column(4).replace('(n ', '(before ')} AS c, {_column(5).replace('(n ', '(before ')} AS d,
      {_column(1)} > 0 AND {_column(2)} > 0 AS first_plays, {_column(4)} > 0 AND {_column(5)} > 0 AS second_plays FROM p),
    x AS (SELECT doc_id, line_no, CASE WHEN r = 5 THEN [greatest(b - a, 0), greatest(a - b, 0), 0] ELSE [CASE WHEN first_plays THEN greatest(b - a, 0) ELSE 0 END, CASE WHEN first_plays THEN greatest(a - b, 0) ELSE 0 END, CASE WHEN second_plays THEN greatest(d - c, 0) ELSE 0 END, CASE WHEN second_plays THEN greatest(c - d, 0) ELSE 0 END] END AS lag FROM t WHERE r IN (5, 8))
    SELECT doc_id, line_no, array_to_string(list_transform(lag, lambda v: {_REST.format('v')}), chr(9)) AS line FROM x WHERE list_sum(lag) > 0""".join(("SELECT * FROM (", ")")))  # fmt: skip
def lagging_rests(lines):
    """The lines of rests that let split columns catch up with each other."""
    found = S.caught_up(S.only_types(_typed_score(lines), "**kern"))
    return found.where("sub = 0").select("doc_id", "line_no", "line")


_LETTER = "substr('cdefgab', length(line) % 7 + 1, 1)"


# A region begins at line 2 (modulo 8) and ends at 6. The first column is half a quarter behind the second, so each of
# its data lines becomes two.
@query("lines", sql=f"""WITH l AS (SELECT doc_id, line_no, line_no % 8 AS r, {_LETTER} AS p FROM lines)
    SELECT doc_id, line_no, 0 AS place, CASE r WHEN 0 THEN concat('=', chr(9), '=') ELSE concat('8', p, chr(9), '4', p) END AS line FROM l WHERE r IN (0, 1, 7)
    UNION ALL SELECT doc_id, line_no - (r - 2), 2 * (r - 3) + k, CASE k WHEN 0 THEN concat('4', p, chr(9), '.') ELSE concat('.', chr(9), '4', p) END FROM (SELECT *, unnest([0, 1]) AS k FROM l WHERE r IN (3, 4, 5))""".join(("SELECT * FROM (", ")")))  # fmt: skip
def rescaled_regions(lines):
    """Scores whose first column is written in half its length between two marks, reflowed."""
    r, pitch = F.col("line_no") % 8, F.substr(F.lit("cdefgab"), F.length("line") % 7 + 1, F.lit(1))
    text = F.when(r == 0, "=\t=").when(r == 2, "*rscale:2\t*").when(r == 6, "*rscale:1\t*").otherwise(F.concat(F.lit("8"), pitch, F.lit("\t4"), pitch))
    return S.reflowed(lines.select("doc_id", "line_no", text.alias("line"))).select("doc_id", "line_no", "place", "line")


QUERIES, ORACLE_SQL = query.queries, query.sql
