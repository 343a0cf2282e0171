"""Spine state: which column of a score line belongs to which spine, through splits, joins and ends, and where cues are.

One ordered pass over each document; of lines that do not change the state only the width is read. Documents without such
lines have their columns as spines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoretables.functions import tokens as T
from scoretables.operators import passes as P

OPERATORS = ("*^", "*v", "*-", "*+", "*cue", "*Xcue")


def _columns():
    """A pass over a document's lines: spine and cue of each of their columns, from the fields of those that change them."""
    spines: list[int] | None = None
    cues: list[bool] = []
    least = None

    def step(width, moves, busy):
        nonlocal spines, cues, least
        # A line with fewer columns than the state has cut it; in one with more the last column that is told apart is repeated.
        known = width if least is None else min(least, width)
        if not busy:
            found, in_cue = list(range(width)), [False] * width
        elif spines is None:
            found, in_cue = [*range(known), *[known - 1] * (width - known)], [False] * width
        elif not spines:
            found, in_cue = [0] * width, [False] * width
        else:
            known = min(known, len(spines))
            found = spines[:known] + [spines[known - 1]] * (width - known)
            in_cue = cues[:known] + [cues[known - 1]] * (width - known)
        least = width if least is None else min(least, width)
        if moves is not None:
            spines, cues, least = [], [], None
            joining = False
            for spine, cue, field in zip(found, in_cue, moves, strict=True):
                if field == "*v" and joining:
                    continue
                joining = field == "*v"
                if field == "*-":
                    continue
                copies = 2 if field == "*^" else 1
                spines += [spine] * copies
                cues += [field == "*cue" or (cue and field != "*Xcue")] * copies
        return found, in_cue

    return step


def assigned(lines: DataFrame) -> DataFrame:
    """``lines``: doc_id, line_no, fields (array). Per field its ``column``, ``spine``, ``token`` and whether it is in a ``cue``.

    A line with fewer columns than the state cuts it; in one with more the last state is repeated. So of the columns only
    as many are told apart as every line since the last change has had.
    """
    lines = lines.where("fields is not null")
    moves = F.exists("fields", lambda x: x.isin(*OPERATORS)) & F.col("doc_id").isNotNull()
    rows = lines.select("doc_id", "line_no", "fields", F.when(moves, F.col("fields")).alias("moves"), F.size("fields").alias("width"))
    whole = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.repartition("doc_id").withColumn("busy", F.max(F.col("moves").isNotNull()).over(whole))
    found = P.scanned(rows, ["width", "moves", "busy"], {"spines": "array<long>", "cues": "array<boolean>"}, _columns)
    each = found.select("doc_id", "line_no", F.posexplode(F.arrays_zip("fields", "spines", "cues")).alias("column", "own"))
    return each.select("doc_id", "line_no", F.col("column").cast("long").alias("column"), F.col("own.spines").alias("spine"), F.col("own.fields").alias("token"), F.col("own.cues").alias("cue"))


def without_cues(lines: DataFrame) -> DataFrame:
    """The same fields with the notes of cue passages as rests of their length."""
    found = assigned(lines)
    note = F.col("cue") & ~T.is_control(F.col("token"))
    return found.withColumn("token", F.when(note, T.cue_rest(F.col("token"))).otherwise(F.col("token")))
