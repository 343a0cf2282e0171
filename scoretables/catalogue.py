"""All registered queries of the engine: name to function of (spark, sf_dir), and the SQL each is held against."""

from __future__ import annotations

from scoretables.plans import evaluation, examples, files, notes, scores, spines, training

_FAMILIES = (evaluation, notes, scores, spines, training, examples, files, spines)

QUERIES = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLE_SQL = {name: sql for family in _FAMILIES for name, sql in family.ORACLE_SQL.items()}
