"""Registration of queries with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoretables.sources.standins import duckdb, view


#: SQL of an even spread of k long among n notes (of a table ``pairs``), letter by letter, with the error and the number
#: placed so far, as the rule has it; the body of a recursive table ``spread``.
SPREAD = """(SELECT n, k, least(k, n - k) AS few, 0 AS step, 0::BIGINT AS error, 0 AS placed, '' AS marks FROM pairs UNION ALL
    SELECT n, k, few, step + 1, CASE WHEN error + few >= n - placed THEN error + few - n ELSE error + few END, CASE WHEN error + few >= n - placed THEN placed + 1 ELSE placed END, concat(marks, CASE WHEN (error + few >= n - placed) = (k <= n - k) THEN 'L' ELSE 'S' END) FROM spread WHERE step < n)"""


class Family:
    """Queries of one family: ``queries`` and ``sql`` by name."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, *views: str, sql: str | None = None, reads: tuple[str, ...] = ()):
        """Register a function of the named views (or tables). ``sql`` may use the views' names, and those of ``reads``."""

        def add(f):
            self.queries[f.__name__] = lambda spark, d: f(*(view(spark, d, v) for v in views))
            if sql:
                self.sql[f.__name__] = duckdb(*views, *reads, then=sql)
            return f

        return add
