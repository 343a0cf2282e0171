"""Views of score-shaped data derived from the driver's tables; the SQL runs on Spark and, but for ``lines``, on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = """
SELECT concat('sys', s.s) AS system,
       concat('C', e.user_id % 7, '#W', e.user_id % 11, '#u', e.user_id, '#perf', e.user_id % 3, '.', e.idx) AS task_id,
       concat('C', e.user_id % 7, '#W', e.user_id % 11, '#u', e.user_id) AS piece_id,
       concat('perf', e.user_id % 3) AS performance, e.idx AS chunk_index,
       CASE WHEN (e.event_id * 7 + e.idx + s.s * 3) % 10 < 4 + 2 * s.s THEN 'success'
            WHEN e.event_id % 3 = 0 THEN 'zero_score' WHEN e.event_id % 3 = 1 THEN 'mv2h_failed' ELSE 'timeout' END AS status,
       CAST((e.event_id * 31 + s.s * 17 + 1) % 1000 AS DOUBLE) / 1000 AS multi_pitch,
       CAST((e.event_id * 37 + s.s * 17 + 2) % 1000 AS DOUBLE) / 1000 AS voice,
       CAST((e.event_id * 41 + s.s * 17 + 3) % 1000 AS DOUBLE) / 1000 AS meter,
       CAST((e.event_id * 43 + s.s * 17 + 4) % 1000 AS DOUBLE) / 1000 AS value,
       CAST((e.event_id * 47 + s.s * 17 + 5) % 1000 AS DOUBLE) / 1000 AS harmony
FROM (SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx FROM events) e
CROSS JOIN (SELECT 0 AS s UNION ALL SELECT 1 UNION ALL SELECT 2) s
WHERE s.s < 2 OR e.event_id % 4 <> 0
"""

NOTES = """
SELECT user_id AS piece_id, rn - 1 AS note_idx, (rn - 1 - (rn - 1) % 2) * 250 AS onset_ms,
       36 + (event_id * 7) % 49 AS pitch, 100 + (event_id * 13) % 900 AS dur_ms, 40 + event_id % 70 AS velocity,
       (rn - 1 - (rn - 1) % 16) AS phrase_id, event_type = 'error' AS has_fermata, event_type = 'click' AS staccato
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rn FROM events) e
"""

DIRECTIONS = "SELECT piece_id, note_idx AS dir_idx, 'crescendo' AS kind, onset_ms AS start_ms, onset_ms + 1500 AS end_ms FROM notes WHERE note_idx % 12 = 0"

_KIND = "CASE substr(line, 1, 1) WHEN 'E' THEN 'bar' WHEN 'A' THEN 'interp' WHEN 'U' THEN 'comment' ELSE 'data' END AS kind"
LINES = {
    "spark": rf"SELECT doc_id, CAST(pos + 1 AS BIGINT) AS line_no, line, {_KIND} FROM documents LATERAL VIEW posexplode(split(text, '\n')) t AS pos, line",
    "duckdb": f"SELECT doc_id, line_no, line, {_KIND} FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
}

TOKENS = {
    "spark": r"SELECT doc_id, line_no, kind, CAST(pos AS BIGINT) AS spine, token, CAST(length(token) AS BIGINT) AS dur FROM lines LATERAL VIEW posexplode(split(line, ' ')) t AS pos, token",
    "duckdb": "SELECT doc_id, line_no, kind, spine, token, CAST(length(token) AS BIGINT) AS dur FROM (SELECT doc_id, line_no, kind, unnest(range(0, len(l))) AS spine, unnest(l) AS token FROM (SELECT *, string_split(line, ' ') AS l FROM lines))",
}

MEASURES = """
SELECT doc_id, line_no - 1 AS m_idx, line_no AS measure, (cum - len) AS start_ms, cum AS end_ms, line_no AS line_start, line_no AS line_end
FROM (SELECT doc_id, line_no, CAST(length(line) + 1 AS BIGINT) AS len,
             CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum FROM lines) q
"""

MANIFEST = "SELECT concat(source, '_', doc_id) AS stem, doc_id, source, lang, n_chars * 10 AS n_frames, CAST(n_chars AS DOUBLE) / 10 AS duration_sec FROM documents"

SPLIT_NAMES = """
SELECT CASE WHEN d.doc_id % 2 = 0 THEN concat(substr(d.source, 4), '#', d.doc_id) ELSE concat(d.source, '_', d.doc_id) END AS name,
       CASE WHEN l.quality = 1 THEN 'test' ELSE 'valid' END AS split
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id % 5 < 2
"""

# Score-like tokens from notes: tie, duration, dot, letters, accidental, marks.
KERN = r"""
SELECT piece_id, note_idx, concat(CASE WHEN note_idx % 13 = 0 THEN '[' ELSE '' END, CASE dur_ms % 7 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '4' WHEN 3 THEN '8' WHEN 4 THEN '16' WHEN 5 THEN '12' ELSE '24' END,
    CASE WHEN velocity % 4 = 0 THEN '.' ELSE '' END, CASE WHEN pitch % 9 = 0 THEN 'r' ELSE repeat(CASE WHEN velocity % 2 = 0 THEN substr('CDEFGAB', CAST(pitch % 7 + 1 AS INT), 1) ELSE substr('cdefgab', CAST(pitch % 7 + 1 AS INT), 1) END, CAST(note_idx % 3 + 1 AS INT)) END,
    CASE WHEN pitch % 9 = 0 THEN '' WHEN pitch % 5 = 0 THEN '#' WHEN pitch % 5 = 1 THEN '-' WHEN pitch % 5 = 2 THEN 'n' WHEN pitch % 5 = 3 THEN '##' ELSE '' END,
    CASE note_idx % 6 WHEN 0 THEN '/' WHEN 1 THEN 'L' WHEN 2 THEN '~' WHEN 3 THEN 'J' WHEN 4 THEN '''' ELSE '' END, CASE WHEN note_idx % 13 = 1 THEN ']' ELSE '' END) AS token FROM notes
"""

#: View name to the tables it is made from and its text; in order of dependence.
VIEWS = {
    "results": (("events",), RESULTS),
    "notes": (("events",), NOTES),
    "directions": (("notes",), DIRECTIONS),
    "kern": (("notes",), KERN),
    "lines": (("documents",), LINES),
    "tokens": (("lines",), TOKENS),
    "measures": (("lines",), MEASURES),
    "manifest": (("documents",), MANIFEST),
    "split_names": (("documents", "labels"), SPLIT_NAMES),
}


def _needs(names: tuple[str, ...]) -> list[str]:
    """The views that these names rest on, themselves included, in order of dependence."""
    wanted = set(names)
    for name in reversed(VIEWS):
        if name in wanted:
            wanted |= set(VIEWS[name][0])
    return [x for x in VIEWS if x in wanted]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view, or the driver's table of that name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sources, text = VIEWS[name]
    text = text["spark"] if isinstance(text, dict) else text
    frames = {x: view(spark, sf_dir, x) for x in sources}
    for x in sources:
        text = text.replace(f"FROM {x}", f"FROM {{{x}}}").replace(f"JOIN {x}", f"JOIN {{{x}}}")
    return spark.sql(text, **frames)


def parts(lines: DataFrame) -> DataFrame:
    """Lines with the rows that ``tokens`` has of them as an array of structs (dur, spine, token)."""
    token = lambda w, i: F.struct(F.length(w).cast("long").alias("dur"), i.cast("long").alias("spine"), w.alias("token"))
    return lines.select("doc_id", "line_no", "kind", F.transform(F.split("line", " "), token).alias("parts"))


def tokens_by_document(lines: DataFrame) -> DataFrame:
    """The view ``tokens`` of lines that are dealt out by document first: counts and ranks within documents then move no token."""
    return lines.sparkSession.sql(TOKENS["spark"].replace("FROM lines", "FROM {lines}"), lines=lines.repartition("doc_id"))


def duckdb(*names: str, then: str) -> str:
    """SQL for the oracle: the views as common table expressions, followed by ``then``."""
    parts = []
    for x in _needs(names):
        text = VIEWS[x][1]
        parts.append(f"{x} AS ({text['duckdb'] if isinstance(text, dict) else text})")
    return f"WITH {', '.join(parts)} {then}" if parts else then
