"""Sources, sinks and the stream of results; these queries write to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoretables.functions import tokens as T
from scoretables.operators import chunking, ids, spines, summaries
from scoretables.operators import corpus as P
from scoretables.operators import tokens as K
from scoretables.plans import evaluation
from scoretables.plans.registry import Family
from scoretables.sources import files as S
from scoretables.sources.standins import duckdb, view
from scoretables.streaming import results as stream

query = Family()


@query("results", sql=evaluation.OVERALL)
def results_file_round_trip(results):
    """A result log written in two appends, read as strings, repaired and summarised."""
    path = S.shared_path(results.sparkSession, "log")
    for part in (results.where("status = 'success'"), results.where("status <> 'success'")):
        S.append_results(part, path)
    return summaries.overall(ids.repair_results(S.read_results(results.sparkSession, path), summaries.METRICS))


@query("results", sql="SELECT system, count(*) AS n, count(*) FILTER (WHERE status = 'success' AND chunk_index % 4 <> 0) AS n_scored, round(sum(CASE WHEN status = 'success' AND chunk_index % 4 <> 0 THEN voice END), 6) AS voice FROM results GROUP BY system")
def strict_metric_reading(results):
    raw = results.withColumns({m: F.when(F.col("chunk_index") % 4 == 0, "").otherwise(F.col(m).cast("string")) if m == "voice" else F.col(m).cast("string") for m in summaries.METRICS})
    found = S.strict_metrics(raw, summaries.METRICS)
    return found.groupBy("system").agg(F.count("*").alias("n"), F.count("voice").alias("n_scored"), F.round(F.sum("voice"), 6).alias("voice"))


@query("manifest", sql="SELECT stem, doc_id, n_frames, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM manifest")
def manifest_round_trip(manifest):
    """Manifests written by split and read again."""
    path = S.shared_path(manifest.sparkSession, "manifest")
    S.write_manifest(manifest.select("stem", "doc_id", "n_frames", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split")), path)
    return S.read_manifest(manifest.sparkSession, path, "stem string, doc_id long, n_frames long, split string")


@query("manifest", sql="SELECT stem AS id, n_frames, lang FROM manifest")
def json_map_rows(manifest):
    """JSON objects keyed by id, one a row here, as rows."""
    text = manifest.select(F.to_json(F.map_from_arrays(F.array("stem"), F.array(F.struct("n_frames", "lang")))).alias("text"))
    return S.map_rows(text, "text", "struct<n_frames:bigint,lang:string>")


@query("manifest", sql="SELECT doc_id, chunk_idx, start_frame FROM (SELECT doc_id, k AS chunk_idx, k * 12000 AS start_frame FROM (SELECT *, unnest(range(0, n_frames // 12000 + 1)) AS k FROM manifest) WHERE k * 12000 + 12000 <= n_frames AND (k = 0 OR (k - 1) * 12000 + 24000 < n_frames))")
def stored_chunk_plan(manifest):
    """A chunk plan that is made once for its parameters and then read."""
    spark = manifest.sparkSession
    folder = S.shared_path(spark, "plans")
    make = lambda chunk, overlap: chunking.frame_chunks(manifest, chunk, overlap).select("doc_id", "chunk_idx", "start_frame")
    S.planned(spark, folder, make, chunk=24_000, overlap=12_000)
    return S.planned(spark, folder, make, chunk=24_000, overlap=12_000)


@query("manifest", sql="SELECT stem, n_frames / 1000 AS rubato, 0.5::DOUBLE AS jitter FROM manifest")
def provenance_round_trip(manifest):
    back = S.provenance_back(S.provenance(manifest, {"rubato": F.col("n_frames") / 1000, "jitter": F.lit(0.5)}))
    return back.select("record.stem", F.col("record.k_values")["rubato"].alias("rubato"), F.col("record.k_values")["jitter"].alias("jitter"))


@query("results", sql=evaluation.OVERALL)
def streamed_summary(results):
    """The overall summary of results that arrive as files, failures first and then every final row."""
    spark = results.sparkSession
    source, table, checkpoint = (S.shared_path(spark, x) for x in ("arrivals", "table", "offsets"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in results.schema)
    for part in (results.withColumn("status", F.lit("timeout")).where("chunk_index % 3 = 0"), results):
        part.write.mode("append").parquet(source)
        stream.ingest(spark, source, schema, table, checkpoint)
    return summaries.overall(stream.current(spark, table, ["system", "task_id"]))


@query("results", sql="SELECT system, task_id, CAST(chunk_index AS BIGINT) AS chunk_index, piece_id, performance FROM results WHERE system <> 'sys2'")
def chunk_files_of_two_dialects(results):
    """Chunk definitions written under two headings and read as one table."""
    spark = results.sparkSession
    read = []
    for system, piece, performance in (("sys0", "piece_id", "performance"), ("sys1", "piece", "perf")):
        path = S.shared_path(spark, "chunks")
        rows = results.where(F.col("system") == system).select("task_id", F.col("piece_id").alias(piece), F.col("performance").alias(performance), "chunk_index", F.col("chunk_index").alias("start_measure"), (F.col("chunk_index") + 4).alias("end_measure"))
        rows.drop("task_id").write.option("header", True).csv(path)
        read.append(S.read_chunks(spark, path).withColumn("system", F.lit(system)))
    both = read[0].unionByName(read[1])
    return both.select("system", F.concat("piece_id", F.lit("#"), "performance", F.lit("."), F.col("chunk_index").cast("string")).alias("task_id"), "chunk_index", "piece_id", "performance")


@query("results", sql="SELECT count(*) FILTER (WHERE status = 'timeout') AS n_timeout, count(*) FILTER (WHERE status NOT IN ('timeout', 'success')) AS n_error, count(*) FILTER (WHERE status = 'timeout') AS n_read FROM results")
def failure_lists(results):
    """Failures written as two lists, with their counts, and the lines of the first list read again."""
    folder = S.shared_path(results.sparkSession, "failures")
    counts = S.write_failures(results, folder).first()
    back = results.sparkSession.read.text(f"{folder}/timeouts")
    return back.agg(F.lit(counts.n_timeout).alias("n_timeout"), F.lit(counts.n_error).alias("n_error"), F.count("*").alias("n_read"))


@query("results", sql="SELECT system, task_id, status FROM results WHERE status IN ('timeout', 'mv2h_failed')")
def retry_list_round_trip(results):
    path = S.shared_path(results.sparkSession, "retries")
    S.write_retries(results, path)
    return S.read_retries(results.sparkSession, path)


@query("pages", sql="""SELECT host AS folder, lang AS piece, min(page_id) AS page_id FROM (SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS lang FROM pages WHERE url IS NOT NULL)
    WHERE lang IN ('de', 'en') AND page_id % 4 <> 1 GROUP BY ALL""")  # fmt: skip
def listed_pieces(pages):
    """A list-driven scan: of the listed pieces all files, without reserved names, one of each piece kept."""
    part = lambda i: F.get(F.split("url", "/"), F.lit(i))
    files = pages.where("url is not null").select("page_id", part(2).alias("folder"), part(3).alias("piece"))
    names = files.select("piece").distinct().where(F.col("piece").isin("de", "en"))
    reserved = files.where("page_id % 4 = 1").select("page_id")
    return P.listed_scan(files, names, reserved, "piece", "page_id").groupBy("folder", "piece").agg(F.min("page_id").alias("page_id"))


@query("pages", sql="""WITH f AS (SELECT url AS path, split_part(url, '/', 3) AS top, split_part(url, '/', 4) AS piece, CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id % 5 END AS part, CASE page_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS name FROM pages WHERE url IS NOT NULL),
    b AS (SELECT top, piece, part, min({'r': CASE name WHEN 'b' THEN 0 ELSE 1 END, 'p': path}) AS best FROM f WHERE name IN ('a', 'b') GROUP BY ALL)
    SELECT top, piece, part, best.p AS path FROM b WHERE part IS NULL OR NOT EXISTS (SELECT 1 FROM b o WHERE o.part IS NULL AND o.top = b.top AND o.piece = b.piece)""".join(("SELECT * FROM (", ")")))  # fmt: skip
def nested_catalogue(pages):
    """A scan of two or three levels: a piece folder's own file, else that of each folder below it."""
    part = lambda i: F.get(F.split("url", "/"), F.lit(i))
    i = F.col("page_id") % 4
    name = F.when(i == 0, "a").when(i == 1, "b").otherwise("c")
    files = pages.where("url is not null").select(part(2).alias("top"), part(3).alias("piece"), F.when(F.col("page_id") % 3 != 0, F.col("page_id") % 5).alias("part"), name.alias("name"), F.col("url").alias("path"))
    return P.nested_scan(files, ["b", "a"]).select("top", "piece", "part", "path")


# The least number of words less one of the lines before is the last spine that a later line can still tell apart.
@query("lines", sql="""WITH w AS (SELECT doc_id, line_no, string_split(line, ' ') AS words, line_no % 2 = 0 AS joins, coalesce(min(len(string_split(line, ' ')) - 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1000000000) AS most FROM lines),
    f AS (SELECT *, CASE WHEN joins THEN list_concat(['.'], words) ELSE words END AS fields FROM w), c AS (SELECT *, unnest(range(0, len(fields))) AS c FROM f), s AS (SELECT *, least(CASE WHEN joins THEN greatest(c - 1, 0) ELSE c END, most) AS spine FROM c)
    SELECT doc_id, 2 * line_no AS line_no, c AS "column", spine, fields[c + 1] AS token FROM s UNION ALL SELECT doc_id, 2 * line_no + 1, c, spine, CASE WHEN joins AND c < 2 THEN '*v' WHEN NOT joins AND c = 0 THEN '*^' ELSE '*' END FROM s""".join(("SELECT * FROM (", ")")))  # fmt: skip
def spine_columns(lines):
    """Columns to spines through splits and joins, over every word of every line.

    After each odd line comes one that splits its first column, after each even line one that joins the first two.
    """
    words = F.split("line", " ")
    # An even line is one column wider, as the split before it asks for.
    fields = F.when(F.col("line_no") % 2 == 0, F.concat(F.array(F.lit(".")), words)).otherwise(words)
    width = F.size(fields)
    stars = lambda n: F.array_repeat(F.lit("*"), n)
    turn = F.when(F.col("line_no") % 2 == 1, F.concat(F.array(F.lit("*^")), stars(width - 1))).otherwise(F.concat(F.array(F.lit("*v"), F.lit("*v")), stars(width - 2)))
    rows = lines.select("doc_id", F.explode(F.array(F.struct((2 * F.col("line_no")).alias("line_no"), fields.alias("fields")), F.struct((2 * F.col("line_no") + 1).alias("line_no"), turn.alias("fields")))).alias("l"))
    return spines.assigned(rows.select("doc_id", "l.line_no", "l.fields")).drop("cue")


# A cue runs from after each fourth line to after the next one but one, in all columns, so every column has its state.
@query("lines", sql="""WITH f AS (SELECT doc_id, line_no, list_transform(string_split(line, ' '), lambda w: concat(length(w) + 1, 'c')) AS fields FROM lines), d AS (SELECT doc_id, line_no, unnest(range(0, len(fields))) AS c, unnest(fields) AS token, len(fields) AS n FROM f)
    SELECT doc_id, 2 * line_no AS line_no, c AS "column", CASE WHEN line_no % 4 IN (2, 3) AND line_no > 1 THEN replace(token, 'c', 'r') ELSE token END AS token FROM d
    UNION ALL SELECT doc_id, 2 * line_no + 1, c, CASE line_no % 4 WHEN 1 THEN '*cue' WHEN 3 THEN '*Xcue' ELSE '*' END FROM d""".join(("SELECT * FROM (", ")")))  # fmt: skip
def cue_passages(lines):
    """Notes of every word's length, with those of cue passages as rests."""
    fields = F.transform(F.split("line", " "), lambda w: F.concat((F.length(w) + 1).cast("string"), F.lit("c")))
    i = F.col("line_no") % 4
    mark = F.when(i == 1, "*cue").when(i == 3, "*Xcue").otherwise("*")
    both = F.array(F.struct((2 * F.col("line_no")).alias("line_no"), fields.alias("fields")), F.struct((2 * F.col("line_no") + 1).alias("line_no"), F.array_repeat(mark, F.size(fields)).alias("fields")))
    rows = lines.select("doc_id", F.explode(both).alias("l")).select("doc_id", "l.line_no", "l.fields")
    return spines.without_cues(rows).select("doc_id", "line_no", "column", "token")


def _factors(spark, d):
    """The factors of the score-like tokens, with their places."""
    kern = view(spark, d, "kern")
    return kern.select(F.col("piece_id").alias("doc_id"), F.col("note_idx").alias("line_no"), F.posexplode(T.factors(F.col("token"))).alias("spine", "token"))


#: The same in SQL: tie, duration, pitch without naturals, tie.
_PARTS = """(SELECT piece_id AS doc_id, note_idx AS line_no, unnest(range(0, len(parts))) AS spine, unnest(parts) AS token FROM (SELECT piece_id, note_idx, list_filter([CASE WHEN token LIKE '[%' THEN '[' ELSE '' END, regexp_extract(token, '([0-9]+\\.?)', 1),
    replace(regexp_extract(token, '([A-Ga-g]+[#n-]*|r)', 1), 'n', ''), CASE WHEN token LIKE '%]' THEN ']' ELSE '' END], lambda x: x <> '') AS parts FROM kern))"""
_LISTED = ", ".join(f"('{t}', {i}, '{kind}')" for i, (t, kind) in enumerate([(t, k) for k, names in (("special", K.SPECIALS), ("meter", K.METERS), ("key", K.KEYS)) for t in names]))
_STRUCTURE = "('.', 36, 'structure'), (chr(9), 37, 'structure'), (chr(10), 38, 'structure')"
_DURATIONS = ", ".join(f"('{t}', {39 + i}, 'duration')" for i, t in enumerate(K.DURATIONS))
_MODIFIERS = ", ".join(f"('{t}', {258 + i}, 'modifier')" for i, t in enumerate(K.MODIFIERS))
#: The vocabulary by rule: 10 specials, 11 meters, 15 keys, 3 of structure, 29 durations, 9 x 7 x 3 pitches and a rest, 13 modifiers.
_VOCABULARY = f"""(SELECT token, CAST(id AS INTEGER) AS id, kind FROM (VALUES {_LISTED}, {_STRUCTURE}, {_DURATIONS}, {_MODIFIERS}, ('r', 257, 'pitch')) AS v(token, id, kind) UNION ALL
    SELECT concat(CASE WHEN o < 4 THEN repeat(substr('CDEFGAB', l + 1, 1), 4 - o) ELSE repeat(substr('cdefgab', l + 1, 1), o - 3) END, ['-', '', '#'][a + 1]), CAST(68 + o * 21 + l * 3 + a AS INTEGER), 'pitch'
    FROM (SELECT unnest(range(0, 9))::INTEGER AS o) CROSS JOIN (SELECT unnest(range(0, 7))::INTEGER AS l) CROSS JOIN (SELECT unnest(range(0, 3))::INTEGER AS a))"""


def vocabulary(spark, d):
    """Every entry of the score vocabulary and how often it occurs among the factors of the score-like tokens."""
    counts = _factors(spark, d).groupBy("token").agg(F.count("*").alias("n"))
    return K.vocabulary(spark).join(counts, "token", "left").select("token", "id", "kind", F.coalesce("n", F.lit(0)).alias("n"))


def unknown_tokens(spark, d):
    """Counts of the factors that the vocabulary lacks."""
    return K.unknown(_factors(spark, d), K.vocabulary(spark))


def encoded_documents(spark, d):
    """Ids of every piece's factors, in order; -1 for those that the vocabulary lacks."""
    found = K.encoded(_factors(spark, d), K.vocabulary(spark))
    return found.withColumn("ids", F.array_join(F.transform("ids", lambda x: F.coalesce(x, F.lit(-1)).cast("string")), ","))


def round_trip_summary(spark, d):
    """Pieces whose factors all have ids, and those that come back from their ids unchanged."""
    found = _factors(spark, d).join(K.vocabulary(spark).select("token", "id"), "token", "left").withColumnRenamed("token", "written")
    back = found.join(K.vocabulary(spark).select("id", "token"), "id", "left")
    pieces = back.groupBy("doc_id").agg(F.bool_and(F.col("id").isNotNull()).alias("known"), F.bool_and(F.coalesce(F.col("token") == F.col("written"), F.lit(False))).alias("same"))
    return pieces.agg(F.count("*").alias("n"), F.count_if("known").alias("n_known"), F.count_if("same").alias("n_same"))


def text_folder(spark, d):
    """Texts written as files in folders by source, scanned again line by line; by source the lines, those that are not
    control lines, and the letters of the longest."""
    documents = view(spark, d, "documents")
    path = S.shared_path(spark, "texts")
    documents.select("source", "text").write.partitionBy("source").option("maxRecordsPerFile", 64).text(path)
    found = S.text_lines(spark, path, ".txt").withColumn("source", F.regexp_extract("path", "/source=([^/]*)/", 1))
    return found.groupBy("source").agg(F.count("*").alias("n_lines"), F.count_if(~T.is_control(F.col("line"))).alias("n_data"), F.max(F.length("line")).cast("long").alias("longest"))


def name_list(spark, d):
    """Names written as a list with a comment, read again and left out of the manifest."""
    manifest = view(spark, d, "manifest")
    path = S.shared_path(spark, "names")
    names = manifest.where("doc_id % 11 = 0").select(F.concat("stem", F.lit(".krn")).alias("value"))
    names.unionByName(spark.range(1).select(F.lit("# left out").alias("value"))).write.text(path)
    return P.among(manifest.select("stem"), "stem", exclude=P.listed(S.read_names(spark, path)).withColumnRenamed("name", "stem"))


query.queries |= {f.__name__: f for f in (vocabulary, unknown_tokens, encoded_documents, round_trip_summary, text_folder, name_list)}
query.sql |= {
    "round_trip_summary": duckdb("kern", then=f"SELECT count(*) AS n, count(*) FILTER (WHERE known) AS n_known, count(*) FILTER (WHERE same) AS n_same FROM (SELECT p.doc_id, bool_and(v.id IS NOT NULL) AS known, bool_and(coalesce(b.token = p.token, false)) AS same FROM {_PARTS} p LEFT JOIN {_VOCABULARY} v USING (token) LEFT JOIN {_VOCABULARY} b ON b.id = v.id GROUP BY p.doc_id)"),
    "text_folder": "SELECT source, count(*) AS n_lines, count(*) FILTER (WHERE NOT regexp_matches(line, '^[=*!]')) AS n_data, max(length(line)) AS longest FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY source",
    "name_list": duckdb("manifest", then="SELECT stem FROM manifest WHERE doc_id % 11 <> 0"),
    "vocabulary": duckdb("kern", then=f"SELECT v.token, v.id, v.kind, coalesce(n, 0) AS n FROM {_VOCABULARY} v LEFT JOIN (SELECT token, count(*) AS n FROM {_PARTS} GROUP BY token) c USING (token)"),
    "unknown_tokens": duckdb("kern", then=f"SELECT token, count(*) AS n FROM {_PARTS} WHERE token NOT IN (SELECT token FROM {_VOCABULARY}) GROUP BY token"),
    "encoded_documents": duckdb("kern", then=f"SELECT p.doc_id, count(*) AS n_tokens, bool_or(v.id IS NULL) AS has_oov, array_to_string(list(coalesce(v.id, -1) ORDER BY line_no, spine), ',') AS ids FROM {_PARTS} p LEFT JOIN {_VOCABULARY} v USING (token) GROUP BY p.doc_id"),
}

QUERIES, ORACLE_SQL = query.queries, query.sql
