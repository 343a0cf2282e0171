"""Corpus plans and training tables: manifests, splits, versions, chunks, stitching, batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scoretables.functions import tokens as T
from scoretables.operators import batching as B
from scoretables.operators import chunking as C
from scoretables.operators import corpus as P
from scoretables.operators import ids
from scoretables.plans.registry import Family

query = Family()
FONTS = ("alpha.sf2", "beta.sf2", "gamma.sf2")

_STEM = "CASE WHEN contains(name, '#') THEN concat('src', split_part(name, '#', 1), '_', split_part(name, '#', 2)) ELSE name END"
_SPLIT = f"(SELECT m.*, CASE min(CASE s.split WHEN 'test' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END) WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split FROM manifest m LEFT JOIN (SELECT {_STEM} AS stem, split FROM split_names) s USING (stem) GROUP BY ALL)"


def _with_split(manifest, split_names):
    name = F.col("name")
    alias = F.when(name.contains("#"), F.concat(F.lit("src"), F.replace(name, F.lit("#"), F.lit("_")))).otherwise(name)
    return P.assigned_splits(manifest, split_names, F.array(alias))


@query("manifest", "split_names", sql=f"SELECT stem, doc_id, split FROM {_SPLIT}")
def split_assignment(manifest, split_names):
    return _with_split(manifest, split_names).select("stem", "doc_id", "split")


_N = "CASE split WHEN 'train' THEN 4 WHEN 'valid' THEN 1 ELSE 3 END"
_PLAN = f"(SELECT *, CASE WHEN split = 'valid' THEN 'alpha' ELSE ['alpha', 'beta', 'gamma'][version % 3 + 1] END AS font FROM (SELECT *, CAST(unnest(range(0, {_N})) AS INTEGER) AS version FROM {_SPLIT}))"
_KEY = "CASE WHEN split = 'train' THEN concat(stem, '_v', version, '~', font) ELSE concat(stem, '~', font) END"


@query("manifest", "split_names", sql=f"SELECT {_KEY} AS id, stem, split, version, concat(font, '.sf2') AS soundfont, split = 'train' AND version > 0 AS transposed, CAST(concat('0x', substr(md5({_KEY}), 25, 8)) AS BIGINT) AS seed FROM {_PLAN}")
def version_plan(manifest, split_names):
    return P.version_plan(_with_split(manifest, split_names), list(FONTS)).select("id", "stem", "split", "version", "soundfont", "transposed", "seed")


@query("manifest", "split_names", sql=f"SELECT split, count(*) AS n, count(*) FILTER (WHERE split = 'train' AND version > 0) AS n_transposed, (sum(doc_id % 7) FILTER (WHERE version = 0))::BIGINT AS n_measures FROM {_PLAN} GROUP BY split")
def version_summary(manifest, split_names):
    plan = P.version_plan(_with_split(manifest, split_names), list(FONTS))
    return P.plan_summary(plan, manifest.select("doc_id", (F.col("doc_id") % 7).alias("n_measures")))


@query("manifest", sql="SELECT stem, doc_id, CASE WHEN doc_id % 6 = 1 THEN 'missing_audio' WHEN doc_id % 7 = 2 THEN 'missing_score' END AS problem FROM manifest")
def manifest_validation(manifest):
    return P.validated(manifest, manifest.where("doc_id % 6 <> 1").select("stem"), manifest.where("doc_id % 7 <> 2").select("doc_id")).select("stem", "doc_id", "problem")


@query("manifest", sql="SELECT CASE WHEN doc_id % 6 = 1 THEN 'missing_audio' ELSE 'missing_score' END AS problem, count(*) AS n, min(stem) AS first_stem, max(stem) AS last_stem FROM manifest WHERE doc_id % 6 = 1 OR doc_id % 7 = 2 GROUP BY 1")
def missing_log(manifest):
    found = P.validated(manifest, manifest.where("doc_id % 6 <> 1").select("stem"), manifest.where("doc_id % 7 <> 2").select("doc_id"))
    return P.missing_log(found)


@query("notes", sql="SELECT piece_id, round(onset_ms / 7000, 6) AS seconds, min(note_idx) AS note_idx FROM notes GROUP BY ALL")
def distinct_onsets(notes):
    """The first note of each onset, as rounded seconds tell them apart."""
    seconds = F.round(F.col("onset_ms") / 7000, 6)
    return P.first_of_each(notes, "note_idx", F.col("piece_id"), seconds).select("piece_id", seconds.alias("seconds"), "note_idx")


@query("manifest", sql="SELECT stem, concat('other_', replace(stem, '_', '-'), '.krn') AS file FROM manifest")
def renamed_files(manifest):
    return manifest.select("stem", P.renamed(F.col("stem"), "other_", ".krn", "_", "-").alias("file"))


@query("manifest", sql="SELECT stem FROM manifest WHERE lang IN ('en', 'de') AND doc_id % 9 <> 0")
def included_and_excluded(manifest):
    """A set of names to take and one to leave out."""
    return P.among(manifest.select("stem"), "stem", manifest.where(F.col("lang").isin("en", "de")).select("stem"), manifest.where("doc_id % 9 = 0").select("stem"))


@query("manifest", sql="""WITH f AS (SELECT concat('out/', source, '/', stem, '_v1.mid') AS path, concat(stem, '_v1') AS name, source, doc_id FROM manifest WHERE doc_id % 4 <> 0), w AS (SELECT stem AS wanted, source, doc_id FROM manifest)
    SELECT w.wanted, CASE WHEN a.path IS NOT NULL THEN 0 WHEN b.path IS NOT NULL THEN 1 WHEN c.path IS NOT NULL THEN 2 END AS rule, coalesce(a.path, b.path, c.path) AS path FROM w LEFT JOIN f a ON a.doc_id = w.doc_id AND w.doc_id % 3 = 0
    LEFT JOIN f b ON b.doc_id = w.doc_id AND w.doc_id % 3 = 1 LEFT JOIN (SELECT source, min(path) AS path FROM f GROUP BY source) c ON c.source = w.source""".join(("SELECT * FROM (", ")")))  # fmt: skip
def prediction_search(manifest):
    """The prediction of each piece: by the exact name, by a name that begins with it, else any file in a folder of its source."""
    files = manifest.where("doc_id % 4 <> 0").select(F.concat(F.lit("out/"), "source", F.lit("/"), "stem", F.lit("_v1.mid")).alias("path"), F.concat("stem", F.lit("_v1")).alias("name"))
    i = F.col("doc_id") % 3
    wanted = manifest.select(F.col("stem").alias("wanted"), "doc_id", "source")
    exact = (F.when(i == 0, F.concat("wanted", F.lit("_v1"))), F.col("name"))
    begins = (F.when(i == 1, F.col("wanted")), P.prefixes(F.col("name")))
    within = (F.col("source"), F.split("path", "/"))
    return P.ranked_lookup(wanted, files, [exact, begins, within])


@query("manifest", sql="SELECT count(*) AS n, round(sum(duration_sec), 6) AS total_sec, round(avg(duration_sec), 6) AS mean_sec, min(duration_sec) AS least_sec, max(duration_sec) AS most_sec, sum(n_frames)::BIGINT AS frames FROM manifest")
def manifest_statistics(manifest):
    return P.manifest_stats(manifest)


@query("manifest", sql="SELECT stem, round(CASE WHEN doc_id % 3 = 0 THEN n_frames * 160 / 16000 ELSE duration_sec END, 4) AS seconds, CAST(floor(round(CASE WHEN doc_id % 3 = 0 THEN n_frames * 160 / 16000 ELSE duration_sec END, 4) * 16000 / 160) AS BIGINT) AS frames FROM manifest")
def duration_fallback(manifest):
    gaps = manifest.withColumn("duration_sec", F.when(F.col("doc_id") % 3 != 0, F.col("duration_sec")))
    return P.durations(gaps).select("stem", "seconds", "frames")


@query("manifest", "split_names", sql=f"SELECT m.stem, s.split FROM manifest m JOIN (SELECT {_STEM} AS stem, split FROM split_names) s USING (stem) WHERE m.source <> 'src3' OR m.doc_id % 4 = 0")
def corpus_filters(manifest, split_names):
    """A selected list applies to one source only; a skip list and an excluded name elsewhere."""
    listed = _with_split(manifest, split_names).where("split <> 'train'")
    selected = listed.where("source = 'src3' and doc_id % 4 = 0").select("stem")
    from_list = listed.where("source = 'src3'").join(selected, "stem", "left_semi")
    return listed.where("source <> 'src3'").unionByName(from_list).select("stem", "split")


@query("manifest", sql="SELECT stem FROM manifest WHERE doc_id % 13 <> 0")
def skip_list(manifest):
    names = P.listed(manifest.where("doc_id % 13 = 0").select(F.concat(F.lit("  "), F.col("stem"), F.lit(".krn")).alias("value")))
    return manifest.join(names.withColumnRenamed("name", "stem"), "stem", "left_anti").select("stem")


@query("manifest", sql="SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 3 = 0) AS n_ok, count(*) FILTER (WHERE doc_id % 3 = 1) AS n_error, count(*) FILTER (WHERE doc_id % 3 = 2) AS n_skipped FROM manifest")
def outcome_counts(manifest):
    i = F.col("doc_id") % 3
    return P.outcomes(manifest.withColumn("status", F.when(i == 0, "ok").when(i == 1, "error: boom").otherwise("skipped_long")), "status")


@query("manifest", sql="SELECT source, lang, count(*) AS n FROM manifest GROUP BY ALL")
def performances_per_piece(manifest):
    return manifest.groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("manifest", sql="SELECT stem, regexp_replace(split_part(concat(stem, '_v2~x'), '~', 1), '^(.*)_v.*$', '\\1') AS base FROM manifest")
def base_stems(manifest):
    return manifest.select("stem", ids.base_stem(F.concat("stem", F.lit("_v2~x"))).alias("base"))


@query("pages", sql="""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE concat('/data/', url) END AS full_path, CASE WHEN list_contains(string_split(url, '/'), 'en') THEN array_to_string(string_split(url, '/')[list_position(string_split(url, '/'), 'en'):], '/')
    WHEN list_contains(string_split(url, '/'), 'fr') THEN array_to_string(string_split(url, '/')[list_position(string_split(url, '/'), 'fr'):], '/') ELSE string_split(url, '/')[-1] END AS tail FROM pages""".replace("url ELSE concat('/data/', url)", "concat('/', url) ELSE concat('/data/', url)"))  # fmt: skip
def paths(pages):
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/"), F.col("url"))).otherwise(F.col("url"))
    return pages.select("page_id", ids.resolve(path, "/data").alias("full_path"), ids.relative_from(F.col("url"), ["en", "fr"]).alias("tail"))


@query("pages", sql="SELECT split_part(url, '/', 3) AS folder, arg_min(url, concat(CASE split_part(url, '/', 4) WHEN 'de' THEN '0' WHEN 'en' THEN '1' END, url)) AS path FROM pages WHERE split_part(url, '/', 4) IN ('de', 'en') GROUP BY 1")
def catalogue_scan(pages):
    part = lambda i: F.get(F.split("url", "/"), F.lit(i))
    return P.first_existing(pages.select(part(2).alias("folder"), part(3).alias("name"), F.col("url").alias("path")), ["de", "en"])


@query("pages", sql="""WITH f AS (SELECT url AS path, split_part(url, '/', 3) AS h, split_part(url, '/', 4) AS l FROM pages WHERE page_id % 3 <> 0), w AS (SELECT DISTINCT concat(split_part(url, '/', 3), '|', split_part(url, '/', 4)) AS wanted, split_part(url, '/', 3) AS h, split_part(url, '/', 4) AS l FROM pages)
    SELECT w.wanted, CASE WHEN a.p IS NOT NULL THEN 0 WHEN b.p IS NOT NULL THEN 1 END AS rule, coalesce(a.p, b.p) AS path FROM w LEFT JOIN (SELECT h, l, min(path) AS p FROM f GROUP BY ALL) a ON w.h = a.h AND w.l = a.l LEFT JOIN (SELECT h, min(path) AS p FROM f GROUP BY ALL) b ON w.h = b.h""".join(("SELECT * FROM (", ")")))  # fmt: skip
def prediction_lookup(pages):
    host, lang = (F.get(F.split("url", "/"), F.lit(i)) for i in (2, 3))
    files = pages.where("page_id % 3 <> 0").select(F.col("url").alias("path"), host.alias("h"), lang.alias("l"))
    wanted = pages.select(F.concat_ws("|", host, lang).alias("wanted"), host.alias("h"), lang.alias("l")).distinct()
    both, one = F.concat_ws("|", "h", "l"), F.col("h")
    return P.ranked_lookup(wanted, files, [(both, both), (one, one)])


@query("pages", sql="""WITH w AS (SELECT DISTINCT substr(url, 9 + page_id % 5, 1 + page_id % 9) AS wanted FROM pages WHERE page_id % 4 = 0 AND length(url) > 20), f AS (SELECT url AS path FROM pages WHERE page_id % 3 <> 0 AND url IS NOT NULL)
    SELECT w.wanted, min(f.path) AS path FROM w LEFT JOIN f ON contains(f.path, w.wanted) GROUP BY w.wanted""".join(("SELECT * FROM (", ")")))
def path_search(pages):
    """The first path that contains each of many pieces of names."""
    piece = F.substr("url", (9 + F.col("page_id") % 5).cast("int"), (1 + F.col("page_id") % 9).cast("int"))
    wanted = pages.where("page_id % 4 = 0 and length(url) > 20").select(piece.alias("wanted")).distinct()
    return P.containing(wanted, pages.where("page_id % 3 <> 0 and url is not null").select(F.col("url").alias("path")))


@query("manifest", sql="SELECT stem, CAST(1 AS INTEGER) AS j, split_part(stem, '_', 1) AS \"left\", split_part(stem, '_', 2) AS \"right\" FROM manifest")
def split_points(manifest):
    return P.split_points(manifest.select("stem"), "stem").select("stem", "j", "left", "right")


@query("documents", sql="""SELECT doc_id, len(l) AS n_lines, CASE WHEN len(l) >= 6 THEN TRY_CAST(split_part(concat(l[-6], ': ', doc_id), ': ', 2) AS DOUBLE) END AS first_value FROM (SELECT doc_id, string_split(replace(text, ':', ''), chr(10)) AS l FROM documents)""")
def tool_output(documents):
    """The number in the sixth line from the end of a text of ``key: value`` lines; null below six lines."""
    lines = F.split(F.replace("text", F.lit(":"), F.lit("")), "\n")
    keyed = F.concat(F.get(F.slice(lines, -6, 6), F.lit(0)), F.lit(": "), F.col("doc_id").cast("string"))
    value = F.split_part(keyed, F.lit(": "), F.lit(2)).try_cast("double")
    return documents.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.when(F.size(lines) >= 6, value).alias("first_value"))


@query("measures", sql="SELECT doc_id, m_idx // 2 AS chunk_index, measure AS start_measure, last_measure AS end_measure, start_ms, window_end AS end_ms FROM (SELECT *, lead(measure, 4) OVER w AS last_measure, lead(end_ms, 4) OVER w AS window_end FROM measures WINDOW w AS (PARTITION BY doc_id ORDER BY m_idx)) WHERE m_idx % 2 = 0 AND last_measure IS NOT NULL")
def sliding_windows(measures):
    return C.sliding(measures, 5, 2)


_CHUNKS = "(SELECT doc_id, k AS chunk_idx, k * {s} AS start_frame, least(k * {s} + {c}, n_frames) AS end_frame, n_frames FROM (SELECT *, unnest(range(0, n_frames // {s} + 1)) AS k FROM manifest) WHERE k * {s} + {m} <= n_frames AND (k = 0 OR (k - 1) * {s} + {c} < n_frames))"


@query("manifest", sql=f"SELECT doc_id, chunk_idx, start_frame, end_frame FROM {_CHUNKS.format(c=24000, s=12000, m=12000)}")
def training_chunks(manifest):
    return C.frame_chunks(manifest).select("doc_id", "chunk_idx", "start_frame", "end_frame")


@query("manifest", sql=f"SELECT doc_id, chunk_idx, start_frame, end_frame FROM {_CHUNKS.format(c=6000, s=5000, m=1)}")
def inference_chunks(manifest):
    return C.frame_chunks(manifest, 6000, 1000, 1 / 6000).select("doc_id", "chunk_idx", "start_frame", "end_frame")


@query("manifest", "measures", sql=f"""SELECT c.doc_id, c.chunk_idx, min(m.m_idx) AS first_m, max(m.m_idx) AS last_m FROM {_CHUNKS.format(c=6000, s=5000, m=1)} c JOIN measures m ON c.doc_id = m.doc_id AND m.end_ms > c.start_frame // 10 AND m.start_ms < c.end_frame // 10 GROUP BY ALL""")
def chunk_measures(manifest, measures):
    chunks = C.frame_chunks(manifest, 6000, 1000, 1 / 6000).select("doc_id", "chunk_idx", F.floor(F.col("start_frame") / 10).alias("start"), F.floor(F.col("end_frame") / 10).alias("end"))
    return C.measures_in(chunks, measures, 1000)


_DENSE = _CHUNKS.format(c=24000, s=12000, m=12000)


@query("manifest", "measures", "tokens", sql=f"""SELECT * FROM (WITH l AS (SELECT doc_id, line_no, count(*) AS n FROM tokens GROUP BY ALL), c AS (SELECT c.doc_id, c.chunk_idx, c.start_frame, c.end_frame, coalesce(sum(l.n), 0) AS n_tokens
      FROM {_DENSE} c LEFT JOIN measures m ON m.doc_id = c.doc_id AND m.end_ms > c.start_frame // 10 AND m.start_ms < c.end_frame // 10 LEFT JOIN l ON l.doc_id = m.doc_id AND l.line_no = m.line_start GROUP BY ALL),
    d AS (SELECT doc_id, chunk_idx, start_frame, end_frame - start_frame AS n, unnest(range(0, (end_frame - start_frame) // 6000 + 1)) AS k FROM c WHERE n_tokens > 360)
    SELECT doc_id, chunk_idx, 0::BIGINT AS part, start_frame, end_frame FROM c WHERE n_tokens <= 360 UNION ALL SELECT doc_id, chunk_idx, k, start_frame + k * 6000, start_frame + least(k * 6000 + 12000, n) FROM d WHERE k * 6000 + 6000 <= n AND (k = 0 OR (k - 1) * 6000 + 12000 < n))""")
def dense_chunks(manifest, measures, tokens):
    """Chunks with more tokens in their measures than the budget, cut into shorter ones."""
    chunks = C.frame_chunks(manifest).select("doc_id", "chunk_idx", "start_frame", "end_frame").withColumns({"start": F.floor(F.col("start_frame") / 10), "end": F.floor(F.col("end_frame") / 10)})
    return C.with_dense_split(C.chunk_tokens(chunks, measures, tokens, 1000), 360).select("doc_id", "chunk_idx", "part", "start_frame", "end_frame")


@query("measures", "tokens", sql="""SELECT doc_id, chunk_idx, coalesce(bool_or(has_oov), false) AS has_oov FROM (SELECT doc_id, m_idx // 3 AS chunk_idx, line_start AS line_no FROM measures) JOIN (SELECT doc_id, line_no, bool_or(dur > 14) AS has_oov FROM tokens GROUP BY ALL) USING (doc_id, line_no) GROUP BY ALL""")
def recovered_chunks(measures, tokens):
    """Chunks of three lines with a word over 14 letters, which counts as unknown here."""
    chunks = measures.groupBy("doc_id", F.floor(F.col("m_idx") / 3).alias("chunk_idx")).agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"))
    return C.recovered(chunks, tokens.groupBy("doc_id", "line_no").agg(F.bool_or(F.col("dur") > 14).alias("has_oov")))


@query("tokens", "measures", sql="""WITH t AS (SELECT doc_id, line_no * 1000000 + spine AS pos, kind = 'bar' AND spine = 0 AS is_bar, kind = 'data' AS is_note FROM tokens), b AS (SELECT *, coalesce(count(*) FILTER (WHERE is_bar) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bars FROM t),
    s AS (SELECT doc_id, min(start_ms) AS a, max(end_ms) * 3 // 4 + 1 AS z, max(m_idx) AS last_m FROM measures GROUP BY doc_id), m AS (SELECT doc_id, m_idx, greatest(0::DOUBLE, least(1::DOUBLE, (start_ms - a) / (z - a))) AS low, greatest(0::DOUBLE, least(1::DOUBLE, (end_ms - a) / (z - a))) AS high FROM measures JOIN s USING (doc_id))
    SELECT b.doc_id, b.pos, CASE WHEN (is_bar OR is_note) AND high > low THEN round(low, 9) ELSE -1 END AS low, CASE WHEN (is_bar OR is_note) AND high > low THEN round(high, 9) ELSE -1 END AS high FROM b JOIN s USING (doc_id) LEFT JOIN m ON m.doc_id = b.doc_id AND m.m_idx = least(b.bars, s.last_m)""".join(("SELECT * FROM (", ")")))  # fmt: skip
def guidance_bounds(tokens, measures):
    """Time bounds of every bar and note within a chunk that ends at three quarters of the document."""
    rows = tokens.select("doc_id", (F.col("line_no") * 1_000_000 + F.col("spine")).alias("pos"), ((F.col("kind") == "bar") & (F.col("spine") == 0)).alias("is_bar"), (F.col("kind") == "data").alias("is_note"))
    spans = measures.groupBy("doc_id").agg(F.min("start_ms").alias("start"), (F.floor(F.max("end_ms") * 3 / 4) + 1).alias("end"))
    found = C.guidance_bounds(rows, measures.select("doc_id", "m_idx", F.col("start_ms").alias("start"), F.col("end_ms").alias("end")), spans)
    return found.select("doc_id", "pos", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("measures", sql="""WITH l AS (SELECT doc_id, measure % 20 AS measure, arg_max(line_start, m_idx) AS ls, arg_max(line_end, m_idx) AS le FROM measures GROUP BY ALL), w AS (SELECT doc_id, m_idx AS chunk_index, measure AS a, measure + 4 AS b FROM measures)
    SELECT w.doc_id, chunk_index, a AS start_measure, b AS end_measure, s.ls AS line_start, e.le AS line_end FROM w JOIN l s ON w.doc_id = s.doc_id AND w.a = s.measure JOIN l e ON w.doc_id = e.doc_id AND w.b = e.measure""".join(("SELECT * FROM (", ")")))  # fmt: skip
def window_lines(measures):
    windows = measures.select("doc_id", F.col("m_idx").alias("chunk_index"), F.col("measure").alias("start_measure"), (F.col("measure") + 4).alias("end_measure"))
    return C.window_lines(windows, measures.withColumn("measure", F.col("measure") % 20))


@query("measures", sql="SELECT a.doc_id, n_left, n_right FROM (SELECT doc_id, count(*) AS n_left FROM measures GROUP BY 1) a JOIN (SELECT doc_id, count(*) AS n_right FROM measures WHERE NOT (doc_id % 5 = 0 AND m_idx = 0) GROUP BY 1) b USING (doc_id) WHERE n_left <> n_right")
def alignment_mismatches(measures):
    return C.unaligned(measures, measures.where("not (doc_id % 5 = 0 and m_idx = 0)"))


@query("measures", sql="SELECT doc_id, m_idx, start_ms, line_start FROM measures")
def paired_measures(measures):
    return C.paired(measures.select("doc_id", "m_idx", "start_ms"), measures.select("doc_id", "m_idx", "line_start"))


@query("measures", sql="""WITH b AS (SELECT doc_id, m_idx // 4 AS c, CAST(m_idx // 4 * 3000 AS DOUBLE) AS s, CAST(m_idx // 4 * 3000 + 4000 AS DOUBLE) AS e FROM measures GROUP BY ALL), k AS (SELECT *, (s + lag(e) OVER w) / 2 AS lc, (lead(s) OVER w + e) / 2 AS rc FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY c)),
    m AS (SELECT doc_id, m_idx // 4 AS c, m_idx % 4 AS j, end_ms - start_ms AS t FROM measures), x AS (SELECT m.*, lc, rc, s + sum(t) OVER (PARTITION BY m.doc_id, m.c ORDER BY j) / sum(t) OVER (PARTITION BY m.doc_id, m.c) * (e - s) AS ends, count(*) OVER (PARTITION BY m.doc_id, m.c) AS n FROM m JOIN k ON m.doc_id = k.doc_id AND m.c = k.c),
    y AS (SELECT *, CASE WHEN lc IS NULL THEN 0 ELSE coalesce(min(j) FILTER (WHERE ends >= lc) OVER (PARTITION BY doc_id, c), n) END AS f, CASE WHEN rc IS NULL THEN n ELSE coalesce(min(j) FILTER (WHERE ends >= rc) OVER (PARTITION BY doc_id, c), n) END AS u FROM x)
    SELECT doc_id, c AS chunk_idx, j, t AS tokens FROM y WHERE j >= f AND j < u""".join(("SELECT * FROM (", ")")))  # fmt: skip
def stitched_chunks(measures):
    chunk = F.floor(F.col("m_idx") / 4)
    rows = measures.select("doc_id", chunk.alias("chunk_idx"), (F.col("m_idx") % 4).alias("j"), (F.col("end_ms") - F.col("start_ms")).alias("tokens"))
    bounds = measures.select("doc_id", chunk.alias("chunk_idx")).distinct().withColumns({"start": (F.col("chunk_idx") * 3000).cast("double"), "end": (F.col("chunk_idx") * 3000 + 4000).cast("double")})
    return C.stitched(rows, bounds)


_BUCKET = "(n_frames >= 15000)::INTEGER + (n_frames >= 20000)::INTEGER + (n_frames >= 25000)::INTEGER + (n_frames >= 30000)::INTEGER"
_BOUNDS = (15_000, 20_000, 25_000, 30_000)


@query("manifest", sql=f"SELECT stem, {_BUCKET} AS bucket FROM manifest")
def length_buckets(manifest):
    return B.bucketed(manifest, "n_frames", _BOUNDS).select("stem", "bucket")


@query("manifest", sql=f"SELECT stem, bucket, (rn - 1) // 16 AS batch FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY stem) AS rn, count(*) OVER (PARTITION BY bucket) AS n FROM (SELECT *, {_BUCKET} AS bucket FROM manifest)) WHERE ((rn - 1) // 16 + 1) * 16 <= n")
def bucket_batches(manifest):
    return B.batched(B.bucketed(manifest, "n_frames", _BOUNDS), "stem", 16, "stem", drop_last=True).select("stem", "bucket", "batch")


@query("manifest", sql=f"""SELECT stem, bucket, p AS at, p // 64 AS batch, p % 64 // 16 AS rank FROM (SELECT *, unnest(range(rn - 1, ceil(n / 64)::BIGINT * 64, n)) AS p FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY stem) AS rn, count(*) OVER (PARTITION BY bucket) AS n FROM (SELECT *, {_BUCKET} AS bucket FROM manifest)))""")
def rank_plan(manifest):
    return B.ranked(B.bucketed(manifest, "n_frames", _BOUNDS), "stem", 16, 4).select("stem", "bucket", "at", "batch", "rank")


@query("manifest", sql="SELECT stem, max(n_chars) OVER w AS padded_tokens, CAST(ceil(max(n_frames) OVER w / 32) * 32 AS BIGINT) AS padded_frames, round(n_frames / (ceil(max(n_frames) OVER w / 32) * 32), 9) AS valid_ratio FROM (SELECT *, n_frames // 10 AS n_chars FROM manifest) WINDOW w AS (PARTITION BY source)")
def padded_batches(manifest):
    rows = manifest.withColumn("n_tokens", F.floor(F.col("n_frames") / 10))
    return B.padded(rows, "source").select("stem", "padded_tokens", "padded_frames", F.round("valid_ratio", 9).alias("valid_ratio"))


@query("tokens", sql="SELECT doc_id, array_to_string(l[:len(l) - 1], ',') AS inputs, array_to_string(l[2:], ',') AS labels FROM (SELECT doc_id, list(dur ORDER BY line_no, spine)[:4096] AS l FROM tokens GROUP BY doc_id)")
def shifted_labels(tokens):
    ids_ = tokens.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "spine", "dur"))), lambda x: x["dur"]).alias("ids"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return B.shifted(ids_, "ids", 4096).select("doc_id", text("inputs"), text("labels"))


@query("embeddings", sql="SELECT vec_id, i, round((x - avg(x) OVER w) / (stddev_samp(x) OVER w + 1e-9::DOUBLE), 6) AS z FROM (SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) WINDOW w AS (PARTITION BY vec_id)")
def standardised_samples(embeddings):
    rows = embeddings.select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return B.standardised(rows, "vec_id", "x").select("vec_id", "i", F.round("z", 6).alias("z"))


@query("lineitem", sql="SELECT l_returnflag AS kind, count(*) AS n, round(avg(CAST(l_discount AS DOUBLE)), 9) AS loss FROM lineitem WHERE l_quantity > 5 GROUP BY 1")
def loss_by_class(lineitem):
    return lineitem.where("l_quantity > 5").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("l_discount").cast("double")), 9).alias("loss"))


@query("customer", "nation", sql="SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, n_name, 'default') AS value FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey > 1")
def config_overlay(customer, nation):
    """A given value, else the file's, else the default."""
    given = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name"))
    return customer.join(nation.where("n_regionkey > 1"), customer.c_nationkey == nation.n_nationkey, "left").select("c_custkey", F.coalesce(given, F.col("n_name"), F.lit("default")).alias("value"))


@query("measures", sql="SELECT doc_id, m_idx, last_value(o IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY m_idx) AS original FROM (SELECT *, CASE WHEN m_idx % 3 <> 1 THEN measure END AS o FROM measures)")
def inherited_measures(measures):
    rows = measures.select("doc_id", "m_idx", F.col("m_idx").alias("expanded"), F.when(F.col("m_idx") % 3 != 1, F.col("measure")).alias("original"))
    return P.last_measure_inherited(rows).select("doc_id", "m_idx", "original")


@query("tokens", sql="""SELECT doc_id, line_no, spine, least(bars, n - 1) AS m_idx FROM (SELECT t.*, coalesce(count(*) FILTER (WHERE kind = 'bar') OVER (PARTITION BY doc_id ORDER BY line_no, spine ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bars, (SELECT 3) AS n FROM tokens t) WHERE kind = 'data'""")
def guidance_measures(tokens):
    """Measure of each note token: bars before it, or the last measure beyond the end (here of three)."""
    before = Window.partitionBy("doc_id").orderBy("line_no", "spine").rowsBetween(Window.unboundedPreceding, -1)
    bars = F.coalesce(F.count_if(F.col("kind") == "bar").over(before), F.lit(0))
    return tokens.withColumn("m_idx", F.least(bars, F.lit(2)).cast("long")).where("kind = 'data'").select("doc_id", "line_no", "spine", "m_idx")


@query("manifest", sql="SELECT stem, n_frames, CAST(power AS BIGINT) AS power FROM (SELECT *, doc_id % 300 + 1 AS d FROM manifest ORDER BY md5(concat(stem, '|0')), stem LIMIT 100) JOIN (SELECT d, arg_min(p, {'c': abs(p - d) * (128 // p), 'p': p}) AS power FROM (SELECT unnest(range(1, 301)) AS d) CROSS JOIN (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128]) AS p) GROUP BY d) USING (d)")
def audit_sample(manifest):
    """A fixed sample for an audit, each with the plain duration nearest to a number."""
    return P.sampled(manifest, "stem", 100).select("stem", "n_frames", T.nearest_power(F.col("doc_id") % 300 + 1).alias("power"))


QUERIES, ORACLE_SQL = query.queries, query.sql
