"""Line dedup: lines that many documents share are dropped from all but one of them, as keep bitmaps.

Each line that is long enough becomes a 128-bit hash of its key with the document and its position; texts go no
further. These rows are dealt by ranges of (hash, document) and sorted within by position, so that the lines of a
common hash lie side by side over as many tasks as they fill, and one pass over a task's sorted rows sees the first
occurrence of each hash in each document. Their counts, added up within tasks before they are shuffled, say which
hashes are common and which document keeps them; the lines of those in all other documents set bits.

A document's bitmap is compressed: an array of ``word`` and ``keep``, sorted, where ``keep`` has a bit for each of the 64
lines from 64 * word on (1: stays), and words that keep all their lines are left out. kept_text() applies it.

Everything is built-in DataFrame functions. Defined results: a null text is empty, and has one empty line; rows that
repeat an id are one document when documents are counted, and each row has the bitmap of its own text; rows with a
null id are no documents, count for nothing and keep all lines. Where several documents are the largest, there is
but one, as ids are compared whole. Without documents there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoretables.llm import tables

#: Code points of the shortest key, and documents from which on it is common.
LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
# Fixed value: what is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEEP = "array<struct<word:int,keep:bigint>>"


def lines(text: Column) -> Column:
    """The lines of a text; a null text has an empty one."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def _version(text: Column) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """A written table of ``hash``, ``doc``, ``version`` and ``pos`` of every line whose key has ``least_chars`` code points or more."""
    # A short line has a short key, so most lines are passed over before they are trimmed.
    long_ones = F.filter(F.transform(lines(F.col("body")), lambda line, i: F.struct(i.alias("pos"), line.alias("line"))), lambda x: F.length(x["line"]) >= least_chars)
    found = docs.where("doc is not null").select("doc", _version(F.col("body")).alias("version"), F.explode(long_ones).alias("x"))
    keyed = found.select("doc", "version", F.col("x.pos").alias("pos"), line_key(F.col("x.line")).alias("key")).where(F.length("key") >= least_chars)
    return tables.scratch(keyed.select(F.substring(F.unhex(F.sha2("key", 256)), 1, 16).alias("hash"), "doc", "version", "pos"), "lines")


def common(found: DataFrame, least_documents: int) -> DataFrame:
    """A written table of the hashes that ``least_documents`` documents or more hold, and of these the ``last``. ``found``: as hashed_lines() gives it."""
    # As many ranges as a shuffle has partitions; the window needs no further exchange.
    ordered = found.select("hash", "doc", "pos").repartitionByRange(F.col("hash"), F.col("doc"))
    first = F.row_number().over(Window.partitionBy("hash", "doc").orderBy("pos")) == 1
    firsts = ordered.withColumn("first", first).where("first")
    counted = firsts.groupBy("hash").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last"))
    return tables.scratch(counted.where(F.col("n_docs") >= least_documents), "common")


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``doc``, ``version``, ``n_dropped`` and ``keep`` of the documents that lose lines. ``docs``: ``doc`` and ``body``."""
    found = hashed_lines(docs, least_chars)
    dropped = found.join(common(found, least_documents), "hash").where("doc <> last")
    # Rows that repeat a document set the same bits again.
    words = dropped.groupBy("doc", "version", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
    entry = F.struct("word", F.bitwise_not("gone").alias("keep"))
    out = words.groupBy("doc", "version").agg(F.sum(F.bit_count("gone")).alias("n_dropped"), F.sort_array(F.collect_list(entry)).alias("keep"))
    return tables.scratch(out, "bitmaps")


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that stay, joined again. The bitmap is first written out, one number for each 64 lines."""
    gap = lambda x, i: x["word"] - F.when(i > 0, F.get(keep, i - 1)["word"]).otherwise(-1) - 1
    dense = F.flatten(F.transform(keep, lambda x, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), gap(x, i)), F.array(x["keep"]))))
    both = F.struct(lines(text).alias("lines"), dense.alias("words"))
    # As the one element of an array the bitmap is made once a text, not once a line.
    stays = lambda b: F.filter(b["lines"], lambda line, i: F.coalesce(F.getbit(F.get(b["words"], F.shiftright(i, 6)), i % 64), F.lit(1)) == 1)
    kept = F.array_join(F.get(F.transform(F.array(both), stays), F.lit(0)), "\n")
    return F.when(F.size(keep) > 0, kept).otherwise(F.coalesce(text, F.lit("")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Per row ``row`` (all its columns), ``n_lines``, ``n_dropped`` and ``keep`` (empty: all lines stay).

    Lines whose key (stripped, A-Z lower-cased) has at least ``least_chars`` code points and occurs in at least
    ``least_documents`` documents go from all documents but the one with the largest id.
    """
    bitmaps = keep_bitmaps(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body")), least_chars, least_documents)
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.col(id_col).alias("doc"), _version(F.col(text_col)).alias("version"))
    # The bitmaps grow with the texts, so they are not broadcast where they happen to be few: every size has one plan.
    out = rows.join(bitmaps.hint("merge"), ["doc", "version"], "left")
    return out.select("row", F.size(lines(F.col("row")[text_col])).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("keep", F.array().cast(KEEP)).alias("keep"))


#: What the registered query gives, with plain joins.
ORACLE_SQL = f"""
WITH split AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{_UPPER}', '{_LOWER}') AS key FROM line),
common AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= {LEAST_CHARS} AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS})
SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (k.doc_id <> c.last) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (c.last IS NULL OR k.doc_id IS NULL OR k.doc_id = c.last), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY k.row
"""
