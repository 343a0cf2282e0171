"""Licence scan by canonical digest: entire texts, normalised, are hash-joined to the digests of known licences.

Only DataFrame functions. The canonical form drops copyright lines, lower-cases, turns every run of characters other
than letters and digits into one blank and writes equivalent spellings alike. A text matches if its canonical form has
the digest of a known one: some of the table are texts, with or without their title line, long ones are given by their
digests. Each single line that speaks of a licence is looked up the same way among known notices.

Defined results: null texts have a null digest and match nothing; empty texts, and texts of punctuation or copyright
lines only, have the digest of the empty form and match nothing; repeated rows are judged each; a known text given
twice, under several ids, counts as the smallest id. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoretables.llm import known_licenses as K

# Spellings that count as equal, from the matching guidelines of public licence lists.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"), ("authoris", "authoriz"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("categoris", "categoriz"), ("centre", "center"),
    ("copyright owner", "copyright holder"), ("emphasis", "emphasiz"), ("favour", "favor"), ("initialis", "initializ"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("licence", "license"), ("maximis", "maximiz"), ("modelling", "modeling"), ("non commercial", "noncommercial"),
    ("optimis", "optimiz"), ("organis", "organiz"), ("per cent", "percent"), ("programme", "program"), ("realis", "realiz"),
    ("recognis", "recogniz"), ("signalling", "signaling"), ("sub license", "sublicense"), ("utilis", "utiliz"), ("whilst", "while"),
)
COPYRIGHT_LINE = r"\n[^\p{L}\p{N}\n©]*(?:[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt][ \t]*(?:\([Cc]\)|©|[0-9]|[\[<{:])|\([Cc]\)|©|[Aa][Ll][Ll] [Rr][Ii][Gg][Hh][Tt][Ss] [Rr][Ee][Ss][Ee][Rr][Vv][Ee][Dd])[^\n]*"
OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    plain = F.regexp_replace(F.concat(F.lit("\n"), text), COPYRIGHT_LINE, "\n")
    plain = F.trim(F.regexp_replace(F.lower(plain), OTHER, " "))
    for spelling, same in SPELLINGS:
        plain = F.replace(plain, F.lit(spelling), F.lit(same))
    return plain


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def rows_of(spark: SparkSession, pairs: tuple[tuple[str, str], ...], second: str) -> DataFrame:
    """Constant pairs as rows ``license_id`` and ``second``."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(a).alias("license_id"), F.lit(b).alias(second)) for a, b in pairs))))


def digests(texts: DataFrame) -> DataFrame:
    """``license_id`` and ``digest`` of texts (license_id, body) whose canonical form is not empty."""
    return texts.where(canonical(F.col("body")) != "").select("license_id", digest(F.col("body")).alias("digest"))


def known(spark: SparkSession) -> DataFrame:
    """``license_id`` and ``digest`` of all known texts."""
    listed = digests(rows_of(spark, K.TEXTS, "body"))
    return listed.unionByName(rows_of(spark, tuple(K.DIGESTS.items()), "digest")) if K.DIGESTS else listed


def scan(docs: DataFrame, licenses: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", notices: tuple[tuple[str, str], ...] = K.NOTICES) -> DataFrame:
    """Per row ``id``, ``digest``, ``license_id`` of the entire text (or null) and ``notices``, sorted and comma-joined.

    ``licenses`` (license_id, body) may be of any size: whether it is broadcast is left to the optimizer's size check.
    ``notices`` are constants; their digests are made once and are part of the plan.
    """
    spark = docs.sparkSession
    table = (known(spark) if licenses is None else digests(licenses)).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    named = {r.digest: r.license_id for r in digests(rows_of(spark, notices, "body")).collect()} if notices else {}
    by_line = F.map_from_arrays(F.array(*(F.lit(x) for x in named)), F.array(*(F.lit(x) for x in named.values()))) if named else F.create_map().cast("map<string,string>")
    lines = F.filter(F.split("body", "\n"), lambda x: F.lower(x).contains("licen"))
    names = F.array_compact(F.transform(lines, lambda x: F.try_element_at(by_line, digest(x))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    rows = rows.select("id", digest(F.col("body")).alias("digest"), F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("notices"))
    return rows.join(table, "digest", "left").select("id", "digest", "license_id", "notices")


def _sql_canonical(text: str) -> str:
    out = rf"trim(regexp_replace(lower(regexp_replace(concat(chr(10), {text}), '{COPYRIGHT_LINE}', chr(10), 'g')), '{OTHER}', ' ', 'g'))"
    for spelling, same in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{same}')"
    return out


def _sql_rows(pairs, second: str) -> str:
    quoted = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in pairs)
    return f"(VALUES {quoted}) AS t(license_id, {second})"


_LISTED = f"SELECT sha256(c) AS digest, license_id FROM (SELECT license_id, {_sql_canonical('body')} AS c FROM {_sql_rows(K.TEXTS, 'body')}) WHERE c <> ''"
_GIVEN = f" UNION ALL SELECT digest, license_id FROM {_sql_rows(K.DIGESTS.items(), 'digest')}" if K.DIGESTS else ""
ORACLE_SQL = f"""
WITH known AS (SELECT digest, min(license_id) AS license_id FROM ({_LISTED}{_GIVEN}) GROUP BY digest),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
notice AS (SELECT license_id, sha256({_sql_canonical('body')}) AS digest FROM {_sql_rows(K.NOTICES, 'body')}),
found AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
          FROM (SELECT doc_id, sha256({_sql_canonical('line')}) AS digest FROM lines WHERE contains(lower(line), 'licen')) JOIN notice USING (digest) GROUP BY doc_id),
whole AS (SELECT doc_id, text, sha256({_sql_canonical('text')}) AS digest FROM documents)
SELECT w.doc_id, w.digest, k.license_id, CASE WHEN w.text IS NULL THEN NULL ELSE coalesce(f.notices, '') END AS notices
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN found f USING (doc_id)
"""
