"""URL filter: host and path rules first, then a blocked Bloom filter and an exact hash join against listed URLs.

A url's canonical form has no scheme, fragment, default port or tracking parameters, a lower-case host and no final
slash. The filter has one block of 512 bits (8 longs) for each value of the hash's high part and sets HASHES bits in
it; it is a table of at most MAX_BLOCKS rows, whatever the list's size, so it may be broadcast. Urls that miss a bit
are not listed. Possible hits go to an exact join with the list, which removes false positives.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and no canonical form and is
allowed; repeated urls are judged each; an empty list blocks nothing. Listed nulls are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoretables.llm import tables

# Verdict, host and path start of each rule.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
# Hosts whose pages are the list of the registered query.
LISTED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com")
WORDS, HASHES, BITS_PER_URL = 8, 6, 12
#: 2^17 blocks of 64 bytes: 8 MB. A longer list makes more false positives, which the exact join removes.
MAX_BLOCKS = 1 << 17
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """``host/path?query``; null where the url has no host."""
    plain = F.regexp_replace(host(url), r":(80|443)$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(plain != "", F.concat(plain, F.regexp_replace(path(url), "/+$", ""), tail))


def rule(hosts: Column, paths: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((hosts == name) | hosts.endswith(f".{name}")) & paths.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _bits(url: Column, blocks: Column | int) -> tuple[Column, Column]:
    """The block of a url and its masks, one for each of the block's words."""
    block = F.pmod(F.xxhash64(F.lit(1), url), F.lit(blocks) if isinstance(blocks, int) else blocks).cast("int")
    spots = F.expr(f"transform(sequence(0, {HASHES - 1}), i -> cast(shiftrightunsigned(h, 9 * i) & 511 as int))")
    masks = F.expr(f"transform(sequence(0, {WORDS - 1}), w -> aggregate(spots, 0L, (acc, s) -> if(s div 64 = w, acc | shiftleft(1L, s % 64), acc)))")
    return block, (spots, masks)


def _masked(df: DataFrame, blocks: int, name: str = "canonical") -> DataFrame:
    block, (spots, masks) = _bits(F.col(name), blocks)
    return df.withColumn("block", block).withColumn("h", F.xxhash64(F.lit(2), name)).withColumn("spots", spots).withColumn("masks", masks).drop("h", "spots")


def bloom(listed: DataFrame, blocks: int, name: str = "canonical") -> DataFrame:
    """The filter: ``block`` and its words ``w0`` to ``w7``. ``listed``: distinct ``canonical``, or what column ``name`` holds."""
    return _masked(listed, blocks, name).groupBy("block").agg(*(F.bit_or(F.col("masks")[i]).alias(f"w{i}") for i in range(WORDS)))


def blocks_for(n: int) -> int:
    """Blocks of a filter of ``n`` items."""
    return min(MAX_BLOCKS, 1 << max(0, (n * BITS_PER_URL // (64 * WORDS)).bit_length()))


def _passes() -> Column:
    """Whether all bits of ``masks`` are in the words ``w0`` to ``w7``."""
    out = F.lit(True)
    for i in range(WORDS):
        out = out & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(F.col("masks")[i]) == F.col("masks")[i])
    return out


def passing(rows: DataFrame, listed: DataFrame, n: int, name: str) -> DataFrame:
    """``rows`` whose column ``name`` may be in that of ``listed``, which has ``n`` rows without repeats, of one type with
    it: all that are, and few others. The rows are not moved, only the filter is broadcast."""
    blocks = blocks_for(n)
    filled = tables.scratch(bloom(listed.select(name), blocks, name), "bloom")
    return _masked(rows, blocks, name).join(F.broadcast(filled), "block").where(_passes()).select(*rows.columns)


def judged(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Per row ``id``, ``host``, ``path``, ``rule``, ``verdict`` and ``listed`` (the exact join's answer; null under a rule).

    ``listed`` has a column ``url``. The list is written once, without repeats, before it is used twice.
    """
    exact = tables.scratch(listed.select(canonical(F.col("url")).alias("canonical")).where("canonical is not null").distinct(), "listed")
    blocks = blocks_for(exact.count())
    filled = tables.scratch(bloom(exact, blocks), "bloom")
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical"))
    rows = rows.withColumn("found", rule(F.col("host"), F.col("path"), rules))
    open_rows = F.when(F.col("found").isNull(), F.col("canonical"))
    probed = _masked(rows.withColumn("canonical", open_rows), blocks).join(F.broadcast(filled), "block", "left")
    probed = probed.select("id", "host", "path", "found", F.when(_passes() & F.col("canonical").isNotNull(), F.col("canonical")).alias("canonical"))
    # Only possible hits meet the list. A url with very many pages is split by the adaptive skew join.
    hits = probed.where("canonical is not null").join(exact.withColumn("listed", F.lit(True)), "canonical", "left")
    out = hits.select("id", "host", "path", "found", "listed").unionByName(probed.where("canonical is null").select("id", "host", "path", "found", F.lit(None).cast("boolean").alias("listed")))
    verdict = F.coalesce("found.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("found").isNull(), F.coalesce("listed", F.lit(False))).alias("listed"))


_H = rf"translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_LISTED = ", ".join(f"'{h}'" for h in LISTED_HOSTS)
#: What the registered query gives, with plain joins.
ORACLE_SQL = rf"""
WITH split AS (SELECT page_id, url, coalesce({_H}, '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
canon AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))) AS kept FROM split),
form AS (SELECT page_id, host, path, CASE WHEN regexp_replace(host, ':(80|443)$', '') <> '' THEN
    concat(regexp_replace(host, ':(80|443)$', ''), regexp_replace(path, '/+$', ''), CASE WHEN len(kept) > 0 THEN concat('?', array_to_string(kept, '&')) ELSE '' END) END AS canonical FROM canon),
listed AS (SELECT DISTINCT canonical FROM form WHERE regexp_replace(host, '^www\.', '') IN ({_LISTED}) AND canonical IS NOT NULL),
rules AS (SELECT * FROM (VALUES {_RULES}) AS t(verdict, name, start)),
best AS (SELECT f.page_id, arg_max(concat(r.name, r.start), length(concat(r.name, r.start))) AS rule, arg_max(r.verdict, length(concat(r.name, r.start))) AS verdict
         FROM form f JOIN rules r ON (f.host = r.name OR ends_with(f.host, concat('.', r.name))) AND starts_with(f.path, r.start) GROUP BY f.page_id)
SELECT f.page_id, f.host, f.path, b.rule, coalesce(b.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN b.rule IS NULL THEN l.canonical IS NOT NULL END AS listed
FROM form f LEFT JOIN best b USING (page_id) LEFT JOIN listed l ON f.canonical = l.canonical
"""
