"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoretables.llm import decontaminate, hardneg, langid, licenses, linededup, neardup, packing, quality, toxicity, urlfilter, vectors, warc, whitening
from scoretables.llm.tables import fold, load, scratch, scratch_path

TOKENIZER = "byte_bpe_50k.json"
#: Of the mixture that op8 packs: large sources give way to small ones until these run dry.
TEMPERATURE = 0.7


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written, read back and assembled."""
    path = scratch_path(spark, "archives")
    warc.write(warc.records(load(spark, sf_dir, "pages")), path)
    found = warc.assemble(warc.read(spark, path, payload=False))
    found = found.select(
        F.regexp_extract("metadata.fields", r"page-id: (-?\d+)", 1).try_cast("long").alias("page_id"), "response.payload_bytes", "response.payload_digest",
        F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("refers_id"), F.col("response.uri").alias("uri"), "capture",
    )
    found = scratch(found, "captures")
    first = found.where("record_type = 'response'").select(F.col("capture").alias("refers_id"), F.col("page_id").alias("refers_to"))
    return found.join(first, "refers_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri")


def op2_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose fold of 3 is not 1."""
    docs = load(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.where(~held_out))
    found = langid.identify(docs, model)
    return found.select("row.doc_id", (fold(F.col("row.doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words of every benchmark item against every whole document."""
    found = decontaminate.hits(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    return decontaminate.judged(found).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_quality_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels whose fold of 3 is not 1."""
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    found = quality.score(docs, model)
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_url_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the rules and the listed urls of the listed hosts."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(F.regexp_replace(urlfilter.host(F.col("url")), r"^www\.", "").isin(*urlfilter.LISTED_HOSTS))
    return urlfilter.judged(pages, listed).withColumnRenamed("id", "page_id")


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents over links of 0.8 on two-word shingles."""
    found = neardup.near_duplicates(load(spark, sf_dir, "documents"), width=2, threshold=80)
    return found.withColumnRenamed("id", "doc_id").select("doc_id", "n_shingles", "component_id", "kept")


def op7_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all vectors over links of cosine 0.98 within a label."""
    return vectors.near_vectors(load(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op8_deficit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; sources are mixed by their shares to the power TEMPERATURE."""
    pieces = packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), temperature=TEMPERATURE)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op9_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels whose fold of 5 is not 0."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    languages = langid.fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    model = toxicity.fit(docs.select("doc_id", "text"), labels.where(fold(F.col("doc_id"), 5) != 0), languages)
    found = toxicity.score(docs, model)
    return found.select("row.doc_id", (fold(F.col("row.doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical digest and what known licences and notices it is or holds."""
    return licenses.scan(load(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op11_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hardneg.hard_negatives(rows, F.col("id") % 100 == 0)


def op12_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the four principal components of all distinct ones, whitened."""
    return whitening.whitened(load(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of what every document keeps of its lines."""
    found = linededup.dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(linededup.kept_text(F.col("row.text"), F.col("keep")), 256)
    return found.select("row.doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_warc_transactions, op2_language_backoff, op3_benchmark_decontamination, op4_quality_ridge, op5_url_bloom, op6_lsh_forest, op7_pca_tiles, op8_deficit_packing, op9_toxicity_cnn, op10_license_digests, op11_angular_negatives, op12_cholesky_whitening, op13_line_bitmaps)
}

ORACLE_SQL: dict[str, str] = {"op5_url_bloom": urlfilter.ORACLE_SQL, "op10_license_digests": licenses.ORACLE_SQL, "op11_angular_negatives": hardneg.ORACLE_SQL, "op13_line_bitmaps": linededup.ORACLE_SQL}
