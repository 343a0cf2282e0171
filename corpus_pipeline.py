"""A corpus pipeline of five stages: toxicity, language, near duplicates, benchmark contamination, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written and read again as the next one's ``docs``.
All but the last return the columns of ``documents``.

Defined results: documents with a null or empty text have no language and go in the second stage; tables without
labels reject nothing as toxic; tables without languages reject every document in the second stage, as none can be
identified. An empty table of documents gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoretables.llm import decontaminate, langid, neardup, packing, toxicity
from scoretables.llm.tables import fold, load, scope, scratch_path

#: Language scores below this many parts in the number of languages are rejected; no evidence at all gives one part.
LEAST_PARTS = 1.2


def _row(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold."""
    learn = docs.where(fold(F.col("doc_id"), 5) != 0)
    labels = load(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    model = toxicity.fit(learn.select("doc_id", "text"), labels, langid.fit(learn))
    return _row(toxicity.score(docs, model, keep=tuple(docs.columns)).where("score < 0.5"), docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told."""
    model = langid.fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    found = langid.identify(docs, model, keep=tuple(docs.columns))
    least = min(1.0, LEAST_PARTS / max(1, len(model.languages)))
    return _row(found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= least)), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 0.8 on five-word shingles the one with the smallest id."""
    return neardup.kept_documents(docs, width=5, threshold=80)


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than one word in twenty."""
    return decontaminate.without_documents(docs, load(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, in sequences of 2048 tokens."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), temperature=0.7)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", contamination_stage),
    ("packing", packing_stage),
]

#: The stages learn, hash and iterate; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scope(spark):  # what a stage has put aside goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
