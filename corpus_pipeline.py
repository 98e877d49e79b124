"""From raw documents to a mix: rejects low quality and unknown language, keeps one of near-duplicates, cuts benchmark passages, mixes.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return documents' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import decontam, langid, mixing, quality, simhash
from loomstone.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
QUALITY_FROM, LANGUAGE_FROM = 0.5, 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of QUALITY_FROM or more."""
    docs = docs.select(*COLUMNS)
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, keep=COLUMNS, score="quality_score", attention="quality_attention")
    return scored.where(F.col("quality_score") >= QUALITY_FROM).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles tell with a score of LANGUAGE_FROM or more; und goes."""
    docs = docs.select(*COLUMNS)
    found = langid.identify_language(docs, langid.fit_profiles(docs), keep=COLUMNS, lang="language_found", score="language_score")
    return found.where((F.col("language_found") != "und") & (F.col("language_score") >= LANGUAGE_FROM)).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each near-duplicate group. Rows are told apart by themselves, not by their ids."""
    return simhash.keep_one(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, benchmark passages cut out of their texts."""
    clean = decontam.remove_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with the words that it takes of each."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", dedup_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage)]
ORACLE_SQL = None  # the stages learn and search; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
