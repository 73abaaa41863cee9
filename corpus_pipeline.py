"""A training-data pipeline over `documents`: each stage works on all that the one before kept.

Stages but the last return the columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import langid
from scorewright.llm.common import Store, documents
from scorewright.llm.debruijn import substring_dedup
from scorewright.llm.decontaminate import decontaminate
from scorewright.llm.minhash import near_duplicates
from scorewright.llm.sentencepiece_nbest import encode

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, or no letters) go; a missing lang is filled with the prediction."""
    told = langid.identify(docs.select(*COLUMNS), langid.train(docs), keep=COLUMNS)
    return told.where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word sets, 0.8) stays, that with the least id.

    Where ids are null or repeat they do not tell rows apart: rows then get numbers of
    their own, and of rows with one id the first stays. So one copy of every text is kept.
    """
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        gone = near_duplicates(docs, width=5, threshold=80).where("not kept").select(F.col("doc_id").alias("gone_"))
        return docs.join(gone, docs["doc_id"] == gone["gone_"], "left_anti").select(*COLUMNS)
    store = Store(spark, "numbered")
    docs = store.keep(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_")), "docs")
    group = near_duplicates(docs, id_col="row_", width=5, threshold=80).select("row_", "component_id")
    least = docs.select("row_", "doc_id").join(group, "row_").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_")).alias("least")).select("least.row_")
    return docs.join(least, "row_", "left_semi").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that repeat go; documents without any word left go."""
    cut = substring_dedup(docs, keep_text=True, keep=["lang", "source"])
    return cut.where("n_words > n_removed").withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, its best and next best scores, and whether decoding gives the text back."""
    return encode(docs)


STAGES = [("language_id", language_id), ("minhash_near_dedup", near_dedup), ("substring_dedup", substrings), ("benchmark_decontamination", benchmark), ("sentencepiece", pieces)]

#: SQL can express neither a trained classifier nor the piece lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    store = Store(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir), name)
    return docs
