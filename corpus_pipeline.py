"""From documents to packed training sequences: filters, deduplication, decontamination and packing in stages.

Rows with a null doc_id pass the stages that match documents by id. Columns beside those of the documents table stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framestride.llm import containment, jaccard_join, language, packing, toxicity
from framestride.session import arrow_rows, stage

#: Confidence below which a language counts as not identified.
LEAST_SCORE = 0.4


def _judged(docs: DataFrame, texts: int) -> DataFrame:
    """The documents that a model keeps, written while this many texts go to Python at once: larger batches take an executor's memory."""
    with arrow_rows(docs.sparkSession, texts):
        return stage(docs)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold of their language."""
    network = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = docs.where(toxicity.toxicity(F.col("text"), network) < toxicity.threshold(F.col("lang"), network))
    return _judged(kept, toxicity.TEXTS_AT_ONCE)


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    found = language.predicted(F.col("text"), language.train(docs))
    kept = docs.where((found["lang_pred"] != language.UNKNOWN) & (found["score"] >= LEAST_SCORE))
    return _judged(kept, language.TEXTS_AT_ONCE)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; of rows that share a doc_id, one."""
    return jaccard_join.without_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return docs.where(~containment.is_contaminated(F.col("text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("language_id", with_language),
    ("ngram_jaccard_join", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: Trained models, tokenizer merges and bin packing are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = step(spark, docs, sf_dir)
    return docs
