"""A training-data pipeline: each stage reads the documents that the stage before it kept.

Every stage is a function of (spark, docs, sf_dir). Its rows are written as Parquet and
read again for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import ngram_join, pii, piece_nbest, source_mixing, toxicity
from lodestone.llm.common import shared_dir
from lodestone.sources.storage import stashes

#: The toxicity model and the seeded mix are no SQL.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold; null and empty texts stay, so do repeated rows."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: five-word shingles, a similarity of 0.8.

    The least id of a group stays; documents without words or without an id stay.
    """
    return ngram_join.drop_similar(docs, percent=80, width=5)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with confirmed personal data replaced by its kind; null texts stay null."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words are not taken. A null source is one of its own."""
    return source_mixing.apply_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and the text's n-best segmentations; a null text has none but the empty one."""
    return piece_nbest.encode_rows(docs, ("doc_id", "lang", "source", "n_chars"), piece_nbest.model_path())


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_copies),
    ("personal data", without_personal_data),
    ("source mix", mixed),
    ("pieces", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with stashes(spark):  # what a stage stashed is no longer needed once its rows are written
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
