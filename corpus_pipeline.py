"""The training-data pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies
them to ``documents``, each stage's result written as Parquet to the shared
folder and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.llm import exact_dedup, jaccard, langid, packing, pii
from plaza.llm.common import discard, shared_folder

#: Near copies: five-word shingles, similarity of at least 0.8.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no learned language: without text or letter, or with a score under the floor of their length.

    If no language can be learned, only those without text or letter go. Rows are
    judged each, ids play no part in it, columns of any name stay as they are.
    """
    model = langid.learn_documents(docs)
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.known(docs, model, langid.floors(langid.labelled(docs), model))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest, then that with the smallest id (null first). Null text counts as empty; of rows equal in id and length too, any one stays."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id (null last), of each connected group of similar texts stays. Texts without words are similar to none; a repeated id's rows are told apart by their texts."""
    return jaccard.dedup(docs, NEAR_WORDS, NEAR_PERCENT).select(*docs.columns)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind. Null texts stay null, all rows and columns stay."""
    return pii.redact(docs, pii.learn(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the token sequences. A null text is its end id alone; repeated rows are packed each."""
    return packing.packed_documents(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("pii", personal), ("packing", pack)]

#: The language, personal-data and packing stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:  # a stage needs what its predecessor wrote, and no more
            discard(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
