"""From raw documents to packed training sequences: quality, near-duplicates, personal data, mixture, packing.

Every stage works on all rows that the one before kept, is written as Parquet and read again. A row with a null or empty
text has no quality and goes in the first stage; repeated rows leave one document; extra columns are kept up to the last
stage; an empty table gives no sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seismark.llm import mixing, neardup, neighbours, packing, pii
from seismark.llm.store import written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Documents that score below this are rejected.
LEAST_SCORE = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return neighbours.score_quality(docs, labels).where(F.col("score") >= LEAST_SCORE).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else redacted


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(docs, TOKENIZER)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_copies), ("pii", redact_personal_data), ("mixing", mix), ("packing", pack)]
#: Trained models and tokenizers are beyond SQL; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
