"""A corpus from documents: rank, deduplicate, sanitise, mix, encode.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last give the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import mixing, ngram_join, pii, quality, sentencepiece_codec
from quern.llm.common import materialize
from quern.llm.queries import tokenizer_path


def rank_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.3; the labels are in sf_dir."""
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), cut=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8, that of the least id."""
    return ngram_join.keep_one(spark, docs, k=5, p=4, q=5)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it masked; n_chars follows the text."""
    masked = pii.sanitise(spark, docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0 to 2 times, with weights 3, 1, 2 and 150 % of all words."""
    return mixing.take_copies(spark, docs, weights=[3, 1, 2], share=1.5)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their pieces; workers give up what they know of pre-tokens after each task."""
    return sentencepiece_codec.encode(spark, docs, tokenizer_path(), task_entries=150_000)


STAGES = [
    ("quality_classifier", rank_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", mask_pii),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Learned scores and lotteries can't be put in SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(spark, docs, name)
    return docs
