"""From raw documents to sampled token sequences: quality, near copies, mixture, segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelloom.llm import jaccard, mixing, pieces, quality
from labelloom.llm.queries import tokenizer
from labelloom.session import scratch_path

NEAR_SHINGLE, NEAR_PERCENT = 5, 80  # near copies of the stage; op8's own values bind its query only


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _labels(spark, sf_dir))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, NEAR_PERCENT, NEAR_SHINGLE)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.remixed(docs, _labels(spark, sf_dir))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pieces.sampled(docs, tokenizer("piece_bpe_32k.model"))
    return found.withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality rules", good_documents),
    ("near duplicates", one_of_each),
    ("mixing", mixed),
    ("segmentation", segmented),
]

# hashing, iteration and sampling: SQL cannot express the stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
