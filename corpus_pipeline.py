"""A corpus pipeline over `documents`: quality, language, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that the one before kept and its
decisions take effect. All stages but the last return the columns of documents; the last one adds `n_tokens` and
`token_ids`. Stages that drop rows keep all columns as they are, also extra ones.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketlane.llm import bpe, decontam, entries, langid, quality, runtime, simhash


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose combined quality score is below 0.5."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def spoken(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a language of mean posterior 0.35 and more (two languages may share one)."""
    return langid.keep_identified(docs, entries.language_model(docs))


def once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate class the document of least id."""
    return simhash.representatives(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token ids and their number."""
    return bpe.encode(docs, *entries.vocabulary()).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality classifier", good),
    ("language ID", spoken),
    ("SimHash near-dedup", once),
    ("benchmark decontamination", untested),
    ("BPE encoding", tokenized),
]
#: Learned models and tokenizers can't be expressed in SQL.
ORACLE_SQL = None

def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again. A stage's rows are deleted
    once the next one's are written; what the last stage reads stays until the program ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{runtime.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                runtime.remove(spark, f"{folder}/{i - 1}")
    atexit.register(lambda: spark.sparkContext._jsc and runtime.remove(spark, folder))
    return docs
