"""The corpus pipeline: each stage takes the documents that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cleanframe.llm import decontaminate, secrets, toxicity
from cleanframe.llm.jaccard import Rule, one_of_each_group
from cleanframe.llm.packing import pack_documents
from cleanframe.llm.queries import toxicity_model
from cleanframe.llm.tokens import VOCABULARY
from cleanframe.plans.storage import stored


#: Bytes that Spark hands to a Python worker at once. Both sides hold a batch, the JVM up to twice its size while it grows.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts or of whole sets are large, so that batches bounded by Spark's 64 MB fill an executor's memory beside its heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled ones among them."""
    small_batches(spark)
    return toxicity.keep_harmless(docs, toxicity_model(spark, sf_dir, docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    small_batches(spark)
    return one_of_each_group(docs, Rule(words=5, num=80, den=100))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return secrets.mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place; replaces the documents' columns."""
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("toxicity", harmless), ("n-gram Jaccard join", distinct), ("benchmark decontamination", decontaminated), ("secret scans", masked),
          ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier of the first stage cannot be expressed in SQL.
ORACLE_SQL = None
