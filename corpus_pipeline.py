"""A corpus pipeline of five stages; each takes what its predecessor kept.

quality (rejected documents go), near duplicates (one document of each class stays), benchmark leaks (documents that
hold a test item go), mixture (documents are taken as often as the mix says), shards (each row gets its shard).

SQL cannot express the stages; tests hold each against a plain version. Null texts pass every filter that they can pass:
they are scored as empty texts, are nobody's duplicates and hold no test item; the mixture never takes them, as they have no words.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, mixing, near_dup, quality, shard_map
from sparkloom.lineage import delete_at_end, remove, shared_dir
from sparkloom.llm._lineage import spare

ORACLE_SQL = None
#: Documents of this similarity of five-word shingles or more are near duplicates.
NEAR_PERCENT = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; learned from the labelled ones among them."""
    weights = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = spare(docs, "__quality")
    scored = quality.score(docs, weights, score_col=name)
    return scored.where(F.col(name) >= quality.THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dup.keep_one(docs, percent=NEAR_PERCENT)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return shard_map.attach(docs)


STAGES = [("quality classifier", good_quality), ("minhash near-dedup", one_of_each), ("benchmark decontamination", no_leaks), ("mixing to target weights", mixture), ("sharding", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again by the next.

    A stage's table goes once the next one is written, the last with the application.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    delete_at_end(spark, folder)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
