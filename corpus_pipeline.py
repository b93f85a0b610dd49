"""The corpus pipeline: bad and unidentified texts go, then near-duplicates; sources are mixed and every text is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import SharedTable, read
from sparkloom.llm.langid import keep_identified
from sparkloom.llm.mixing import mixed
from sparkloom.llm.quality import keep_good
from sparkloom.llm.queries import tokenizer_path
from sparkloom.llm.simhash import keep_one
from sparkloom.llm.tokens import encode_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty."""
    return keep_identified(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order that mixes sources to their weights."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their texts, in training order.

    Files don't keep the order of the stage before, so it is laid out again; encoding leaves it as it is.
    """
    return encode_documents(mixed(docs), tokenizer_path())


STAGES = [("quality", quality), ("language", language), ("near-duplicates", dedup), ("mixing", mix), ("encoding", encode)]

#: Training and components can't be put into SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each stage's rows written to the shared folder for the next one."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = SharedTable(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
