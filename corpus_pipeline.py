"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and gives the documents that the next one works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import contamination, jaccard, packing, secrets, toxicity
from sievework.llm.common import table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the network trained on the labels calls toxic."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the least doc_id."""
    return jaccard.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item within its edit budget."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; no document goes."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, with their ids."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("near copies", near_copies), ("benchmark", benchmark), ("secrets", secret_scan), ("packing", pack)]
#: Networks, edit distances and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
