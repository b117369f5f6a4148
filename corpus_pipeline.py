"""Corpus pipeline over ``documents``: each stage is one of the training-data operators.

Quality (rows that the classifier rejects go), exact dedup, near-dedup (one document of each group
stays), decontamination (documents with a benchmark item go), packing. All but the last stage give
the columns of ``documents``; what a stage does with nulls, empty and long texts, ties, repeated rows
and empty tables is said in its operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from localmarkets.llm import decontaminate, near, packing, quality
from localmarkets.llm.exact_dedup import exact_dedup
from localmarkets.llm.queries import vocabulary
from localmarkets.shared import cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learned, hashed and edit-distance stages can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
