"""The training-data pipeline: quality rules, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a DataFrame
that is written as Parquet and read again. All but the last return the columns of documents.
Documents are told apart by doc_id and text: different texts stay though they share an id or have none, and of
repeated rows one stays. Null and empty texts fail the quality rules; very long texts pass through whole. Empty tables give no rows. Of
ties the smallest doc_id stays. Other columns, whatever their names, are carried along up to packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sluice.llm.common import dropped, shared_folder, table, temporary
from sluice.llm.decontamination import clean
from sluice.llm.near_dedup import one_of_each
from sluice.llm.packing import pack_documents
from sluice.llm.pii import sanitised
from sluice.llm.quality_rules import filtered
from sluice.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitised(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: Expectation-maximisation and tokenizer ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; what a stage no longer needs is deleted, the rest when the driver ends."""
    docs, folder, last = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            dropped(spark, f"{folder}/{last}")
        last = name
    temporary(spark, folder)
    return docs
