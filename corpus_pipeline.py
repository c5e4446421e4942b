"""A corpus pipeline of five operators, each written as Parquet and read again before the next.

Quality rules drop documents; line dedup drops lines; of each class of
near-duplicates one document stays; the source mix repeats and drops documents to
its targets; packing cuts what is left into sequences. All but the last return the
columns of documents, n_chars being that of the text as it then is. Every stage
takes nulls in any column, empty and long texts, repeated rows and empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorehouse import shared
from lorehouse.llm import common, linededup, mixing, neardup, packing, quality
from lorehouse.llm.common import DOCUMENT_COLUMNS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the trees keep."""
    scored = quality.quality(docs, common.read(spark, sf_dir, "labels"), keep=DOCUMENT_COLUMNS)
    return scored.where("kept").select(*DOCUMENT_COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are common elsewhere; a text may end up empty."""
    kept = linededup.dedup_lines(docs, keep=("doc_id", "lang", "source"))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of the least doc_id, and of its rows the least."""
    return neardup.one_of_each(docs.select(*DOCUMENT_COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = mixing.mix(docs, keep=DOCUMENT_COLUMNS).where(F.col("copies") > 0)
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*DOCUMENT_COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: Learned trees, signatures and tokens have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    at = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with common.scratch(spark):  # what a stage set aside goes once its result is written
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{at}/{k}")
        if k:
            shared.delete(spark, f"{at}/{k - 1}")  # what this stage was made of
        docs = spark.read.schema(out.schema).parquet(f"{at}/{k}")
    return docs
