"""Parquet table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows in several parts for each core; a table of few files may be one row group, which a single task would work off.

    Tables of as many files as there are cores stay as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(4 * cores, key)


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of the prose corpus, dealt out for work on every text."""
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def prose_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prose corpus in the shape the feature and rule operators expect."""
    return prose(spark, sf_dir).select(
        "doc_id",
        "text",
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.struct(
            F.lit(None).cast("int").alias("page_count"),
            F.lit(None).cast("double").alias("ocr_confidence"),
        ).alias("stats"),
    )
