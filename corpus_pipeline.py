"""From documents to a training mix: each stage reads what the one before it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkproof.llm import mix_weights
from inkproof.llm.common import stored, table
from inkproof.llm.decision_rules import judge
from inkproof.llm.decontaminate import decontaminate
from inkproof.llm.near_dedup import near_duplicates
from inkproof.llm.toxicity import score_toxicity

#: No SQL: the learned stages and the near-duplicate stage are beyond it.
ORACLE_SQL = None

#: From this score on a document is toxic.
TOXIC = 0.3


def only(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of docs whose id stands in verdicts (kept_id); null ids match null ids."""
    return docs.join(verdicts, docs["doc_id"].eqNullSafe(verdicts["kept_id"]), "left_semi")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; all labels of the documents here are learnt from."""
    scores = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return only(docs, scores.filter(F.col("score") < TOXIC).select(F.col("doc_id").alias("kept_id")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    verdicts = judge(docs, table(spark, sf_dir, "labels"))
    return only(docs, verdicts.filter("kept").select(F.col("doc_id").alias("kept_id")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    return only(docs, near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose benchmark passages reach the coverage limit go; the others stay as they are."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return only(docs, found.filter(~F.col("contaminated")).select(F.col("doc_id").alias("kept_id")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each copy that a source's target asks for, with the copy's number."""
    return mix_weights.emit(docs)


STAGES = [
    ("toxicity", toxicity), ("quality rules", quality_rules), ("near-duplicates", near_dedup),
    ("decontamination", decontamination), ("source mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
