"""What is stored of an analysis: its tables, explanation, document row and report, as DataFrames and writers.

Targets are folders of any file system that Spark can write to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkproof.functions.text import explode_rows
from inkproof.operators.risk import display_category, display_severity, normalise_prediction

def marker_rows(analyses: DataFrame) -> DataFrame:
    """A row for each marker; scores in percent with two digits, texts lower-cased and never NULL."""
    word = lambda c, instead: F.lower(F.trim(F.coalesce(F.col(c), F.lit(instead))))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("m.score", F.lit(0.0))))
    return explode_rows(analyses, F.col("markers"), "analysis_id").select(
        "analysis_id", "pos", word("m.category", "other").alias("category"), F.coalesce("m.name", F.lit("unknown_marker")).alias("name"),
        word("m.severity", "medium").alias("severity"), F.coalesce("m.description", F.lit("")).alias("description"),
        "m.page_number", F.coalesce("m.evidence", F.lit("")).alias("evidence"), F.round(score * 100, 2).alias("score"))


def prediction_rows(analyses: DataFrame) -> DataFrame:
    """A row for each model's prediction, with probabilities that sum to one."""
    fixed = F.transform("predictions", normalise_prediction)
    return explode_rows(analyses, fixed, "analysis_id").select("analysis_id", "m.*")


def write_explanations(rows: DataFrame, target: str, version: int) -> None:
    """Appends (analysis_id, explanation) as JSON; a NULL explanation deletes what was stored."""
    payload = F.when(F.col("explanation").isNotNull(), F.to_json("explanation"))
    rows.select("analysis_id", F.lit(version).cast("long").alias("version"), payload.alias("payload")).write.mode("append").parquet(target)


def delete_explanations(ids: DataFrame, target: str, version: int) -> None:
    empty = F.lit(None).cast("string")
    ids.select("analysis_id", F.lit(version).cast("long").alias("version"), empty.alias("payload")).write.mode("append").parquet(target)


def read_explanations(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The latest explanation of each analysis, parsed; deleted ones are left out."""
    newest = F.max(F.struct("version", "payload")).alias("r")
    rows = spark.read.parquet(target).groupBy("analysis_id").agg(newest).where(F.col("r.payload").isNotNull())
    return rows.select("analysis_id", F.from_json("r.payload", schema).alias("explanation"))


def register_documents(read: DataFrame, words: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of read files (doc_id, name, size, text, error) to document rows, and the rejected ones with their reason."""
    zero = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    fine = read.where(F.col("error").isNull()).select(
        F.col("doc_id").alias("document_id"), F.col("name").alias("original_filename"), "file_type", zero(F.col("size")).alias("file_size"),
        F.lit(1).cast("long").alias("pages"), zero(words).alias("words"), zero(F.length("text")).alias("characters"),
        F.lit(0).cast("long").alias("tables_detected"), F.lit(False).alias("ocr_used"))
    rejected = read.where(F.col("error").isNotNull()).select(F.col("doc_id").alias("document_id"), F.col("name").alias("original_filename"), F.col("error").alias("reason"))
    return fine, rejected


def write_back_types(documents: DataFrame, detected: DataFrame) -> DataFrame:
    """Documents with the detected type (document_id, detected_type) in place of another one, and whether it changed."""
    new = F.coalesce("detected_type", "document_type")
    return documents.join(detected, "document_id", "left").withColumns({
        "changed": ~new.eqNullSafe(F.col("document_type")), "document_type": new}).drop("detected_type")


def report_rows(analyses: DataFrame) -> DataFrame:
    """The contents of the report, a row for each line: analysis_id, section, ord, label, value, detail."""
    number = lambda c: F.format_string("%.2f", F.coalesce(F.col(c), F.lit(0.0)))
    line = lambda section, ord_, label, value, detail="": F.struct(
        F.lit(section).alias("section"), F.lit(ord_).cast("int").alias("ord"), F.lit(label).alias("label"),
        value.cast("string").alias("value"), F.lit(detail).alias("detail"))
    document = [("Analysis ID", "analysis_id"), ("Document ID", "document_id"), ("Filename", "original_filename"), ("File Type", "file_type")]
    pillars = [("Overall risk score", "risk_score"), ("Machine Learning Risk", "ml_risk_score"), ("Marker Risk", "marker_risk_score"),
               ("Structural Risk", "structural_risk_score"), ("Consistency Risk", "consistency_risk_score")]
    fixed = [line("document", i, label, F.coalesce(F.col(c).cast("string"), F.lit("-"))) for i, (label, c) in enumerate(document)]
    fixed += [line("risk", i, label, number(c)) for i, (label, c) in enumerate(pillars)]
    fixed.append(line("risk", len(pillars), "Decision", F.col("decision")))
    models = F.transform(F.transform("predictions", normalise_prediction), lambda p, i: F.struct(
        F.lit("predictions").alias("section"), i.alias("ord"), p["model_name"].alias("label"),
        F.format_string("%.4f", p["genuine_probability"]).alias("value"), F.format_string("%.4f", p["fake_probability"]).alias("detail")))
    markers = F.transform("markers", lambda m, i: F.struct(
        F.lit("markers").alias("section"), i.alias("ord"), m["name"].alias("label"), F.format_string("%.2f", F.round(m["score"] * 100, 2)).alias("value"),
        F.concat(F.initcap(display_category(m["category"])), F.lit(", "), F.initcap(display_severity(m["severity"]))).alias("detail")))
    evidence = F.transform(F.filter(F.transform("markers", lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda x: F.length(x["m"]["evidence"]) > 0), lambda x: F.struct(
        F.lit("evidence").alias("section"), x["i"].alias("ord"), x["m"]["name"].alias("label"), x["m"]["evidence"].alias("value"), F.lit("").alias("detail")))
    return explode_rows(analyses, F.concat(F.array(*fixed), models, markers, evidence), "analysis_id").select("analysis_id", "m.*")
