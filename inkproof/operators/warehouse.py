"""History, dashboard and batch views over the persisted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from inkproof.operators.risk import Thresholds


def history(analyses: DataFrame, documents: DataFrame) -> DataFrame:
    """Analyses with their document."""
    return analyses.join(documents, "document_id")


def history_filter(rows: DataFrame, decision: str | None = None, search: str | None = None) -> DataFrame:
    """By decision, and by a case-insensitive part of the file name or type."""
    if decision:
        rows = rows.where(F.col("decision") == decision.lower())
    if search and search.strip():
        like = f"%{search.strip()}%"
        rows = rows.where(F.col("original_filename").ilike(like) | F.col("file_type").ilike(like))
    return rows


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("created_at").desc(), F.col("analysis_id").desc())


def history_page(rows: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    """One page, newest first.  Becomes a top-k per task, not a global sort."""
    return newest_first(rows).offset(skip).limit(limit)


def totals(rows: DataFrame) -> DataFrame:
    """One row of totals over documents and analyses (is_document, risk_score, markers)."""
    analysis = ~F.col("is_document")
    mean = F.avg(F.when(analysis, F.col("risk_score").cast("decimal(9,2)"))).cast("double")
    return rows.agg(
        F.count_if("is_document").alias("total_documents"), F.count_if(analysis).alias("total_analyses"),
        F.round(F.coalesce(mean, F.lit(0.0)), 2).alias("average_risk_score"),
        F.coalesce(F.sum("markers"), F.lit(0)).alias("total_markers"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def severity_distribution(markers: DataFrame) -> DataFrame:
    """One row with the four severities, zero-filled."""
    name = F.lower("severity")
    return markers.agg(*[
        F.count_if(name == s).alias(s) for s in ("low", "medium", "high", "critical")
    ])


def risk_bands(analyses: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Count and one-decimal share of the three risk bands, in one pass."""
    s = F.col("risk_score")
    low, high = s < thresholds.medium, s >= thresholds.high
    counts = analyses.agg(
        F.count_if(low).alias("low"), F.count_if(~low & ~high).alias("medium"),
        F.count_if(high).alias("high"), F.count(F.lit(1)).alias("total"),
    )
    bands = F.array(*[
        F.struct(F.lit(label).alias("label"), F.col(c).alias("n"))
        for label, c in (("Low risk", "low"), ("Medium risk", "medium"), ("High risk", "high"))
    ])
    share = F.when(F.col("total") > 0, F.round(F.col("b.n") / F.col("total") * 100, 1)).otherwise(F.lit(0.0))
    return counts.select("total", F.explode(bands).alias("b")).select(
        "b.label", F.col("b.n").alias("n"), share.alias("percentage"))


def since(rows: DataFrame, column: str, as_of: Column, days: int = 7) -> DataFrame:
    return rows.where(F.col(column) >= as_of - F.make_dt_interval(F.lit(days)))


def delete_cascade(deleted: DataFrame, *children: DataFrame) -> list[DataFrame]:
    """Children without the rows of the deleted analyses."""
    return [child.join(deleted.select("analysis_id"), "analysis_id", "left_anti") for child in children]


def latest_per_document(analyses: DataFrame) -> DataFrame:
    """Newest analysis of each document.

    An aggregate of structs combines map-side, so a document with very many analyses does
    not land in one task as a ranking window would make it.
    """
    rest = [c for c in analyses.columns if c not in ("document_id", "created_at", "analysis_id")]
    newest = F.max(F.struct("created_at", "analysis_id", *rest)).alias("newest")
    return analyses.groupBy("document_id").agg(newest).select("document_id", "newest.*")


def batch_items(requested: DataFrame, analysed: DataFrame) -> DataFrame:
    """Requested ids with their result; unknown ids fail."""
    found = F.col("risk_score").isNotNull()
    return requested.join(analysed, "document_id", "left").select(
        "document_id",
        F.coalesce("original_filename", F.concat(F.lit("Document #"), F.col("document_id").cast("string")))
        .alias("original_filename"),
        F.when(found, "success").otherwise("failed").alias("status"),
        F.when(~found, F.lit("Document not found")).alias("error"),
        "risk_score", "decision",
    )


def batch_rollup(items: DataFrame) -> DataFrame:
    ok = F.col("status") == "success"
    return items.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.round(F.coalesce(F.avg(F.col("risk_score").cast("decimal(9,2)")).cast("double"), F.lit(0.0)), 2)
        .alias("overall_risk_score"),
    )


def batch_view(items: DataFrame, decision: str = "all", field: str = "risk_score", ascending: bool = False) -> DataFrame:
    if decision != "all":
        items = items.where(F.lower("decision") == decision.lower())
    key = F.lower(field) if field == "original_filename" else F.col(field)
    return items.orderBy(key.asc() if ascending else key.desc(), "document_id")


def matched_ids(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct document ids whose file name is among the given ones, ignoring case."""
    wanted = names.select(F.lower("filename").alias("_name")).distinct()
    return (
        rows.withColumn("_name", F.lower("original_filename"))
        .join(wanted, "_name", "left_semi").select("document_id").distinct()
    )


def top_marker(markers: DataFrame) -> DataFrame:
    """Most frequent marker name."""
    counts = distribution(markers, "name")
    return counts.orderBy(F.col("n").desc(), "name").limit(1).select(
        F.col("name").alias("top_marker"), F.col("n").alias("top_marker_count"))


def metrics_upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or update by model name: the newest run of each model wins."""
    both = current.unionByName(incoming)
    rest = [c for c in both.columns if c not in ("model_name", "run_ts")]
    newest = F.max(F.struct("run_ts", *rest)).alias("newest")
    return both.groupBy("model_name").agg(newest).select("model_name", "newest.*")


