"""Streaming forms of scoring and of the scan counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkproof.operators.artifacts import FreshModels, predictions_of
from inkproof.operators.features import extract_features
from inkproof.operators.store import AnalysisStore
from inkproof.plans.scoring import assess, readable


def daily_volume(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per tumbling day; the watermark bounds the state on a stream."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("day"), "n")
    )


def score_stream(documents: DataFrame, output: str, checkpoint: str, as_of: str | None = None):
    """Score each arriving document once and append it; stateless, so nothing is kept."""
    return (
        assess(readable(documents), as_of).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output)
    )


def score_batch(rows: DataFrame, as_of: str | None = None, models: FreshModels | None = None) -> DataFrame:
    """Analyses of documents (with analysis_id and arrived_at), by the newest saved classifiers if there are any."""
    rows = readable(rows)
    predictions = version = None
    if models is not None and (fitted := models.get()):
        predictions, version = predictions_of(fitted, extract_features(rows).withColumn("label", F.lit(0))), models.version
    return assess(rows, as_of, predictions=predictions).withColumnsRenamed(
        {"doc_id": "document_id", "arrived_at": "created_at", "filename": "original_filename"}).withColumn("model_version", F.lit(version).cast("long"))


def score_into_store(
    arrivals: DataFrame, store: AnalysisStore, checkpoint: str, as_of: str | None = None, late: str = "1 day",
    models: str | None = None, name: str = "stream",
):
    """Scores arriving documents into the stored warehouse.

    arrivals: documents with analysis_id and arrived_at.  A document that arrives again within ``late``
    is dropped; the watermark ends its state.  Each micro-batch is one batch of the store under its
    number, so a batch that is played again after a failure changes nothing.  ``models``: a folder of
    saved classifiers; every batch looks whether there are newer ones.
    """
    fresh = FreshModels(arrivals.sparkSession, models) if models else None

    def run(batch: DataFrame, number: int) -> None:
        store.write(f"{name}-{number}", score_batch(batch, as_of, fresh))

    once = arrivals.withWatermark("arrived_at", late).dropDuplicatesWithinWatermark(["doc_id"])
    return once.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
