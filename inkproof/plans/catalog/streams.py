"""Streaming queries: counters in batch form (the tests compare them with their stream), and scoring as a stream into the warehouse."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkproof.operators.store import AnalysisStore
from inkproof.plans import oracle as O
from inkproof.plans.registry import query
from inkproof.session import shared_folder
from inkproof.sources.business import AS_OF, business_documents
from inkproof.sources.tables import table
from inkproof.streaming.jobs import daily_volume, score_into_store


@query("st_scan_volume_window", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def scan_volume_window(spark, sf_dir):
    return daily_volume(table(spark, sf_dir, "events")).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def arrivals(spark, sf_dir):
    """A stream of all documents in three portions by year; two portions bring the last year of the one before again."""
    docs = business_documents(spark, sf_dir).withColumns({"year": F.year("uploaded_at"), "analysis_id": F.col("doc_id") * 2})
    inbox, files = f"{shared_folder(spark)}-inbox", max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    for hour, (first, last) in enumerate(((0, 1993), (1993, 1995), (1995, 9999))):
        own = docs.where(F.col("year").between(first, last)).withColumn("arrived_at", F.lit(AS_OF).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(hour)))
        own.repartition(files).write.mode("append").parquet(inbox)
    return spark.readStream.schema(spark.read.parquet(inbox).schema).option("maxFilesPerTrigger", files).parquet(inbox)


_COLUMNS = "ml_risk_score, marker_risk_score, structural_risk_score, consistency_risk_score, risk_score, decision, confidence"


@query("st_incremental_scoring", f"WITH {O.scored_ctes()} SELECT doc_id * 2 AS analysis_id, doc_id, {_COLUMNS}, n_markers AS marker_count FROM scored")
def incremental_scoring(spark, sf_dir):
    """Documents arrive in several micro-batches, some of them twice; what is stored is what a batch would have scored."""
    folder = shared_folder(spark)
    store = AnalysisStore(spark, f"{folder}-streamed")
    score_into_store(arrivals(spark, sf_dir), store, f"{folder}-progress", AS_OF).awaitTermination()
    return store.read("analyses").select("analysis_id", F.col("document_id").alias("doc_id"), *_COLUMNS.split(", "), "marker_count")
