"""The stored warehouse: documents, analyses, markers and predictions in Parquet, with commits.

Every batch is written below its own name and counts only once a row in `commits` names it, so a write
that fails leaves nothing visible, and a batch id that is already committed is not written again: a
retried or replayed batch changes nothing. Names rise with the commits, so one comparison tells which
deletions came after a row. Each batch also leaves partial sums; the dashboard adds those up, and a
deletion leaves the negative sums of what it took away.

One writer deletes at a time. Two that write the same batch at once both commit, and the first counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from inkproof.operators import sinks
from inkproof.operators.markers.base import MARKER_TYPE
from inkproof.operators.risk import PREDICTION_TYPE, Thresholds

RISK_FIELDS = ("ml_risk_score double, marker_risk_score double, structural_risk_score double, consistency_risk_score double, "
               "risk_score double, decision string, confidence double")
#: Tables with their columns and the columns that part their folders.
SCHEMAS = {
    "documents": "document_id long, original_filename string, file_type string, pages long, tables_detected long, words long, uploaded_at timestamp",
    "analyses": f"analysis_id long, document_id long, created_at timestamp, original_filename string, file_type string, {RISK_FIELDS}, "
                f"marker_count long, markers {MARKER_TYPE}, predictions {PREDICTION_TYPE}, model_version long, month string, bucket int",
    "markers": "analysis_id long, pos int, category string, name string, severity string, description string, page_number int, evidence string, "
               "score double, bucket int",
    "model_predictions": "analysis_id long, model_name string, genuine_probability double, fake_probability double, bucket int",
    "deletions": "analysis_id long",
    "summaries": "measure string, key string, n long, amount decimal(38,2)",
}
PARTS = {"analyses": ("month", "bucket"), "markers": ("bucket",), "model_predictions": ("bucket",)}
COMMITS = "batch_id string, kind string, name string"


def bands(thresholds: Thresholds) -> Column:
    s = F.col("risk_score")
    return F.when(s < thresholds.medium, "low").when(s < thresholds.high, "medium").otherwise("high")


class AnalysisStore:
    """Tables below a folder of any file system that Spark can write to.

    buckets: folders an analysis id is dealt to, so that one analysis is read from one of them.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 4, thresholds: Thresholds = Thresholds()) -> None:
        self.spark, self.folder, self.buckets, self.thresholds = spark, folder.rstrip("/"), buckets, thresholds

    # --- commits

    def commits(self) -> list:
        """Committed batches in order: a row each, of equal batch ids the first."""
        try:
            rows = self.spark.read.schema(COMMITS).parquet(f"{self.folder}/commits").collect()
        except AnalysisException:  # nothing was committed yet
            return []
        first: dict[str, object] = {}
        for r in sorted(rows, key=lambda r: r.name):
            first.setdefault(r.batch_id, r)
        return list(first.values())

    def _begin(self, batch_id: str) -> str | None:
        """A name for a new batch; None if it is committed already."""
        done = self.commits()
        if any(r.batch_id == batch_id for r in done):
            return None
        last = max((int(r.name.split("-")[0]) for r in done), default=0)
        return f"{last + 1:012d}-{uuid.uuid4().hex}"

    def _commit(self, batch_id: str, kind: str, name: str) -> bool:
        # one row is one file, which its committer moves into place at the end
        self.spark.createDataFrame([(batch_id, kind, name)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return True

    # --- files

    def _put(self, table: str, name: str, rows: DataFrame) -> DataFrame:
        """Writes a batch of a table and reads it back."""
        path, parts = f"{self.folder}/{table}/batch={name}", PARTS.get(table, ())
        if parts:
            rows = rows.repartition(*parts).sortWithinPartitions(*parts, "analysis_id")
        rows.write.mode("overwrite").partitionBy(*parts).parquet(path)
        return self.spark.read.schema(SCHEMAS[table]).parquet(path)

    def _all(self, table: str, kinds: tuple[str, ...]) -> DataFrame:
        """All committed rows of a table with their batch."""
        schema = SCHEMAS[table] + ", batch string"
        paths = [f"{self.folder}/{table}/batch={r.name}" for r in self.commits() if r.kind in kinds]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{table}").parquet(*paths)

    def bucket(self, analysis_id: Column) -> Column:
        return F.pmod(F.xxhash64(analysis_id), F.lit(self.buckets)).cast("int")

    # --- writing

    def register(self, batch_id: str, documents: DataFrame) -> bool:
        """Adds documents; False, and nothing done, if the batch is there already."""
        name = self._begin(batch_id)
        if name is None:
            return False
        own = self._put("documents", name, _shaped(documents, SCHEMAS["documents"]))
        entries = F.array(_entry("documents", ""), _entry("upload_day", F.date_format("uploaded_at", "yyyy-MM-dd")))
        self._put("summaries", name, _summed(own, entries, 1))
        return self._commit(batch_id, "documents", name)

    def write(self, batch_id: str, analyses: DataFrame) -> bool:
        """Adds analyses (with markers and predictions inside); False if the batch is there already.

        They are computed once, for the first table; the others are made from what was stored.
        """
        name = self._begin(batch_id)
        if name is None:
            return False
        rows = analyses.withColumns({
            "marker_count": F.size("markers").cast("long"), "month": F.date_format("created_at", "yyyy-MM"), "bucket": self.bucket(F.col("analysis_id"))})
        own = self._put("analyses", name, _shaped(rows, SCHEMAS["analyses"]))
        self._put("markers", name, _shaped(sinks.marker_rows(own).withColumn("bucket", self.bucket(F.col("analysis_id"))), SCHEMAS["markers"]))
        self._put("model_predictions", name, _shaped(
            sinks.prediction_rows(own).withColumn("bucket", self.bucket(F.col("analysis_id"))), SCHEMAS["model_predictions"]))
        self._put("summaries", name, _summed(own, self._entries(), 1))
        return self._commit(batch_id, "analyses", name)

    def delete(self, batch_id: str, ids: DataFrame) -> bool:
        """Takes analyses and all that hangs on them away; ids (analysis_id) that are not there are passed over."""
        name = self._begin(batch_id)
        if name is None:
            return False
        gone = self.read("analyses").join(ids.select("analysis_id").distinct(), "analysis_id", "left_semi")
        own = self._put("deletions", name, gone.select("analysis_id").distinct())
        taken = self.read("analyses").join(own, "analysis_id", "left_semi")
        self._put("summaries", name, _summed(taken, self._entries(), -1))
        return self._commit(batch_id, "deletions", name)

    def _entries(self) -> Column:
        fixed = F.array(
            _entry("analyses", "", 1, F.col("risk_score")), _entry("decision", F.col("decision")), _entry("band", bands(self.thresholds)),
            _entry("day", F.date_format("created_at", "yyyy-MM-dd")), _entry("markers", "", F.col("marker_count")))
        marks = F.flatten(F.transform("markers", lambda m: F.array(
            _entry("severity", F.lower(F.trim(m["severity"]))), _entry("name", m["name"]))))
        return F.concat(fixed, F.coalesce(marks, F.array().cast(ENTRIES)))

    # --- reading

    def read(self, table: str) -> DataFrame:
        """The visible rows of a table. Filters on month, bucket and batch choose folders, others reach the files."""
        kind = "documents" if table == "documents" else "analyses"
        rows = self._all(table, (kind,))
        columns = [c for c in rows.columns if c != "batch"]
        if kind == "analyses" and any(r.kind == "deletions" for r in self.commits()):
            gone = self._all("deletions", ("deletions",)).groupBy(F.col("analysis_id").alias("gone_id")).agg(F.max("batch").alias("gone_at"))
            rows = rows.join(gone, (F.col("analysis_id") == F.col("gone_id")) & (F.col("gone_at") > F.col("batch")), "left_anti")
        return rows.select(columns)

    def one(self, table: str, analysis_id: int) -> DataFrame:
        """The rows of one analysis, from its bucket alone."""
        number = F.lit(analysis_id).cast("long")
        return self.read(table).where((F.col("bucket") == self.bucket(number)) & (F.col("analysis_id") == number))

    def sums(self) -> DataFrame:
        """measure, key, n and amount over all batches: what the dashboard reads instead of the rows."""
        return self._all("summaries", ("documents", "analyses", "deletions")).groupBy("measure", "key").agg(
            F.sum("n").alias("n"), F.sum("amount").cast("decimal(38,2)").alias("amount")).where("n <> 0 OR amount <> 0")


ENTRIES = "array<struct<measure:string,key:string,n:bigint,amount:decimal(38,2)>>"


def _entry(measure: str, key: Column | str, n: Column | int = 1, amount: Column | None = None) -> Column:
    key = key if isinstance(key, Column) else F.lit(key)
    n = n if isinstance(n, Column) else F.lit(n)
    amount = F.lit(0) if amount is None else F.coalesce(amount, F.lit(0.0))
    return F.struct(
        F.lit(measure).alias("measure"), F.coalesce(key, F.lit("")).alias("key"), n.cast("long").alias("n"), amount.cast("decimal(38,2)").alias("amount"))


def _summed(rows: DataFrame, entries: Column, sign: int) -> DataFrame:
    """One row for each measure and key of a batch."""
    parts = rows.select(F.explode(entries).alias("e")).groupBy("e.measure", "e.key").agg(
        (F.sum("e.n") * sign).alias("n"), (F.sum("e.amount") * sign).cast("decimal(38,2)").alias("amount"))
    return parts.coalesce(1)


def _shaped(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, missing ones as NULL."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


# --- the dashboard from sums ------------------------------------------------------------------------


def _of(sums: DataFrame, *measures: str) -> DataFrame:
    return sums.where(F.col("measure").isin(*measures))


def _n(measure: str, key: Column | None = None) -> Column:
    hit = F.col("measure") == measure
    return F.coalesce(F.sum(F.when(hit if key is None else hit & key, F.col("n"))), F.lit(0))


def totals(sums: DataFrame) -> DataFrame:
    amount = F.sum(F.when(F.col("measure") == "analyses", F.col("amount")))
    mean = (amount / F.nullif(_n("analyses"), F.lit(0))).cast("double")
    return _of(sums, "documents", "analyses", "markers").agg(
        _n("documents").alias("total_documents"), _n("analyses").alias("total_analyses"),
        F.round(F.coalesce(mean, F.lit(0.0)), 2).alias("average_risk_score"), _n("markers").alias("total_markers"))


def distribution(sums: DataFrame, measure: str, column: str) -> DataFrame:
    return _of(sums, measure).where("n <> 0").select(F.col("key").alias(column), "n")


def severity_distribution(sums: DataFrame) -> DataFrame:
    return _of(sums, "severity").agg(*[_n("severity", F.col("key") == s).alias(s) for s in ("low", "medium", "high", "critical")])


def risk_bands(sums: DataFrame) -> DataFrame:
    """Count and one-decimal share of the three risk bands."""
    counts = _of(sums, "band", "analyses").agg(_n("analyses").alias("total"), *[_n("band", F.col("key") == b).alias(b) for b in ("low", "medium", "high")])
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.col(b).alias("n")) for label, b in (("Low risk", "low"), ("Medium risk", "medium"), ("High risk", "high"))])
    share = F.when(F.col("total") > 0, F.round(F.col("b.n") / F.col("total") * 100, 1)).otherwise(F.lit(0.0))
    return counts.select("total", F.explode(rows).alias("b")).select("b.label", F.col("b.n").alias("n"), share.alias("percentage"))


def _from(day: Column) -> list[Column]:
    """Uploads and analyses from a day on; days are whole, so the day's beginning is the border."""
    from_day = F.col("key") >= F.date_format(day, "yyyy-MM-dd")
    return [_n("upload_day", from_day).alias("files_this_week"), _n("day", from_day).alias("analyses_this_week")]


def since_day(sums: DataFrame, day: Column) -> DataFrame:
    return _of(sums, "upload_day", "day").agg(*_from(day))


def declared(sums: DataFrame, day: Column) -> DataFrame:
    """The most frequent marker (of equals the first by name) and the activity since a day."""
    first = F.min(F.when(F.col("measure") == "name", F.struct((-F.col("n")).alias("n"), F.col("key").alias("key"))))
    return _of(sums, "name", "upload_day", "day").agg(first.alias("top"), *_from(day)).select(
        F.col("top.key").alias("top_marker"), (-F.col("top.n")).alias("top_marker_count"), "files_this_week", "analyses_this_week")
