"""The stored warehouse: commits, replays, failures, deletions, and streams that write into it."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from inkproof.operators import store as S
from inkproof.plans.scoring import assess
from inkproof.plans.stored import stored
from inkproof.sources.business import AS_OF, business_documents
from inkproof.streaming.jobs import score_batch, score_into_store

SMALL = "/root/testdata/sf0.001"
ONE = "array(named_struct('model_name', 'm', 'genuine_probability', 0.25D, 'fake_probability', 0.75D))"


@pytest.fixture(scope="module")
def wide(spark):
    docs = business_documents(spark, SMALL).where("doc_id <= 160")
    rows = assess(docs, AS_OF, predictions=docs.select("doc_id", F.expr(ONE).cast("array<struct<model_name:string,genuine_probability:double,fake_probability:double>>").alias("predictions")))
    rows = rows.select(
        F.col("doc_id").alias("analysis_id"), F.col("doc_id").alias("document_id"), F.col("uploaded_at").cast("timestamp").alias("created_at"),
        F.col("filename").alias("original_filename"), "file_type", "risk_score", "decision", "markers", "predictions")
    path = tempfile.mkdtemp(prefix="spark-") + "/wide"
    rows.write.parquet(path)
    return spark.read.parquet(path)


def new_store(spark):
    return S.AnalysisStore(spark, tempfile.mkdtemp(prefix="spark-") + "/store")


def anew(store):
    """The sums computed from the visible rows."""
    return {tuple(r) for r in S._summed(store.read("analyses"), store._entries(), 1).collect()}


def sums(store):
    return {tuple(r) for r in store.sums().collect()}


def test_a_batch_written_twice_counts_once(spark, wide):
    store, n = new_store(spark), wide.count()
    assert store.read("analyses").isEmpty() and store.sums().isEmpty()
    assert store.write("a", wide) and not store.write("a", wide)
    assert store.read("analyses").count() == n == store.read("model_predictions").count()
    assert store.read("markers").count() == wide.agg(F.sum(F.size("markers"))).first()[0]
    assert store.read("markers").where("score > 100 or score < 0 or name is null or evidence is null").isEmpty()
    assert sums(store) == anew(store)


def test_two_commits_of_one_batch_count_once(spark, wide):
    store = new_store(spark)
    names = [store._begin("a"), store._begin("a")]  # two writers that saw no commit
    for name in names:
        store._put("analyses", name, S._shaped(wide.withColumns({"month": F.lit("1995-01"), "bucket": F.lit(0)}), S.SCHEMAS["analyses"]))
        store._commit("a", "analyses", name)
    assert store.read("analyses").count() == wide.count() and len(store.commits()) == 1


def test_a_failed_write_shows_nothing(spark, wide, monkeypatch):
    store = new_store(spark)
    store.write("a", wide.where("analysis_id < 50"))
    before = sums(store)

    def broken(*_):
        raise OSError("disk is full")

    with monkeypatch.context() as m:
        m.setattr(S, "_summed", broken)
        with pytest.raises(OSError):
            store.write("b", wide.where("analysis_id >= 50"))
    assert store.read("analyses").where("analysis_id >= 50").isEmpty() and store.read("markers").where("analysis_id >= 50").isEmpty() and sums(store) == before
    assert store.write("b", wide.where("analysis_id >= 50"))
    assert store.read("analyses").count() == wide.count() and sums(store) == anew(store)


def test_deletions_are_retracted_and_rows_can_come_again(spark, wide):
    store = new_store(spark)
    store.write("a", wide)
    gone = wide.where("decision = 'forged'").select("analysis_id")
    assert 0 < gone.count() < wide.count()
    assert store.delete("d", gone.unionByName(gone)) and not store.delete("d", gone)
    assert store.delete("again", gone)  # what is gone is not taken away twice
    assert store.read("analyses").where("decision = 'forged'").isEmpty() and sums(store) == anew(store)
    assert store.read("markers").join(gone, "analysis_id").isEmpty() and store.read("model_predictions").join(gone, "analysis_id").isEmpty()
    store.write("back", wide.join(gone, "analysis_id", "left_semi"))
    assert store.read("analyses").count() == wide.count() and sums(store) == anew(store)


def test_one_analysis_is_read_from_its_bucket(spark, wide):
    store = new_store(spark)
    store.write("a", wide)
    one = store.one("markers", 32)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and one.count() == wide.where("analysis_id = 32").select(F.size("markers")).first()[0]


def test_warehouse_is_written_once(spark, wide):
    asked = []

    def analyses():
        asked.append(1)
        return wide

    docs = wide.select("document_id", F.col("created_at").alias("uploaded_at"))
    for _ in range(2):
        store = stored(spark, "some folder", "test", lambda: docs, analyses)
    assert asked == [1] and store.read("documents").count() == wide.count()


def test_stream_with_repeats_and_a_replayed_batch(spark):
    work = tempfile.mkdtemp(prefix="spark-")
    docs = business_documents(spark, SMALL).where("doc_id <= 60").withColumn("analysis_id", F.col("doc_id"))
    for hour, (a, b) in enumerate(((0, 20), (10, 40), (30, 60))):
        docs.where(F.col("doc_id").between(a, b)).withColumn("arrived_at", F.lit(AS_OF).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(hour))).coalesce(1).write.mode("append").parquet(f"{work}/in")
    batch = spark.read.parquet(f"{work}/in")
    store = S.AnalysisStore(spark, f"{work}/store")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in")
    score_into_store(stream, store, f"{work}/checkpoint", AS_OF).awaitTermination()
    want = {(r.document_id, r.risk_score) for r in score_batch(batch, AS_OF).collect()}
    got = store.read("analyses").collect()
    assert len(got) == docs.count() and {(r.document_id, r.risk_score) for r in got} == want and len(store.commits()) >= 3
    assert not store.write("stream-0", score_batch(batch, AS_OF))
    assert store.read("analyses").count() == len(got)
