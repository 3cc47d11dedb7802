"""Operators whose results SQL cannot give, against brute force; and streams against batch."""

import tempfile
from itertools import combinations

from pyspark.sql import functions as F

from inkproof.operators.compare import similar_pairs
from inkproof.functions.constants import FEATURE_NAMES
from inkproof.operators import artifacts, sinks, training
from inkproof.operators.features import extract_features
from inkproof.operators.learning import rejected_labels, roc_auc, roc_curve, stratified_split
from inkproof.plans import registry
from inkproof.plans.catalog import learning
from inkproof.plans.scoring import assess
from inkproof.sources.business import AS_OF, business_documents
from inkproof.sources import rulebook
from inkproof.sources.datasets import labelled_dataset, read_csv
from inkproof.sources.files import decode_files
from inkproof.operators.store import AnalysisStore
from inkproof.streaming.jobs import score_into_store, score_stream

SMALL = "/root/testdata/sf0.001"


def test_similar_pairs_match_brute_force_with_copies(spark):
    base = [f"w{i} w{i + 1} w{i + 2} w{i + 3} w{i + 4} common" for i in range(12)]
    texts = base + [base[0]] * 20 + [b + " extra" for b in base[:4]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.rep_a, r.rep_b): (r.copies_a, r.copies_b) for r in similar_pairs(docs, 0.6).collect()}
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault(frozenset(t.split()), []).append(i)
    want = {}
    for (a, ia), (b, ib) in combinations(sorted(sets.items(), key=lambda e: min(e[1])), 2):
        if len(a & b) / len(a | b) >= 0.6:
            want[(min(ia), min(ib))] = (len(ia), len(ib))
    assert got == want and want


def test_split_is_exact_and_independent_of_partitioning(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    one = stratified_split(rows.repartition(1), "k", "y")
    many = stratified_split(rows.repartition(7), "k", "y")
    sizes = {(r.y, r.is_test): r["count"] for r in one.groupBy("y", "is_test").count().collect()}
    assert sizes == {(0, True): 180, (0, False): 720, (1, True): 20, (1, False): 80}
    assert one.exceptAll(many).isEmpty()


def test_binary_is_rejected_and_encodings_decoded(spark):
    rows = [(1, b"\x00\x01 payload"), (2, "hé".encode("utf-8")), (3, b"\xef\xbb\xbfhi"), (4, "hé!".encode("latin-1")), (5, "\uac8d\U0001f64f\uac8d".encode("utf-16-le")),
            (6, b"\xfe\xff" + "\uac8d\uac8e".encode("utf-16-be")), (7, b" \x1c\n"), (8, None), (9, b"\x8d\xd8\x8d\xac"), (10, b""), (11, b"x" * 5000 + b"\x00")]
    got = {r.k: r for r in decode_files(spark.createDataFrame(rows, "k int, content binary")).collect()}
    assert "binary" in got[1].error and got[2].text == "hé" and got[3].text == "hi"
    assert got[4].encoding == "latin-1" and got[2].error is None
    assert got[1].text is None and got[1].encoding is None and got[7].error and got[11].error
    assert (got[5].text, got[5].encoding) == ("\uac8d\U0001f64f\uac8d", "utf-16") and (got[6].text, got[6].line_count) == ("\uac8d\uac8e", 1)
    assert got[8].text is None and got[8].error is None and got[9].encoding == "latin-1" and (got[10].text, got[10].line_count) == ("", 0)


def test_stream_scores_like_batch(spark):
    work = tempfile.mkdtemp(prefix="spark-")
    docs = business_documents(spark, SMALL).limit(50)
    docs.write.parquet(f"{work}/in")
    stored = spark.read.parquet(f"{work}/in")
    stream = spark.readStream.schema(stored.schema).parquet(f"{work}/in")
    score_stream(stream, f"{work}/out", f"{work}/checkpoint", AS_OF).awaitTermination()
    pick = ["doc_id", "risk_score", "decision"]
    live = spark.read.parquet(f"{work}/out").select(*pick)
    assert live.exceptAll(assess(stored, AS_OF).select(*pick)).isEmpty() and live.count() == 50


def test_marker_plan_has_no_shuffle(spark):
    work = tempfile.mkdtemp(prefix="spark-")
    business_documents(spark, SMALL).limit(5).write.parquet(f"{work}/in")
    plan = assess(spark.read.parquet(f"{work}/in"), AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_filters_go_below_the_rules(spark):
    docs = business_documents(spark, SMALL)
    for condition in (F.col("doc_id") == 1155, F.col("filename").contains("invoice"), F.col("uploaded_at") > "1997-01-01"):
        plan = assess(docs, AS_OF, wanted=["risk_score"]).where(condition)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" in plan and "Filter" not in plan[:plan.index("Generate")]


def test_scores_listen_to_predictions(spark):
    docs = business_documents(spark, SMALL).limit(20)
    one = "array(named_struct('model_name', 'm', 'genuine_probability', {}, 'fake_probability', {}))"
    fake = docs.select("doc_id", F.expr(one.format("0.1D", "0.9D")).alias("predictions"))
    plain = {r.doc_id: r for r in assess(docs, AS_OF).collect()}
    for r in assess(docs, AS_OF, predictions=fake).collect():
        assert r.ml_risk_score == 90.0 and r.risk_score > plain[r.doc_id].risk_score


def test_registry_names_and_sql():
    entries = registry.load()
    assert len(entries) > 120
    assert sum(1 for e in entries.values() if e.sql) > 110


def test_explanations_are_replaced_and_deleted(spark):
    work = tempfile.mkdtemp(prefix="spark-") + "/explanations"
    rows = spark.createDataFrame([(1, ("a",)), (2, ("b",))], "analysis_id long, explanation struct<summary: string>")
    sinks.write_explanations(rows, work, 1)
    sinks.write_explanations(rows.where("analysis_id = 1").withColumn("explanation", F.struct(F.lit("c").alias("summary"))), work, 2)
    sinks.delete_explanations(rows.where("analysis_id = 2"), work, 3)
    got = sinks.read_explanations(spark, work, "struct<summary: string>").collect()
    assert [(r.analysis_id, r.explanation.summary) for r in got] == [(1, "c")]


def test_labelled_csv_file(spark):
    work = tempfile.mkdtemp(prefix="spark-")
    with open(f"{work}/d.csv", "w") as f:
        f.write('# made for a test\ndocument_id,Text,is_fake\n1,"two\nlines, ""quoted""",fake\n2,plain,0\n3,odd,maybe\n')
    rows = labelled_dataset(read_csv(spark, f"{work}/d.csv")).collect()
    assert [(r.document_id, r.text, r.label) for r in rows] == [("1", 'two\nlines, "quoted"', 1), ("2", "plain", 0)]
    numbers = labelled_dataset(spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 5.0)], "body string, y double")).collect()
    assert [(r.text, r.label) for r in numbers] == [("a", 1), ("b", 0)]
    odd = spark.createDataFrame([("7",), ("fake",), (None,)], "label string")
    assert [tuple(r) for r in rejected_labels(odd).collect()] == [("7", 1)]


def test_rule_book_falls_back_to_the_package(spark):
    assert rulebook.rules("no json") == rulebook.rules() == rulebook.rules("[1]")
    assert rulebook.rules_table(spark, "{").count() == len(rulebook.rules())
    own = '{"categories": {"c": {"rules": [{"name": "n", "severity": "low", "score": 0.1, "threshold": 2, "patterns": ["ab", "c"]}]}}}'
    docs = spark.createDataFrame([(1, "ab c"), (2, "ab"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.hits) for r in rulebook.scan(docs, rulebook.rules(own)).collect()] == [(1, 2)]


def test_one_word_in_all_and_many_near_copies(spark):
    """A word that every document has and 2000 near copies: pairs are those of the result, no more."""
    base = [f"w{i}" for i in range(40)]
    rows = [(i, "common " + " ".join(base[:30] + [f"a{i}x{k}" for k in range(12)])) for i in range(2000)]
    rows += [(5000 + i, "common " + " ".join(f"b{i}x{k}" for k in range(20))) for i in range(2000)] + [(9000, rows[0][1] + " more")]
    got = similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()
    assert [(r.rep_a, r.rep_b) for r in got] == [(0, 9000)]


def test_roc_curve_of_one_class_is_empty(spark):
    rows = spark.createDataFrame([("m", 1, 0.5), ("m", 1, 0.2)], "model_name string, label int, score double")
    assert roc_curve(rows).isEmpty()


def test_training_query_has_the_full_settings(spark, monkeypatch):
    asked, whole = [], training.train

    def fewer(rows, width, trees=300, rounds=300, limit=training.MAX_ROWS):
        asked.append((trees, rounds))
        return whole(rows, width, 2, 2, limit)

    monkeypatch.setattr(training, "train", fewer)
    monkeypatch.setattr(learning, "_runs", {})
    out = learning.train_and_predict(spark, SMALL)
    assert asked == [(300, 300)]
    assert {r.model_name for r in out.select("model_name").distinct().collect()} == {"logistic_regression", "random_forest", "xgboost"}
    assert learning.training_run(spark, SMALL).first().timed and learning.batch_predict(spark, SMALL).where("not sums_to_one").isEmpty()
    assert learning.model_artifacts(spark, SMALL).where("not same").isEmpty()


def test_saved_models_are_picked_up_when_newer(spark):
    work = tempfile.mkdtemp(prefix="spark-")
    business_documents(spark, SMALL).where("doc_id <= 480").limit(120).write.parquet(f"{work}/in")
    stored = spark.read.parquet(f"{work}/in")
    extract_features(stored).select("doc_id", "label", "text", *FEATURE_NAMES).write.parquet(f"{work}/rows")
    rows = spark.read.parquet(f"{work}/rows")
    fitted, summary = training.fit(rows, max_features=300, trees=6, rounds=4)
    assert artifacts.latest_version(spark, f"{work}/models") is None and artifacts.FreshModels(spark, f"{work}/models").get() is None
    artifacts.save_models(spark, fitted, f"{work}/models", 1)
    fresh = artifacts.FreshModels(spark, f"{work}/models")
    artifacts.save_models(spark, fitted, f"{work}/models", 2)
    assert fresh.version == 1 and fresh.get() and fresh.version == 2
    every = fresh.get().predict(rows).collect()
    assert all(abs(p.genuine_probability + p.fake_probability - 1) < 1e-5 for p in every) and len(every) == 360
    assert {tuple(r) for r in every} == {tuple(r) for r in fitted.predict(rows).collect()}
    auc = {r.model_name: r.roc_auc for r in roc_auc(fitted.predict(rows).withColumnRenamed("fake_probability", "score")).collect()}
    assert all(a > 0.6 for a in auc.values()) and summary["warning"] is None
    arrivals = spark.readStream.schema(stored.schema).parquet(f"{work}/in").withColumns(
        {"analysis_id": F.col("doc_id"), "arrived_at": F.lit(AS_OF).cast("timestamp")})
    store = AnalysisStore(spark, f"{work}/out")
    score_into_store(arrivals, store, f"{work}/checkpoint", AS_OF, models=f"{work}/models").awaitTermination()
    live = store.read("analyses")
    assert live.count() == 120 and live.where("ml_risk_score <> 50").count() > 0 and live.where("model_version <> 2").isEmpty()


def test_no_models_means_no_rows(spark):
    rows = spark.createDataFrame([(1, 0, [0], [1.0])], "doc_id long, label int, columns array<long>, values array<double>")
    assert training.scored(None, rows).isEmpty()
    assert training.scored(None, rows).columns == ["doc_id", "label", "model_name", "genuine_probability", "fake_probability"]
