"""Trees against plain searches, the vocabulary, the matrix and whole training runs."""

from __future__ import annotations

import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkproof.functions.constants import FEATURE_NAMES
from inkproof.operators import training, trees, vectorize
from inkproof.operators.learning import roc_auc


def data(n=300, width=12, seed=1, dense=3):
    r = np.random.default_rng(seed)
    x = np.where(r.random((width, n)) < 0.15, r.integers(1, 9, (width, n)), 0).astype(float)
    x[:dense] = r.integers(-4, 5, (dense, n))
    y = ((x[0] > 1) ^ (x[4] > 0) ^ (r.random(n) < 0.1)).astype(float)
    cuts = np.full((width, trees.BINS), np.inf)
    for f in range(width):
        own = np.unique(np.append(x[f], 0.0))
        cuts[f, :len(own)] = own
    column, row = np.nonzero(x)
    bin_ = np.array([np.searchsorted(cuts[c, :trees.BINS - 1], x[c, i]) for c, i in zip(column, row)], np.int8)
    return x, y, trees.Binned(cuts, n, column, row, bin_)


def test_histograms_are_the_same_by_rows_and_by_columns():
    x, y, d = data()
    r = np.random.default_rng(2)
    rows = np.sort(r.choice(300, 200, replace=False))
    at = np.sort(r.integers(0, 5, 200))
    at[-3:] = 4  # a large and a small node
    place = np.full(300, -1)
    place[rows] = at
    feats = r.integers(0, 12, (5, 4))
    h = r.random(300)
    (got_y, got_h), total = trees.histograms(d, rows, at, place, feats, (y, h))
    for node in range(5):
        for j, f in enumerate(feats[node]):
            own = rows[at == node]
            want = np.bincount(d.bins[f, own], h[own], trees.BINS)
            assert np.allclose(got_h[node, j], want) and np.allclose(got_y[node, j], np.bincount(d.bins[f, own], y[own], trees.BINS))
    assert np.allclose(total[1], np.bincount(at, h[rows], 5))


def test_best_split_like_a_search_over_all():
    x, y, d = data()
    rows = np.arange(300)
    feats = np.arange(12)[None, :]
    gain, feature, bin_ = trees.best_splits(d, rows, np.zeros(300, int), np.zeros(300, int), feats, y, np.ones(300), np.ones(300), 1e-9, 2)
    best = 0.0
    for f in range(12):
        for cut in np.unique(x[f])[:-1]:
            left = x[f] <= cut
            if left.sum() >= 2 and (~left).sum() >= 2:
                best = max(best, sum(y[s].sum() ** 2 / s.sum() for s in (left, ~left)) - y.sum() ** 2 / 300)
    assert math.isclose(gain[0], best, rel_tol=1e-9)
    assert d.cuts[feature[0], bin_[0]] in x[feature[0]]


def test_trees_learn_and_predict_alike_on_values_and_bins():
    x, y, d = data(600)
    grown = list(trees.forest(d, y, 20, 3)) + list(trees.boosted(d, y, 30, 3))[1:]
    for t in grown:
        assert np.allclose(t.predict(x), t.predict_binned(d, np.arange(600)))
    p = np.mean([t.predict(x) for t in grown[:20]], axis=0)
    assert ((p > 0.5) == (y == 1)).mean() > 0.85
    margin = np.sum([t.predict(x) for t in trees.boosted(d, y, 60, 3)], axis=0)
    assert ((margin > 0) == (y == 1)).mean() > 0.85
    again = list(trees.forest(d, y, 2, 3))
    assert all(np.array_equal(a.value, b.value) for a, b in zip(again, grown))


def test_forest_leaves_have_two_rows_or_more():
    x, y, d = data(200)
    rows = np.arange(200)
    tree, where = trees.grow(d, rows, y, np.ones(200), np.ones(200), lambda g, h: g / h, np.random.default_rng(1), None, 6, 2, 1e-9, pure=True)
    assert np.bincount(where)[np.unique(where)].min() >= 2
    assert np.allclose(tree.value[where], [y[where == n].mean() for n in where])


def test_numbers_are_dense_and_in_order(spark):
    words = sorted({f"{random.Random(i).randrange(10**6):x}" for i in range(3000)})
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "term string, want long").repartition(9)
    out = vectorize.numbered(df, "term", first=5)
    plan = out._jdf.queryExecution().toString()
    assert out.where(F.col("column") != F.col("want") + 5).isEmpty() and out.count() == len(words)
    assert "Window" not in plan and "SinglePartition" not in plan
    assert vectorize.numbered(df.limit(0), "term").count() == 0


TEXTS = [(1, "Blue whale sings. Blue sky"), (2, "blue WHALE"), (3, "the red-hot iron iron"), (4, ""), (5, None), (6, "unseen words only")]


def test_vectorizer_like_a_recount_and_its_tables(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    model = vectorize.TextVectorizer(None, stop_words=["the"]).fit(df.where("doc_id < 6"))
    grams = {1: ["blue", "whale", "sings", "blue", "sky", "blue whale", "whale sings", "sings blue", "blue sky"], 2: ["blue", "whale", "blue whale"],
             3: ["red", "hot", "iron", "iron", "red hot", "hot iron", "iron iron"], 4: [], 5: [], 6: []}
    names = sorted({g for i, own in grams.items() for g in own})
    assert [r.name for r in model.feature_names().orderBy("column").collect()] == names + FEATURE_NAMES
    idf = {g: math.log(6 / (1 + sum(g in own for own in grams.values()))) + 1 for g in names}
    path = tempfile.mkdtemp(prefix="spark-") + "/model"
    model.save(path)
    for m in (model, vectorize.TextVectorizerModel.load(spark, path)):
        for r in m.transform(df).collect():
            raw = {names.index(g): (1 + math.log(grams[r.doc_id].count(g))) * idf[g] for g in set(grams[r.doc_id])}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            assert list(r.columns) == sorted(raw) and np.allclose(r["values"], [raw[c] / norm for c in sorted(raw)])
    few = vectorize.TextVectorizer(2, stop_words=["the"]).fit(df)
    assert [r.term for r in few.vocabulary.orderBy("column").collect()] == ["blue", "blue whale"]  # of equals the first


def test_tables_must_have_the_same_documents(spark):
    texts = spark.createDataFrame(TEXTS, "doc_id long, text string")
    features = texts.select("doc_id", *[F.lit(float(i)).alias(n) for i, n in enumerate(FEATURE_NAMES)])
    rows, model = vectorize.prepare(texts, features, texts.select("doc_id", F.lit(1).alias("label")))
    whole = vectorize.combine(rows, FEATURE_NAMES, model.size)
    assert whole.count() == 6 and whole.where(F.size("columns") < 31).isEmpty()
    assert whole.where(F.element_at("columns", -1) != model.size + 31).isEmpty()
    for short in (features.where("doc_id <> 3"), features.unionByName(features.limit(1).withColumn("doc_id", F.lit(99).cast("long")))):
        with pytest.raises(ValueError, match="same documents"):
            vectorize.matched(texts, short)


def test_features_of_a_file(spark):
    bare = spark.createDataFrame([("a", "One two. Three!"), ("b", None)], "key string, text string")
    got = {r.key: r for r in vectorize.dataset_features(bare).collect()}
    assert got["a"].word_count == 3.0 and all(got["b"][n] == 0.0 for n in FEATURE_NAMES)
    wide = bare.select("key", "text", *[F.lit("1.5" if i else "NaN").alias(n) for i, n in enumerate(FEATURE_NAMES)])
    row = vectorize.dataset_features(wide).first()
    assert row[FEATURE_NAMES[0]] == 0.0 and all(row[n] == 1.5 for n in FEATURE_NAMES[1:])


def rows(spark, n, one_class=False):
    r = random.Random(5)
    made = []
    for i in range(n):
        y = 0 if one_class else int(r.random() < 0.4)
        cells = {c: float(r.randrange(1, 5)) for c in r.sample(range(40), 5)}
        if y and r.random() < 0.9:
            cells[3] = 3.0
        made.append((i, y, sorted(cells), [cells[c] for c in sorted(cells)]))
    return spark.createDataFrame(made, "doc_id long, label int, columns array<long>, values array<double>")


def test_a_run_trains_three_models_and_they_last(spark):
    df = rows(spark, 500)
    run = training.train(df, 40, trees=20, rounds=20)
    out = training.scored(run.models, df)
    auc = {r.model_name: r.roc_auc for r in roc_auc(out.withColumnRenamed("fake_probability", "score")).collect()}
    assert set(auc) == {"logistic_regression", "random_forest", "xgboost"} and min(auc.values()) > 0.8
    assert run.models.trees.groupBy("model").count().orderBy("model").collect()[0]["count"] == 20
    s = run.summary
    assert s["warning"] is None and s["training_samples"] == 500 and all(0 < v <= s["total_seconds"] for v in s["training_seconds"].values())
    path = tempfile.mkdtemp(prefix="spark-") + "/models"
    run.models.save(path)
    again = training.scored(training.Models.load(spark, path), df)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in out.collect()}
    same = training.train(df.repartition(3), 40, trees=20, rounds=20)
    trees_of = lambda r: {(t.model, t.tree, tuple(t.feature), tuple(t.value)) for t in r.models.trees.collect()}
    assert trees_of(same) == trees_of(run)


def test_a_run_of_one_class_warns_and_of_none_fails(spark):
    run = training.train(rows(spark, 60, one_class=True), 40, trees=3, rounds=3)
    assert "single class" in run.summary["warning"]
    assert training.scored(run.models, rows(spark, 5)).where("fake_probability > 0.01").isEmpty()
    with pytest.raises(ValueError, match="at least one row"):
        training.train(rows(spark, 5).limit(0), 40)


def test_more_rows_than_the_bound_are_thinned_by_id(spark):
    df = rows(spark, 900)
    kept = training.bounded(df, 300)
    assert 220 < kept.count() < 380 and training.bounded(df, 900).count() == 900
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in training.bounded(df.repartition(5), 300).collect()}
