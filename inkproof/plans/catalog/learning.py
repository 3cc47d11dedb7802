"""Text preparation, split, TF-IDF, training and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.functions import text as T
from inkproof.operators import artifacts, training, vectorize
from inkproof.operators import learning as L
from inkproof.operators.features import extract_features
from inkproof.operators.warehouse import metrics_upsert
from inkproof.plans import oracle as O
from inkproof.plans.catalog.features import PROSE_SQL, VECTOR_SQL, phrases_sql
from inkproof.plans.registry import query
from inkproof.session import materialised, shared_folder
from inkproof.sources import datasets
from inkproof.sources.business import business_documents
from inkproof.sources.tables import prose, prose_documents, table

STOP = ["the", "and", "of", "to", "in", "a", "is", "that", "for", "it", "on", "by", "with", "as", "der", "die", "und", "de", "la", "el", "en", "et", "le"]
CLEAN = f"trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9{O.WS}]+', ' ', 'g'), '[{O.WS}]+', ' ', 'g'))"


@query("ml_clean_text", f"SELECT doc_id, md5({CLEAN}) AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    docs = prose(spark, sf_dir)
    return docs.select("doc_id", F.md5(L.clean_text(F.col("text"))).alias("cleaned"))


@query("ml_label_normalise", """SELECT doc_id, CASE WHEN toxic = 1 THEN 1 WHEN doc_id % 3 = 0 THEN NULL ELSE 0 END AS label FROM labels""")
def label_normalise(spark, sf_dir):
    raw = F.when(F.col("toxic") == 1, F.lit(" Forged ")).when(F.col("doc_id") % 3 == 0, F.lit("unsure")).otherwise(F.lit("genuine"))
    return table(spark, sf_dir, "labels").select("doc_id", L.normalise_label(raw).alias("label"))


@query("ml_class_balance", f"""WITH {O.BIZ} SELECT count(*) AS total_rows, CAST(floor(count(*) * 0.8) AS BIGINT) AS training_samples,
count(*) - CAST(floor(count(*) * 0.8) AS BIGINT) AS testing_samples, count(*) FILTER (label = 0) AS genuine, count(*) FILTER (label = 1) AS fake FROM biz""")
def class_balance(spark, sf_dir):
    return L.class_balance(business_documents(spark, sf_dir))


@query("ml_stratified_split", f"""WITH {O.BIZ}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS rn,
count(*) OVER (PARTITION BY label) AS n FROM biz) SELECT doc_id, label, rn <= ceil(n / 5.0) AS is_test FROM r""")
def stratified_split(spark, sf_dir):
    return L.stratified_split(business_documents(spark, sf_dir).select("doc_id", "label"), "doc_id", "label")


_STOPS = ", ".join(O.q(w) for w in STOP)


@query("ml_tfidf_vectorize", f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all({CLEAN}, '[a-z0-9]{{2,}}'), lambda w: w NOT IN ({_STOPS})) AS w FROM documents),
g AS (SELECT doc_id, unnest(w) AS term FROM t UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t) x),
c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2),
v AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf, sum(tf) AS uses FROM c GROUP BY 1
HAVING count(*) <= 0.95 * (SELECT count(*) FROM documents)),
r AS (SELECT doc_id, c.term, (1 + ln(tf)) * idf AS raw FROM c JOIN v ON v.term = c.term)
SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 5) AS weight FROM r""")
def tfidf_vectorize(spark, sf_dir):
    return L.tfidf(prose(spark, sf_dir), STOP).withColumn("weight", F.round("weight", 5))


_SCORERS = [("logistic_regression", 997), ("random_forest", 409), ("xgboost", 211)]
PRED = "pr AS (" + " UNION ALL ".join(
    f"SELECT l.doc_id, l.toxic AS label, '{name}' AS model_name, round((n_chars % {p}) / CAST({p} AS DOUBLE), 6) AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id"
    for name, p in _SCORERS) + ")"


def scored_labels(spark, sf_dir):
    """Three simple length-based scorers against the toxicity label."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    scores = F.array(*[
        F.struct(F.lit(n).alias("model_name"), F.round((F.col("n_chars") % p) / F.lit(float(p)), 6).alias("score"))
        for n, p in _SCORERS])
    return joined.select("doc_id", F.col("toxic").alias("label"), F.explode(scores).alias("s")).select("doc_id", "label", "s.*")


_M = """SELECT model_name, round(count(*) FILTER ((label = 1) = (score >= 0.5)) / CAST(count(*) AS DOUBLE), 6) AS accuracy,
round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1 FROM pr JOIN (SELECT model_name AS m,
count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn
FROM pr GROUP BY 1) k ON m = model_name GROUP BY model_name, tp, fp, fn"""
_COLS = ["accuracy", "precision", "recall", "f1"]


def _rounded(df):
    return df.select("model_name", *[F.round(c, 6).alias(c) for c in _COLS])


@query("ml_classification_metrics", f"WITH {PRED} {_M}")
def classification_metrics(spark, sf_dir):
    return _rounded(L.metrics(scored_labels(spark, sf_dir)))


@query("w_model_leaderboard", f"WITH {PRED} SELECT * FROM ({_M}) t ORDER BY model_name")
def model_leaderboard(spark, sf_dir):
    return _rounded(L.metrics(scored_labels(spark, sf_dir))).orderBy("model_name")


_AUC = """SELECT a.model_name, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS roc_auc
FROM pr a JOIN pr b ON a.model_name = b.model_name AND a.label = 1 AND b.label = 0 GROUP BY 1"""


def all_metrics(spark, sf_dir):
    scored = scored_labels(spark, sf_dir)
    return _rounded(L.metrics(scored)).join(L.roc_auc(scored).withColumn("roc_auc", F.round("roc_auc", 6)), "model_name")


@query("ml_metrics_comparison", f"WITH {PRED}, m AS (SELECT * FROM ({_M}) a JOIN ({_AUC}) b USING (model_name)) " + " UNION ALL ".join(
    f"SELECT model_name, '{c}' AS metric, {c} AS value FROM m" for c in [*_COLS, "roc_auc"]))
def metrics_comparison(spark, sf_dir):
    return L.comparison(all_metrics(spark, sf_dir))


@query("ml_roc_auc", f"WITH {PRED} {_AUC}")
def roc_auc(spark, sf_dir):
    return L.roc_auc(scored_labels(spark, sf_dir)).withColumn("roc_auc", F.round("roc_auc", 6))


@query("ml_roc_curve", f"""WITH {PRED}, c AS (SELECT model_name, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM pr GROUP BY 1, 2),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER m AS p, sum(neg) OVER m AS n, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS i
FROM c WINDOW w AS (PARTITION BY model_name ORDER BY score DESC), m AS (PARTITION BY model_name))
SELECT model_name, score AS threshold, round(fp / CAST(n AS DOUBLE), 6) AS fpr, round(tp / CAST(p AS DOUBLE), 6) AS tpr FROM r
WHERE p > 0 AND n > 0 AND (i = 1 OR np IS NULL OR np <> pos OR nn <> neg) UNION ALL SELECT model_name, NULL, 0, 0 FROM r WHERE i = 1 AND p > 0 AND n > 0""")
def roc_curve(spark, sf_dir):
    return L.roc_curve(scored_labels(spark, sf_dir)).withColumns({"fpr": F.round("fpr", 6), "tpr": F.round("tpr", 6)})


@query("ml_confusion_matrix", f"WITH {PRED} SELECT model_name, label, count(*) FILTER (score < 0.5) AS predicted_0, count(*) FILTER (score >= 0.5) AS predicted_1 FROM pr GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return L.confusion_matrix(scored_labels(spark, sf_dir))


@query("snk_metrics_upsert", f"WITH {PRED}, m AS ({_M}) SELECT model_name, " + ", ".join(
    f"round(CASE WHEN model_name = 'random_forest' THEN {c} ELSE 1 - {c} END, 6) AS {c}" for c in _COLS) + ", CASE WHEN model_name = 'random_forest' THEN 1 ELSE 2 END AS run_ts FROM m")
def upsert(spark, sf_dir):
    """A later run replaces two of the three models."""
    base = _rounded(L.metrics(scored_labels(spark, sf_dir))).withColumn("run_ts", F.lit(1))
    later = base.where(F.col("model_name") != "random_forest").withColumns({**{c: F.round(1 - F.col(c), 6) for c in _COLS}, "run_ts": F.lit(2)})
    return metrics_upsert(base, later)


@query("ml_label_numbers", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE toxic END AS label FROM labels")
def label_numbers(spark, sf_dir):
    """Labels stored as doubles; every fifth is neither class."""
    raw = F.when(F.col("doc_id") % 5 == 0, F.lit(7.0)).otherwise(F.col("toxic").cast("double"))
    return table(spark, sf_dir, "labels").select("doc_id", L.normalise_label(raw, numeric=True).alias("label"))


# --- training on text and numbers ---------------------------------------------------------------


_runs: dict[tuple[str, str], tuple[training.Fitted, str]] = {}


def training_rows(spark, sf_dir) -> DataFrame:
    """The rendered documents with text, features and the split."""
    docs = business_documents(spark, sf_dir)
    split = L.stratified_split(docs.select("doc_id", "label"), "doc_id", "label").select("doc_id", "is_test")
    return extract_features(docs).select("doc_id", "label", "text", *C.FEATURE_NAMES).join(split, "doc_id")


def trained(spark, sf_dir) -> tuple[training.Fitted, str]:
    """The classifiers of this session for a data folder, with their full settings, and the folder of the run's tables.

    Fitted on four fifths of the documents and applied to the rest, once.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _runs:
        folder = f"{shared_folder(spark)}-run"
        training_rows(spark, sf_dir).write.parquet(f"{folder}/rows")
        rows = spark.read.parquet(f"{folder}/rows")
        fitted, summary = training.fit(rows.where(~F.col("is_test")), STOP)
        held = rows.where("is_test")
        fitted.predict(held).write.parquet(f"{folder}/predictions")
        training.run_row(spark, "first", summary, held.count()).write.parquet(f"{folder}/runs")
        artifacts.save_models(spark, fitted, f"{folder}/saved", 1)
        _runs[key] = fitted, folder
    return _runs[key]


_SPLIT = f"""{O.BIZ}, split AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) <= ceil(count(*) OVER (PARTITION BY label) / 5.0) AS is_test FROM biz)"""
_MODEL_VALUES = "(VALUES ('logistic_regression'), ('random_forest'), ('xgboost')) m(model_name)"


@query("ml_train_and_predict")
def train_and_predict(spark, sf_dir):
    """Three classifiers fitted with their full settings on terms and features, applied to the held-out fifth."""
    return spark.read.parquet(f"{trained(spark, sf_dir)[1]}/predictions")


@query("ml_batch_predict", f"WITH {_SPLIT} SELECT doc_id, CAST(label AS INT) AS label, model_name, TRUE AS sums_to_one FROM split, {_MODEL_VALUES} WHERE is_test")
def batch_predict(spark, sf_dir):
    """Which documents every model was applied to, and that its two probabilities make one."""
    genuine, fake = F.col("genuine_probability"), F.col("fake_probability")
    fine = (F.round(genuine + fake, 6) == 1) & genuine.between(0, 1) & fake.between(0, 1)
    return train_and_predict(spark, sf_dir).select("doc_id", F.col("label").cast("int").alias("label"), "model_name", fine.alias("sums_to_one"))


@query("snk_model_artifacts", f"WITH {_SPLIT} SELECT doc_id, model_name, TRUE AS same FROM split, {_MODEL_VALUES} WHERE is_test")
def model_artifacts(spark, sf_dir):
    """The saved version, loaded again, predicts what the fitted one did."""
    _, folder = trained(spark, sf_dir)
    loaded = artifacts.load_models(spark, f"{folder}/saved")[1].predict(spark.read.parquet(f"{folder}/rows").where("is_test"))
    before = spark.read.parquet(f"{folder}/predictions").select("doc_id", "model_name", F.col("fake_probability").alias("before"))
    return loaded.join(before, ["doc_id", "model_name"]).select("doc_id", "model_name", (F.col("fake_probability") == F.col("before")).alias("same"))


@query("ml_evaluate_fitted")
def evaluate_fitted(spark, sf_dir):
    """Everything the evaluation of the run reports, from the fitted models' predictions."""
    rows = train_and_predict(spark, sf_dir).withColumnRenamed("fake_probability", "score")
    both = L.metrics(rows).join(L.roc_auc(rows), "model_name")
    return L.evaluate(rows, both)


@query("ml_training_run", f"""WITH {_SPLIT} SELECT 'first' AS run_id, count(*) FILTER (NOT is_test) AS training_samples, count(*) FILTER (is_test) AS testing_samples,
count(*) FILTER (NOT is_test AND label = 0) AS genuine, count(*) FILTER (NOT is_test AND label = 1) AS fake, {5000 + len(C.FEATURE_NAMES)} AS feature_count,
{O.q(', '.join(C.MODEL_NAMES))} AS models, '' AS warning, TRUE AS timed FROM split""")
def training_run(spark, sf_dir):
    """The stored row about the run; seconds are shown only as being there."""
    runs = spark.read.parquet(f"{trained(spark, sf_dir)[1]}/runs")
    timed = F.forall("training_seconds", lambda s: (s > 0) & (s <= F.col("total_seconds"))) & (F.size("training_seconds") == 3)
    return runs.withColumns({"timed": timed, "warning": F.coalesce("warning", F.lit(""))}).drop("training_seconds", "total_seconds")


def _terms(source: str) -> str:
    """CTE c: the terms of the documents in a source with their counts."""
    return f"""t AS (SELECT doc_id, list_filter(regexp_extract_all({CLEAN}, '[a-z0-9]{{2,}}'), lambda w: w NOT IN ({_STOPS})) AS w FROM {source}),
g AS (SELECT doc_id, unnest(w) AS term FROM t UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t) x),
c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2)"""


_ALL_TERMS = f"{_terms('documents')}, v AS (SELECT term FROM c GROUP BY 1 HAVING count(*) <= 0.95 * (SELECT count(*) FROM documents))"


@query("ml_feature_columns", f"WITH {_ALL_TERMS} SELECT row_number() OVER (ORDER BY term) - 1 AS \"column\", term AS name FROM v UNION ALL "
       f"SELECT (SELECT count(*) FROM v) + i, name FROM (VALUES {', '.join(f'({i}, {O.q(n)})' for i, n in enumerate(C.FEATURE_NAMES))}) f(i, name)")
def feature_columns(spark, sf_dir):
    """All column names of the matrix over the prose, the vocabulary being as large as the corpus makes it."""
    model = vectorize.TextVectorizer(None, stop_words=STOP).fit(prose(spark, sf_dir))
    return model.feature_names()


@query("ml_combine_features", f"""WITH {_SPLIT}, {_terms('biz')},
k AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS col, idf FROM (SELECT term, ln((1 + n) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf
FROM c JOIN split USING (doc_id), (SELECT count(*) AS n FROM split WHERE NOT is_test) z WHERE NOT is_test GROUP BY term, n HAVING count(*) <= 0.95 * n ORDER BY sum(tf) DESC, term LIMIT 5000) x),
r AS (SELECT doc_id, col, (1 + ln(tf)) * idf AS raw FROM c JOIN k USING (term)),
x AS (SELECT doc_id, unnest([{', '.join(f'CAST({e} AS DOUBLE)' for e in VECTOR_SQL.values())}]) AS v, generate_subscripts([{', '.join('0' for _ in VECTOR_SQL)}], 1) AS i FROM biz LEFT JOIN ({phrases_sql('biz')}) ph USING (doc_id))
SELECT doc_id, col AS "column", round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 5) AS value FROM r
UNION ALL SELECT doc_id, (SELECT count(*) FROM k) + i - 1, round(v, 6) FROM x WHERE v <> 0""")
def combine_features(spark, sf_dir):
    """The matrix in coordinates: terms learnt from the training part, and all 32 features, for every document, seen or not."""
    rows = materialised(training_rows(spark, sf_dir), "rows")
    texts, features, labels = rows.select("doc_id", "text"), rows.select("doc_id", *C.FEATURE_NAMES), rows.select("doc_id", "label")
    train = rows.where(~F.col("is_test")).select("doc_id", "text")
    model = vectorize.TextVectorizer(5000, stop_words=STOP).fit(train)
    whole = model.transform(vectorize.matched(texts, features, labels))
    cells = vectorize.coordinates(vectorize.combine(whole, C.FEATURE_NAMES, model.size))
    return cells.withColumn("value", F.when(F.col("column") < model.size, F.round("value", 5)).otherwise(F.round("value", 6)))


def csv_lines(spark, sf_dir, wide: bool) -> DataFrame:
    """The documents as lines of a labelled file, with all 32 features in it or with the text alone."""
    docs = prose_documents(spark, sf_dir).where(F.col("text").isNotNull())
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit('""')), F.lit('"'))
    parts = [F.col("doc_id").cast("string"), quoted(F.col("text")), F.lit("genuine")]
    if wide:
        # what a file may hold in place of a number becomes zero: every third word count is none
        docs = extract_features(docs)
        parts += [F.when((F.lit(n) == "word_count") & (F.col("doc_id") % 3 == 0), "n/a").otherwise(F.round(n, 6).cast("string")) for n in C.FEATURE_NAMES]
    # a filter on the lines would compute all features again below it
    return T.computed_once(docs.select(F.concat_ws(",", *parts).alias("line")))


_FLAT = "(SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents)"


def _dataset_sql(source: str, name: str, instead: dict[str, str]) -> str:
    cells = ", ".join(f"round(CAST({instead.get(n, e)} AS DOUBLE), 6) AS {n}" for n, e in PROSE_SQL.items())
    return f"SELECT '{name}' AS branch, doc_id, {cells} FROM {source} d LEFT JOIN ({phrases_sql(source)}) ph USING (doc_id)"


@query("ml_dataset_features", "SELECT * FROM (" + _dataset_sql(_FLAT, "computed", {}) + ") UNION ALL SELECT * FROM ("
       + _dataset_sql("documents", "given", {"word_count": f"CASE WHEN doc_id % 3 = 0 THEN 0 ELSE {PROSE_SQL['word_count']} END"}) + ")")
def dataset_features(spark, sf_dir):
    """Features of a labelled file: computed from its texts, or taken from its columns where it has all of them."""
    parts = []
    for name, wide in (("computed", False), ("given", True)):
        header = ["doc_id", "Content", "target", *(C.FEATURE_NAMES if wide else [])]
        rows = datasets.labelled_dataset(datasets.parse_lines(csv_lines(spark, sf_dir, wide), header))
        made = vectorize.dataset_features(rows)
        parts.append(made.select(F.lit(name).alias("branch"), F.col("doc_id").cast("bigint").alias("doc_id"), *[F.round(n, 6).alias(n) for n in C.FEATURE_NAMES]))
    return parts[0].unionByName(parts[1])
