"""Text preparation, splitting, TF-IDF, training and evaluation of the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.functions import text as T
from inkproof.operators import text_batch
from inkproof.session import materialised


def clean_text(text: Column) -> Column:
    """Lower case, everything but ASCII letters and digits to blanks, blanks collapsed."""
    kept = F.regexp_replace(F.lower(text), r"(?U)[^a-z0-9\s\x1c-\x1f]+", " ")
    return F.coalesce(T.collapse(kept), F.lit(""))


def normalise_label(label: Column, numeric: bool = False) -> Column:
    """Textual labels to 0 (genuine) or 1 (fake), numbers to their whole part; NULL for anything else.

    ``numeric``: the column has a number type.  ``rejected_labels`` counts what becomes NULL.
    """
    if numeric:
        whole = label.cast("double").cast("int")
        return F.when(whole.isin(0, 1), whole)
    values = F.create_map(*[F.lit(x) for pair in C.LABEL_VALUES.items() for x in pair])
    return F.try_element_at(values, F.lower(T.strip(label.cast("string"))))


def rejected_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    """Labels that are neither class, with their counts."""
    numeric = dict(rows.dtypes)[label] != "string"
    known = normalise_label(F.col(label), numeric)
    return rows.where(F.col(label).isNotNull() & known.isNull()).groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def class_balance(rows: DataFrame, label: str = "label") -> DataFrame:
    total = F.count(F.lit(1))
    train = F.floor(total * 8 / 10).cast("bigint")
    return rows.agg(
        total.alias("total_rows"), train.alias("training_samples"),
        (total - train).alias("testing_samples"),
        F.count_if(F.col(label) == 0).alias("genuine"), F.count_if(F.col(label) == 1).alias("fake"))


def stratified_split(rows: DataFrame, key: str, label: str, parts: int = 5, seed: int = 42) -> DataFrame:
    """Add ``is_test``: per class, exactly the smallest fifth (rounded up) of a keyed hash.

    Ranking a whole class in one window would put it in one task.  Instead rows are counted
    per hash bucket (4096 per class); buckets wholly below the cut are test rows, those
    above are training rows, and only the one bucket holding the cut is ranked.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    hashed = rows.withColumn("_h", order).withColumn("_b", F.left("_h", F.lit(3)))
    counts = hashed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    by_class = Window.partitionBy(label)
    upto = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edges = counts.select(
        F.col(label).alias("_label"), F.col("_b").alias("_bucket"), "_n",
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
        F.ceil(F.sum("_n").over(by_class) / parts).alias("_quota"))
    placed = hashed.join(
        F.broadcast(edges), (F.col(label) == F.col("_label")) & (F.col("_b") == F.col("_bucket")))
    cut = (F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("_n") > F.col("_quota"))
    inside = placed.where(cut).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)))
    exact = inside.withColumn("is_test", F.col("_before") + F.col("_rank") <= F.col("_quota"))
    rest = placed.where(~cut).withColumn("is_test", F.col("_before") < F.col("_quota"))
    columns = [*rows.columns, "is_test"]
    return rest.select(columns).unionByName(exact.select(columns))


def term_counts(docs: DataFrame, stop_words: list[str]) -> DataFrame:
    """(doc_id, term, tf) of one- and two-word terms, counted inside each document for a batch of texts at once.

    The words are those of :func:`clean_text` with two characters at least: runs of ASCII letters and digits.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(
        text_batch.term_rows(stop_words), f"doc_id {key}, term string, tf int")


def tfidf(docs: DataFrame, stop_words: list[str], max_features: int | None = None, max_df: float = 0.95) -> DataFrame:
    """Sublinear tf, smoothed idf, unit length.

    The vocabulary is joined, so it may grow with the corpus; ``max_features`` keeps the most
    used terms only, if the caller wants that.  The terms are counted once and stored, as both
    the vocabulary and the weights read them.
    """
    counts = materialised(term_counts(docs, stop_words), "counts")
    total = docs.count()
    used = (
        counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("uses"))
        .where(F.col("df") <= total * max_df))
    if max_features is not None:
        used = used.orderBy(F.col("uses").desc(), "term").limit(max_features)
    vocabulary = used.select("term", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = counts.join(vocabulary, "term").select(
        "doc_id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    return weighted.select("doc_id", "term", (F.col("raw") / norm).alias("weight"))


def metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 per model from (model_name, label, score)."""
    y, p = F.col("label") == 1, F.col("score") >= 0.5
    n = predictions.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y == p).alias("right"),
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return n.select(
        "model_name", (F.col("right") / F.col("n")).alias("accuracy"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def score_steps(predictions: DataFrame, buckets: int = 1000) -> DataFrame:
    """Running true and false positives per distinct score, and the counts of the next lower score.

    A model's scores are never ordered in one task: counts are summed per bucket of scores, the
    at most ``buckets`` + 1 sums of a model run on, and only the scores of a bucket are ordered.
    """
    per_score = predictions.groupBy("model_name", "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"),
    ).withColumn("bucket", F.floor(F.col("score") * buckets))
    sums = per_score.groupBy("model_name", "bucket").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max(F.struct("score", "pos", "neg")).alias("first"))
    down = Window.partitionBy("model_name").orderBy(F.col("bucket").desc())
    before, model = down.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("model_name")
    edges = sums.select(
        "model_name", "bucket",
        F.coalesce(F.sum("pos").over(before), F.lit(0)).alias("tp0"), F.coalesce(F.sum("neg").over(before), F.lit(0)).alias("fp0"),
        F.sum("pos").over(model).alias("p"), F.sum("neg").over(model).alias("n"), F.lead("first").over(down).alias("below"))
    inside = Window.partitionBy("model_name", "bucket").orderBy(F.col("score").desc())
    rows = per_score.select(
        "model_name", "bucket", "score", "pos", "neg", F.sum("pos").over(inside).alias("tp1"), F.sum("neg").over(inside).alias("fp1"),
        F.lead("pos").over(inside).alias("next_pos"), F.lead("neg").over(inside).alias("next_neg"))
    return rows.join(edges, ["model_name", "bucket"]).select(
        "model_name", "score", "pos", "neg", (F.col("tp0") + F.col("tp1")).alias("tp"), (F.col("fp0") + F.col("fp1")).alias("fp"), "p", "n",
        F.coalesce("next_pos", "below.pos").alias("next_pos"), F.coalesce("next_neg", "below.neg").alias("next_neg"))


def roc_auc(predictions: DataFrame) -> DataFrame:
    """Exact area under the curve, ties counted half; zero when only one class is present."""
    s = score_steps(predictions)
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    pairs = F.max(F.col("p") * F.col("n"))
    return s.groupBy("model_name").agg(
        F.when(pairs > 0, wins / pairs).otherwise(F.lit(0.0)).alias("roc_auc"))


def roc_curve(predictions: DataFrame) -> DataFrame:
    """Corner points of the curve per model, from (0, 0) with a NULL threshold on; none for one class only.

    A point between two equal steps lies on their line and is left out; the first and last stay.
    """
    s = score_steps(predictions).where((F.col("p") > 0) & (F.col("n") > 0))
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    last = F.col("next_pos").isNull()
    turns = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    corners = s.where(first | last | turns).select(
        "model_name", F.col("score").alias("threshold"),
        (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"))
    starts = s.where(first).select("model_name", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return starts.unionByName(corners)


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    hit = F.col("score") >= 0.5
    return predictions.groupBy("model_name", "label").agg(
        F.count_if(~hit).alias("predicted_0"), F.count_if(hit).alias("predicted_1"))


def comparison(metric_rows: DataFrame) -> DataFrame:
    """Metric by model, long form."""
    return metric_rows.unpivot("model_name", C.METRIC_NAMES, "metric", "value")


def standard_scale(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns divided by their population deviation, not centred; a constant one becomes NULL."""
    spread = rows.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    return rows.withColumns({c: F.col(c) / F.lit(spread[c] or None).cast("double") for c in columns})


def evaluate(predictions: DataFrame, metric_rows: DataFrame) -> DataFrame:
    """Metrics of each model with its confusion counts."""
    hit, positive = F.col("score") >= 0.5, F.col("label") == 1
    counts = predictions.groupBy("model_name").agg(
        F.count_if(~positive & ~hit).alias("tn"), F.count_if(~positive & hit).alias("fp"),
        F.count_if(positive & ~hit).alias("fn"), F.count_if(positive & hit).alias("tp"), F.count(F.lit(1)).alias("samples"))
    return metric_rows.join(counts, "model_name")


def run_summary(split: DataFrame, n_features: int) -> DataFrame:
    """One row about a training run: sizes, classes, features and models."""
    return split.agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(~F.col("is_test")).alias("train_samples"), F.count_if("is_test").alias("test_samples"),
        F.count_if(F.col("label") == 0).alias("genuine"), F.count_if(F.col("label") == 1).alias("fake"),
    ).select("*", F.lit(n_features).alias("n_features"), F.lit(", ".join(C.MODEL_NAMES)).alias("models"))
