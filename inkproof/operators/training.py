"""Training runs: three classifiers fitted side by side on sparse rows, each timed, and what they predict.

The rows of a run are stored, binned once, and dealt to the tasks that grow trees.  All rows take part:
where there are more than MAX_ROWS, every part of the forest gets that many of them, and boosting goes
through them in turns, a part of the rounds for each.  Scaling, cuts and predictions are jobs over all rows given.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.operators.trees import BINS, Binned, Tree, boosted, forest
from inkproof.operators.vectorize import TextVectorizer, TextVectorizerModel, combine, coordinates
from inkproof.session import materialised, shared_folder

#: Labelled rows that one task grows trees on, about; more only if there are so many for each tree.
MAX_ROWS = 20_000
SEED = 42
TREES = "model string, tree int, feature array<int>, threshold array<double>, left array<int>, value array<double>"


@dataclass
class Models:
    """Fitted classifiers of rows with ``width`` columns: weights and intercept of the linear one, the others' trees as a table."""

    width: int
    weights: np.ndarray
    intercept: float
    trees: DataFrame
    names: list[str] = field(default_factory=lambda: list(C.MODEL_NAMES))

    def save(self, path: str) -> None:
        spark = self.trees.sparkSession
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame(
            [(self.width, self.intercept, self.weights.tolist(), self.names)], "width int, intercept double, weights array<double>, names array<string>",
        ).write.mode("overwrite").parquet(f"{path}/linear")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Models:
        row = spark.read.parquet(f"{path}/linear").first()
        return cls(row["width"], np.array(row["weights"]), row["intercept"], spark.read.schema(TREES).parquet(f"{path}/trees"), list(row["names"]))


@dataclass
class Run:
    """What a training run leaves: its models and one row about it."""

    models: Models
    summary: dict


def bounded(rows: DataFrame, limit: int) -> DataFrame:
    """About ``limit`` rows at most, by a hash of the id."""
    n = rows.count()
    if n <= limit:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(limit / n * (1 << 20)))


def deviations(rows: DataFrame, width: int, total: int) -> np.ndarray:
    """Population deviation of every column; 1 where a column does not vary."""
    sums = coordinates(rows).groupBy("column").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).collect()  # a row a column
    out = np.ones(width)
    for r in sums:
        spread = r["q"] / total - (r["s"] / total) ** 2
        out[r["column"]] = np.sqrt(spread) if spread > 1e-12 else 1.0
    return out


def cut_points(rows: DataFrame, width: int) -> np.ndarray:
    """For each column the largest value of every bin: quantiles of what is not zero, zero itself, and infinity at the end."""
    shares = F.array(*[F.lit(i / (BINS - 2)) for i in range(BINS - 2)])
    found = coordinates(rows).groupBy("column").agg(F.percentile_approx("value", shares, 2000).alias("c")).collect()  # a row a column
    cuts = np.full((width, BINS), np.inf)
    for r in found:
        own = np.unique(np.append(r["c"], 0.0))[:BINS - 1]
        cuts[r["column"], :len(own)] = own
    return cuts


def binned(cuts: np.ndarray):
    """Sparse rows to (label, columns, bins, hash)."""

    def run(batches):
        for batch in batches:
            columns, values = batch.column("columns"), batch.column("values")
            at, x = columns.flatten().to_numpy(), values.flatten().to_numpy()
            out = np.empty(len(at), np.int8)
            order = np.argsort(at, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                if len(own):
                    out[own] = np.searchsorted(cuts[at[own[0]], :BINS - 1], x[own])
            ends = np.append(0, np.cumsum(columns.value_lengths().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").cast(pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32())),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int8())), batch.column("hash")],
                names=["label", "columns", "bins", "hash"])

    return run


def planted(model: str, cuts: np.ndarray, counts: list[int], before: tuple[Tree, ...] = ()):
    """All binned rows of one part to its trees; part p of a forest has counts[p] of them. before: trees that boosting goes on from."""

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        columns, bins = (table[c].combine_chunks() for c in ("columns", "bins"))
        y = table["label"].to_numpy().astype(np.float64)
        length = columns.value_lengths().to_numpy(zero_copy_only=False)
        column, bin_, row = columns.flatten().to_numpy(), bins.flatten().to_numpy(), np.repeat(np.arange(len(y)), length)
        # trees depend on the order of the rows, which shuffles do not keep: order them by what they hold
        weight = np.random.default_rng(SEED).random(len(cuts))
        order = np.lexsort((np.bincount(row, weight[column] * (bin_ + 1.0), len(y)), y))
        place = np.empty(len(y), np.int64)
        place[order] = np.arange(len(y))
        y, data = y[order], Binned(cuts, len(y), column, place[row], bin_)
        first = sum(counts[:part]) + len(before)
        grown = forest(data, y, counts[part], SEED + part) if model == "random_forest" else boosted(data, y, counts[part], SEED, before)
        rows = [{"model": model, "tree": first + i, "feature": t.feature.tolist(), "threshold": t.threshold.tolist(), "left": t.left.tolist(), "value": t.value.tolist()}
                for i, t in enumerate(grown)]
        return pa.Table.from_pylist(rows, pa.schema([
            ("model", pa.string()), ("tree", pa.int32()), ("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())),
            ("left", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))]))

    return run


def grow_forest(rows: DataFrame, cuts: np.ndarray, counts: list[int], total: int, limit: int) -> DataFrame:
    """Each of the parts gets all binned rows, or ``limit`` of many, and grows its trees; every row goes to one part at least."""
    parts = len(counts)
    copies = min(parts, max(1, parts * limit // total))
    own = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda j: F.pmod(F.col("hash") + j, F.lit(parts)).cast("int"))
    dealt = rows.withColumn("part", F.explode(own)).repartitionByRange(parts, "part")
    return materialised(dealt.groupBy("part").applyInArrow(planted("random_forest", cuts, counts), TREES), "random_forest")


def tree_of(row) -> Tree:
    return Tree(np.array(row["feature"]), np.array(row["threshold"]), np.array(row["left"]), np.array(row["value"]))


def boost(rows: DataFrame, cuts: np.ndarray, rounds: int, turns: int) -> DataFrame:
    """The rounds in ``turns`` shares; each goes on from the trees so far with the rows of its turn."""
    if turns > 1:
        path = f"{shared_folder(rows.sparkSession)}-turns"
        dealt = rows.withColumn("turn", F.pmod(F.col("hash"), F.lit(turns)).cast("int"))
        dealt.repartition(F.col("turn")).write.partitionBy("turn").parquet(path)
        rows = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    grown: list[Tree] = []
    tables = []
    for turn in range(turns):
        own = rows.where(F.col("turn") == turn) if turns > 1 else rows
        share = rounds // turns + (turn < rounds % turns)
        made = own.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(planted("xgboost", cuts, [share], tuple(grown)), TREES)
        tables.append(materialised(made, f"xgboost-{turn}"))
        if turn + 1 < turns:
            grown += [tree_of(r) for r in tables[-1].orderBy("tree").collect()]  # as many as the settings allow
    return tables[0] if turns == 1 else materialised(reduce(DataFrame.unionByName, tables).coalesce(1), "xgboost")


def fit_linear(rows: DataFrame, width: int, total: int, scale: np.ndarray, weight: dict) -> tuple[np.ndarray, float]:
    """Logistic regression with a penalty on columns of unit deviation; weights are given for the unscaled columns."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    def vector(columns, values):
        return Vectors.sparse(width, columns, [v / scale[c] for c, v in zip(columns, values, strict=True)])

    balance = F.lit(0.0)
    for y, w in weight.items():
        balance = F.when(F.col("label") == y, w).otherwise(balance)
    ready = materialised(rows.select(F.udf(vector, VectorUDT())("columns", "values").alias("features"), F.col("label").cast("double").alias("label"), balance.alias("weight")), "scaled")
    tasks = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 2000))
    fitted = LogisticRegression(weightCol="weight", maxIter=2000, tol=1e-5, regParam=1 / (0.5 * total), standardization=False).fit(ready.coalesce(tasks).cache())
    return fitted.coefficients.toArray() / scale, float(fitted.intercept)


def train(rows: DataFrame, width: int, trees: int = 300, rounds: int = 300, limit: int = MAX_ROWS) -> Run:
    """Fits the three classifiers on rows (doc_id, label 0 or 1, columns, values) at the same time.

    Each has a scheduler pool of its own.  Raises without rows; with one class only the summary says so.
    """
    spark = rows.sparkSession
    started = time.perf_counter()
    own = materialised(rows.select("doc_id", "label", "columns", "values"), "training")
    sizes = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    total = sum(sizes.values())
    if not total:
        raise ValueError("training needs at least one row")
    cuts = cut_points(own, width)
    dealt = own.withColumn("hash", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1)))
    ready = materialised(dealt.mapInArrow(binned(cuts), "label int, columns array<int>, bins array<tinyint>, hash long"), "binned")
    parts = max(1, min(trees, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // limit))))
    turns = max(1, min(rounds, -(-total // limit)))
    shares = [trees // parts + (p < trees % parts) for p in range(parts)]
    weight = {y: total / (len(sizes) * n) for y, n in sizes.items()}
    fits = {
        "logistic_regression": lambda: fit_linear(own, width, total, deviations(own, width, total), weight),
        "random_forest": lambda: grow_forest(ready, cuts, shares, total, limit),
        "xgboost": lambda: boost(ready, cuts, rounds, turns),
    }

    def timed(name):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        begin = time.perf_counter()
        return fits[name](), round(time.perf_counter() - begin, 4)

    done = side_by_side(timed, list(fits))
    (weights, intercept), planted_, raised = (done[n][0] for n in fits)
    summary = {
        "training_samples": total, "genuine": sizes.get(0, 0), "fake": sizes.get(1, 0), "feature_count": width, "model_names": list(fits),
        "warning": "the training set has a single class" if len(sizes) < 2 else None,
        "training_seconds": {n: done[n][1] for n in fits}, "total_seconds": round(time.perf_counter() - started, 4)}
    return Run(Models(width, weights, intercept, planted_.unionByName(raised)), summary)


def side_by_side(run, names: list[str]) -> dict:
    """run(name) for all names at once; a failure of one is raised when all are through."""
    results: dict = {}

    def one(name):
        try:
            results[name] = run(name)
        except Exception as e:  # raised below, in the caller's thread
            results[name] = e

    threads = [InheritableThread(target=one, args=(n,)) for n in names]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for r in results.values():
        if isinstance(r, Exception):
            raise r
    return results


def scored(models: Models | None, rows: DataFrame) -> DataFrame:
    """(doc_id, label, model_name, genuine and fake probability) for sparse rows, one row for each model; none without models."""
    spark = rows.sparkSession
    if models is None:
        none = F.lit(None)
        return rows.limit(0).select("doc_id", "label", none.cast("string").alias("model_name"), *[
            none.cast("double").alias(f"{c}_probability") for c in ("genuine", "fake")])
    grown: dict[str, list[Tree]] = {}
    for r in models.trees.orderBy("model", "tree").toLocalIterator():  # as large as the settings and a part's rows allow
        grown.setdefault(r["model"], []).append(tree_of(r))
    shared = spark.sparkContext.broadcast((models.width, models.weights, models.intercept, grown, models.names))
    kinds = dict(rows.dtypes)
    fields = f"doc_id {kinds['doc_id']}, label {kinds['label']}, model_name string, genuine_probability double, fake_probability double"

    def run(batches):
        width, weights, intercept, own, names = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield block(batch.slice(at, 512), width, weights, intercept, own, names)

    def block(batch, width, weights, intercept, own, names):
        n = batch.num_rows
        lengths = batch.column("columns").value_lengths().to_numpy(zero_copy_only=False)
        x = np.zeros((width, n))
        x[batch.column("columns").flatten().to_numpy(), np.repeat(np.arange(n), lengths)] = batch.column("values").flatten().to_numpy()
        sigmoid = lambda m: 1 / (1 + np.exp(-np.clip(m, -500, 500)))
        by_name = {
            "logistic_regression": lambda: sigmoid(weights @ x + intercept),
            "random_forest": lambda: np.mean([t.predict(x) for t in own["random_forest"]], axis=0),
            "xgboost": lambda: sigmoid(np.sum([t.predict(x) for t in own["xgboost"]], axis=0))}
        fake = np.round(np.concatenate([by_name[m]() for m in names]), 6)
        again = pa.array(np.tile(np.arange(n), len(names)))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(again), batch.column("label").take(again), pa.array(np.repeat(names, n).tolist(), pa.string()),
             pa.array(np.round(1 - fake, 6)), pa.array(fake)], names=["doc_id", "label", "model_name", "genuine_probability", "fake_probability"])

    return rows.select("doc_id", "label", "columns", "values").mapInArrow(run, fields)


@dataclass
class Fitted:
    """A vocabulary with the classifiers that were trained on it: what is saved as one version, and what predicts."""

    vectorizer: TextVectorizerModel
    models: Models

    def matrix(self, rows: DataFrame) -> DataFrame:
        """(doc_id, label, columns, values) of rows with doc_id, label, text and the 32 features."""
        return combine(self.vectorizer.transform(rows), C.FEATURE_NAMES, self.vectorizer.size).select("doc_id", "label", "columns", "values")

    def predict(self, rows: DataFrame) -> DataFrame:
        return scored(self.models, self.matrix(rows))

    def save(self, path: str) -> None:
        self.vectorizer.save(f"{path}/vectorizer")
        self.models.save(f"{path}/models")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Fitted:
        return cls(TextVectorizerModel.load(spark, f"{path}/vectorizer"), Models.load(spark, f"{path}/models"))


def fit(
    rows: DataFrame, stop_words: list[str] | None = None, max_features: int | None = 5000, trees: int = 300, rounds: int = 300, limit: int = MAX_ROWS,
) -> tuple[Fitted, dict]:
    """A training run on rows with doc_id, label, text and the 32 features: vocabulary, classifiers and the row about the run."""
    vectorizer = TextVectorizer(max_features, stop_words=stop_words).fit(rows)
    matrix = combine(vectorizer.transform(rows), C.FEATURE_NAMES, vectorizer.size)
    run = train(matrix, vectorizer.size + len(C.FEATURE_NAMES), trees, rounds, limit)
    return Fitted(vectorizer, run.models), run.summary


def run_row(spark: SparkSession, run_id: str, summary: dict, testing_samples: int) -> DataFrame:
    """The run as a table row."""
    names = summary["model_names"]
    values = (run_id, summary["training_samples"], testing_samples, summary["genuine"], summary["fake"], summary["feature_count"],
              ", ".join(names), summary["warning"], [summary["training_seconds"][n] for n in names], summary["total_seconds"])
    return spark.createDataFrame([values], (
        "run_id string, training_samples long, testing_samples long, genuine long, fake long, feature_count int, models string, warning string, "
        "training_seconds array<double>, total_seconds double"))
