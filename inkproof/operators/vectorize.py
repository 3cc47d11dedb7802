"""Text to sparse rows: a vocabulary that is a table, its column numbers, and the matrix of terms and numeric features."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.operators import text_batch
from inkproof.operators.features import finite
from inkproof.operators.learning import term_counts
from inkproof.session import materialised

#: Vocabularies up to this size are broadcast to the documents; larger ones are joined by a shuffle.
BROADCAST_TERMS = 100_000
#: ``monotonically_increasing_id`` holds the partition above these bits and the row inside of it below.
ROW_BITS = 33


def numbered(rows: DataFrame, key: str, name: str = "column", first: int = 0) -> DataFrame:
    """rows with dense numbers in the order of ``key``, which must be distinct.

    The rows are dealt into ranges of the key and numbered inside of each; a range begins where the
    counts of those before it end.  Nothing is ordered in one task, and one count for each range is
    all that reaches the driver.
    """
    spark = rows.sparkSession
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(ranges, key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id())
    # written down, so that numbers and counts come from the same ranges
    placed = materialised(ordered, "numbered").withColumn("_range", F.shiftright("_at", ROW_BITS))
    sizes = sorted((r["_range"], r["count"]) for r in placed.groupBy("_range").count().collect())
    begins, total = [], first
    for where, size in sizes:
        begins.append((where, total))
        total += size
    offsets = spark.createDataFrame(begins, "_range long, _first long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return placed.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_first") + inside).drop("_range", "_first", "_at")


def term_frequency(counts: DataFrame, total: int, max_df: float, max_features: int | None) -> DataFrame:
    """(term, idf) of the terms in at most ``max_df`` of the documents; with ``max_features`` the most used, of equals the first."""
    used = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("uses")).where(F.col("df") <= total * max_df)
    if max_features is not None:
        used = used.orderBy(F.col("uses").desc(), "term").limit(max_features)
    return used.select("term", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf"))


class TextVectorizer(Estimator):
    """Learns which terms of one or two words count and how rare they are.

    ``max_features``: so many of the most used terms at most; None for all.
    """

    def __init__(self, max_features: int | None = 5000, max_df: float = 0.95, stop_words: list[str] | None = None) -> None:
        super().__init__()
        self.max_features, self.max_df, self.stop_words = max_features, max_df, stop_words or []

    def _fit(self, dataset: DataFrame) -> TextVectorizerModel:
        docs = dataset.select("doc_id", "text")
        terms = term_frequency(term_counts(docs, self.stop_words), docs.count(), self.max_df, self.max_features)
        vocabulary = materialised(numbered(terms, "term"), "vocabulary")
        return TextVectorizerModel(vocabulary, vocabulary.count(), self.stop_words)


class TextVectorizerModel(Model):
    """A learnt vocabulary (term, idf, column); columns are numbered from 0 in the order of the terms."""

    def __init__(self, vocabulary: DataFrame, size: int, stop_words: list[str]) -> None:
        super().__init__()
        self.vocabulary, self.size, self.stop_words = vocabulary, size, stop_words

    def coordinates(self, docs: DataFrame) -> DataFrame:
        """(doc_id, column, raw): weights before they are brought to unit length; unknown terms are passed over."""
        words = self.vocabulary if self.size > BROADCAST_TERMS else F.broadcast(self.vocabulary)
        return term_counts(docs.select("doc_id", "text"), self.stop_words).join(words, "term").select(
            "doc_id", "column", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds columns and values, the document's sparse row in order of the columns; empty for texts without a known term.

        doc_id must be distinct.  The row of a document is as long as its distinct terms.  Vocabularies that can be broadcast go with the
        task function, which makes the rows of a batch of texts without a shuffle.
        """
        if self.size <= BROADCAST_TERMS:
            known = [tuple(r) for r in self.vocabulary.select("term", "idf", "column").collect()]
            made = F.arrow_udf(text_batch.sparse_rows(known, self.stop_words), "struct<columns:array<bigint>,values:array<double>>")
            rows = dataset.withColumn("_row", made(F.lower("text")))
            return rows.withColumns({"columns": F.col("_row.columns"), "values": F.col("_row.values")}).drop("_row")
        rows = self.coordinates(dataset).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("column", "raw"))).alias("_row"))
        norm = F.sqrt(F.aggregate("_row", F.lit(0.0), lambda s, e: s + e["raw"] * e["raw"]))
        rows = rows.select("doc_id", "_row", norm.alias("_norm"))
        values = F.transform("_row", lambda e: e["raw"] / F.col("_norm"))
        joined = dataset.join(rows, "doc_id", "left")
        return joined.withColumns({
            "columns": F.coalesce(F.col("_row.column"), F.array().cast("array<bigint>")), "values": F.coalesce(values, F.array().cast("array<double>")),
        }).drop("_row", "_norm")

    def save(self, path: str) -> None:
        """Two tables below path: the vocabulary, and what else the model knows."""
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        spark = self.vocabulary.sparkSession
        spark.createDataFrame([(self.size, self.stop_words)], "size long, stop_words array<string>").write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextVectorizerModel:
        row = spark.read.parquet(f"{path}/model").first()
        return cls(spark.read.parquet(f"{path}/vocabulary"), row["size"], list(row["stop_words"]))

    def feature_names(self, numeric: list[str] = C.FEATURE_NAMES) -> DataFrame:
        """(column, name) of the whole matrix: the terms, then the numeric features."""
        spark = self.vocabulary.sparkSession
        rest = spark.createDataFrame([(self.size + i, n) for i, n in enumerate(numeric)], "column long, name string")
        return self.vocabulary.select("column", F.col("term").alias("name")).unionByName(rest)


def combine(rows: DataFrame, numeric: list[str], width: int) -> DataFrame:
    """Sparse rows of ``width`` columns with the numeric features behind them; zeros are left out.

    Missing, NaN and infinite features are zeros.
    """
    number = F.array(*[F.struct(F.lit(width + i).cast("long").alias("c"), finite(F.col(n)).alias("v")) for i, n in enumerate(numeric)])
    kept = rows.withColumn("_n", F.filter(number, lambda e: e["v"] != 0))
    return kept.withColumns({
        "columns": F.concat(F.col("columns"), F.col("_n.c")), "values": F.concat(F.col("values"), F.col("_n.v"))}).drop("_n")


def matched(texts: DataFrame, features: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """texts (doc_id, text) with their features and labels; raises if one of the tables has a document that another lacks."""
    parts = [("features", features)] + ([("labels", labels)] if labels is not None else [])
    for name, part in parts:
        both = texts.select("doc_id", F.lit(1).alias("_t")).join(part.select("doc_id", F.lit(1).alias("_p")), "doc_id", "full")
        odd = both.agg(F.count_if(F.col("_t").isNull() | F.col("_p").isNull()).alias("n")).first()["n"]
        if odd:
            raise ValueError(f"texts and {name} must have the same documents; {odd} are in one of them only")
    out = texts
    for _, part in parts:
        out = out.join(part, "doc_id")
    return out


def prepare(
    texts: DataFrame, features: DataFrame, labels: DataFrame | None = None, vectorizer: TextVectorizer | None = None,
) -> tuple[DataFrame, TextVectorizerModel]:
    """Everything that training needs: doc_id, term part (columns, values), all 32 features, label, and the fitted vocabulary.

    ``combine`` puts term part and features into one row.
    """
    rows = matched(texts, features, labels)
    model = (vectorizer or TextVectorizer()).fit(rows)
    return model.transform(rows), model


def coordinates(rows: DataFrame) -> DataFrame:
    """(doc_id, column, value) of sparse rows."""
    return rows.select("doc_id", F.explode(F.arrays_zip("columns", "values")).alias("e")).select("doc_id", F.col("e.columns").alias("column"), F.col("e.values").alias("value"))


def dataset_features(rows: DataFrame, text: Column | None = None) -> DataFrame:
    """rows of a labelled file with the 32 features.

    If the file has all 32 columns they are taken, as numbers; what is no number becomes zero.  Otherwise
    the features are computed from the text alone, and a row whose text is missing gets zeros.
    """
    from inkproof.operators.features import extract_features

    if set(C.FEATURE_NAMES) <= set(rows.columns):
        return rows.withColumns({n: finite(F.col(n).try_cast("double")) for n in C.FEATURE_NAMES})
    text = F.col("text") if text is None else text
    bare = rows.withColumns({
        "text": text, "metadata": F.create_map().cast("map<string,string>"),
        "stats": F.struct(F.lit(None).cast("int").alias("page_count"), F.lit(None).cast("double").alias("ocr_confidence"))})
    found = extract_features(bare).drop("metadata", "stats")
    missing = F.col("text").isNull()
    return found.withColumns({n: F.when(missing, F.lit(0.0)).otherwise(finite(F.col(n))) for n in C.FEATURE_NAMES})
