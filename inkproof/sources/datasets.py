"""Labelled datasets in CSV: lines to rows, columns by their accepted names, labels to classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.operators.learning import normalise_label
from inkproof.sources.files import resolve_column

CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header line; lines that begin with # are comments."""
    return spark.read.options(header=True, comment="#", multiLine=True, **CSV_OPTIONS).csv(path)


def parse_lines(lines: DataFrame, header: list[str], column: str = "line") -> DataFrame:
    """Lines of one record each to string columns; comments and blank lines are left out."""
    line = F.col(column)
    kept = lines.where((F.length(F.trim(line)) > 0) & ~line.startswith("#"))
    schema = ", ".join(f"`{c}` string" for c in header)
    # parsed once: a filter on a field is not pushed below the explode
    return kept.select(F.explode_outer(F.array(F.from_csv(line, F.lit(schema), CSV_OPTIONS))).alias("r")).select("r.*")


def labelled_dataset(rows: DataFrame, text_column: str | None = None, label_column: str | None = None) -> DataFrame:
    """All columns with text and label (0 genuine, 1 fake) under these names; rows of neither class are left out."""
    text = resolve_column(rows.columns, C.TRAIN_TEXT_ALIASES, text_column)
    label = resolve_column(rows.columns, C.TRAIN_LABEL_ALIASES, label_column)
    numeric = dict(rows.dtypes)[label] != "string"
    rest = [c for c in rows.columns if c not in (text, label, "text", "label")]
    out = rows.select(*rest, F.col(text).alias("text"), normalise_label(F.col(label), numeric).alias("label"))
    return out.where(F.col("label").isNotNull())
