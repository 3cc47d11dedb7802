"""Reading the tables, shared scratch folders and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkproof.session import shared_folder

#: White space as the word rules of this subpackage see it; everything else is part of a word.
BLANK = r"[ \t-\r]+"
BLANK_CHARACTERS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}-{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_of(key: Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo: the folds of the labelled rows. Null keys are in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(0))


def labelled(labels: DataFrame, label: str, fold: Column, limit: int) -> DataFrame:
    """(doc_id, label) of about `limit` labelled rows at most, so that they can be broadcast.

    Rows are taken by a hash of the id if there are more. Labels repeated for an id count once (the
    largest); rows without an id or a label are left out.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & fold)
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    rows = known.count()
    if rows > limit:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(limit / rows * (1 << 20)))
    return F.broadcast(known)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    trimmed = F.btrim(text, F.lit(BLANK_CHARACTERS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANK_CHARACTERS))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, BLANK))).otherwise(0).cast("long")
