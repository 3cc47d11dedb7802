"""The rule book: configured patterns as a table, and their scan over a corpus."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "categories map<string, struct<rules: array<struct<name: string, severity: string, score: double,"
    "threshold: int, patterns: array<string>>>>>"
)


@dataclass(frozen=True)
class ConfiguredRule:
    category: str
    name: str
    severity: str
    score: float
    threshold: int
    patterns: tuple[str, ...]


def default_text() -> str:
    return (Path(__file__).parent.parent / "data" / "rules.json").read_text(encoding="utf-8")


def rules_table(spark: SparkSession, text: str | None = None) -> DataFrame:
    """category, name, severity, score, threshold, patterns: a row for each rule of a book in JSON.

    A text that is no rule book falls back to the one in the package.
    """
    def parsed(book: str) -> DataFrame:
        one = spark.range(1).select(F.from_json(F.lit(book), SCHEMA).alias("b"))
        return one.select(F.explode("b.categories").alias("category", "c")).select("category", F.explode("c.rules").alias("r")).select("category", "r.*")

    return parsed(text) if text and is_rule_book(text) else parsed(default_text())


def is_rule_book(text: str) -> bool:
    try:
        return isinstance(json.loads(text).get("categories"), dict)
    except (ValueError, AttributeError):
        return False


def rules(text: str | None = None) -> list[ConfiguredRule]:
    """The same as a list, for building columns; a book has as many rules as somebody wrote."""
    book = json.loads(text if text and is_rule_book(text) else default_text())
    return [
        ConfiguredRule(category, r["name"], r["severity"], r["score"], r["threshold"], tuple(r["patterns"]))
        for category, c in book["categories"].items() for r in c["rules"]
    ]


def hits(text: Column, rule: ConfiguredRule) -> Column:
    return sum((F.regexp_count(text, F.lit(p)) for p in rule.patterns), F.lit(0))


def scan(docs: DataFrame, book: list[ConfiguredRule]) -> DataFrame:
    """doc_id, category, rule, hits: the rules whose patterns are found as often as their threshold asks for."""
    found = F.array(*[
        F.struct(F.lit(r.category).alias("category"), F.lit(r.name).alias("rule"), hits(F.col("text"), r).alias("hits"), F.lit(r.threshold).alias("threshold"))
        for r in book if r.patterns])
    rows = docs.select("doc_id", F.explode(found).alias("r")).select("doc_id", "r.*")
    return rows.where(F.col("hits") >= F.col("threshold")).drop("threshold")
