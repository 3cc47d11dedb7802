"""Forgery-marker rules: every rule is a column of type ``array<marker struct>``.

A rule never leaves its row, so detecting all markers of a corpus is one projection
without a shuffle, whatever the size of a document or the number of its copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.functions.text import explode_rows, is_ascii, let
from inkproof.operators.features import stat, stats_fields
from inkproof.operators.markers import batch
from inkproof.operators.markers.base import MARKER_TYPE, none, wordless_markers
from inkproof.operators.markers.dates import dates_rules
from inkproof.operators.markers.ids import ids_rules
from inkproof.operators.markers.metadata import metadata_rules
from inkproof.operators.markers.numerical import numerical_rules
from inkproof.operators.markers.structural import structural_rules
from inkproof.operators.markers.textual import textual_rules
from inkproof.operators.markers.visual import visual_rules
from inkproof.session import per_session

SEVERITY_ORDER = ("high", "medium", "low")


def by_severity(markers: Column) -> Column:
    """Stable order: high, medium, low; rule order inside a severity."""

    def only(all_: Column, severity: str) -> Column:
        return F.filter(all_, lambda m: m["severity"] == severity)

    return let(markers, lambda all_: F.concat(*[only(all_, s) for s in SEVERITY_ORDER]))


def int_stat(fields: tuple[str, ...], name: str) -> Column:
    return F.col("stats")[name].cast("int") if name in fields else F.lit(None).cast("int")


@per_session
def family_columns(fields: tuple[str, ...], as_of: str | None = None, worded: bool = True) -> dict[str, Column]:
    """The seven rule families in the order they are reported.

    Building a few thousand column nodes costs more than planning them, so they are kept.
    """
    if not worded:
        with wordless_markers():
            return rule_families(fields, as_of)
    return rule_families(fields, as_of)


def today(as_of: str | None) -> Column:
    return F.lit(as_of).cast("date") if as_of else F.current_date()


def rule_families(fields: tuple[str, ...], as_of: str | None) -> dict[str, Column]:
    text, metadata = F.col("text"), F.col("metadata")
    return {
        "textual": textual_rules(text),
        "numerical": numerical_rules(text),
        "date": dates_rules(text, today(as_of)),
        "id_reference": ids_rules(text),
        "structural": structural_rules(text, int_stat(fields, "page_count")),
        "metadata": metadata_rules(metadata),
        "visual": visual_rules(
            stat(fields, "suspicious_region_count", 0), int_stat(fields, "width"),
            int_stat(fields, "height"), stat(fields, "ocr_confidence", 1),
        ),
    }


@per_session
def batched_markers(fields: tuple[str, ...], as_of: str | None, families: tuple[str, ...], worded: bool) -> Column:
    """The markers of these families in ASCII texts, found for a batch of texts at once; NULL where the columns decide."""
    found = F.arrow_udf(batch.marker_lists(families, worded), MARKER_TYPE)
    return found(F.when(is_ascii(F.col("text")), F.col("text")), int_stat(fields, "page_count"), F.year(today(as_of)))


def detect_markers(df: DataFrame, as_of: str | None = None, only: tuple[str, ...] | None = None, worded: bool = True) -> DataFrame:
    """Add ``markers``: every marker of the document, most severe first.

    ``only``: the families to look for; a family's name is the category of all its markers.  Without
    ``worded`` descriptions and evidence are NULL, for scores that do not read them.  ASCII texts are searched in
    batches (:mod:`.batch`), all others by the columns.
    """
    fields = stats_fields(df)
    families = family_columns(fields, as_of, worded)
    families = {name: column for name, column in families.items() if only is None or name in only}
    if not families:
        return df.withColumn("markers", none())
    parts = {f"_{name}": column for name, column in families.items() if name not in batch.FAMILIES}
    if read := tuple(name for name in families if name in batch.FAMILIES):
        by_column = F.concat(*[families[name] for name in read])
        parts = {"_text": F.coalesce(batched_markers(fields, as_of, read, worded), by_column), **parts}
    staged = df.withColumns(parts)
    merged = staged.withColumn("markers", by_severity(F.concat(*[F.col(name) for name in parts])))
    return merged.drop(*parts)


def marker_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Long marker table with the marker's position in its document."""
    return explode_rows(df, F.col("markers"), *keys).select(*keys, "pos", "m.*")
