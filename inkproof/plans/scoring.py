"""The whole per-document job: features, markers, fold-back, type, risk, explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkproof.functions.text import computed_once, is_blank
from inkproof.operators.doctype import classify
from inkproof.operators.explain import explain_documents
from inkproof.operators.features import extract_features
from inkproof.operators.markers import detect_markers
from inkproof.operators.risk import RISK_COLUMNS, Thresholds, fold_back, marker_risk, score_documents


#: The marker families that a computed column depends on; all other columns depend on every family.
READ_FAMILIES = {
    "ml_risk_score": (),
    "structural_risk_score": (),
    "total_inconsistencies": ("numerical", "date"),
    "id_inconsistencies": ("id_reference",),
    "consistency_risk_score": ("numerical", "date", "id_reference"),
}


def read_families(wanted: list[str] | None) -> tuple[str, ...] | None:
    """The marker families that the wanted columns depend on, None for all."""
    if wanted is None or not all(c in READ_FAMILIES for c in wanted):
        return None
    return tuple(sorted({family for c in wanted for family in READ_FAMILIES[c]}))


def assess(
    df: DataFrame, as_of: str | None = None, thresholds: Thresholds = Thresholds(), predictions: DataFrame | None = None,
    wanted: list[str] | None = None,
) -> DataFrame:
    """Markers and risk for a corpus, without the text features the risk does not read.

    Every step is a projection, so the plan has no shuffle of its own unless ``predictions``
    (doc_id, predictions: array of structs) are joined.  Texts without a readable character have
    no marker of their own; leave them out before (``readable``) if they should not be scored.
    ``wanted``: computed columns to keep; only the marker families that they depend on are looked for.  The columns of ``df`` stay outside the part that is
    computed once, so filters on them reach the scan.
    """
    rows = with_predictions(df, predictions)
    if wanted == ["marker_risk_score"]:
        marked = detect_markers(rows, as_of, worded=False)
        return computed_once(marked.withColumn("marker_risk_score", marker_risk(F.col("markers"))), df.columns, wanted)
    worded = wanted is None or not {*wanted} <= {*RISK_COLUMNS, *READ_FAMILIES}
    scored = score_documents(fold_back(detect_markers(rows, as_of, read_families(wanted), worded)), thresholds)
    return computed_once(scored, df.columns, wanted)


def readable(df: DataFrame) -> DataFrame:
    return df.where(~is_blank(F.col("text")))


def with_predictions(df: DataFrame, predictions: DataFrame | None) -> DataFrame:
    if predictions is None:
        return df
    return df.join(predictions.select("doc_id", "predictions"), "doc_id", "left")


def analyse(
    df: DataFrame, as_of: str | None = None, thresholds: Thresholds = Thresholds(),
    filename_col: str | None = "filename", predictions: DataFrame | None = None,
) -> DataFrame:
    """Features, markers, document type, risk and explanation for every document with text."""
    rows = with_predictions(readable(df), predictions)
    marked = fold_back(detect_markers(extract_features(rows), as_of))
    return computed_once(explain_documents(score_documents(classify(marked, filename_col), thresholds)), df.columns)
