"""Risk pillars, blended score, decision and confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.functions.text import clamp, let
from inkproof.session import per_session

PREDICTION_TYPE = (
    "array<struct<model_name:string,genuine_probability:double,fake_probability:double>>"
)


@dataclass(frozen=True)
class Thresholds:
    medium: float = 30.0
    high: float = 60.0


def mean(values: Column) -> Column:
    """Average of an array, NULL when empty."""
    return F.when(
        F.size(values) > 0,
        F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values),
    )


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


# --- pillars -------------------------------------------------------------------------


def probability(value: Column) -> Column:
    """Clamped to [0, 1]; NULL stays NULL, which least/greatest alone would not keep."""
    return F.when(value.isNotNull(), clamp(value, 0.0, 1.0))


def fake_probability(p: Column) -> Column:
    """Probability of forgery, inferred from the genuine one when missing."""
    return F.coalesce(probability(p["fake_probability"]), 1.0 - probability(p["genuine_probability"]))


def fake_probabilities(predictions: Column) -> Column:
    return F.filter(F.transform(predictions, fake_probability), lambda v: v.isNotNull())


def ml_risk(predictions: Column) -> Column:
    return let(
        fake_probabilities(predictions),
        lambda f: F.coalesce(F.round(mean(f) * 100, 2), F.lit(C.NEUTRAL_ML_RISK)),
    )


def normalised_score(score: Column) -> Column:
    """Rule scores come in [0, 1], stored ones in [0, 100]."""
    value = F.coalesce(score.cast("double"), F.lit(0.0))
    return clamp(F.when(value <= 1, value).otherwise(value / 100), 0.0, 1.0)


def severity_weight(severity: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(severity, F.lit("low"))))
    weight = F.lit(C.SEVERITY_WEIGHTS["low"])
    for key in ("medium", "high", "critical"):
        weight = F.when(name == key, F.lit(C.SEVERITY_WEIGHTS[key])).otherwise(weight)
    return weight


def marker_risk(markers: Column) -> Column:
    total = F.aggregate(
        markers,
        F.lit(0.0),
        lambda acc, m: acc + normalised_score(m["score"]) * severity_weight(m["severity"]),
    )
    return F.round(F.least(F.lit(100.0), 100.0 * total / C.MARKER_WEIGHTED_CAP), 2)


def structural_risk(s: dict[str, Column]) -> Column:
    """Blend of layout (40 %), scan (30 %), page (20 %) and table (10 %) sub-scores."""
    font = clamp(s["font_size_variance"] / 5.0, 0.0, 1.0)
    align = clamp(s["alignment_variance"] / 3.0, 0.0, 1.0)
    layout = 100.0 * (0.6 * font + 0.4 * align)
    penalty = (1.0 - clamp(s["ocr_confidence"], 0.0, 1.0)) * 100.0
    bump = F.least(F.lit(40.0), s["ocr_pages"] * 8.0 + s["image_only_pages"] * 10.0)
    scan = F.when(s["ocr_used"], F.least(F.lit(100.0), penalty + bump)).otherwise(F.lit(0.0))
    pages = F.floor(s["page_count"])
    length = F.when(pages <= 0, 60.0).when(pages >= 40, 30.0).otherwise(0.0)
    blank = F.when(
        (s["blank_page_count"] >= 1) & (pages > 0),
        F.least(F.lit(100.0), 300.0 * F.floor(s["blank_page_count"]) / F.nullif(pages, F.lit(0))),
    ).otherwise(F.lit(0.0))
    tables = (
        F.when(s["table_count"] >= 20, 35.0).when(s["table_count"] >= 8, 20.0)
        .when(s["table_count"] >= 3, 10.0).otherwise(0.0)
    )
    blend = 0.4 * layout + 0.3 * scan + 0.2 * F.greatest(length, blank) + 0.1 * tables
    return F.round(clamp(blend, 0.0, 100.0), 2)


def family_count(markers: Column, family: list[str]) -> Column:
    return F.size(F.filter(
        markers, lambda m: F.lower(F.trim(F.coalesce(m["category"], F.lit("")))).isin(family)
    ))


def consistency_risk(markers: Column, explicit_total: Column, explicit_ids: Column) -> Column:
    counts = F.struct(
        family_count(markers, C.DATE_FAMILY).alias("date"),
        family_count(markers, C.NUMERICAL_FAMILY).alias("num"),
        family_count(markers, C.ID_FAMILY).alias("id"),
    )

    def blend(n: Column) -> Column:
        date = F.least(F.lit(100.0), n["date"] * 30.0)
        numerical = F.least(F.lit(100.0), n["num"] * 25.0)
        identity = F.least(
            F.lit(100.0), (n["id"] + F.greatest(F.floor(explicit_ids), F.lit(0))) * 20.0
        )
        uncovered = F.greatest(F.floor(explicit_total) - (n["date"] + n["num"]), F.lit(0))
        bump = F.least(F.lit(40.0), uncovered * 10.0)
        return F.round(
            clamp(0.40 * date + 0.35 * numerical + 0.25 * identity + bump, 0.0, 100.0), 2
        )

    return let(counts, blend)


# --- score, decision, confidence -------------------------------------------------------


def risk_score(ml: Column, marker: Column, structural: Column, consistency: Column) -> Column:
    w = C.RISK_WEIGHTS
    return F.round(
        clamp(
            w["ml"] * ml + w["marker"] * marker + w["structural"] * structural
            + w["consistency"] * consistency,
            0.0, 100.0,
        ),
        2,
    )


def decision(score: Column, thresholds: Thresholds = Thresholds()) -> Column:
    return (
        F.when(score < thresholds.medium, "original")
        .when(score < thresholds.high, "suspicious")
        .otherwise("forged")
    )


def confidence(predictions: Column, markers: Column, marker_score: Column) -> Column:
    """Mean peak probability; without predictions, distance of the marker pillar from 50."""

    def peak(p: Column) -> Column:
        fake = fake_probability(p)
        return F.greatest(fake, F.coalesce(probability(p["genuine_probability"]), 1.0 - fake))

    evidence = F.least(F.lit(1.0), F.size(markers) / 4.0)
    distance = F.abs(marker_score - 50.0) / 50.0
    peaks = F.filter(F.transform(predictions, peak), lambda v: v.isNotNull())
    return let(
        peaks,
        lambda c: F.round(clamp(F.coalesce(mean(c), distance * evidence), 0.0, 1.0), 4),
    )


def normalise_prediction(p: Column) -> Column:
    """Clamp, replace a missing pair by one half each, force a sum of about one."""
    genuine = F.coalesce(clamp(p["genuine_probability"], 0.0, 1.0), F.lit(0.0))
    fake = F.coalesce(clamp(p["fake_probability"], 0.0, 1.0), F.lit(0.0))
    neither = (genuine == 0) & (fake == 0)
    g, f = (F.when(neither, F.lit(0.5)).otherwise(x) for x in (genuine, fake))
    forced = F.when(F.abs(g + f - 1.0) > 0.02, 1.0 - g).otherwise(f)
    return F.struct(
        F.coalesce(p["model_name"], F.lit("unknown")).alias("model_name"),
        F.round(g, 6).alias("genuine_probability"),
        F.round(forced, 6).alias("fake_probability"),
    )


def normalise_decision(value: Column, score: Column, thresholds: Thresholds = Thresholds()) -> Column:
    raw = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    known = F.when(raw.isin("original", "suspicious", "forged"), raw)
    alias = F.try_element_at(literal_map(C.DECISION_ALIASES), raw)
    return F.coalesce(known, alias, decision(F.coalesce(clamp(score, 0.0, 100.0), F.lit(0.0)), thresholds))


def display_category(category: Column) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(C.DISPLAY_CATEGORIES), F.lower(F.trim(category))), F.lit("other")
    )


def display_severity(severity: Column) -> Column:
    name = F.lower(F.trim(severity))
    return F.when(name.isin(list(C.SEVERITY_WEIGHTS)), name).otherwise(F.lit("medium"))


def fallback_risk(predictions: Column, markers: Column) -> Column:
    """The simple estimate: half model risk, 35 % mean marker, 15 % mean structural marker."""

    def mean_score(kept: Column) -> Column:
        return F.coalesce(mean(F.transform(kept, lambda m: clamp(m["score"], 0.0, 1.0))) * 100, F.lit(0.0))

    parts = F.struct(
        F.coalesce(
            mean(F.transform(predictions, lambda p: F.coalesce(clamp(p["fake_probability"], 0.0, 1.0), F.lit(0.0)))) * 100,
            F.lit(0.0),
        ).alias("ml"),
        mean_score(markers).alias("marker"),
        mean_score(F.filter(markers, lambda m: m["category"] == "structural")).alias("structural"),
        mean_score(F.filter(
            markers, lambda m: m["category"].isin("textual", "numerical", "date", "id_reference")
        )).alias("consistency"),
    )

    def result(p: Column) -> Column:
        score = F.round(F.least(F.lit(100.0), 0.5 * p["ml"] + 0.35 * p["marker"] + 0.15 * p["structural"]), 2)
        return F.struct(
            score.alias("risk_score"),
            decision(score).alias("decision"),
            F.round(clamp(1.0 - F.abs(score - 50.0) / 50.0, 0.5, 1.0), 2).alias("confidence"),
            F.round(p["ml"], 2).alias("ml_risk_score"),
            F.round(p["marker"], 2).alias("marker_risk_score"),
            F.round(p["structural"], 2).alias("structural_risk_score"),
            F.round(p["consistency"], 2).alias("consistency_risk_score"),
        )

    return let(parts, result)


# --- whole-corpus steps -----------------------------------------------------------------


def fold_back(df: DataFrame) -> DataFrame:
    """Set the two inconsistency features from the detected markers."""
    m = F.col("markers")
    both = C.DATE_FAMILY + C.FOLDBACK_NUMERICAL_FAMILY
    return df.withColumns({
        "total_inconsistencies": family_count(m, both).cast("double"),
        "id_inconsistencies": family_count(m, C.ID_FAMILY).cast("double"),
    })


def structure_inputs(fields: tuple[str, ...], columns: frozenset[str]) -> dict[str, Column]:
    """Feature column first, then the statistic, then the default."""
    from inkproof.operators.features import stat

    def value(name: str, default: float) -> Column:
        return F.col(name) if name in columns else stat(fields, name, default)

    used = F.coalesce(F.col("stats")["ocr_used"], F.lit(False)) if "ocr_used" in fields else F.lit(False)
    return {
        "page_count": value("page_count", 1),
        "blank_page_count": value("blank_page_count", 0),
        "table_count": value("table_count", 0),
        "font_size_variance": value("font_size_variance", 0),
        "alignment_variance": value("alignment_variance", 0),
        "ocr_confidence": value("ocr_confidence", 1),
        "ocr_pages": value("ocr_pages", 0),
        "image_only_pages": value("image_only_pages", 0),
        "ocr_used": used,
    }


RISK_COLUMNS = (
    "ml_risk_score", "marker_risk_score", "structural_risk_score", "consistency_risk_score",
    "risk_score", "decision", "confidence",
)


@per_session
def risk_column(fields: tuple[str, ...], columns: frozenset[str], thresholds: Thresholds) -> Column:
    """All risk outputs as one struct; marker and prediction arrays are bound once."""
    p = F.col("predictions") if "predictions" in columns else F.array().cast(PREDICTION_TYPE)
    totals = F.col("total_inconsistencies") if "total_inconsistencies" in columns else F.lit(0.0)
    ids = F.col("id_inconsistencies") if "id_inconsistencies" in columns else F.lit(0.0)

    def blended(i: Column) -> Column:
        return let(
            F.struct(
                ml_risk(i["p"]).alias("ml"),
                marker_risk(i["m"]).alias("marker"),
                structural_risk(structure_inputs(fields, columns)).alias("structural"),
                consistency_risk(i["m"], totals, ids).alias("consistency"),
            ),
            lambda r: let(
                risk_score(r["ml"], r["marker"], r["structural"], r["consistency"]),
                lambda score: F.struct(
                    r["ml"].alias("ml_risk_score"),
                    r["marker"].alias("marker_risk_score"),
                    r["structural"].alias("structural_risk_score"),
                    r["consistency"].alias("consistency_risk_score"),
                    score.alias("risk_score"),
                    decision(score, thresholds).alias("decision"),
                    confidence(i["p"], i["m"], r["marker"]).alias("confidence"),
                ),
            ),
        )

    return let(F.struct(F.col("markers").alias("m"), p.alias("p")), blended)


def score_documents(df: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Add the four pillars, risk score, decision and confidence.

    Needs ``markers`` and ``stats``; ``predictions`` and the folded-back features are used
    when present.
    """
    from inkproof.operators.features import stats_fields

    scored = df.withColumn("_risk", risk_column(stats_fields(df), frozenset(df.columns), thresholds))
    return scored.withColumns({n: F.col(f"_risk.{n}") for n in RISK_COLUMNS}).drop("_risk")
