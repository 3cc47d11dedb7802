"""Explanations: factor ranking and the summary sentences, all inside the document row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.functions.text import clamp, let, percent_text, value_counts
from inkproof.operators.risk import (
    PREDICTION_TYPE, fake_probability, literal_map, mean, normalised_score, severity_weight,
)
from inkproof.session import per_session


def safe_score(score: Column) -> Column:
    return F.round(clamp(F.coalesce(score, F.lit(0.0)), 0.0, 100.0), 2)


def decision_label(decision: Column) -> Column:
    key = F.lower(decision)
    return F.coalesce(F.try_element_at(literal_map(C.DECISION_LABELS), key), key)


def risk_breakdown(df: DataFrame) -> Column:
    """Pillar scores, weights and counts as one struct."""
    p = F.col("predictions") if "predictions" in df.columns else F.array().cast(PREDICTION_TYPE)
    return F.struct(
        F.round(F.col("risk_score"), 2).alias("risk_score"),
        F.lower("decision").alias("decision"),
        decision_label(F.col("decision")).alias("decision_label"),
        *[safe_score(F.col(name)).alias(name) for _, name, _ in C.PILLARS],
        F.struct(*[F.lit(w).alias(k) for k, w in C.RISK_WEIGHTS.items()]).alias("weights"),
        F.size("markers").alias("marker_count"),
        F.size(p).alias("model_count"),
    )


def fallback_breakdown(score: Column, decision: Column) -> Column:
    """The breakdown used when pillar scores are not available."""
    return F.struct(
        F.round(F.coalesce(score, F.lit(0.0)), 2).alias("risk_score"),
        F.lower(decision).alias("decision"),
        decision_label(decision).alias("decision_label"),
        F.lit(C.NEUTRAL_ML_RISK).alias("ml_risk_score"),
        F.lit(0.0).alias("marker_risk_score"),
        F.lit(0.0).alias("structural_risk_score"),
        F.lit(0.0).alias("consistency_risk_score"),
        F.struct(*[F.lit(w).alias(k) for k, w in C.RISK_WEIGHTS.items()]).alias("weights"),
        F.lit(0).alias("marker_count"),
        F.lit(0).alias("model_count"),
    )


def factor_direction(score: Column, final: Column) -> Column:
    return (
        F.when(score >= C.DIRECTION_HIGH, "increase")
        .when((score <= C.DIRECTION_LOW) & (final >= C.DIRECTION_FINAL), "decrease")
        .otherwise("neutral")
    )


def factor(label: Column, contribution: Column, direction: Column) -> Column:
    return F.struct(
        label.alias("factor"), contribution.alias("contribution"), direction.alias("direction")
    )


def risk_inputs() -> Column:
    return F.struct("risk_score", *[F.col(name) for _, name, _ in C.PILLARS])


def pillar_factors(risk: Column | None = None) -> Column:
    """Four entries: weight times pillar score, and which way it pushes."""

    def entries(r: Column) -> Column:
        return F.array(*[
            factor(
                F.lit(label),
                F.round(C.RISK_WEIGHTS[key] * safe_score(r[name]), 2),
                factor_direction(safe_score(r[name]), r["risk_score"]),
            )
            for label, name, key in C.PILLARS
        ])

    return let(risk_inputs(), entries) if risk is None else entries(risk)


def marker_contribution(m: Column) -> Column:
    return F.round(
        F.least(
            F.lit(100.0),
            100.0 * normalised_score(m["score"]) * severity_weight(m["severity"]) / C.MARKER_WEIGHTED_CAP,
        ),
        2,
    )


def top_markers(markers: Column, limit: int = C.TOP_MARKERS) -> Column:
    """Highest normalised score first, ties in marker order."""
    ranked = F.array_sort(F.transform(
        markers, lambda m, i: F.struct((-normalised_score(m["score"])).alias("k"), i.alias("i"), m.alias("m"))
    ))
    return F.transform(F.slice(ranked, 1, limit), lambda r: r["m"])


def top_factors(markers: Column, risk: Column | None = None) -> Column:
    """Pillars and top markers by absolute contribution; increases win ties."""
    from_markers = F.transform(
        top_markers(markers),
        lambda m: factor(
            F.format_string("Marker: %s (%s)", m["name"], m["category"]),
            marker_contribution(m),
            F.lit("increase"),
        ),
    )
    ranked = F.array_sort(F.transform(
        F.concat(pillar_factors(risk), from_markers),
        lambda f, i: F.struct(
            (-F.abs(f["contribution"])).alias("k"),
            (f["direction"] != "increase").alias("late"),
            i.alias("i"),
            f.alias("f"),
        ),
    ))
    return F.transform(F.slice(ranked, 1, C.TOP_FACTORS), lambda r: r["f"])


def plural(n: Column, many: str, one: str = "") -> Column:
    return F.when(n != 1, F.lit(many)).otherwise(F.lit(one))


def marker_summary(markers: Column) -> Column:
    """Counts per category and severity as a sentence."""

    def listed(counts: Column, key, text) -> Column:
        ranked = F.array_sort(F.transform(
            counts, lambda c: F.struct(key(c).alias("k"), c["first"].alias("i"), c.alias("c"))
        ))
        return F.array_join(F.transform(ranked, lambda r: text(r["c"])), ", ")

    counts = F.struct(
        value_counts(F.transform(
            markers, lambda m: F.lower(F.coalesce(m["category"], F.lit("uncategorised"))))).alias("cats"),
        value_counts(F.transform(
            markers, lambda m: F.lower(F.coalesce(m["severity"], F.lit("low"))))).alias("sevs"),
        F.size(markers).alias("total"),
    )

    def sentence(n: Column) -> Column:
        def has(family: list[str]) -> Column:
            return F.exists(n["cats"], lambda c: c["value"].isin(family))

        notes = F.array_compact(F.array(
            F.when(has(C.DATE_FAMILY), F.lit("date-related")),
            F.when(has(C.NUMERICAL_FAMILY), F.lit("numerical or arithmetic")),
            F.when(has(C.ID_FAMILY), F.lit("reference-number")),
        ))
        cats = listed(n["cats"], lambda c: -c["n"], lambda c: F.format_string("%s (%d)", c["value"], c["n"]))
        sevs = listed(
            n["sevs"], lambda c: -severity_weight(c["value"]),
            lambda c: F.format_string("%d %s", c["n"], c["value"]),
        )
        body = F.concat(
            F.lit("Potential issue detected: A total of "), n["total"].cast("string"),
            F.lit(" potential issue"), plural(n["total"], "s were", " was"),
            F.lit(" detected, across "), F.size(n["cats"]).cast("string"), F.lit(" categor"),
            plural(F.size(n["cats"]), "ies: ", "y: "), cats,
            F.lit(", with a severity breakdown of "), sevs, F.lit("."),
        )
        return F.when(n["total"] == 0, F.lit(C.NO_MARKERS_TEXT)).when(
            F.size(notes) > 0,
            F.concat(body, F.lit(" The reported inconsistencies relate to "),
                     F.array_join(notes, " and "), F.lit(".")),
        ).otherwise(body)

    return let(counts, sentence)


def ml_summary(predictions: Column) -> Column:
    """Consensus wording from the highest, lowest and mean forged probability."""
    used = F.filter(
        F.transform(predictions, lambda p: F.struct(
            fake_probability(p).alias("fake"),
            F.coalesce(F.nullif(p["model_name"], F.lit("")), F.lit("model")).alias("name"),
        )),
        lambda u: u["fake"].isNotNull(),
    )

    def sentence(u: Column) -> Column:
        fakes = F.transform(u, lambda x: x["fake"])
        n, average = F.size(u), mean(fakes)
        high, low = F.array_max(fakes), F.array_min(fakes)
        s = F.when(n == 1, F.lit("s")).otherwise(F.lit(""))
        verb = (
            F.when(
                (high >= 0.6) & (low >= 0.4),
                F.concat(F.when(average >= 0.6, F.lit("strongly lean")).otherwise(F.lit("lean")), s,
                         F.lit(" towards the document being forged")),
            )
            .when(high < 0.4, F.concat(F.lit("lean"), s, F.lit(" towards the document being genuine")))
            .otherwise(F.concat(F.lit("disagree"), s,
                                F.lit(" with one another, so the models themselves are uncertain")))
        )
        return F.when(n == 0, F.lit(C.NO_MODELS_TEXT)).otherwise(F.concat(
            F.lit("Model analysis: "), n.cast("string"), F.lit(" model"), plural(n, "s"), F.lit(" ("),
            F.array_join(F.slice(F.transform(u, lambda x: x["name"]), 1, 3), ", "), F.lit(") "), verb,
            F.lit(" (average forged probability "), percent_text(average), F.lit(")."),
        ))

    return let(used, sentence)


def summary(score: Column, decision: Column, factors: Column, markers_text: Column, ml_text: Column) -> Column:
    pushing = F.slice(
        F.transform(F.filter(factors, lambda f: f["direction"] == "increase"), lambda f: f["factor"]), 1, 3
    )

    def paragraph(names: Column) -> Column:
        middle = (
            F.when(F.size(names) > 0, F.concat(
                F.lit(" The main risk contributors were "), F.array_join(names, ", "), F.lit(".")))
            .when(score < 30, F.lit(
                " No significant risk indicators were detected; the document looks consistent with an original."))
            .otherwise(F.lit(" A balanced combination of signals contributed to this assessment."))
        )
        return F.concat(
            F.format_string("The document received a risk score of %.1f out of 100 and is classified as %s.",
                            score, decision_label(decision)),
            middle,
            F.when(markers_text != C.NO_MARKERS_TEXT, F.concat(F.lit(" "), markers_text)).otherwise(F.lit("")),
            F.when(ml_text != C.NO_MODELS_TEXT, F.concat(F.lit(" "), ml_text)).otherwise(F.lit("")),
        )

    return let(pushing, paragraph)


@per_session
def explanation_column(has_predictions: bool) -> Column:
    """summary, top_factors, marker_summary and ml_summary as one struct."""
    p = F.col("predictions") if has_predictions else F.array().cast(PREDICTION_TYPE)
    inputs = F.struct(
        F.col("markers").alias("m"), risk_inputs().alias("r"), F.col("decision").alias("d")
    )

    def build(i: Column) -> Column:
        parts = F.struct(
            top_factors(i["m"], i["r"]).alias("factors"),
            marker_summary(i["m"]).alias("markers"),
            ml_summary(p).alias("ml"),
        )
        return let(parts, lambda x: F.struct(
            summary(i["r"]["risk_score"], i["d"], x["factors"], x["markers"], x["ml"]).alias("summary"),
            x["factors"].alias("top_factors"),
            x["markers"].alias("marker_summary"),
            x["ml"].alias("ml_summary"),
        ))

    return let(inputs, build)


def explain_documents(df: DataFrame) -> DataFrame:
    """Add ``explanation``: summary, top_factors, risk_breakdown and the two summaries."""
    texts = df.withColumn("_x", explanation_column("predictions" in df.columns))
    return texts.withColumn(
        "explanation",
        F.struct(
            F.col("_x.summary"), F.col("_x.top_factors"), risk_breakdown(df).alias("risk_breakdown"),
            F.col("_x.marker_summary"), F.col("_x.ml_summary"),
        ),
    ).drop("_x")
