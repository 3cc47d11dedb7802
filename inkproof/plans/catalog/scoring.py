"""Document type, risk and explanation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.functions.text import explode_rows
from inkproof.operators import doctype, explain, risk
from inkproof.operators.markers import detect_markers
from inkproof.plans import oracle as O
from inkproof.plans.registry import query, register
from inkproof.plans.scoring import analyse, assess
from inkproof.sources.business import AS_OF, business_documents
from inkproof.sources.tables import table

# --- document type ---------------------------------------------------------------------


def _score_sql(category: str) -> str:
    parts = [
        f"{w} * CASE WHEN {O.count('low', p)} > 0 THEN 1.0 + 0.25 * least({O.count('low', p)} - 1, 3) ELSE 0 END"
        for w, p in C.DOCTYPE_RULES[category]
    ]
    return O.half_up(" + ".join(parts))


_HINT = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(filename), {O.q(w)})" for w in words) + f" THEN {O.q(cat)}"
    for cat, words in C.FILENAME_HINTS
) + " END"
TYPE_CTES = f"""{O.BIZ}, h AS (SELECT *, {_HINT} AS hint FROM biz), s0 AS (
""" + " UNION ALL ".join(
    f"SELECT doc_id, hint, {i} AS ord, {O.q(c)} AS category, {_score_sql(c)} AS base FROM h"
    for i, c in enumerate(C.DOCTYPE_RULES)
) + """), ts AS (SELECT *, base + CASE WHEN category = hint THEN 2.0 ELSE 0 END AS score FROM s0),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, CASE WHEN base = 0 THEN 1 ELSE 0 END, ord) AS rn
FROM ts WHERE score > 0),
typed AS (SELECT h.doc_id, CASE WHEN coalesce(a.score, 0) >= 3 THEN a.category ELSE 'unknown' END AS document_type,
round(coalesce(a.score, 0), 6) AS type_score, round(coalesce(a.score, 0) - coalesce(b.score, 0), 6) AS type_margin
FROM h LEFT JOIN top a ON a.doc_id = h.doc_id AND a.rn = 1 LEFT JOIN top b ON b.doc_id = h.doc_id AND b.rn = 2)"""


@query("t_doctype_scores", f"WITH {TYPE_CTES} SELECT doc_id, category, round(score, 6) AS score FROM ts WHERE score > 0")
def doctype_scores(spark, sf_dir):
    df = business_documents(spark, sf_dir)
    scores = doctype.score_array(F.col("text"), F.col("filename"))
    return explode_rows(df, scores, "doc_id").select(
        "doc_id", "m.category", F.round("m.score", 6).alias("score"))


@query("t_filename_hint", f"WITH {O.BIZ} SELECT doc_id, {_HINT} AS hint FROM biz")
def filename_hint(spark, sf_dir):
    return business_documents(spark, sf_dir).select(
        "doc_id", doctype.filename_hint(F.col("filename")).alias("hint"))


@query("t_doctype", f"WITH {TYPE_CTES} SELECT doc_id, document_type FROM typed")
def doctype_argmax(spark, sf_dir):
    return doctype.classify(business_documents(spark, sf_dir)).select("doc_id", "document_type")


@query("t_doctype_margin", f"WITH {TYPE_CTES} SELECT doc_id, type_score, type_margin FROM typed")
def doctype_margin(spark, sf_dir):
    return doctype.classify(business_documents(spark, sf_dir)).select(
        "doc_id", F.round("type_score", 6).alias("type_score"), F.round("type_margin", 6).alias("type_margin"))


@query("t_doctype_counts", f"WITH {TYPE_CTES} SELECT document_type, count(*) AS n FROM typed GROUP BY 1")
def doctype_counts(spark, sf_dir):
    typed = doctype.classify(business_documents(spark, sf_dir))
    return typed.groupBy("document_type").agg(F.count(F.lit(1)).alias("n"))


# --- predictions derived from the order key -------------------------------------------------

_MODELS = [("logistic_regression", 7), ("random_forest", 11), ("xgboost", 13)]


def predictions(k: Column) -> Column:
    """Three model outputs per document; some lack a side, every tenth document has none."""

    def one(name: str, step: int) -> Column:
        fake = (k * step % 1000) / F.lit(1000.0)
        return F.struct(
            F.lit(name).alias("model_name"),
            F.when(k % 5 != 0, 1 - fake).alias("genuine_probability"),
            F.when(k % 4 != 0, fake).alias("fake_probability"),
        )

    return F.when(k % 10 != 9, F.array(*[one(n, s) for n, s in _MODELS])).otherwise(
        F.array().cast(risk.PREDICTION_TYPE))


PRED = "pred AS (" + " UNION ALL ".join(
    f"SELECT o_orderkey AS doc_id, {i} AS m, '{name}' AS model_name, "
    f"CASE WHEN o_orderkey % 5 <> 0 THEN 1 - (o_orderkey * {step} % 1000) / CAST(1000 AS DOUBLE) END AS g, "
    f"CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey * {step} % 1000) / CAST(1000 AS DOUBLE) END AS f "
    "FROM orders WHERE o_orderkey % 10 <> 9"
    for i, (name, step) in enumerate(_MODELS)) + ")"
FAKE = "coalesce(f, 1 - g)"


def predicted(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return orders.withColumn("predictions", predictions(F.col("doc_id")))


_ML = f"SELECT doc_id, {O.half_up(f'sum({FAKE}) / count({FAKE}) * 100')} AS ml FROM pred GROUP BY 1"


@query("r_ml_risk", f"""WITH {PRED}, a AS ({_ML})
SELECT o_orderkey AS doc_id, coalesce(ml, 50) AS ml_risk_score FROM orders LEFT JOIN a ON doc_id = o_orderkey""")
def ml_risk(spark, sf_dir):
    return predicted(spark, sf_dir).select(
        "doc_id", risk.ml_risk(F.col("predictions")).alias("ml_risk_score"))


def _scored(*columns: str):
    def run(spark, sf_dir):
        return assess(business_documents(spark, sf_dir), AS_OF, wanted=list(columns)).select("doc_id", *columns)

    return run


for _name, _columns in {
    "r_marker_risk": ["marker_risk_score"],
    "r_structural_risk": ["structural_risk_score"],
    "r_consistency_risk": ["consistency_risk_score"],
    "r_risk_score": ["ml_risk_score", "marker_risk_score", "structural_risk_score",
                     "consistency_risk_score", "risk_score"],
    "r_decision": ["decision"],
    "r_confidence": ["confidence"],
}.items():
    register(_name, _scored(*_columns),
             f"WITH {O.scored_ctes()} SELECT doc_id, {', '.join(_columns)} FROM scored")


@query("r_confidence_from_models", f"""WITH {PRED}, a AS (
SELECT doc_id, {O.half_up(f"sum(greatest({FAKE}, coalesce(g, 1 - {FAKE}))) / count(*)", 4)} AS c FROM pred GROUP BY 1)
SELECT doc_id, coalesce(c, 0) AS confidence FROM a""")
def confidence_from_models(spark, sf_dir):
    df = predicted(spark, sf_dir).where(F.size("predictions") > 0)
    no_markers = F.array().cast("array<struct<score:double>>")
    return df.select("doc_id", risk.confidence(F.col("predictions"), no_markers, F.lit(0.0)).alias("confidence"))


@query("r_marker_score_normalise", """
SELECT o_orderkey AS doc_id, round(CASE WHEN r <= 1 THEN greatest(r, 0) ELSE least(r / 100, 1) END, 6) AS normalised
FROM (SELECT o_orderkey, (o_orderkey % 600 - 20) / CAST(4 AS DOUBLE) AS r FROM orders) t""")
def marker_score_normalise(spark, sf_dir):
    raw = (F.col("o_orderkey") % 600 - 20) / F.lit(4.0)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.round(risk.normalised_score(raw), 6).alias("normalised"))


@query("r_probability_normalise", f"""WITH {PRED}, a AS (
SELECT doc_id, model_name, coalesce(g, 0) AS g, coalesce(f, 0) AS f FROM pred), b AS (
SELECT doc_id, model_name, CASE WHEN g = 0 AND f = 0 THEN 0.5 ELSE g END AS g, CASE WHEN g = 0 AND f = 0 THEN 0.5 ELSE f END AS f FROM a)
SELECT doc_id, model_name, round(g, 6) AS genuine_probability,
       round(CASE WHEN abs(g + f - 1) > 0.02 THEN 1 - g ELSE f END, 6) AS fake_probability FROM b""")
def probability_normalise(spark, sf_dir):
    fixed = F.transform("predictions", risk.normalise_prediction)
    return explode_rows(predicted(spark, sf_dir), fixed, "doc_id").select("doc_id", "m.*")


_WORDS = ["original", " Forged ", "GENUINE", "fake", "authentic", "unclear", None, "fraudulent", "suspicious"]


@query("r_decision_normalise", """
SELECT doc_id, CASE WHEN v IN ('original', 'suspicious', 'forged') THEN v
  WHEN v IN ('genuine', 'authentic', 'legitimate') THEN 'original' WHEN v IN ('fake', 'fraudulent', 'forgery') THEN 'forged'
  WHEN s >= 60 THEN 'forged' WHEN s >= 30 THEN 'suspicious' ELSE 'original' END AS decision
FROM (SELECT o_orderkey AS doc_id, o_orderkey % 101 AS s, trim(lower(coalesce(
['original', ' Forged ', 'GENUINE', 'fake', 'authentic', 'unclear', NULL, 'fraudulent', 'suspicious'][o_orderkey % 9 + 1], ''))) AS v FROM orders) t""")
def decision_normalise(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in _WORDS])
    k = F.col("o_orderkey")
    value = F.get(words, (k % len(_WORDS)).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k.alias("doc_id"), risk.normalise_decision(value, (k % 101).cast("double")).alias("decision"))


def _mean_sql(condition: str) -> str:
    """Mean in marker order, so that both engines add in the same sequence."""
    return f"sum(score ORDER BY pos) FILTER ({condition}) / count(*) FILTER ({condition}) * 100"


@query("r_fallback_risk", f"""WITH {O.marker_ctes()}, {PRED},
a AS (SELECT doc_id, {_mean_sql("true")} AS m, {_mean_sql("category = 'structural'")} AS s,
      {_mean_sql("category IN ('textual', 'numerical', 'date', 'id_reference')")} AS c FROM mk GROUP BY 1),
p AS (SELECT doc_id, sum(coalesce(f, 0) ORDER BY m) / count(*) * 100 AS ml FROM pred GROUP BY 1),
r AS (SELECT biz.doc_id, coalesce(ml, 0) AS ml, coalesce(m, 0) AS m, coalesce(s, 0) AS s, coalesce(c, 0) AS c,
      least(100e0, 0.5e0 * coalesce(ml, 0) + 0.35e0 * coalesce(m, 0) + 0.15e0 * coalesce(s, 0)) AS raw
      FROM biz LEFT JOIN a ON a.doc_id = biz.doc_id LEFT JOIN p ON p.doc_id = biz.doc_id)
SELECT *, CASE WHEN risk_score < 30 THEN 'original' WHEN risk_score < 60 THEN 'suspicious' ELSE 'forged' END AS decision,
       {O.half_up("least(1e0, greatest(0.5e0, 1e0 - abs(risk_score - 50e0) / 50e0))")} AS confidence
FROM (SELECT doc_id, {O.half_up("raw")} AS risk_score, {O.half_up("ml")} AS ml_risk_score, {O.half_up("m")} AS marker_risk_score,
       {O.half_up("s")} AS structural_risk_score, {O.half_up("c")} AS consistency_risk_score FROM r) x""")
def fallback_risk(spark, sf_dir):
    df = detect_markers(business_documents(spark, sf_dir), AS_OF, worded=False)
    fallback = risk.fallback_risk(predictions(F.col("doc_id")), F.col("markers"))
    names = ["risk_score", "decision", "confidence", "ml_risk_score", "marker_risk_score", "structural_risk_score", "consistency_risk_score"]
    return df.select("doc_id", fallback.alias("r")).select("doc_id", *[F.col(f"r.{n}") for n in names])


@query("r_consistency_foldback", f"""WITH {O.scored_ctes()}
SELECT doc_id, CAST(total_inconsistencies AS DOUBLE) AS total_inconsistencies,
       CAST(id_inconsistencies AS DOUBLE) AS id_inconsistencies FROM scored""")
def consistency_foldback(spark, sf_dir):
    wanted = ["total_inconsistencies", "id_inconsistencies"]
    return assess(business_documents(spark, sf_dir), AS_OF, wanted=wanted).select("doc_id", *wanted)


@query("r_category_severity_map", f"""WITH {O.marker_ctes()}
SELECT CASE category WHEN 'textual' THEN 'content' WHEN 'numerical' THEN 'inconsistency' WHEN 'date' THEN 'inconsistency'
  WHEN 'id_reference' THEN 'digital' ELSE category END AS category, severity, count(*) AS n FROM mk GROUP BY 1, 2""")
def category_severity_map(spark, sf_dir):
    df = detect_markers(business_documents(spark, sf_dir), AS_OF)
    return (
        explode_rows(df, F.col("markers"))
        .select(risk.display_category(F.col("m.category")).alias("category"),
                risk.display_severity(F.col("m.severity")).alias("severity"))
        .groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))
    )


# --- explanations -------------------------------------------------------------------------


def explained(spark, sf_dir) -> DataFrame:
    scored = assess(business_documents(spark, sf_dir), AS_OF).select(
        "doc_id", "markers", "ml_risk_score", "marker_risk_score", "structural_risk_score",
        "consistency_risk_score", "risk_score", "decision", "confidence")
    return explain.explain_documents(scored)


_LABEL = "CASE decision WHEN 'original' THEN 'original (Likely Genuine)' WHEN 'forged' THEN 'forged (Likely Fake)' ELSE decision END"
_DIRECTION = "CASE WHEN {s} >= 55 THEN 'increase' WHEN {s} <= 25 AND risk_score >= 30 THEN 'decrease' ELSE 'neutral' END"
_PILLARS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS ord, {O.q(label)} AS factor, {O.half_up(f'CAST({C.RISK_WEIGHTS[key]} AS DOUBLE) * {col}')} AS contribution, "
    f"{_DIRECTION.format(s=col)} AS direction FROM scored"
    for i, (label, col, key) in enumerate(C.PILLARS))
_CONTRIB = O.half_up(f"least(100.0, 100.0 * score * ({O.WEIGHT}) / 6.0)")
_TOP = ("tm AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r FROM mk), "
        f"pf AS ({_PILLARS}), fac AS (SELECT * FROM pf UNION ALL SELECT doc_id, 3 + r, 'Marker: ' || name || ' (' || category || ')', "
        f"{_CONTRIB}, 'increase' FROM tm WHERE r <= 3), "
        "tf AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(contribution) DESC, "
        "CASE WHEN direction = 'increase' THEN 0 ELSE 1 END, ord) AS rank FROM fac)")


@query("x_risk_breakdown", f"""WITH {O.scored_ctes()}
SELECT doc_id, risk_score, decision, {_LABEL} AS decision_label, ml_risk_score, marker_risk_score, structural_risk_score,
       consistency_risk_score, 0.4 AS weight_ml, n_markers AS marker_count, 0 AS model_count FROM scored""")
def risk_breakdown(spark, sf_dir):
    df = explained(spark, sf_dir).select("doc_id", "explanation.risk_breakdown.*")
    return df.select(
        "doc_id", "risk_score", "decision", "decision_label", "ml_risk_score", "marker_risk_score",
        "structural_risk_score", "consistency_risk_score", F.col("weights.ml").alias("weight_ml"),
        F.col("marker_count").cast("bigint").alias("marker_count"), "model_count")


@query("x_fallback_breakdown", f"""WITH {O.scored_ctes()}
SELECT doc_id, risk_score, {_LABEL} AS decision_label, CAST(50 AS DOUBLE) AS ml_risk_score, 0 AS marker_count FROM scored""")
def fallback_breakdown(spark, sf_dir):
    scored = assess(business_documents(spark, sf_dir), AS_OF)
    return scored.select(
        "doc_id", explain.fallback_breakdown(F.col("risk_score"), F.col("decision")).alias("b")).select(
        "doc_id", "b.risk_score", "b.decision_label", "b.ml_risk_score", "b.marker_count")


@query("x_pillar_factors", f"WITH {O.scored_ctes()}, pf AS ({_PILLARS}) SELECT doc_id, factor, contribution, direction FROM pf")
def pillar_factors(spark, sf_dir):
    scored = assess(business_documents(spark, sf_dir), AS_OF)
    return explode_rows(scored, explain.pillar_factors(), "doc_id").select("doc_id", "m.*")


@query("x_factor_direction", f"""WITH {O.scored_ctes()}, pf AS ({_PILLARS})
SELECT factor, direction, count(*) AS n FROM pf GROUP BY 1, 2""")
def factor_direction(spark, sf_dir):
    scored = assess(business_documents(spark, sf_dir), AS_OF)
    return (
        explode_rows(scored, explain.pillar_factors())
        .groupBy(F.col("m.factor").alias("factor"), F.col("m.direction").alias("direction"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("x_top_markers", f"WITH {O.scored_ctes()}, {_TOP} SELECT doc_id, r AS rank, name, round(score, 6) AS score FROM tm WHERE r <= 3")
def top_markers(spark, sf_dir):
    df = detect_markers(business_documents(spark, sf_dir), AS_OF)
    best = explain.top_markers(F.col("markers"))
    return explode_rows(df, best, "doc_id").select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "m.name", F.round("m.score", 6).alias("score"))


@query("x_marker_contribution", f"WITH {O.marker_ctes()} SELECT doc_id, pos, name, {_CONTRIB} AS contribution FROM mk")
def marker_contribution(spark, sf_dir):
    df = detect_markers(business_documents(spark, sf_dir), AS_OF)
    return explode_rows(df, F.col("markers"), "doc_id").select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "m.name",
        explain.marker_contribution(F.col("m")).alias("contribution"))


@query("x_top_factors", f"WITH {O.scored_ctes()}, {_TOP} SELECT doc_id, rank, factor, contribution, direction FROM tf WHERE rank <= 7")
def top_factors(spark, sf_dir):
    df = explained(spark, sf_dir)
    return explode_rows(df, F.col("explanation.top_factors"), "doc_id").select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "m.*")


_MS = f"""cc AS (SELECT doc_id, category, count(*) AS n, min(pos) AS p FROM mk GROUP BY 1, 2),
sc AS (SELECT doc_id, severity, count(*) AS n, {O.SEVERITY_RANK} AS sr FROM mk GROUP BY 1, 2),
ct AS (SELECT doc_id, sum(n) AS total, count(*) AS cats, string_agg(category || ' (' || n || ')', ', ' ORDER BY n DESC, p) AS txt,
       concat_ws(' and ', CASE WHEN bool_or(category = 'date') THEN 'date-related' END,
                 CASE WHEN bool_or(category = 'numerical') THEN 'numerical or arithmetic' END,
                 CASE WHEN bool_or(category = 'id_reference') THEN 'reference-number' END) AS notes FROM cc GROUP BY 1),
st AS (SELECT doc_id, string_agg(n || ' ' || severity, ', ' ORDER BY sr) AS txt FROM sc GROUP BY 1),
ms AS (SELECT biz.doc_id, CASE WHEN total IS NULL THEN {O.q(C.NO_MARKERS_TEXT)} ELSE
  'Potential issue detected: A total of ' || total || ' potential issue' || CASE WHEN total = 1 THEN ' was' ELSE 's were' END ||
  ' detected, across ' || cats || ' categor' || CASE WHEN cats = 1 THEN 'y: ' ELSE 'ies: ' END || ct.txt ||
  ', with a severity breakdown of ' || st.txt || '.' ||
  CASE WHEN notes <> '' THEN ' The reported inconsistencies relate to ' || notes || '.' ELSE '' END END AS marker_summary
FROM biz LEFT JOIN ct ON ct.doc_id = biz.doc_id LEFT JOIN st ON st.doc_id = biz.doc_id)"""


@query("x_marker_summary", f"WITH {O.marker_ctes()}, {_MS} SELECT doc_id, marker_summary FROM ms")
def marker_summary(spark, sf_dir):
    df = detect_markers(business_documents(spark, sf_dir), AS_OF)
    return df.select("doc_id", explain.marker_summary(F.col("markers")).alias("marker_summary"))


@query("x_ml_summary", f"""WITH {PRED}, a AS (
SELECT doc_id, max({FAKE}) AS hi, min({FAKE}) AS lo, avg({FAKE}) AS av FROM pred GROUP BY 1)
SELECT o_orderkey AS doc_id, CASE WHEN hi IS NULL THEN {O.q(C.NO_MODELS_TEXT)} ELSE
  'Model analysis: 3 models (logistic_regression, random_forest, xgboost) ' ||
  CASE WHEN hi >= 0.6 AND lo >= 0.4 THEN CASE WHEN av >= 0.6 THEN 'strongly lean' ELSE 'lean' END || ' towards the document being forged'
       WHEN hi < 0.4 THEN 'lean towards the document being genuine'
       ELSE 'disagree with one another, so the models themselves are uncertain' END END AS verdict
FROM orders LEFT JOIN a ON doc_id = o_orderkey""")
def ml_summary(spark, sf_dir):
    """Consensus sentence without its closing average, whose last digit is a rounding matter."""
    text = explain.ml_summary(F.col("predictions"))
    return predicted(spark, sf_dir).select(
        "doc_id", F.regexp_replace(text, r" \(average forged probability [^)]*\)\.$", "").alias("verdict"))


@query("x_summary", f"""WITH {O.scored_ctes()}, {_TOP}, {_MS},
inc AS (SELECT doc_id, string_agg(factor, ', ' ORDER BY rank) AS names FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS k FROM tf WHERE rank <= 7 AND direction = 'increase') t
  WHERE k <= 3 GROUP BY 1)
SELECT scored.doc_id, 'classified as ' || {_LABEL} || '.' || CASE WHEN names IS NOT NULL THEN ' The main risk contributors were ' || names || '.'
  WHEN risk_score < 30 THEN ' No significant risk indicators were detected; the document looks consistent with an original.'
  ELSE ' A balanced combination of signals contributed to this assessment.' END ||
  CASE WHEN marker_summary <> {O.q(C.NO_MARKERS_TEXT)} THEN ' ' || marker_summary ELSE '' END AS summary
FROM scored JOIN ms ON ms.doc_id = scored.doc_id LEFT JOIN inc ON inc.doc_id = scored.doc_id""")
def summary(spark, sf_dir):
    """The explanation paragraph from the classification on."""
    df = explained(spark, sf_dir)
    return df.select("doc_id", F.regexp_replace(
        "explanation.summary", r"^The document received a risk score of [\d.]+ out of 100 and is ", "").alias("summary"))


@query("flagship_forged_by_type", f"""WITH {TYPE_CTES}, {O.scored_ctes().replace(O.BIZ + ',', '', 1)}
SELECT document_type, decision, count(*) AS documents, round(avg(risk_score), 4) AS avg_risk
FROM typed JOIN scored ON scored.doc_id = typed.doc_id GROUP BY 1, 2""")
def forged_by_type(spark, sf_dir):
    scored = doctype.classify(assess(business_documents(spark, sf_dir), AS_OF, wanted=["decision", "risk_score"]))
    return scored.groupBy("document_type", "decision").agg(
        F.count(F.lit(1)).alias("documents"), F.round(F.avg("risk_score"), 4).alias("avg_risk"))


@query("full_analysis")
def full_analysis(spark, sf_dir):
    """Features, markers, type, risk and explanation of every rendered document."""
    df = analyse(business_documents(spark, sf_dir), AS_OF)
    return df.select("doc_id", "document_type", *C.FEATURE_NAMES, "risk_score", "decision", "confidence",
                     F.size("markers").alias("marker_count"), "explanation.summary")
