"""Stored tables, registration, reports, the rule book and labelled datasets as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.operators import learning as L
from inkproof.operators import sinks as K
from inkproof.operators.doctype import classify
from inkproof.operators.explain import marker_summary
from inkproof.operators.features import word_count
from inkproof.operators.markers import detect_markers
from inkproof.operators.risk import normalise_prediction
from inkproof.plans import oracle as O
from inkproof.plans.catalog.features import WORD_N
from inkproof.plans.catalog.learning import _M, PRED as SCORED, _AUC, _COLS, all_metrics, scored_labels
from inkproof.plans.catalog.scoring import _ML, _MS, FAKE, PRED, TYPE_CTES, predictions
from inkproof.plans.catalog.warehouse import AN, MT, RISK, by_score, documents, runs
from inkproof.plans.registry import query
from inkproof.plans.scoring import assess
from inkproof.plans.stored import stored
from inkproof.session import materialised, shared_folder
from inkproof.sources import datasets, files, rulebook
from inkproof.sources.business import AS_OF, business_documents
from inkproof.sources.tables import table


def modelled(spark, sf_dir, *wanted: str):
    """Analyses of the rendered documents with three model predictions derived from their keys."""
    docs = business_documents(spark, sf_dir)
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), predictions(F.col("o_orderkey")).alias("predictions"))
    wanted = wanted or ("markers", "predictions", *RISK)
    return runs(assess(docs, AS_OF, predictions=found, wanted=list(wanted)), *wanted)


_CONFIDENCE = O.half_up(f"sum(greatest({FAKE}, coalesce(g, 1 - {FAKE}))) / count(*)", 4)
_MODELLED = f"""WITH {O.scored_ctes()}, {PRED}, mlr AS ({_ML}), conf AS (SELECT doc_id, {_CONFIDENCE} AS c FROM pred GROUP BY 1),
blend AS (SELECT scored.* EXCLUDE (ml_risk_score, risk_score, decision, confidence), coalesce(ml, 50) AS ml_risk_score, coalesce(c, confidence) AS confidence FROM scored
LEFT JOIN mlr ON mlr.doc_id = scored.doc_id LEFT JOIN conf ON conf.doc_id = scored.doc_id),
modelled AS (SELECT *, CASE WHEN risk_score < 30 THEN 'original' WHEN risk_score < 60 THEN 'suspicious' ELSE 'forged' END AS decision FROM (SELECT *, {O.half_up(
    "CAST(0.4 AS DOUBLE) * ml_risk_score + CAST(0.25 AS DOUBLE) * marker_risk_score + CAST(0.2 AS DOUBLE) * structural_risk_score + CAST(0.15 AS DOUBLE) * consistency_risk_score")} AS risk_score FROM blend) b),
{AN.replace('FROM scored', 'FROM modelled')}, {MT}"""


def results(spark, sf_dir):
    """The stored analyses with model predictions."""
    return stored(spark, sf_dir, "modelled", lambda: documents(spark, sf_dir), lambda: modelled(spark, sf_dir))


@query("r_risk_score_with_models", _MODELLED + " SELECT analysis_id, document_id AS doc_id, ml_risk_score, risk_score, decision, confidence FROM an")
def risk_with_models(spark, sf_dir):
    """The models' predictions weigh in the score, the decision and the confidence."""
    rows = modelled(spark, sf_dir, "ml_risk_score", "risk_score", "decision", "confidence")
    return rows.select("analysis_id", F.col("document_id").alias("doc_id"), "ml_risk_score", "risk_score", "decision", "confidence")


@query("snk_analyses", f"{_MODELLED} SELECT analysis_id, document_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, {', '.join(RISK)} FROM an")
def stored_analyses(spark, sf_dir):
    return results(spark, sf_dir).read("analyses").select("analysis_id", "document_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), *RISK)


@query("snk_markers", f"{_MODELLED} SELECT analysis_id, pos, category, name, severity, score FROM mt")
def stored_markers(spark, sf_dir):
    return results(spark, sf_dir).read("markers").select("analysis_id", F.col("pos").cast("bigint").alias("pos"), "category", "name", "severity", "score")


_NORMAL = """SELECT doc_id, model_name, CASE WHEN g = 0 AND f = 0 THEN 0.5 ELSE g END AS g, CASE WHEN g = 0 AND f = 0 THEN 0.5 ELSE f END AS f
FROM (SELECT doc_id, model_name, coalesce(g, 0) AS g, coalesce(f, 0) AS f FROM pred) z"""


@query("snk_model_predictions", f"""WITH {O.BIZ}, {PRED}, n AS ({_NORMAL})
SELECT n.doc_id * 2 + v AS analysis_id, model_name, round(g, 6) AS genuine_probability, round(CASE WHEN abs(g + f - 1) > 0.02 THEN 1 - g ELSE f END, 6) AS fake_probability
FROM n JOIN biz ON biz.doc_id = n.doc_id, (VALUES (0), (1)) r(v) WHERE v = 0 OR n.doc_id % 10 = 0""")
def stored_predictions(spark, sf_dir):
    return results(spark, sf_dir).read("model_predictions").drop("bucket")


@query("w_analysis_result_nested", f"""{_MODELLED}, n AS ({_NORMAL}), m AS (SELECT analysis_id, string_agg(name || ':' || severity || ':' || CAST(CAST(score AS DECIMAL(9,2)) AS VARCHAR), ';'
ORDER BY score DESC, pos) AS markers FROM mt GROUP BY 1), p AS (SELECT doc_id, string_agg(model_name || ':' || printf('%.4f', g) || ':' || printf('%.4f', CASE WHEN abs(g + f - 1) > 0.02 THEN 1 - g ELSE f END), ';'
ORDER BY model_name) AS predictions FROM n GROUP BY 1) SELECT an.analysis_id, an.document_id, risk_score, decision, confidence, coalesce(markers, '') AS markers, coalesce(predictions, '') AS predictions
FROM an LEFT JOIN m ON m.analysis_id = an.analysis_id LEFT JOIN p ON p.doc_id = an.document_id""")
def analysis_result_nested(spark, sf_dir):
    """Each stored result with all its markers, highest score first, and its models' predictions."""
    marks = F.transform(by_score("markers"), lambda r: F.concat_ws(":", r["name"], r["severity"], (-r["k"]).cast("decimal(9,2)").cast("string")))
    fixed = F.array_sort(F.transform("predictions", normalise_prediction))
    models = F.transform(fixed, lambda p: F.concat_ws(":", p["model_name"], F.format_string("%.4f", p["genuine_probability"]), F.format_string("%.4f", p["fake_probability"])))
    return results(spark, sf_dir).read("analyses").select(
        "analysis_id", "document_id", "risk_score", "decision", "confidence", F.array_join(marks, ";").alias("markers"), F.array_join(models, ";").alias("predictions"))


_PILLAR_ROWS = [("Overall risk score", "risk_score"), ("Machine Learning Risk", "ml_risk_score"), ("Marker Risk", "marker_risk_score"),
                ("Structural Risk", "structural_risk_score"), ("Consistency Risk", "consistency_risk_score")]
_DOCUMENT_ROWS = [("Analysis ID", "analysis_id"), ("Document ID", "document_id"), ("Filename", "original_filename"), ("File Type", "file_type")]
_SHOWN = ("CASE category WHEN 'textual' THEN 'Content' WHEN 'numerical' THEN 'Inconsistency' WHEN 'date' THEN 'Inconsistency' WHEN 'id_reference' THEN 'Digital' "
          "ELSE upper(category[1]) || category[2:] END || ', ' || upper(severity[1]) || severity[2:]")


@query("snk_report_dataset", f"{_MODELLED}, n AS ({_NORMAL}) " + " UNION ALL ".join(
    [f"SELECT analysis_id, 'document' AS section, {i} AS ord, '{label}' AS label, CAST({c} AS VARCHAR) AS value, '' AS detail FROM an" for i, (label, c) in enumerate(_DOCUMENT_ROWS)]
    + [f"SELECT analysis_id, 'risk', {i}, '{label}', printf('%.2f', {c}), '' FROM an" for i, (label, c) in enumerate(_PILLAR_ROWS)]
    + ["SELECT analysis_id, 'risk', 5, 'Decision', decision, '' FROM an",
       "SELECT analysis_id, 'predictions', CASE model_name WHEN 'logistic_regression' THEN 0 WHEN 'random_forest' THEN 1 ELSE 2 END, model_name, printf('%.4f', g), "
       "printf('%.4f', CASE WHEN abs(g + f - 1) > 0.02 THEN 1 - g ELSE f END) FROM an JOIN n ON n.doc_id = an.document_id",
       f"SELECT analysis_id, 'markers', pos, name, printf('%.2f', score), {_SHOWN} FROM mt"]))
def report_dataset(spark, sf_dir):
    """All lines of the report but the evidence, whose texts m_marker_evidence and the stored markers hold."""
    return K.report_rows(results(spark, sf_dir).read("analyses")).where(F.col("section") != "evidence")


@query("snk_explanations", f"""WITH {O.marker_ctes()}, {_MS} SELECT ms.doc_id AS analysis_id, CASE WHEN file_type = 'pdf' THEN 'Reviewed. ' ELSE '' END || marker_summary AS marker_summary
FROM ms JOIN biz ON biz.doc_id = ms.doc_id WHERE marker_summary <> {O.q(C.NO_MARKERS_TEXT)}""")
def stored_explanations(spark, sf_dir):
    """Explanations that were stored, replaced for one type of file, and deleted where they say nothing."""
    docs = detect_markers(business_documents(spark, sf_dir), AS_OF)
    rows = docs.select(F.col("doc_id").alias("analysis_id"), "file_type", marker_summary(F.col("markers")).alias("marker_summary"))
    rows = materialised(rows, "explanations")
    told = lambda c: F.struct(c.alias("marker_summary")).alias("explanation")
    target = f"{shared_folder(spark)}-explanations"
    K.write_explanations(rows.select("analysis_id", told(F.col("marker_summary"))), target, 1)
    reviewed = rows.where(F.col("file_type") == "pdf").select("analysis_id", told(F.concat(F.lit("Reviewed. "), F.col("marker_summary"))))
    K.write_explanations(reviewed, target, 2)
    K.delete_explanations(rows.where(F.col("marker_summary") == C.NO_MARKERS_TEXT), target, 3)
    return K.read_explanations(spark, target, "struct<marker_summary: string>").select("analysis_id", "explanation.marker_summary")


@query("snk_doctype_writeback", f"WITH {TYPE_CTES} SELECT biz.doc_id AS document_id, document_type, document_type <> file_type AS changed FROM biz JOIN typed ON typed.doc_id = biz.doc_id")
def doctype_writeback(spark, sf_dir):
    """Documents are registered under their file type; the detected type takes its place."""
    docs = business_documents(spark, sf_dir)
    registered = docs.select(F.col("doc_id").alias("document_id"), F.col("file_type").alias("document_type"))
    detected = classify(docs).select(F.col("doc_id").alias("document_id"), F.col("document_type").alias("detected_type"))
    return K.write_back_types(registered, detected)


@query("snk_document_register", f"""SELECT doc_id AS document_id, 'f' || doc_id || '.txt' AS original_filename, CASE WHEN doc_id % 3 <> 1 THEN {WORD_N} END AS words,
CASE WHEN doc_id % 3 <> 1 THEN length(text) END AS characters, CASE WHEN doc_id % 3 = 1 THEN {O.q(files.BINARY_FILE)} END AS reason FROM documents""")
def document_register(spark, sf_dir):
    """Every third file has a NUL byte and is rejected; the others become document rows."""
    tail = F.when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    raw = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("f"), F.col("doc_id"), F.lit(".txt")).alias("name"), F.lit("txt").alias("file_type"), F.concat(F.encode("text", "UTF-8"), tail).alias("content"))
    read = files.decode_files(raw.withColumn("size", F.octet_length("content")))
    fine, rejected = K.register_documents(read, word_count(F.col("text")))
    nothing = F.lit(None)
    return fine.select("document_id", "original_filename", "words", "characters", nothing.cast("string").alias("reason")).unionByName(
        rejected.select("document_id", "original_filename", nothing.cast("bigint").alias("words"), nothing.cast("bigint").alias("characters"), "reason"))


# --- rule book --------------------------------------------------------------------------------

_RULES = [r for r in rulebook.rules() if r.patterns]


def _rule_sql(source: str) -> str:
    counts = lambda r: " + ".join(f"len(regexp_extract_all(text, {O.q(p)}))" for p in r.patterns)
    return " UNION ALL ".join(
        f"SELECT doc_id, {O.q(r.category)} AS category, {O.q(r.name)} AS rule, {counts(r)} AS hits FROM {source} WHERE {counts(r)} >= {r.threshold}" for r in _RULES)


@query("m_rule_pattern_scan", f"WITH {O.BIZ} {_rule_sql('biz')}")
def rule_pattern_scan(spark, sf_dir):
    return rulebook.scan(business_documents(spark, sf_dir).select("doc_id", "text"), rulebook.rules())


@query("m_rule_pattern_scan_prose", f"""SELECT r.*, severity, score FROM ({_rule_sql('documents')}) r JOIN (VALUES """
       + ", ".join(f"({O.q(r.category)}, {O.q(r.name)}, {O.q(r.severity)}, CAST({r.score} AS DOUBLE))" for r in _RULES) + ") b(category, rule, severity, score) USING (category, rule)")
def rule_pattern_scan_prose(spark, sf_dir):
    """Hits in the prose, with severity and score from the rule table."""
    found = rulebook.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), rulebook.rules())
    book = rulebook.rules_table(spark).select("category", F.col("name").alias("rule"), "severity", "score")
    return found.join(book, ["category", "rule"])


# --- labelled datasets, evaluation ---------------------------------------------------------------

@query("src_csv_dataset_scan", """SELECT doc_id, md5(replace(d.text, chr(10), ' ')) AS text_hash, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS label
FROM documents d JOIN labels USING (doc_id) WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0""")
def csv_dataset_scan(spark, sf_dir):
    """Lines of a labelled dataset: every seventh is a comment, every eleventh has an unknown label."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    quoted = F.concat(F.lit('"'), F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit('""')), F.lit('"'))
    label = F.when(F.col("doc_id") % 11 == 0, F.lit("unsure")).when(F.col("toxic") == 1, F.lit(" Forged")).otherwise(F.lit("genuine"))
    line = F.concat(F.when(F.col("doc_id") % 7 == 0, F.lit("# ")).otherwise(F.lit("")), F.col("doc_id"), F.lit(","), quoted, F.lit(","), label)
    parsed = datasets.parse_lines(rows.select(line.alias("line")), ["doc_id", "Content", "target"])
    return datasets.labelled_dataset(parsed).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_hash"), "label")


@query("ml_standard_scale", """SELECT doc_id, round(n_chars / nullif(stddev_pop(n_chars) OVER (), 0), 6) AS n_chars,
round(words / nullif(stddev_pop(words) OVER (), 0), 6) AS words FROM (SELECT doc_id, n_chars, """ + WORD_N + " AS words FROM documents) t")
def standard_scale(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), word_count(F.col("text")).cast("double").alias("words"))
    scaled = L.standard_scale(docs, ["n_chars", "words"])
    return scaled.select("doc_id", F.round("n_chars", 6).alias("n_chars"), F.round("words", 6).alias("words"))


@query("ml_evaluate_bundle", f"""WITH {SCORED}, m AS ({_M}), a AS ({_AUC}) SELECT m.*, roc_auc, tn, fp, fn, tp, tn + fp + fn + tp AS samples FROM m JOIN a USING (model_name) JOIN (
SELECT model_name, count(*) FILTER (label = 0 AND score < 0.5) AS tn, count(*) FILTER (label = 0 AND score >= 0.5) AS fp,
count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 1 AND score >= 0.5) AS tp FROM pr GROUP BY 1) c USING (model_name)""")
def evaluate_bundle(spark, sf_dir):
    """Everything the evaluation of a run reports, a row for each model."""
    return L.evaluate(scored_labels(spark, sf_dir), all_metrics(spark, sf_dir)).select("model_name", *_COLS, "roc_auc", "tn", "fp", "fn", "tp", "samples")


@query("ml_train_run_summary", f"""WITH {O.BIZ}, r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) <= ceil(count(*) OVER (PARTITION BY label) / 5.0) AS is_test FROM biz)
SELECT count(*) AS samples, count(*) FILTER (NOT is_test) AS train_samples, count(*) FILTER (is_test) AS test_samples, count(*) FILTER (label = 0) AS genuine, count(*) FILTER (label = 1) AS fake,
{len(C.FEATURE_NAMES)} AS n_features, {O.q(', '.join(C.MODEL_NAMES))} AS models FROM r""")
def train_run_summary(spark, sf_dir):
    rows = business_documents(spark, sf_dir).select("doc_id", "label")
    return L.run_summary(L.stratified_split(rows, "doc_id", "label"), len(C.FEATURE_NAMES))
