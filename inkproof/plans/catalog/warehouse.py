"""History, dashboard and batch queries over the stored warehouse: documents are scored once, when it is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.operators import store as S
from inkproof.operators import warehouse as W
from inkproof.operators.doctype import classify
from inkproof.operators.features import word_count
from inkproof.operators.risk import display_category
from inkproof.plans import oracle as O
from inkproof.plans.catalog.scoring import TYPE_CTES
from inkproof.plans.registry import query
from inkproof.plans.scoring import assess
from inkproof.plans.stored import stored
from inkproof.session import shared_folder
from inkproof.sources.business import AS_OF, business_documents
from inkproof.sources.tables import table

RISK = ["ml_risk_score", "marker_risk_score", "structural_risk_score", "consistency_risk_score",
        "risk_score", "decision", "confidence"]


def documents(spark, sf_dir) -> DataFrame:
    return business_documents(spark, sf_dir).select(
        F.col("doc_id").alias("document_id"),
        F.col("filename").alias("original_filename"),
        "file_type",
        F.col("stats.page_count").cast("bigint").alias("pages"),
        F.col("stats.table_count").cast("bigint").alias("tables_detected"),
        word_count(F.col("text")).cast("bigint").alias("words"),
        "uploaded_at",
    )


def runs(docs: DataFrame, *columns: str) -> DataFrame:
    """One analysis per document, a second a day later for every tenth."""
    times = F.when(F.col("doc_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return docs.withColumn("run", F.explode(times)).select(
        (F.col("doc_id") * 2 + F.col("run")).alias("analysis_id"),
        F.col("doc_id").alias("document_id"),
        (F.col("uploaded_at") + F.make_dt_interval(F.col("run"), F.lit(0), F.lit(5))).alias("created_at"),
        F.col("filename").alias("original_filename"), "file_type", *columns,
    )


def analyses(spark, sf_dir, *wanted: str, where: Column | None = None) -> DataFrame:
    """The analyses with their markers inside, or with the wanted computed columns only.

    Without any wanted column nothing is scored.  ``where`` filters documents before they are scored.
    """
    docs = business_documents(spark, sf_dir)
    if where is not None:
        docs = docs.where(where)
    wanted = wanted or ("markers", *RISK)
    return runs(assess(docs, AS_OF, wanted=list(wanted)), *wanted)


def warehouse(spark, sf_dir) -> S.AnalysisStore:
    return stored(spark, sf_dir, "warehouse", lambda: documents(spark, sf_dir), lambda: analyses(spark, sf_dir))


def kept(spark, sf_dir, *columns: str) -> DataFrame:
    """Stored analyses; without columns, those that the lists show."""
    return warehouse(spark, sf_dir).read("analyses").select(*(columns or (
        "analysis_id", "document_id", "created_at", "original_filename", "file_type", *RISK, "marker_count")))


def sums(spark, sf_dir) -> DataFrame:
    return warehouse(spark, sf_dir).sums()


def marker_table(spark, sf_dir) -> DataFrame:
    return warehouse(spark, sf_dir).read("markers")


STAMP = "date_format(created_at, 'yyyy-MM-dd HH:mm:ss')"
TS = "strftime(created_at, '%Y-%m-%d %H:%M:%S')"
AN = """an AS MATERIALIZED (SELECT doc_id * 2 + v AS analysis_id, doc_id AS document_id, uploaded_at + INTERVAL 5 MINUTE + v * INTERVAL 1 DAY AS created_at,
filename AS original_filename, file_type, n_markers, ml_risk_score, marker_risk_score, structural_risk_score, consistency_risk_score,
risk_score, decision, confidence FROM scored, (VALUES (0), (1)) r(v) WHERE v = 0 OR doc_id % 10 = 0)"""
MT = f"mt AS (SELECT an.analysis_id, pos, category, name, severity, {O.half_up('score * 100')} AS score FROM an JOIN mk ON mk.doc_id = an.document_id)"
CTES = f"WITH {O.scored_ctes()}, {AN}, {MT}"
DOCS = f"WITH {O.BIZ} "


def _stamped(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.expr(STAMP).alias("created_at") if c == "created_at" else c for c in columns])


@query("w_analyses_documents_join", f"{CTES} SELECT analysis_id, document_id, original_filename, file_type, risk_score FROM an")
def analyses_documents_join(spark, sf_dir):
    store = warehouse(spark, sf_dir)
    return W.history(store.read("analyses").select("analysis_id", "document_id", "risk_score"), store.read("documents")).select(
        "analysis_id", "document_id", "original_filename", "file_type", "risk_score")


@query("w_history_filter", f"{CTES} SELECT analysis_id, original_filename, decision FROM an WHERE decision = 'forged' AND (original_filename ILIKE '%INV%' OR file_type ILIKE '%INV%')")
def history_filter(spark, sf_dir):
    return W.history_filter(kept(spark, sf_dir), "Forged", " INV ").select("analysis_id", "original_filename", "decision")


@query("w_history_total", f"{CTES} SELECT count(*) AS total FROM an WHERE original_filename ILIKE '%pdf%' OR file_type ILIKE '%pdf%'")
def history_total(spark, sf_dir):
    return W.history_filter(kept(spark, sf_dir), search="pdf").agg(F.count(F.lit(1)).alias("total"))


@query("w_history_page", f"{CTES} SELECT analysis_id, {TS} AS created_at, decision FROM (SELECT * FROM an ORDER BY an.created_at DESC, analysis_id DESC LIMIT 20 OFFSET 40) an")
def history_page(spark, sf_dir):
    return _stamped(W.history_page(kept(spark, sf_dir), 40, 20), "analysis_id", "created_at", "decision")


@query("w_history_item", f"{CTES} SELECT analysis_id, n_markers AS marker_count FROM an")
def history_item(spark, sf_dir):
    return kept(spark, sf_dir, "analysis_id", "marker_count")


@query("w_dashboard_totals", f"{CTES} SELECT (SELECT count(*) FROM biz) AS total_documents, (SELECT count(*) FROM an) AS total_analyses, "
       f"(SELECT {O.half_up('sum(CAST(risk_score AS DECIMAL(9,2))) / count(*)')} FROM an) AS average_risk_score, (SELECT count(*) FROM mt) AS total_markers")
def dashboard_totals(spark, sf_dir):
    return S.totals(sums(spark, sf_dir))


@query("w_decision_distribution", f"{CTES} SELECT decision, count(*) AS n FROM an GROUP BY 1")
def decision_distribution(spark, sf_dir):
    return S.distribution(sums(spark, sf_dir), "decision", "decision")


@query("w_doctype_distribution", f"WITH {TYPE_CTES} SELECT document_type, count(*) AS n FROM typed GROUP BY 1")
def doctype_distribution(spark, sf_dir):
    return W.distribution(classify(business_documents(spark, sf_dir)), "document_type")


@query("w_severity_distribution", f"{CTES} SELECT count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium, "
       "count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical FROM mt")
def severity_distribution(spark, sf_dir):
    return S.severity_distribution(sums(spark, sf_dir))


_BANDS = " UNION ALL ".join(
    f"SELECT '{label}' AS label, count(*) FILTER ({cond}) AS n, {O.half_up(f'count(*) FILTER ({cond}) / CAST(max(total) AS DOUBLE) * 100', 1)} AS percentage FROM an, t"
    for label, cond in (("Low risk", "risk_score < 30"), ("Medium risk", "risk_score >= 30 AND risk_score < 60"), ("High risk", "risk_score >= 60")))


@query("w_risk_bands", f"{CTES}, t AS (SELECT count(*) AS total FROM an) {_BANDS}")
def risk_bands(spark, sf_dir):
    return S.risk_bands(sums(spark, sf_dir))


@query("w_recent_analyses", f"{CTES} SELECT analysis_id, {TS} AS created_at, risk_score FROM (SELECT * FROM an ORDER BY an.created_at DESC, analysis_id DESC LIMIT 5) an")
def recent_analyses(spark, sf_dir):
    return _stamped(W.history_page(kept(spark, sf_dir), 0, 5), "analysis_id", "created_at", "risk_score")


_WEEK = (f"(SELECT count(*) FROM biz WHERE uploaded_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS files_this_week, "
         f"(SELECT count(*) FROM an WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS analyses_this_week")


@query("w_activity_last_7_days", f"{CTES} SELECT {_WEEK}")
def activity_last_7_days(spark, sf_dir):
    return S.since_day(sums(spark, sf_dir), F.date_sub(F.lit(AS_OF).cast("date"), 7))


@query("w_delete_analysis_cascade", f"{CTES} SELECT name, count(*) AS n FROM mt WHERE analysis_id NOT IN (SELECT analysis_id FROM an WHERE decision = 'forged') GROUP BY 1")
def delete_analysis_cascade(spark, sf_dir):
    """Markers left if every analysis that ended in ``forged`` were deleted; the warehouse itself keeps them."""
    gone = kept(spark, sf_dir, "analysis_id", "decision").where(F.col("decision") == "forged")
    (left,) = W.delete_cascade(gone, marker_table(spark, sf_dir).select("analysis_id", "name"))
    return W.distribution(left, "name")


_LEFT = "l AS (SELECT * FROM an WHERE decision <> 'forged'), lm AS (SELECT mt.* FROM mt JOIN l USING (analysis_id))"


@query("w_incremental_totals", f"{CTES}, {_LEFT} SELECT 'documents' AS measure, '' AS key, count(*) AS n, CAST(0 AS DECIMAL(38,2)) AS amount FROM biz UNION ALL "
       "SELECT 'upload_day', strftime(uploaded_at, '%Y-%m-%d'), count(*), 0 FROM biz GROUP BY 2 UNION ALL "
       "SELECT 'analyses', '', count(*), sum(CAST(risk_score AS DECIMAL(9,2))) FROM l UNION ALL SELECT 'markers', '', count(*), 0 FROM lm UNION ALL "
       "SELECT 'decision', decision, count(*), 0 FROM l GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*), 0 FROM lm GROUP BY 2 UNION ALL "
       "SELECT 'name', name, count(*), 0 FROM lm GROUP BY 2 UNION ALL SELECT 'day', strftime(created_at, '%Y-%m-%d'), count(*), 0 FROM l GROUP BY 2 UNION ALL "
       "SELECT 'band', CASE WHEN risk_score < 30 THEN 'low' WHEN risk_score < 60 THEN 'medium' ELSE 'high' END, count(*), 0 FROM l GROUP BY 2")
def incremental_totals(spark, sf_dir):
    """The dashboard's sums after three batches, a repeated one and a deletion: added up from what each batch left."""
    store = S.AnalysisStore(spark, shared_folder(spark))
    whole = warehouse(spark, sf_dir)
    store.register("documents", whole.read("documents"))
    rows = whole.read("analyses")
    year = F.year("created_at")
    for batch, part in (("old", year < 1994), ("middle", (year >= 1994) & (year < 1996)), ("new", year >= 1996), ("middle", year == 1994)):
        store.write(batch, rows.where(part))  # the fourth has the id of the second and changes nothing
    store.delete("forged ones", rows.where(F.col("decision") == "forged"))
    return store.sums()


@query("w_after_deletion", f"{CTES}, {_LEFT} SELECT l.analysis_id, risk_score, count(lm.name) AS markers FROM l LEFT JOIN lm ON lm.analysis_id = l.analysis_id GROUP BY 1, 2")
def after_deletion(spark, sf_dir):
    """Rows that are still visible after a batch, its replay and a deletion, with their markers counted."""
    store = S.AnalysisStore(spark, shared_folder(spark))
    rows = warehouse(spark, sf_dir).read("analyses")
    store.write("all", rows)
    store.write("all", rows)
    store.delete("forged ones", rows.where(F.col("decision") == "forged"))
    marks = store.read("markers").groupBy("analysis_id").agg(F.count(F.lit(1)).alias("markers"))
    return store.read("analyses").select("analysis_id", "risk_score").join(marks, "analysis_id", "left").fillna(0, "markers")


@query("w_latest_analysis_per_document", f"{CTES} SELECT document_id, max(analysis_id) AS analysis_id FROM an GROUP BY 1")
def latest_analysis_per_document(spark, sf_dir):
    return W.latest_per_document(kept(spark, sf_dir, "document_id", "created_at", "analysis_id")).select("document_id", "analysis_id")


_NESTED = ("SELECT an.analysis_id, an.document_id, an.risk_score, string_agg(name || ':' || CAST(CAST(score AS DECIMAL(9,2)) AS VARCHAR), ';' "
           "ORDER BY score DESC, pos) AS markers FROM an LEFT JOIN mt ON mt.analysis_id = an.analysis_id {} GROUP BY 1, 2, 3")


def by_score(markers: str) -> Column:
    """Name, severity and negative score of each marker, highest stored score first; they never left the analysis row."""
    return F.array_sort(F.transform(markers, lambda m, i: F.struct(
        (-F.round(m["score"] * 100, 2)).alias("k"), i.alias("i"), m["name"].alias("name"), m["severity"].alias("severity"))))


@query("w_single_result_lookup", f"{CTES} {_NESTED.format('WHERE an.analysis_id = 2040')}")
def single_result_lookup(spark, sf_dir):
    """One analysis with its markers, from its bucket of the stored table."""
    shown = F.transform(by_score("markers"), lambda r: F.concat(r["name"], F.lit(":"), (-r["k"]).cast("decimal(9,2)").cast("string")))
    text = F.when(F.size("markers") > 0, F.array_join(shown, ";"))
    return warehouse(spark, sf_dir).one("analyses", 2040).select("analysis_id", "document_id", "risk_score", text.alias("markers"))


@query("w_document_content", DOCS + "SELECT doc_id, filename, text, page_count AS pages, coalesce(md_author, '') AS author FROM biz WHERE doc_id = 1155")
def document_content(spark, sf_dir):
    df = business_documents(spark, sf_dir).where(F.col("doc_id") == 1155)
    author = F.coalesce(F.try_element_at("metadata", F.lit("author")), F.lit(""))
    return df.select("doc_id", "filename", "text", F.col("stats.page_count").alias("pages"), author.alias("author"))


_ITEMS = f"""{CTES}, items AS (SELECT o_orderkey AS document_id, coalesce(filename, 'Document #' || o_orderkey) AS original_filename,
CASE WHEN risk_score IS NULL THEN 'failed' ELSE 'success' END AS status, risk_score, decision
FROM orders LEFT JOIN scored ON doc_id = o_orderkey)"""


def items(spark, sf_dir) -> DataFrame:
    """Every order is requested; orders without lines have no document."""
    requested = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"))
    newest = W.latest_per_document(kept(spark, sf_dir, "document_id", "created_at", "analysis_id", "original_filename", "risk_score", "decision"))
    return W.batch_items(requested, newest)


@query("w_batch_analyze_rollup", f"{_ITEMS} SELECT count(*) AS total_files, count(*) FILTER (status = 'success') AS successful, "
       f"count(*) FILTER (status = 'failed') AS failed, {O.half_up('sum(CAST(risk_score AS DECIMAL(9,2))) / count(risk_score)')} AS overall_risk_score FROM items")
def batch_analyze_rollup(spark, sf_dir):
    return W.batch_rollup(items(spark, sf_dir))


@query("w_batch_result_view", f"{_ITEMS} SELECT document_id, original_filename, risk_score FROM items WHERE decision = 'forged' ORDER BY lower(original_filename)")
def batch_result_view(spark, sf_dir):
    view = W.batch_view(items(spark, sf_dir), "Forged", "original_filename", ascending=True)
    return view.select("document_id", "original_filename", "risk_score")


@query("w_unique_ids", DOCS + "SELECT DISTINCT doc_id AS document_id FROM biz WHERE lower(filename) IN (SELECT 'invoice_' || o_orderkey || '.pdf' FROM orders)")
def unique_ids(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("INVOICE_"), F.col("o_orderkey").cast("string"), F.lit(".PDF")).alias("filename"))
    return W.matched_ids(warehouse(spark, sf_dir).read("documents"), names)


@query("w_dashboard_declared", f"{CTES}, t AS (SELECT name, count(*) AS n FROM mt GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) SELECT t.name AS top_marker, t.n AS top_marker_count, {_WEEK} FROM t")
def dashboard_declared(spark, sf_dir):
    """The most frequent marker beside the activity of the week: one aggregate of the sums."""
    return S.declared(sums(spark, sf_dir), F.date_sub(F.lit(AS_OF).cast("date"), 7))


@query("w_marker_frequency", f"{CTES} SELECT name, count(*) AS n FROM mt GROUP BY 1")
def marker_frequency(spark, sf_dir):
    return S.distribution(sums(spark, sf_dir), "name", "name")


@query("w_display_categories", f"{CTES} SELECT CASE category WHEN 'textual' THEN 'content' WHEN 'numerical' THEN 'inconsistency' WHEN 'date' THEN 'inconsistency' "
       "WHEN 'id_reference' THEN 'digital' ELSE category END AS category, count(*) AS n FROM mt GROUP BY 1")
def display_categories(spark, sf_dir):
    shown = marker_table(spark, sf_dir).select(display_category(F.col("category")).alias("category"))
    return W.distribution(shown, "category")
