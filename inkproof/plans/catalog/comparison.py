"""Comparison queries: every document with its neighbour by key, and the corpus join."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.operators import compare as P
from inkproof.operators.doctype import classify
from inkproof.operators.features import word_count
from inkproof.plans import oracle as O
from inkproof.plans.catalog.features import WORD_N
from inkproof.plans.catalog.scoring import TYPE_CTES
from inkproof.plans.registry import query
from inkproof.session import materialised
from inkproof.plans.scoring import assess
from inkproof.sources.business import AS_OF, business_documents
from inkproof.sources.tables import prose, table

WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'))"
JACCARD = "len(list_intersect(wa, wb)) / CAST(len(list_distinct(list_concat(wa, wb))) AS DOUBLE)"


@query("c_token_jaccard", f"""SELECT doc_a, doc_b, round({JACCARD}, 6) AS jaccard FROM (
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, {WORDS.format('a.text')} AS wa, {WORDS.format('b.text')} AS wb
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) t""")
def token_jaccard(spark, sf_dir):
    """Word sets are built once a document, and only those are joined."""
    sets = prose(spark, sf_dir).select("doc_id", P.word_set(F.col("text")).alias("words"))
    pairs = sets.select(F.col("doc_id").alias("doc_a"), (F.col("doc_id") + 1).alias("doc_b"), F.col("words").alias("a_words"))
    other = sets.select(F.col("doc_id").alias("doc_b"), F.col("words").alias("b_words"))
    score = P.jaccard(F.col("a_words"), F.col("b_words"))
    return pairs.join(other, "doc_b").select("doc_a", "doc_b", F.round(score, 6).alias("jaccard"))


def _extract(name, column, regex, ignore_case=True, group=0, keep=""):
    values = O._unnest(O.hits("text", regex, ignore_case, group), "v")
    sql = f"""WITH {O.BIZ}, f AS (SELECT doc_id, v, min(i) AS i FROM {values} u {keep} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f)
SELECT biz.doc_id, coalesce(string_agg(v, ' | ' ORDER BY rn), '') AS found FROM biz LEFT JOIN r ON r.doc_id = biz.doc_id GROUP BY 1"""

    def run(spark, sf_dir):
        return business_documents(spark, sf_dir).select("doc_id", F.array_join(column(F.col("text")), " | ").alias("found"))

    query(name, sql)(run)


_extract("c_extract_dates", P.dates_of, C.COMPARE_DATE_PATTERN)
_extract("c_extract_ids", P.ids_of, C.COMPARE_ID_PATTERN)
_extract("c_extract_numbers", P.numbers_of, C.COMPARE_NUMBER_PATTERN, False, 1, "WHERE length(v) > 1")

ENTITIES = {"dates": P.dates_of, "ids": P.ids_of, "numbers": P.numbers_of, "names": P.names_of}


def business_pairs(spark, sf_dir, with_risk=True):
    """Each order's document with that of the next order number."""
    base = business_documents(spark, sf_dir)
    text = F.col("text")
    meta = lambda k: F.nullif(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    if with_risk:
        side = classify(assess(base, AS_OF)).select(
            "doc_id", F.coalesce(F.get(P.dates_of(text), F.lit(0)), F.lit("")).alias("date"),
            F.trim(F.coalesce(meta("creator"), meta("author"), F.lit(""))).alias("origin"),
            F.col("stats.page_count").alias("pages"), F.col("stats.table_count").alias("tables"), word_count(text).cast("bigint").alias("words"),
            "document_type", "risk_score", "decision", F.array_distinct(F.transform("markers", lambda m: m["name"])).alias("marker_names"))
    else:
        side = base.select("doc_id", *[f(text).alias(k) for k, f in ENTITIES.items()])
    # both sides of the pairs read what was found once
    side = materialised(side, "sides" if with_risk else "entities")
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_a"), (F.col("o_orderkey") + 1).alias("doc_b"))
    return P.pair_up(pairs, side)


_FOUND = {
    "dates": O.hits("text", C.COMPARE_DATE_PATTERN, True), "ids": O.hits("text", C.COMPARE_ID_PATTERN, True),
    "numbers": f"list_filter({O.hits('text', C.COMPARE_NUMBER_PATTERN, False, 1)}, lambda v: length(v) > 1)",
    "names": O.hits("text", C.COMPARE_NAME_PATTERN),
}


@query("c_common_entities", f"WITH {O.BIZ}, e AS (SELECT doc_id, " + ", ".join(f"list_distinct({v}) AS {k}" for k, v in _FOUND.items())
       + " FROM biz) SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, "
       + ", ".join(f"array_to_string(list_sort(list_intersect(a.{k}, b.{k})), ' | ') AS {k}" for k in _FOUND)
       + " FROM e a JOIN e b ON b.doc_id = a.doc_id + 1")
def common_entities(spark, sf_dir):
    """Dates, ids, numbers and names that both documents have."""
    both = business_pairs(spark, sf_dir, with_risk=False)
    return both.select("doc_a", "doc_b", *[F.array_join(F.array_sort(F.array_intersect(f"a_{k}", f"b_{k}")), " | ").alias(k) for k in ENTITIES])


_SIDE = f"""{TYPE_CTES.replace(O.BIZ + ',', '', 1)}, s AS (SELECT scored.doc_id, risk_score, decision, page_count AS pages, table_count AS tables, document_type, {WORD_N} AS words,
trim(coalesce(nullif(md_creator, ''), nullif(md_author, ''), '')) AS origin, coalesce({O.hits('text', C.COMPARE_DATE_PATTERN, True)}[1], '') AS dt,
coalesce(n.names, []) AS names FROM scored JOIN typed ON typed.doc_id = scored.doc_id
LEFT JOIN (SELECT doc_id, list(DISTINCT name) AS names FROM mk GROUP BY 1) n ON n.doc_id = scored.doc_id),
pr AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.dt <> '' AND b.dt <> '' AND a.dt <> b.dt AS d1, a.decision <> b.decision AS d2,
a.origin <> '' AND b.origin <> '' AND lower(a.origin) <> lower(b.origin) AS d3, a.pages <> b.pages AS d4, a AS a, b AS b
FROM s a JOIN s b ON b.doc_id = a.doc_id + 1)"""
_PAIRED = f"WITH {O.scored_ctes()}, {_SIDE}"
_KEYS = ["date", "decision", "risk_score", "origin", "pages", "tables", "words", "document_type", "marker_names"]


def _sides():
    return [{k: F.col(f"{p}_{k}") for k in _KEYS} for p in "ab"]


@query("c_differences", f"""{_PAIRED} SELECT doc_a, doc_b, concat_ws('; ',
CASE WHEN d1 THEN 'Date discrepancy detected: Document A states ''' || a.dt || ''' while Document B states ''' || b.dt || '''' END,
CASE WHEN d2 THEN 'Classification decision disparity: Document A is ''' || a.decision || ''' vs Document B ''' || b.decision || '''' END,
CASE WHEN d3 THEN 'Metadata origin mismatch: Document A created by ''' || a.origin || ''' vs Document B ''' || b.origin || '''' END,
CASE WHEN d4 THEN 'Document length variance: ' || a.pages || ' pages vs ' || b.pages || ' pages' END) AS differences FROM pr""")
def differences(spark, sf_dir):
    """The sentences; scores in them, which the engines round differently at .5, are what c_field_comparison shows."""
    found = F.array_join(P.differences(*_sides()), "; ")
    return business_pairs(spark, sf_dir).select("doc_a", "doc_b", F.regexp_replace(found, r" \(Risk: \d+\)", "").alias("differences"))


_FIELDS = {
    "Document Type": ("{}.document_type", "a.document_type = b.document_type"),
    "Risk Score": ("printf('%.2f', {}.risk_score)", "abs(a.risk_score - b.risk_score) < 5"),
    "Decision": ("{}.decision", "a.decision = b.decision"),
    "Page Count": ("CAST({}.pages AS VARCHAR)", "a.pages = b.pages"),
    "Word Count": ("CAST({}.words AS VARCHAR)", "abs(a.words - b.words) < 20"),
    "Detected Tables": ("CAST({}.tables AS VARCHAR)", "a.tables = b.tables"),
    "Primary Reference Date": ("coalesce(nullif({}.dt, ''), 'None')", "a.dt <> '' AND a.dt = b.dt"),
    "Metadata Author": ("coalesce(nullif({}.origin, ''), 'Not specified')", "NOT d3"),
}


@query("c_field_comparison", _PAIRED + " UNION ALL ".join(
    f" SELECT doc_a, doc_b, '{k}' AS attribute, {v.format('a')} AS value_a, {v.format('b')} AS value_b, {m} AS matches FROM pr"
    for k, (v, m) in _FIELDS.items()))
def field_comparison(spark, sf_dir):
    return P.field_rows(business_pairs(spark, sf_dir), *_sides())


@query("c_comparison_summary", f"""{_PAIRED}
SELECT doc_a, doc_b, {O.half_up('abs(a.risk_score - b.risk_score)')} AS risk_difference, array_to_string(list_sort(list_intersect(a.names, b.names)), ' | ') AS common_markers,
NOT d2 AS decision_matches, CASE WHEN d1 OR d2 OR d3 OR d4 THEN {O.q(C.VERDICT_DIFFERENT)} ELSE {O.q(C.VERDICT_SAME)} END AS verdict FROM pr""")
def comparison_summary(spark, sf_dir):
    a, b = _sides()
    return business_pairs(spark, sf_dir).select(
        "doc_a", "doc_b", F.round(F.abs(a["risk_score"] - b["risk_score"]), 2).alias("risk_difference"),
        F.array_join(F.array_sort(F.array_intersect(a["marker_names"], b["marker_names"])), " | ").alias("common_markers"),
        (a["decision"] == b["decision"]).alias("decision_matches"),
        F.when(F.size(P.differences(a, b)) > 0, C.VERDICT_DIFFERENT).otherwise(C.VERDICT_SAME).alias("verdict"))


@query("c_corpus_pair_join", f"""WITH w AS (SELECT doc_id, list_sort({WORDS.format('text')}) AS w FROM documents),
e AS (SELECT w, min(doc_id) AS rep, count(*) AS copies FROM w WHERE len(w) > 0 GROUP BY 1),
t AS (SELECT rep, len(w) AS n, unnest(w) AS x FROM e),
s AS (SELECT a.rep AS ra, b.rep AS rb, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep GROUP BY 1, 2)
SELECT ra AS rep_a, rb AS rep_b, ea.copies AS copies_a, eb.copies AS copies_b, round(shared / CAST(na + nb - shared AS DOUBLE), 6) AS jaccard
FROM s JOIN e ea ON ea.rep = ra JOIN e eb ON eb.rep = rb WHERE shared / CAST(na + nb - shared AS DOUBLE) >= 0.8""")
def corpus_pair_join(spark, sf_dir):
    return P.similar_pairs(prose(spark, sf_dir), 0.8).withColumn("jaccard", F.round("jaccard", 6))
