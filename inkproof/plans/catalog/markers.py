"""Marker-rule queries over the rendered business documents and the prose corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.functions import text as T
from inkproof.functions.dates import parse_date, parse_pdf_date
from inkproof.operators import markers as M
from inkproof.operators.features import stat, stats_fields
from inkproof.operators.markers import ids, metadata, numerical, structural, textual, visual
from inkproof.operators.markers import dates as date_rules
from inkproof.plans import oracle as O
from inkproof.plans.registry import query, register
from inkproof.sources.business import AS_OF, business_documents
from inkproof.sources.tables import prose_documents



def text() -> Column:
    return F.col("text")


def meta() -> Column:
    return F.col("metadata")


def day() -> Column:
    return F.lit(AS_OF).cast("date")


def rows(df: DataFrame, markers: Column) -> DataFrame:
    """(doc_id, name, severity, score) of one rule."""
    return (
        T.explode_rows(df, markers, "doc_id")
        .select("doc_id", F.col("m.name").alias("name"), F.col("m.severity").alias("severity"),
                F.round("m.score", 6).alias("score"))
    )


RULES = {
    "inconsistent_terminology": lambda f: textual.inconsistent_terminology(text()),
    "suspicious_phrases": lambda f: textual.suspicious_phrases(text()),
    "repeated_sentences": lambda f: textual.repeated_sentences(text()),
    "abnormal_capitalization": lambda f: textual.abnormal_capitalization(text()),
    "excessive_exclamation": lambda f: F.filter(
        textual.excessive_punctuation(text()), lambda m: m["description"].contains("exclamation")),
    "excessive_ellipsis": lambda f: F.filter(
        textual.excessive_punctuation(text()), lambda m: m["description"].contains("ellipsis")),
    "template_like_language": lambda f: textual.template_like_language(text()),
    "inconsistent_totals": lambda f: numerical.inconsistent_totals(text()),
    "amount_mismatches": lambda f: numerical.amount_mismatches(text()),
    "percentage_inconsistencies": lambda f: numerical.percentage_inconsistencies(text()),
    "repeated_numbers": lambda f: numerical.repeated_numbers(text()),
    "impossible_dates": lambda f: date_rules.impossible_dates(text()),
    "future_dates": lambda f: date_rules.future_dates(text(), day()),
    "issue_after_expiry": lambda f: date_rules.issue_after_expiry(text()),
    "inconsistent_date_formats": lambda f: date_rules.inconsistent_date_formats(text()),
    "repeated_ids": lambda f: ids.repeated_ids(ids.rule_ids(text())),
    "malformed_patterns": lambda f: ids.malformed_patterns(ids.rule_ids(text())),
    "inconsistent_ids": lambda f: ids.inconsistent_ids(ids.rule_ids(text())),
    "missing_sections": lambda f: structural.missing_sections(text()),
    "inconsistent_headers_footers": lambda f: structural.inconsistent_headers_footers(text()),
    "page_numbering_issues": lambda f: structural.page_numbering_issues(text(), M.int_stat(f, "page_count")),
    "suspicious_timestamps": lambda f: metadata.suspicious_timestamps(meta()),
    "missing_metadata": lambda f: metadata.missing_metadata(meta()),
    "inconsistent_creator": lambda f: metadata.inconsistent_creator(meta()),
    "compression_artifacts": lambda f: visual.compression_artifacts(stat(f, "suspicious_region_count", 0)),
    "low_resolution": lambda f: visual.low_resolution(M.int_stat(f, "width"), M.int_stat(f, "height")),
    "low_ocr_confidence": lambda f: visual.low_ocr_confidence(stat(f, "ocr_confidence", 1)),
}


def _register_rules() -> None:
    sql = O.rules()
    for name, build in RULES.items():
        def run(spark: SparkSession, sf_dir: str, build=build) -> DataFrame:
            df = business_documents(spark, sf_dir)
            return rows(df, build(stats_fields(df)))

        register(
            f"m_{name}", run,
            f"WITH {O.BIZ}, r AS ({sql[name]}) SELECT doc_id, name, severity, round(score, 6) AS score FROM r",
        )


_register_rules()


@query("m_repeated_sentences_prose",
       f"SELECT doc_id, k AS repeated, mx AS most FROM {O.sentence_groups('documents')}")
def repeated_sentences_prose(spark, sf_dir):
    """Repeated sentences over the prose corpus, whose documents run to 20 000 words."""
    df = prose_documents(spark, sf_dir)
    counts = df.select("doc_id", textual.repeated_sentence_counts(text()).alias("c"))
    return counts.where(F.size("c") > 0).select(
        "doc_id",
        F.size("c").cast("bigint").alias("repeated"),
        F.array_max(F.transform("c", lambda c: c["n"])).cast("bigint").alias("most"),
    )


@query("m_amount_mismatches_prose", f"SELECT doc_id, n AS mismatches FROM ({O.mismatch_counts('documents')}) t WHERE n > 0")
def amount_mismatches_prose(spark, sf_dir):
    df = prose_documents(spark, sf_dir)
    pairs = df.select("doc_id", numerical.amount_pairs(text()).alias("p"))
    return pairs.where(F.size("p") > 0).select("doc_id", F.size("p").cast("bigint").alias("mismatches"))


@query("m_capital_lines_prose", f"""
SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '\\p{{Lu}}') AND NOT regexp_matches(x, '[\\p{{Ll}}\\p{{Lt}}\\x{{aa}}\\x{{ba}}]'))) AS caps, len(l) AS total
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 3) AS l FROM documents) a""")
def capital_lines_prose(spark, sf_dir):
    df = prose_documents(spark, sf_dir)
    return df.select("doc_id", textual.capital_line_counts(text()).alias("c")).select(
        "doc_id", F.col("c.caps").cast("bigint").alias("caps"), F.col("c.total").cast("bigint").alias("total"))


@query("m_detect_all", f"""WITH {O.marker_ctes()}
SELECT doc_id, pos, category, name, severity, round(score, 6) AS score FROM mk""")
def detect_all(spark, sf_dir):
    """All rules, most severe first, with the marker's position in its document."""
    df = M.detect_markers(business_documents(spark, sf_dir), AS_OF)
    return M.marker_rows(df, "doc_id").select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "category", "name", "severity",
        F.round("score", 6).alias("score"))


@query("m_detect_all_prose")
def detect_all_prose(spark, sf_dir):
    """All rules over the prose corpus, evidence included."""
    df = M.detect_markers(prose_documents(spark, sf_dir), AS_OF)
    return M.marker_rows(df, "doc_id")


@query("m_marker_evidence", f"""WITH {O.BIZ}, r AS (
SELECT doc_id, 'February 30th or 31st (impossible date): ' || array_to_string(({O.hits('text', C.IMPOSSIBLE_DATE_PATTERNS[0][0], False, 1)})[1:3], ', ') AS evidence
FROM biz WHERE {O.found('text', C.IMPOSSIBLE_DATE_PATTERNS[0][0])}
UNION ALL
SELECT doc_id, 'Suspicious phrases found: ' || array_to_string(list_filter([{', '.join(O.q(p) for p in C.RULE_PHRASES)}], lambda p: contains(low, p)), '; ')
FROM biz WHERE {' OR '.join(f'contains(low, {O.q(p)})' for p in C.RULE_PHRASES)}
UNION ALL
SELECT doc_id, 'Missing fields: ' || concat_ws(', ', {', '.join(f"CASE WHEN coalesce(md_{k}, '') = '' THEN {O.q(n)} END" for k, n in C.ESSENTIAL_METADATA)})
FROM biz WHERE {' OR '.join(f"coalesce(md_{k}, '') = ''" for k, _ in C.ESSENTIAL_METADATA)})
SELECT doc_id, evidence FROM r""")
def marker_evidence(spark, sf_dir):
    """Rendered evidence strings of three rules."""
    df = business_documents(spark, sf_dir)
    found = F.concat(
        F.filter(date_rules.impossible_dates(text()), lambda m: m["evidence"].startswith("February 30th")),
        textual.suspicious_phrases(text()),
        metadata.missing_metadata(meta()),
    )
    return T.explode_rows(df, found, "doc_id").select("doc_id", F.col("m.evidence").alias("evidence"))


@query("d_parse_date", f"""WITH {O.BIZ}
SELECT doc_id, v AS raw, strftime({O.day('v')}, '%Y-%m-%d') AS parsed, count(*) AS n FROM {O._unnest(O.DATES_LIST, 'v')} u GROUP BY 1, 2, 3""")
def parse_dates(spark, sf_dir):
    df = T.explode_rows(business_documents(spark, sf_dir), T.date_strings(text()), "doc_id").withColumnRenamed("m", "raw")
    return (
        df.select("doc_id", "raw", F.date_format(parse_date(F.col("raw")), "yyyy-MM-dd").alias("parsed"))
        .groupBy("doc_id", "raw", "parsed").agg(F.count(F.lit(1)).alias("n"))
    )


@query("d_parse_money", f"""WITH {O.BIZ}
SELECT doc_id, i AS pos, v AS raw, round({O.money('v')}, 6) AS amount FROM {O._unnest(O.hits('text', C.TOTAL_PATTERN, True, 1), 'v')} u""")
def parse_money(spark, sf_dir):
    found = T.find_all(text(), C.TOTAL_PATTERN, 1, True)
    df = T.explode_rows(business_documents(spark, sf_dir), found, "doc_id").withColumnsRenamed({"pos": "i", "m": "raw"})
    return df.select("doc_id", (F.col("i") + 1).cast("bigint").alias("pos"), "raw",
                     F.round(T.parse_money(F.col("raw")), 6).alias("amount"))


@query("d_pdf_date_parse", """
SELECT o_orderkey AS doc_id,
       CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
            WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00')
            WHEN 2 THEN strftime(o_orderdate, 'D:%Y13') ELSE 'undated' END AS iso
FROM orders""")
def pdf_date_parse(spark, sf_dir):
    from inkproof.sources.tables import table

    raw = F.expr(
        "CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, \"'D:'yyyyMMddHHmmss'Z'\") "
        "WHEN 1 THEN date_format(o_orderdate, \"'D:'yyyyMMdd\") "
        "WHEN 2 THEN date_format(o_orderdate, \"'D:'yyyy'13'\") ELSE 'undated' END")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), parse_pdf_date(raw).alias("iso"))
