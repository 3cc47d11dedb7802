"""ANSI SQL forms of the operators, used to check the Spark queries independently."""

from __future__ import annotations

import re

from inkproof.functions import constants as C
from inkproof.sources.business import AS_OF, render_ansi

WS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
NL = "chr(10)"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def pat(regex: str, ignore_case: bool = False) -> str:
    return q(("(?i)" if ignore_case else "") + regex)


def hits(text: str, regex: str, ignore_case: bool = False, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {pat(regex, ignore_case)}, {group})"


def count(text: str, regex: str, ignore_case: bool = False) -> str:
    return f"len({hits(text, regex, ignore_case)})"


def found(text: str, regex: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({text}, {pat(regex, ignore_case)})"


def n_true(conditions: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conditions) + ")"


def money(expr: str) -> str:
    return f"TRY_CAST(regexp_replace({expr}, '[,$€£¥₹\\s]', '', 'g') AS DOUBLE)"


def half_up(expr: str, digits: int = 2) -> str:
    """Round half up on the shortest decimal form of a double, as Spark does."""
    return f"CAST(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(20,{digits})) AS DOUBLE)"


def day(expr: str) -> str:
    formats = ["%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%B %d, %Y", "%b %d, %Y",
               "%d %B %Y", "%d %b %Y", "%B %d %Y", "%b %d %Y", "%m-%d-%Y"]
    return f"try_strptime({expr}, [{', '.join(q(f) for f in formats)}])"


BIZ = f"biz AS MATERIALIZED (SELECT *, lower(text) AS low FROM ({render_ansi()}) r)"


def rule(no: int, seq: str, category: str, name: str, severity: str, score: str, source: str) -> str:
    # decimal literals become doubles, so that sums carry the same last digits as in Spark
    score = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", score)
    sev = severity if severity.startswith("CASE") else q(severity)
    return (
        f"SELECT doc_id, {no} AS rule_no, {seq} AS seq, {q(category)} AS category, {q(name)} AS name, "
        f"{sev} AS severity, CAST(least(greatest({score}, 0), 1) AS DOUBLE) AS score\nFROM {source}"
    )


def _unnest(text_list: str, alias: str, source: str = "biz") -> str:
    return (
        f"(SELECT doc_id, i, l[i] AS {alias} FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i "
        f"FROM (SELECT doc_id, {text_list} AS l FROM {source}) a) b)"
    )


DATES_LIST = "list_concat(" * (len(C.DATE_PATTERNS) - 1) + hits("text", *C.DATE_PATTERNS[0], 1) + "".join(
    f", {hits('text', p, ic, 1)})" for p, ic in C.DATE_PATTERNS[1:]
)
IDS_LIST = "list_concat(" * (len(C.RULE_ID_PATTERNS) - 1) + hits("text", *C.RULE_ID_PATTERNS[0], 1) + "".join(
    f", {hits('text', p, ic, 1)})" for p, ic in C.RULE_ID_PATTERNS[1:]
)
CLEAN = "regexp_replace({}, '[^a-zA-Z0-9]', '', 'g')"


def rules() -> dict[str, str]:
    """Every marker rule as SQL rows (doc_id, rule_no, seq, category, name, severity, score)."""
    out: dict[str, str] = {}
    terms = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS g, {n_true([f'contains(low, {q(w)})' for w in words])} AS n FROM biz"
        for i, (_, words) in enumerate(C.TERM_GROUPS)
    )
    out["inconsistent_terminology"] = rule(
        1, "g", "textual", "inconsistent_terminology", "medium", "0.5 + 0.1 * (n - 2)",
        f"({terms}) t WHERE n > 1")
    phrases = n_true([f"contains(low, {q(p)})" for p in C.RULE_PHRASES])
    out["suspicious_phrases"] = rule(
        2, "0", "textual", "suspicious_phrases", "CASE WHEN n < 3 THEN 'medium' ELSE 'high' END",
        "least(0.5 + 0.1 * n, 0.9)", f"(SELECT doc_id, {phrases} AS n FROM biz) t WHERE n > 0")
    out["repeated_sentences"] = rule(
        3, "0", "textual", "repeated_sentences", "CASE WHEN mx <= 3 THEN 'medium' ELSE 'high' END",
        "least(0.4 + 0.05 * k + 0.1 * (mx - 2), 0.85)",
        sentence_groups("biz"))
    lines = f"list_transform(string_split(text, {NL}), lambda x: trim(x))"
    out["abnormal_capitalization"] = rule(
        4, "0", "textual", "abnormal_capitalization", "CASE WHEN r > 0.6 THEN 'high' ELSE 'medium' END",
        "least(0.3 + r, 0.8)",
        f"(SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '\\p{{Lu}}') AND NOT regexp_matches(x, '[\\p{{Ll}}\\p{{Lt}}]'))) "
        f"/ len(l) AS r FROM (SELECT doc_id, list_filter({lines}, lambda x: length(x) > 3) AS l FROM biz) a WHERE len(l) > 0) t WHERE r > 0.4")
    out["excessive_exclamation"] = rule(
        5, "0", "textual", "excessive_punctuation", "low", "least(0.3 + n * 0.02, 0.7)",
        f"(SELECT doc_id, {count('text', '!')} AS n FROM biz) t WHERE n > 10")
    out["excessive_ellipsis"] = rule(
        6, "0", "textual", "excessive_punctuation", "low", "least(0.3 + n * 0.03, 0.7)",
        f"(SELECT doc_id, {count('text', '[.][.][.]')} AS n FROM biz) t WHERE n > 5")
    out["template_like_language"] = rule(
        7, "0", "textual", "template_like_language", "medium", "least(0.4 + 0.05 * n, 0.8)",
        f"(SELECT doc_id, {n_true([found('text', p, True) for p, _ in C.TEMPLATE_PATTERNS])} AS n FROM biz) t WHERE n > 0")
    triples = (
        f"(SELECT s.doc_id, s.i * 1000000 + x.i * 1000 + t.i AS seq, abs(s.v + x.v - t.v) / (s.v + x.v) AS d "
        f"FROM {_amount(C.SUBTOTAL_PATTERN)} s JOIN {_amount(C.TAX_PATTERN)} x ON s.doc_id = x.doc_id "
        f"JOIN {_amount(C.TOTAL_PATTERN)} t ON t.doc_id = s.doc_id WHERE s.v + x.v > 0) m WHERE d > 0.01")
    out["inconsistent_totals"] = rule(
        8, "seq", "numerical", "inconsistent_totals", "CASE WHEN d > 0.05 THEN 'high' ELSE 'medium' END",
        "least(0.6 + d * 2, 0.95)", triples)
    out["amount_mismatches"] = rule(
        9, "0", "numerical", "amount_mismatches", "high", "least(0.6 + 0.05 * n, 0.9)",
        f"({mismatch_counts('biz')}) t WHERE n > 0")
    near = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS g, list_filter(list_transform({hits(_window(w), C.PERCENT_PATTERN, False, 1)}, "
        f"lambda v: TRY_CAST(v AS DOUBLE)), lambda v: v IS NOT NULL) AS l FROM biz WHERE contains(low, {q(w)})"
        for i, w in enumerate(C.ALLOCATION_WORDS))
    out["percentage_inconsistencies"] = rule(
        10, "g", "numerical", "percentage_inconsistencies", "medium", "least(0.5 + abs(s - 100) * 0.02, 0.85)",
        f"(SELECT doc_id, g, list_sum(l) AS s FROM ({near}) a WHERE len(l) > 1) t WHERE abs(s - 100) > 0.1 AND s > 0")
    out["repeated_numbers"] = rule(
        11, "0", "numerical", "repeated_numbers", "medium", "least(0.4 + mx * 0.05, 0.8)",
        f"(SELECT doc_id, max(c) AS mx FROM (SELECT doc_id, v, count(*) AS c FROM "
        f"{_unnest(hits('text', C.BIG_NUMBER_PATTERN, False, 1), 'v')} u GROUP BY 1, 2 HAVING count(*) > 2) g GROUP BY 1) t")
    impossible = [p for p, _ in C.IMPOSSIBLE_DATE_PATTERNS]
    # the look-arounds of the third pattern can never fail, so plain two digits say the same
    impossible[2] = r"\b(02[/-]29[/-]\d{2})\b"
    out["impossible_dates"] = rule(
        12, "g", "date", "impossible_dates", "high", "0.9",
        "(" + " UNION ALL ".join(
            f"SELECT doc_id, {i} AS g FROM biz WHERE {found('text', p)}" for i, p in enumerate(impossible)) + ") t")
    out["future_dates"] = rule(
        13, "i", "date", "future_dates", "medium",
        f"least(0.5 + (y - {int(AS_OF[:4]) + C.FUTURE_YEARS}) * 0.02, 0.8)",
        f"(SELECT doc_id, i, year({day('v')}) AS y FROM {_unnest(DATES_LIST, 'v')} u) t "
        f"WHERE y > {int(AS_OF[:4]) + C.FUTURE_YEARS}")
    out["issue_after_expiry"] = rule(
        14, "seq", "date", "issue_after_expiry", "high", "0.85",
        f"(SELECT a.doc_id, a.i * 1000 + b.i AS seq FROM {_unnest(hits('text', C.ISSUE_DATE_PATTERN, True, 1), 'v')} a "
        f"JOIN {_unnest(hits('text', C.EXPIRY_DATE_PATTERN, True, 1), 'v')} b ON a.doc_id = b.doc_id "
        f"WHERE {day('a.v')} > {day('b.v')}) t")
    styles = n_true([found("text", p, ic) for _, p, ic in C.DATE_STYLE_PATTERNS])
    out["inconsistent_date_formats"] = rule(
        15, "0", "date", "inconsistent_date_formats", "low", "0.3 + 0.05 * (n - 1)",
        f"(SELECT doc_id, {styles} AS n FROM biz) t WHERE n > 1")
    ids = _unnest(IDS_LIST, "v")
    out["repeated_ids"] = rule(
        16, "0", "id_reference", "repeated_ids", "medium", "least(0.5 + 0.1 * k, 0.8)",
        f"(SELECT doc_id, count(*) AS k FROM (SELECT doc_id, upper(trim(v)) AS u, count(*) AS c FROM {ids} i "
        f"GROUP BY 1, 2 HAVING count(*) > 1) g GROUP BY 1) t")
    out["malformed_patterns"] = rule(
        17, "0", "id_reference", "malformed_patterns", "medium", "0.7",
        f"(SELECT DISTINCT doc_id FROM (SELECT doc_id, {CLEAN.format('v')} AS c FROM {ids} i) m "
        f"WHERE (length(c) > 3 AND replace(c, left(c, 1), '') = '') OR (length(c) > 4 AND contains('0123456789', c))) t")
    out["inconsistent_ids"] = rule(
        18, "first", "id_reference", "inconsistent_ids", "medium", "0.65",
        f"(SELECT doc_id, p, min(i) AS first FROM (SELECT doc_id, i, rtrim(upper(regexp_extract(v, '^[A-Za-z-]+')), '-') AS p, "
        f"length({CLEAN.format('v')}) AS w FROM {ids} i WHERE regexp_matches(v, '^[A-Za-z-]')) m "
        f"GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT w) > 1) t")
    sections = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS g, {n_true(['NOT ' + found('low', p) for p, _ in pats])} AS n FROM biz "
        f"WHERE {' OR '.join(f'contains(low, {q(w)})' for w in C.SECTION_TRIGGERS[kind])}"
        for i, (kind, pats) in enumerate(C.SECTION_PATTERNS.items()))
    out["missing_sections"] = rule(
        19, "g", "structural", "missing_sections", "medium", "least(0.4 + n * 0.05, 0.75)",
        f"({sections}) t WHERE n >= 2")
    breaks = (
        f"SELECT doc_id, list_transform(brk, lambda i: array_to_string(l[greatest(i - 2, 1):i + 2], ' ')) AS around FROM "
        f"(SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], "
        f"'(?i)^(page\\s*\\d+|---|[*][*][*]|===)$')) AS brk FROM (SELECT doc_id, {lines} AS l FROM biz) a WHERE len(l) >= 10) b")
    out["inconsistent_headers_footers"] = rule(
        20, "0", "structural", "inconsistent_headers_footers", "medium", "0.5",
        f"({breaks}) t WHERE len(around) > 1 AND len(list_distinct(around)) > 1")
    refs = hits("text", C.PAGE_REF_PATTERN, True, 1)
    out["page_numbering_issues"] = rule(
        21, "0", "structural", "page_numbering_issues", "CASE WHEN top IS NULL THEN 'low' ELSE 'medium' END",
        "CASE WHEN top IS NULL THEN 0.4 ELSE 0.55 END",
        f"(SELECT doc_id, page_count, list_max(list_transform({refs}, lambda x: CAST(x AS BIGINT))) AS top FROM biz) t "
        "WHERE (top IS NULL AND page_count > 1) OR abs(top - page_count) > 1")
    out["suspicious_timestamps"] = rule(
        22, "0", "metadata", "suspicious_timestamps", "medium", "0.5",
        f"biz WHERE {day('md_creation_date')} = {day('md_modification_date')}")
    essential = n_true([f"coalesce(md_{k}, '') = ''" for k, _ in C.ESSENTIAL_METADATA])
    out["missing_metadata"] = rule(
        23, "0", "metadata", "missing_metadata", "low", "0.2 + 0.05 * n",
        f"(SELECT doc_id, {essential} AS n FROM biz) t WHERE n > 0")
    out["inconsistent_creator"] = rule(
        24, "0", "metadata", "inconsistent_creator", "medium", "0.55",
        "biz WHERE length(md_creator) > 5 AND length(md_producer) > 5 AND NOT "
        "list_has_any(string_split(lower(md_creator), ' '), string_split(lower(md_producer), ' '))")
    out["compression_artifacts"] = rule(
        25, "0", "visual", "compression_artifacts",
        "CASE WHEN suspicious_region_count < 3 THEN 'medium' ELSE 'high' END",
        "least(0.4 + suspicious_region_count * 0.1, 0.85)", "biz WHERE suspicious_region_count > 0")
    out["low_resolution"] = rule(
        26, "0", "visual", "resolution_issues", "low", "0.4", "biz WHERE width < 300 OR height < 300")
    out["low_ocr_confidence"] = rule(
        27, "0", "visual", "resolution_issues", "medium", "least(0.5 + (0.6 - ocr_confidence), 0.8)",
        "biz WHERE ocr_confidence < 0.6")
    return out


def _amount(regex: str) -> str:
    return f"(SELECT doc_id, i, {money('v')} AS v FROM {_unnest(hits('text', regex, True, 1), 'v')} u)"


def _window(word: str) -> str:
    at = f"instr(low, {q(word)})"
    start = f"greatest({at} - 1 - 200, 0)"
    return f"substring(text, {start} + 1, {at} - 1 + 500 - {start})"


def sentence_groups(source: str) -> str:
    """Documents with repeated sentences: k distinct ones, the most frequent mx times."""
    return (
        f"(SELECT doc_id, count(*) AS k, max(c) AS mx FROM (SELECT doc_id, s, count(*) AS c FROM "
        f"(SELECT doc_id, trim(regexp_replace(lower(t), '[{WS}]+', ' ', 'g')) AS s FROM "
        f"(SELECT doc_id, regexp_replace(regexp_replace(p, '^[{WS}]+', ''), '[{WS}]+$', '') AS t FROM "
        f"(SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+')) AS p FROM {source}) a) b WHERE length(t) > 10) c "
        f"GROUP BY 1, 2 HAVING count(*) > 1) d GROUP BY 1) t")


def mismatch_counts(source: str) -> str:
    first, second = (hits("text", C.TWO_AMOUNTS_PATTERN, False, g) for g in (2, 3))
    return (
        f"SELECT doc_id, len(list_filter(list_zip({first}, {second}), lambda z: "
        f"{money('z[1]')} <> {money('z[2]')})) AS n FROM {source} "
        f"WHERE regexp_matches(text, '\\s[$€£¥₹]?\\s*[\\d,]+\\.?\\d*\\s')")


SEVERITY_RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
WEIGHT = "CASE severity WHEN 'high' THEN 3.0 WHEN 'medium' THEN 2.0 ELSE 1.0 END"


def marker_ctes() -> str:
    """``WITH`` body: biz, then mk with every marker and its rank in the document."""
    union = "\nUNION ALL\n".join(rules().values())
    return (
        f"{BIZ},\nmk0 AS ({union}),\nmk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "
        f"{SEVERITY_RANK}, rule_no, seq) - 1 AS pos FROM mk0)"
    )


ML_NEUTRAL = "CAST(50 AS DOUBLE)"


def scored_ctes() -> str:
    """``WITH`` body: biz, mk, and scored with pillars, risk score, decision, confidence."""
    font = "least(1.0, greatest(font_size_variance / 5.0, 0))"
    align = "least(1.0, greatest(alignment_variance / 3.0, 0))"
    scan = ("CASE WHEN ocr_used THEN least(100.0, (1.0 - least(greatest(coalesce(ocr_confidence, 1.0), 0.0), 1.0)) * 100.0 "
            "+ least(40.0, ocr_pages * 8.0 + image_only_pages * 10.0)) ELSE 0.0 END")
    tab = "CASE WHEN table_count >= 20 THEN 35.0 WHEN table_count >= 8 THEN 20.0 WHEN table_count >= 3 THEN 10.0 ELSE 0.0 END"
    page = "CASE WHEN blank_page_count > 0 THEN least(100.0, 300.0 * blank_page_count / page_count) ELSE 0.0 END"
    structural = (f"CAST(0.4 AS DOUBLE) * (100.0 * (CAST(0.6 AS DOUBLE) * {font} + CAST(0.4 AS DOUBLE) * {align})) + CAST(0.3 AS DOUBLE) * ({scan}) "
                  f"+ CAST(0.2 AS DOUBLE) * ({page}) + CAST(0.1 AS DOUBLE) * ({tab})")
    agg = (
        f"agg AS (SELECT doc_id, count(*) AS n, sum(score * {WEIGHT}) AS w, "
        "count(*) FILTER (category = 'date') AS nd, count(*) FILTER (category = 'numerical') AS nn, "
        "count(*) FILTER (category = 'id_reference') AS ni FROM mk GROUP BY 1)")
    pillars = (
        "pillars AS (SELECT biz.*, coalesce(n, 0) AS n_markers, coalesce(nd, 0) + coalesce(nn, 0) AS total_inconsistencies, "
        "coalesce(ni, 0) AS id_inconsistencies, "
        f"{ML_NEUTRAL} AS ml_risk_score, {half_up('least(100.0, 100.0 * coalesce(w, 0) / 6.0)')} AS marker_risk_score, "
        f"{half_up(structural)} AS structural_risk_score, "
        + half_up("CAST(0.4 AS DOUBLE) * least(100.0, coalesce(nd, 0) * 30.0) + CAST(0.35 AS DOUBLE) * least(100.0, coalesce(nn, 0) * 25.0) "
                  "+ CAST(0.25 AS DOUBLE) * least(100.0, 2 * coalesce(ni, 0) * 20.0)")
        + " AS consistency_risk_score FROM biz LEFT JOIN agg ON agg.doc_id = biz.doc_id)")
    scored = (
        "scored AS MATERIALIZED (SELECT *, CASE WHEN risk_score < 30 THEN 'original' WHEN risk_score < 60 THEN 'suspicious' "
        "ELSE 'forged' END AS decision, " + half_up(
            "least(abs(marker_risk_score - 50.0) / 50.0 * least(1.0, n_markers / 4.0), 1.0)", 4)
        + " AS confidence FROM (SELECT *, " + half_up(
            "CAST(0.4 AS DOUBLE) * ml_risk_score + CAST(0.25 AS DOUBLE) * marker_risk_score + CAST(0.2 AS DOUBLE) * structural_risk_score "
            "+ CAST(0.15 AS DOUBLE) * consistency_risk_score")
        + " AS risk_score FROM pillars) p)")
    return f"{marker_ctes()},\n{agg},\n{pillars},\n{scored}"
