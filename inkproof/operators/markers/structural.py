"""Rules about sections, page breaks and page numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.functions import text as T
from inkproof.operators.markers.base import emit, emit_many, join, marker


def has_section(low: Column, regex: str) -> Column:
    """A match in lower-cased text; alternatives that are plain words are looked for as such first."""
    options = regex[3:-1].split("|") if re.fullmatch(r"\(\?:[^()]*\)", regex) else []
    words = [o for o in options if re.fullmatch("[a-z/]+", o)]
    if not words:
        return T.matches(low, regex)
    plain = T.contains_any(low, words)
    return plain if len(words) == len(options) else plain | T.matches(low, regex)


def missing_section_names(low: Column, kind: str) -> Column:
    return F.array_compact(F.array(*[
        F.when(~has_section(low, regex), F.lit(name)) for regex, name in C.SECTION_PATTERNS[kind]
    ]))


def missing_sections(text: Column) -> Column:
    """One marker per document kind the text resembles with two or more sections absent."""

    def one(low: Column, kind: str) -> Column:
        resembles = T.contains_any(low, C.SECTION_TRIGGERS[kind])
        missing = T.let(
            missing_section_names(low, kind),
            lambda gone: emit(
                F.size(gone) >= 2,
                marker(
                    "structural", "missing_sections", "medium",
                    F.format_string("Document may be missing %d expected sections", F.size(gone)),
                    F.concat(F.lit("Potentially missing sections: "), join(gone)),
                    F.least(0.4 + F.size(gone) * 0.05, F.lit(0.75)),
                ),
            ),
        )
        return emit_many(resembles, missing)

    return T.let(
        F.lower(text), lambda low: F.concat(*[one(low, kind) for kind in C.SECTION_PATTERNS])
    )


def page_break_contexts(text: Column) -> Column:
    """Stripped text of the two lines around every page-break line."""

    def contexts(lines: Column) -> Column:
        at = F.filter(
            F.sequence(F.lit(0), F.size(lines) - 1),
            lambda i: T.matches(F.get(lines, i), C.PAGE_BREAK_PATTERN, True),
        )
        return F.transform(
            at,
            lambda i: F.array_join(
                F.slice(lines, F.greatest(i - 2, F.lit(0)) + 1, i + 3 - F.greatest(i - 2, F.lit(0))), " "
            ),
        )

    return T.let(
        F.transform(F.split(text, "\n"), T.strip),
        lambda lines: F.when(F.size(lines) >= 10, contexts(lines)),
    )


def inconsistent_headers_footers(text: Column) -> Column:
    return T.let(
        page_break_contexts(text),
        lambda around: emit(
            (F.size(around) > 1) & (F.size(F.array_distinct(around)) > 1),
            marker(
                "structural", "inconsistent_headers_footers", "medium",
                "Headers or footers appear inconsistent across pages",
                F.format_string("Found %d page breaks with varying surrounding content", F.size(around)),
                0.5,
            ),
        ),
    )


def page_refs(text: Column) -> Column:
    return T.find_all(text, C.PAGE_REF_PATTERN, 1, True)


def page_numbering_issues(text: Column, page_count: Column) -> Column:
    pages = F.greatest(F.coalesce(page_count, F.lit(1)).cast("int"), F.lit(1))

    def rule(refs: Column) -> Column:
        # digits beyond 38 places exceed any page count as well
        top = F.array_max(F.transform(
            refs, lambda p: F.coalesce(p.try_cast("decimal(38,0)"), F.lit("9" * 38).cast("decimal(38,0)"))
        ))
        return F.concat(
            emit(
                (F.size(refs) == 0) & (pages > 1),
                marker(
                    "structural", "page_numbering_issues", "low",
                    "Multi-page document has no page numbers",
                    F.format_string("Document has %d pages but no page number references found", pages),
                    0.4,
                ),
            ),
            emit(
                F.abs(top - pages) > 1,
                marker(
                    "structural", "page_numbering_issues", "medium",
                    "Page numbers don't match page count",
                    F.concat(
                        F.lit("Max page reference is "), top.cast("string"),
                        F.format_string(" but document has %d pages", pages),
                    ),
                    0.55,
                ),
            ),
        )

    return T.let(page_refs(text), rule)


def structural_rules(text: Column, page_count: Column) -> Column:
    return F.concat(
        missing_sections(text), inconsistent_headers_footers(text),
        page_numbering_issues(text, page_count),
    )
