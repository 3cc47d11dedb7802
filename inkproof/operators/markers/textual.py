"""Rules about the wording of a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.functions import text as T
from inkproof.operators.markers.base import emit, join, marker


def inconsistent_terminology(text: Column) -> Column:
    """One marker per concept that is named by at least two of its synonyms."""

    def rule(low: Column) -> Column:
        named = F.array(*[
            F.when(several(low, terms), T.present(low, terms)) for _, terms in C.TERM_GROUPS
        ])
        return F.transform(
            F.filter(named, lambda hit: hit.isNotNull()),
            lambda hit: marker(
                "textual", "inconsistent_terminology", "medium",
                "Same concept referred to by different terms throughout the document",
                F.concat(F.lit("Multiple terms used for same concept: "), join(hit)),
                0.5 + 0.1 * (F.size(hit) - 2),
            ),
        )

    def several(low: Column, terms: list[str]) -> Column:
        """At least two of the terms, without listing them."""
        hits = F.lit(0)
        for word in terms:
            hits = hits + F.when(F.contains(low, F.lit(word)), 1).otherwise(0)
        return hits > 1

    return T.let(F.lower(text), rule)


def suspicious_phrases(text: Column) -> Column:
    return T.let(
        T.let(F.lower(text), lambda low: T.present(low, C.RULE_PHRASES)),
        lambda hit: emit(
            F.size(hit) > 0,
            marker(
                "textual", "suspicious_phrases",
                F.when(F.size(hit) < 3, "medium").otherwise("high"),
                "Document contains phrases commonly found in forged or template documents",
                F.concat(F.lit("Suspicious phrases found: "), join(hit, "; ")),
                F.least(0.5 + 0.1 * F.size(hit), F.lit(0.9)),
            ),
        ),
    )


def repeated_sentence_counts(text: Column) -> Column:
    """Normalised sentences longer than ten characters that occur more than once."""
    long_enough = F.filter(
        F.transform(F.split(text, "[.!?]+"), T.strip), lambda s: F.length(s) > 10
    )
    return T.repeats(F.transform(F.transform(long_enough, F.lower), T.collapse))


def repeated_sentences(text: Column) -> Column:
    def rule(repeated: Column) -> Column:
        most = F.array_max(F.transform(repeated, lambda c: c["n"]))
        top = F.transform(
            T.most_frequent(repeated, 5),
            lambda c: F.format_string('"%s..." (repeated %dx)', F.left(c["value"], F.lit(80)), c["n"]),
        )
        return emit(
            F.size(repeated) > 0,
            marker(
                "textual", "repeated_sentences",
                F.when(most <= 3, "medium").otherwise("high"),
                F.format_string("Found %d sentences repeated (max %d times)", F.size(repeated), most),
                F.concat(F.lit("Repeated sentences: "), join(top, "; ")),
                F.least(0.4 + 0.05 * F.size(repeated) + 0.1 * (most - 2), F.lit(0.85)),
            ),
        )

    return T.let(repeated_sentence_counts(text), rule)


def capital_line_counts(text: Column) -> Column:
    """struct(caps, total) over lines of more than three characters."""
    lines = F.filter(
        F.transform(F.split(text, "\n"), T.strip), lambda line: F.length(line) > 3
    )
    return T.let(
        lines,
        lambda kept: F.struct(
            F.size(F.filter(kept, T.is_upper)).alias("caps"), F.size(kept).alias("total")
        ),
    )


def abnormal_capitalization(text: Column) -> Column:
    def rule(n: Column) -> Column:
        share = n["caps"] / F.greatest(n["total"], F.lit(1))
        return emit(
            share > 0.4,
            marker(
                "textual", "abnormal_capitalization",
                F.when(share > 0.6, "high").otherwise("medium"),
                F.format_string("Abnormal capitalization: %d/%d lines are all-caps", n["caps"], n["total"]),
                F.concat(
                    F.lit("All-caps ratio: "), T.percent_text(share),
                    F.format_string(" (%d of %d lines)", n["caps"], n["total"]),
                ),
                F.least(0.3 + share, F.lit(0.8)),
            ),
        )

    return T.let(capital_line_counts(text), rule)


def exclamation_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "!", ""))


def ellipsis_count(text: Column) -> Column:
    """Non-overlapping runs of three dots."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit("..."), F.lit("")))) / 3)


def excessive_punctuation(text: Column) -> Column:
    shouting, trailing = exclamation_count(text), ellipsis_count(text)
    return F.concat(
        emit(
            shouting > 10,
            marker(
                "textual", "excessive_punctuation", "low",
                "Excessive use of exclamation marks",
                F.format_string("Found %d exclamation marks in document", shouting),
                F.least(0.3 + shouting * 0.02, F.lit(0.7)),
            ),
        ),
        emit(
            trailing > 5,
            marker(
                "textual", "excessive_punctuation", "low",
                "Excessive use of ellipsis",
                F.format_string("Found %d ellipsis sequences", trailing),
                F.least(0.3 + trailing * 0.03, F.lit(0.7)),
            ),
        ),
    )


def template_hits(text: Column) -> Column:
    """``array<struct<label, n>>`` of the placeholder families present."""

    def count(low: Column, regex: str) -> Column:
        # upper and lower case of other alphabets fold in more ways than lower() knows
        absent = T.is_ascii(text) & ~T.contains_any(low, C.TEMPLATE_WORDS[regex])
        return F.when(absent, F.lit(0)).otherwise(T.count_matches(text, regex, True))

    return T.let(F.lower(text), lambda low: F.filter(
        F.array(*[
            F.struct(F.lit(label).alias("label"), count(low, regex).alias("n"))
            for regex, label in C.TEMPLATE_PATTERNS
        ]),
        lambda h: h["n"] > 0,
    ))


def template_like_language(text: Column) -> Column:
    return T.let(
        template_hits(text),
        lambda hit: emit(
            F.size(hit) > 0,
            marker(
                "textual", "template_like_language", "medium",
                "Document contains template-like language patterns",
                F.concat(
                    F.lit("Template indicators: "),
                    join(F.transform(hit, lambda h: F.format_string("%s (%d occurrences)", h["label"], h["n"])), "; "),
                ),
                F.least(0.4 + 0.05 * F.size(hit), F.lit(0.8)),
            ),
        ),
    )


def textual_rules(text: Column) -> Column:
    return F.concat(
        inconsistent_terminology(text), suspicious_phrases(text), repeated_sentences(text),
        abnormal_capitalization(text), excessive_punctuation(text), template_like_language(text),
    )
