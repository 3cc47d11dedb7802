"""Rules about amounts, percentages and repeated numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.functions import text as T
from inkproof.operators.markers.base import emit, emit_many, join, marker, none


def amounts(text: Column, regex: str) -> Column:
    """Parsed amounts captured by a labelled-amount pattern."""
    return F.filter(
        F.transform(T.find_all(text, regex, 1, True), T.parse_money), lambda v: v.isNotNull()
    )


def total_mismatches(text: Column) -> Column:
    """``array<struct<sub, tax, total, diff>>``: every stated triple off by more than 1 %."""

    def per_sub(a: Column) -> Column:
        return F.flatten(F.transform(a["subs"], lambda s: F.flatten(F.transform(
            a["taxes"],
            lambda x: F.transform(
                F.filter(
                    a["totals"],
                    lambda t: (s + x > 0) & (F.abs(s + x - t) / F.nullif(s + x, F.lit(0.0)) > 0.01),
                ),
                lambda t: F.struct(
                    s.alias("sub"), x.alias("tax"), t.alias("total"),
                    (F.abs(s + x - t) / F.nullif(s + x, F.lit(0.0))).alias("diff"),
                ),
            ),
        ))))

    found = F.struct(
        amounts(text, C.SUBTOTAL_PATTERN).alias("subs"),
        amounts(text, C.TAX_PATTERN).alias("taxes"),
        amounts(text, C.TOTAL_PATTERN).alias("totals"),
    )
    return T.let(found, per_sub)


def inconsistent_totals(text: Column) -> Column:
    marked = F.transform(
        total_mismatches(text),
        lambda m: marker(
            "numerical", "inconsistent_totals",
            F.when(m["diff"] > 0.05, "high").otherwise("medium"),
            "Subtotal + tax does not equal stated total",
            F.concat(
                F.lit("Subtotal ("), T.float_text(m["sub"]), F.lit(") + Tax ("), T.float_text(m["tax"]),
                F.lit(") = "), T.float_text(m["sub"] + m["tax"]), F.lit(", but Total shows "),
                T.float_text(m["total"]), F.lit(" (difference: "), T.percent_text(m["diff"]), F.lit(")"),
            ),
            F.least(0.6 + m["diff"] * 2, F.lit(0.95)),
        ),
    )
    return emit_many(T.matches(text, r"sub\s*total", True), marked)


def amount_pairs(text: Column) -> Column:
    """``array<struct<item, first, second>>`` where a line states two different amounts.

    The lazy pattern can only start where a line starts or where the previous match ended,
    so it is anchored there; an unanchored search would rescan each line per character.
    """
    anchored = r"(?:(?m:^)|\G)" + C.TWO_AMOUNTS_PATTERN

    def group(m: Column, i: int) -> Column:
        return T.by_alphabet(m, C.TWO_AMOUNTS_PATTERN, False, lambda p: F.call_function("regexp_extract", m, p, F.lit(i)))

    stated = F.transform(
        T.find_all(text, anchored, 0),
        lambda m: F.struct(m.alias("m"), T.parse_money(group(m, 2)).alias("first"), T.parse_money(group(m, 3)).alias("second")),
    )
    # no match is possible without a number between white space
    possible = T.matches(text, r"\s[$€£¥₹]?\s*[\d,]+\.?\d*\s")
    return F.when(possible, F.transform(
        F.filter(stated, lambda h: h["first"] != h["second"]),
        lambda h: F.struct(T.strip(group(h["m"], 1)).alias("item"), h["first"].alias("first"), h["second"].alias("second")),
    ))


def amount_mismatches(text: Column) -> Column:
    def rule(bad: Column) -> Column:
        shown = F.transform(
            F.slice(bad, 1, 5),
            lambda m: F.concat(
                F.lit('"'), F.left(m["item"], F.lit(50)), F.lit('": '),
                T.float_text(m["first"]), F.lit(" vs "), T.float_text(m["second"]),
            ),
        )
        return emit(
            F.size(bad) > 0,
            marker(
                "numerical", "amount_mismatches", "high",
                F.format_string("Found %d line items with different amounts", F.size(bad)),
                F.concat(F.lit("Amount mismatches found: "), join(shown, "; ")),
                F.least(0.6 + 0.05 * F.size(bad), F.lit(0.9)),
            ),
        )

    return T.let(amount_pairs(text), rule)


def percentages_near(text: Column, word: str) -> Column:
    """Percentages in the 200 characters before and 500 after the word's first mention."""

    def window(at: Column) -> Column:
        start = F.greatest(at - 1 - 200, F.lit(0))
        return F.substring(text, start + 1, at - 1 + 500 - start)

    found = T.let(
        F.instr(F.lower(text), F.lit(word)),
        lambda at: T.find_all(window(at), C.PERCENT_PATTERN, 1),
    )
    return F.filter(
        F.transform(found, lambda v: v.try_cast("double")), lambda v: v.isNotNull()
    )


def percentage_inconsistencies(text: Column) -> Column:
    def one(word: str) -> Column:
        def rule(values: Column) -> Column:
            total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
            return T.let(total, lambda s: emit(
                (F.size(values) > 1) & (F.abs(s - 100) > 0.1) & (s > 0),
                marker(
                    "numerical", "percentage_inconsistencies", "medium",
                    "Allocation percentages do not sum to 100%",
                    F.concat(
                        F.lit(f"Percentages near '{word}' section sum to "),
                        F.format_string("%.1f%% instead of 100%% (values: [", s),
                        join(F.transform(values, T.float_text)), F.lit("])"),
                    ),
                    F.least(0.5 + F.abs(s - 100) * 0.02, F.lit(0.85)),
                ),
            ))

        return F.when(
            F.contains(F.lower(text), F.lit(word)), T.let(percentages_near(text, word), rule)
        ).otherwise(none())

    return emit_many(F.contains(text, F.lit("%")), F.concat(*[one(w) for w in C.ALLOCATION_WORDS]))


def repeated_number_counts(text: Column) -> Column:
    return T.repeats(T.find_all(text, C.BIG_NUMBER_PATTERN, 1), 2)


def repeated_numbers(text: Column) -> Column:
    def rule(repeated: Column) -> Column:
        most = F.array_max(F.transform(repeated, lambda c: c["n"]))
        top = F.transform(
            T.most_frequent(repeated, 5),
            lambda c: F.format_string("%s (appears %dx)", c["value"], c["n"]),
        )
        return emit(
            F.size(repeated) > 0,
            marker(
                "numerical", "repeated_numbers", "medium",
                F.format_string("Found %d numbers repeated 3+ times", F.size(repeated)),
                F.concat(F.lit("Repeated numbers: "), join(top, "; ")),
                F.least(0.4 + most * 0.05, F.lit(0.8)),
            ),
        )

    return T.let(repeated_number_counts(text), rule)


def numerical_rules(text: Column) -> Column:
    rules = F.concat(
        inconsistent_totals(text), amount_mismatches(text),
        percentage_inconsistencies(text), repeated_numbers(text),
    )
    # an amount may also be written with commas only, which parses to nothing
    return emit_many(T.matches(text, r"\d"), rules)
