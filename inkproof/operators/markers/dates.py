"""Rules about dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.functions import text as T
from inkproof.functions.dates import parse_date
from inkproof.operators.markers.base import emit, emit_many, join, marker, none


def impossible_dates(text: Column) -> Column:
    """One marker per impossible-date pattern found; evidence lists three matches."""

    def hits(short: Column, regex: str) -> Column:
        if "$" in regex:  # looks at the end of the text
            return F.when(T.contains_any(text, ["02/29", "02-29"]), T.find_all(text, regex, 1))
        return T.find_all(short, regex, 1)

    return T.let(T.numeric_dates(text), lambda short: F.when(short == "", none()).otherwise(F.concat(*[
        T.let(
            hits(short, regex),
            lambda hit: emit(
                F.size(hit) > 0,
                marker(
                    "date", "impossible_dates", "high", "Document contains impossible dates",
                    F.concat(F.lit(f"{label}: "), join(F.slice(hit, 1, 3))), 0.9,
                ),
            ),
        )
        for regex, label in C.IMPOSSIBLE_DATE_PATTERNS
    ])))


def future_dates(text: Column, as_of: Column) -> Column:
    """One marker per date more than five years after ``as_of``; overlapping patterns repeat."""
    parsed = F.transform(
        T.date_strings(text),
        lambda s: F.struct(s.alias("raw"), F.year(parse_date(s)).alias("year")),
    )
    now = F.year(as_of)
    return F.transform(
        F.filter(parsed, lambda p: p["year"] > now + C.FUTURE_YEARS),
        lambda p: marker(
            "date", "future_dates", "medium", "Document contains dates far in the future",
            F.format_string(
                "Future date found: %s (%d, %d years from now)", p["raw"], p["year"], p["year"] - now
            ),
            F.least(0.5 + (p["year"] - now - C.FUTURE_YEARS) * 0.02, F.lit(0.8)),
        ),
    )


def inverted_date_pairs(text: Column) -> Column:
    """``array<struct<issue, expiry>>``: every issue date later than some expiry date."""

    def dated(regex: str) -> Column:
        return F.transform(
            T.find_all(text, regex, 1, True),
            lambda s: F.struct(s.alias("raw"), parse_date(s).alias("day")),
        )

    pair = F.struct(dated(C.ISSUE_DATE_PATTERN).alias("issues"), dated(C.EXPIRY_DATE_PATTERN).alias("expiries"))
    return T.let(pair, lambda p: F.flatten(F.transform(
        p["issues"],
        lambda i: F.transform(
            F.filter(p["expiries"], lambda e: i["day"] > e["day"]),
            lambda e: F.struct(i["raw"].alias("issue"), e["raw"].alias("expiry")),
        ),
    )))


def issue_after_expiry(text: Column) -> Column:
    return F.transform(
        inverted_date_pairs(text),
        lambda p: marker(
            "date", "issue_after_expiry", "high", "Issue date appears after expiry date",
            F.concat(
                F.lit("Issue date ("), p["issue"], F.lit(") is after expiry date ("),
                p["expiry"], F.lit(")"),
            ),
            0.85,
        ),
    )


def date_styles(text: Column) -> Column:
    styles: dict[tuple[str, bool], list[str]] = {}  # neighbours that share a pattern are looked for once
    for name, regex, ic in C.DATE_STYLE_PATTERNS:
        styles.setdefault((regex, ic), []).append(name)

    def known(searched: Column, ignore_case: bool) -> Column:
        return F.flatten(F.array(*[
            F.when(T.matches(searched, regex, ic), F.array(*[F.lit(n) for n in names])).otherwise(F.array().cast("array<string>"))
            for (regex, ic), names in styles.items() if ic == ignore_case
        ]))

    none = F.array().cast("array<string>")
    numeric = T.let(T.numeric_dates(text), lambda short: F.when(short == "", none).otherwise(known(short, False)))
    return F.concat(numeric, F.when(T.matches(text, T.MONTH_DATE_GUARD, True), known(text, True)).otherwise(none))


def inconsistent_date_formats(text: Column) -> Column:
    return T.let(
        date_styles(text),
        lambda styles: emit(
            F.size(styles) > 1,
            marker(
                "date", "inconsistent_date_formats", "low",
                "Document uses inconsistent date formatting",
                F.concat(F.lit("Multiple date formats used: "), join(styles)),
                0.3 + 0.05 * (F.size(styles) - 1),
            ),
        ),
    )


def dates_rules(text: Column, as_of: Column) -> Column:
    rules = F.concat(
        impossible_dates(text), future_dates(text, as_of),
        issue_after_expiry(text), inconsistent_date_formats(text),
    )
    return emit_many(T.matches(text, r"\d"), rules)
