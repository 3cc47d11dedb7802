"""Column builders for text: Python-compatible whitespace, case and regex semantics.

Java's ``\\s \\d \\w`` are ASCII and its ``.``/``$`` know more line ends than Python's,
so every pattern gets the ``U`` (Unicode classes) and ``d`` (only ``\\n`` ends a line)
flags.  All functions return JVM-side expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.functions.constants import (
    DATE_PATTERNS, WHITESPACE_CHARS, WHITESPACE_CLASS,
)

UPPER = r"\p{Lu}\x{2160}-\x{216f}\x{24b6}-\x{24cf}"
LOWER = r"\p{Ll}\p{Lt}\x{aa}\x{ba}"

# Every date with a month name satisfies this cheap scan: a word whose first three letters
# could be a month, followed by a digit.
MONTH_DATE_GUARD = r"[jfmasond][aepuco][nbrylgptvc][a-z]*\.?\s+\d"


#: How a pattern begins, and the class of the first character of all its matches.
FIRST_CHARACTERS = [
    (r"\b(\d", r"\d"), (r"\b\d", r"\d"), (r"\b((?:Jan", "[JFMASOND]"), (r"\b(?:Jan", "[JFMASOND]"), (r"\b((?:INV", "[IBPRNST#]"),
    (r"\b([A-Z]", "[A-Z]"), (r"\b([A-Z0-9]", "[A-Z0-9]"), (r"\b[A-Z]", "[A-Z]"), (r"\b[a-zA-Z]", "[a-zA-Z]"),
    (r"\b(02", "0"), (r"\b(0[469]|11)", "[01]"), (r"\b(1[", "1"), (r"\b(?:\d", r"[\dJFMASOND]"), (r"\b(?:[A-Z]", "[A-Z]"),
    ("[$€£¥₹]\\s*\\d[\\d,]*\\.?\\d*|", "[$€£¥₹\\ddepyr]"), ("(?:sub", "s"), ("(?:tax", "[tvg]"), ("(?:total|grand", "[tgab]"),
    ("(?:issue|issue", "[iefs]"), ("(?:expir|expir", "[evu]"), ("(?:page|p", "p"),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression once and use it many times inside ``body``.

    A plain column would be inlined by the optimizer into every lambda that uses it and
    be recomputed per element; a one-element array keeps the value outside the lambda.
    """
    return F.transform(F.array(value), body)[0]


def explode_rows(df: DataFrame, array: Column, *keys: str) -> DataFrame:
    """One row per array element: the keys, ``pos`` and the element ``m``.

    A plain explode makes the optimizer add a size check on the array and push it below,
    where the whole array expression is computed again.  The outer form plus a filter on
    its output computes it once.
    """
    return df.select(*keys, F.posexplode_outer(array).alias("pos", "m")).where(F.col("m").isNotNull())


def computed_once(df: DataFrame, keys: list[str] | None = None, wanted: list[str] | None = None) -> DataFrame:
    """Stop later filters from being pushed below, and so repeating, costly projections.

    ``keys`` are plain columns that stay outside: filters on them still go below.  Of the others
    only those ``wanted`` are computed.
    """
    keys = [k for k in keys or [] if k in df.columns]
    costly = [c for c in df.columns if c not in keys and (wanted is None or c in wanted)]
    row = F.explode_outer(F.array(F.struct(*costly))).alias("row")
    return df.select(*keys, row).select(*keys, "row.*")


def led(regex: str) -> str:
    """The pattern behind a look at the first character, far cheaper than a word border or a list of words at every place."""
    first = next((c for head, c in FIRST_CHARACTERS if regex.startswith(head)), None)
    return f"(?={first})(?:{regex})" if first else regex


def pattern(regex: str, ignore_case: bool = False) -> Column:
    return F.lit(f"(?U{'i' if ignore_case else ''}d){led(regex)}")


def is_ascii(text: Column) -> Column:
    return F.lit(True) if _plain else F.octet_length(text) == F.length(text)


#: Set while columns are built that only see texts of ASCII.
_plain = False


@contextmanager
def plain_texts():
    global _plain
    before, _plain = _plain, True
    try:
        yield
    finally:
        _plain = before


def by_text(text: Column, build: Callable[[Column], Column]) -> Column:
    """build(text), made once for texts of ASCII and once for all others.

    ``build`` may search the text and what it takes from it, nothing else: a search then need not look at its string first.
    """
    with plain_texts():
        plain = build(text)
    return F.when(is_ascii(text), plain).otherwise(build(text))


def by_alphabet(text: Column, regex: str, ignore_case: bool, build: Callable[[Column], Column]) -> Column:
    """build(pattern), with the costly Unicode classes and case folding only where the text has more than ASCII."""
    plain = F.lit(f"(?{'i' if ignore_case else ''}d){led(regex)}")
    if _plain:
        return build(plain)
    return F.when(is_ascii(text), build(plain)).otherwise(build(pattern(regex, ignore_case)))


def matches(text: Column, regex: str, ignore_case: bool = False) -> Column:
    return by_alphabet(text, regex, ignore_case, lambda p: F.regexp_like(text, p))


def count_matches(text: Column, regex: str, ignore_case: bool = False) -> Column:
    return by_alphabet(text, regex, ignore_case, lambda p: F.regexp_count(text, p))


def find_all(text: Column, regex: str, group: int = 0, ignore_case: bool = False) -> Column:
    return by_alphabet(text, regex, ignore_case, lambda p: F.regexp_extract_all(text, p, F.lit(group)))


def find_each(text: Column, patterns: list[tuple[str, bool]], group: int = 1) -> Column:
    """All matches of several patterns, pattern by pattern."""
    return F.concat(*[find_all(text, p, group, ic) for p, ic in patterns])


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def leading_words(regex: str) -> list[str]:
    """The literal word every alternative of a ``\\bword...|\\bword...`` pattern starts with."""
    heads = []
    for branch in re.split(r"\|(?![^(]*\))", regex):
        word = re.match(r"\\b([a-z]{2,})", branch).group(1)
        optional = re.match(r"\\b[a-z]+[?*]", branch)
        heads.append(word[:-1] if optional else word)
    return heads


def begun_words(low: Column, heads: list[str]) -> Column:
    """The distinct heads that words of a lower-cased text begin with, the longest for each word; one search for all heads."""
    by_letter: dict[str, list[str]] = {}
    for head in sorted(set(heads), key=lambda h: (-len(h), h)):
        by_letter.setdefault(head[0], []).append(head[1:])
    tree = "|".join(f"{letter}(?:{'|'.join(tails)})" for letter, tails in sorted(by_letter.items()))
    letters = "".join(sorted(by_letter))
    return F.array_distinct(find_all(low, rf"(?=[{letters}])\b(?:{tree})"))


def where_begun(begun: Column, heads: list[str], regex: str, found: Column, absent: float) -> Column:
    """``found`` only where :func:`begun_words` of all heads has one that the pattern leads with, else ``absent``.

    Most patterns have no hit in most documents.  ``begun`` is the heads joined by :func:`as_line`.
    """
    led_by = sorted({h for h in heads if h.startswith(tuple(leading_words(regex)))})
    # a head that another one of the list begins with stands for both
    shortest = [h for h in led_by if not any(h != o and h.startswith(o) for o in led_by)]
    return F.when(contains_any(begun, [f"|{h}" for h in shortest]), found).otherwise(F.lit(absent))


def as_line(heads: Column) -> Column:
    """Heads of :func:`begun_words` as one string, each after a bar."""
    return F.concat(F.lit("|"), F.array_join(heads, "|"))


def date_strings(text: Column) -> Column:
    """Date strings of the six overlapping layouts, layout by layout."""
    none = F.array().cast("array<string>")
    numeric = let(numeric_dates(text), lambda short: find_each(short, DATE_PATTERNS[:2]))
    named = F.when(matches(text, MONTH_DATE_GUARD, True), find_each(text, DATE_PATTERNS[2:])).otherwise(none)
    return F.when(matches(text, r"\d"), F.concat(numeric, named)).otherwise(none)


def numeric_dates(text: Column) -> Column:
    """The places that can hold a date of digits and marks, each up to the end of its word, parted by blanks.

    Patterns that only know digits, ``/``, ``-`` and word borders find here what they find in the whole text.
    """
    return F.array_join(find_all(text, r"\b\d{1,4}[/-]\d[\w/-]*+"), " ")


def strip(text: Column) -> Column:
    blanks = "".join(c for c in WHITESPACE_CHARS if c.isascii()) if _plain else WHITESPACE_CHARS
    return F.btrim(text, F.lit(blanks))


def collapse(text: Column) -> Column:
    """Strip and join whitespace-separated tokens by one blank."""
    joined = by_alphabet(text, f"[{WHITESPACE_CLASS}]+", False, lambda p: F.regexp_replace(text, p, F.lit(" ")))
    return F.btrim(joined, F.lit(" "))


def tokens(text: Column) -> Column:
    return find_all(text, f"[^{WHITESPACE_CLASS}]+")


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def is_upper(text: Column) -> Column:
    """At least one upper-case letter and no lower-case one."""
    upper, lower = ("A-Z", "a-z") if _plain else (UPPER, LOWER)
    return F.regexp_like(text, F.lit(f"[{upper}]")) & ~F.regexp_like(text, F.lit(f"[{lower}]"))


def chars_kept(text: Column, drop_class: str) -> Column:
    """Number of characters left after dropping runs of a character class."""
    return by_alphabet(text, f"[{drop_class}]+", False, lambda p: F.length(F.regexp_replace(text, p, F.lit(""))))


def present(text: Column, words: list[str]) -> Column:
    """The given words that occur in the text, in the given order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))


def value_counts(values: Column) -> Column:
    """``array<struct<value, n, first>>``: distinct values with count and first position.

    Sorts once and cuts the sorted array at value changes, so a row costs n log n and
    nothing is shuffled.  Elements come out in value order.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i)["value"] != F.get(ordered, i - 1)["value"]),
        )
        return let(
            starts,
            lambda cut: F.transform(
                cut,
                lambda start, j: F.struct(
                    F.get(ordered, start)["value"].alias("value"),
                    (F.coalesce(F.get(cut, j + 1), F.size(ordered)) - start).alias("n"),
                    F.get(ordered, start)["first"].alias("first"),
                ),
            ),
        )

    tagged = F.sort_array(
        F.transform(values, lambda v, i: F.struct(v.alias("value"), i.alias("first")))
    )
    return let(tagged, lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(
        F.filter(F.transform(s, lambda e: F.struct(
            e["value"].alias("value"), e["first"].alias("n"), e["first"].alias("first")
        )), lambda e: F.lit(False))
    ))


def repeats(values: Column, more_than: int = 1) -> Column:
    """:func:`value_counts` of the values that occur more often; nothing is sorted where all are distinct."""
    none = F.array().cast("array<struct<value:string,n:int,first:int>>")
    return let(values, lambda v: F.when(
        F.size(F.array_distinct(v)) < F.size(v), F.filter(value_counts(v), lambda c: c["n"] > more_than)
    ).otherwise(none))


def most_frequent(counts: Column, limit: int) -> Column:
    """Top entries of :func:`value_counts`, ties by first appearance."""
    ranked = F.sort_array(
        F.transform(counts, lambda c: F.struct((-c["n"]).alias("k"), c["first"].alias("first"),
                                               c["value"].alias("value"), c["n"].alias("n")))
    )
    return F.slice(ranked, 1, limit)


def repeated_value_count(values: Column) -> Column:
    """How many distinct values occur more than once."""
    return let(
        F.sort_array(values),
        lambda s: F.when(
            F.size(s) > 1,
            F.size(
                F.filter(
                    F.sequence(F.lit(1), F.size(s) - 1),
                    lambda i: (F.get(s, i) == F.get(s, i - 1))
                    & ((i == 1) | (F.get(s, i - 2) != F.get(s, i))),
                )
            ),
        ).otherwise(F.lit(0)),
    )


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def float_text(value: Column) -> Column:
    """A double as Python prints it: ``115.0``, ``12500000.0``."""
    plain = value.cast("string")
    wide = F.regexp_replace(value.try_cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.abs(value).between(1e-3, 9999999.0) | (value == 0), plain).otherwise(
        F.coalesce(wide, plain)
    )


def percent_text(ratio: Column) -> Column:
    return F.format_string("%.1f%%", ratio * 100)


def parse_money(text: Column) -> Column:
    """Amount string to double; NULL when nothing numeric is left."""
    return F.regexp_replace(text, r"(?U)[,$€£¥₹\s]", "").try_cast("double")
