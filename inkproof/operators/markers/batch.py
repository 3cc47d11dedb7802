"""The rules that read the text, for whole Arrow batches of ASCII texts.

The modules beside this one say in columns what each rule finds; here the same is found text by text in Python, whose
searches over short strings cost a fraction of evaluating the columns.  A text that this cannot say exactly (amounts
beyond the digits of a double) comes back as null and is left to the columns.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark import cloudpickle

from inkproof.functions.constants import (
    ALLOCATION_WORDS, DATE_PATTERNS, DATE_STYLE_PATTERNS, EXPIRY_DATE_PATTERN, FUTURE_YEARS, IMPOSSIBLE_DATE_PATTERNS, ISSUE_DATE_PATTERN,
    MONTH_ABBR, MONTH_FULL, PAGE_BREAK_PATTERN, PERCENT_PATTERN, RULE_PHRASES, SECTION_PATTERNS, SECTION_TRIGGERS, TAX_PATTERN, TEMPLATE_PATTERNS,
    TEMPLATE_WORDS, TERM_GROUPS, TOTAL_PATTERN,
)

# executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The families found here, in the order they are reported.
FAMILIES = ("textual", "numerical", "date", "id_reference", "structural")
MARKER = pa.struct([
    ("category", pa.string()), ("name", pa.string()), ("severity", pa.string()), ("description", pa.string()),
    ("evidence", pa.string()), ("score", pa.float64()), ("page_number", pa.int32()),
])
#: Terms of a concept, each with the place of a term before it that it holds: without that one it cannot be there.
TERMS = [[(w, next((j for j in range(i) if terms[j] in w), None)) for i, w in enumerate(terms)] for _, terms in TERM_GROUPS]
#: From this amount on the columns decide.
EXACT = 1e15


class Inexact(Exception):
    """The columns have to decide about a text."""


def searched(regex: str, ignore_case: bool = False) -> re.Pattern:
    return re.compile(regex, re.ASCII | re.IGNORECASE if ignore_case else re.ASCII)


# --- patterns; those for lower-cased texts are written in lower case ---------------------
# A pattern that begins with its first character and looks back from there is searched for far faster than one that
# begins with a word border: ``x(?<!\w.)`` is ``\bx`` for a letter or a digit x.

DIGIT = searched("[0-9]")
TEMPLATES = [(TEMPLATE_WORDS[p], searched(p, True), label) for p, label in TEMPLATE_PATTERNS]
SUBTOTAL = searched(r"sub\s*total[:\s]*\$?\s*([\d,]+\.?\d*)")
TAX, TOTAL = searched(TAX_PATTERN), searched(TOTAL_PATTERN)
#: For texts with none of the other words that TAX and TOTAL know.
TAX_ALONE, TOTAL_ALONE = (searched(word + r"[:\s]*\$?\s*([\d,]+\.?\d*)") for word in ("tax", "total"))
#: What follows the item in TWO_AMOUNTS_PATTERN.
TWO_AMOUNTS_REST = searched(r"\s+\$?\s*([\d,]+\.?\d*)\s+.*?\$?\s*([\d,]+\.?\d*)")
PERCENT = searched(PERCENT_PATTERN)
BIG_NUMBER = searched(r"\d(?<!\w.)\d{3,}\b")
DATE_PLACES = searched(r"\d(?<!\w.)\d{0,3}[/-]\d[\w/-]*+")
IMPOSSIBLE_DATES = [(searched(p), label, "$" in p) for p, label in IMPOSSIBLE_DATE_PATTERNS]
NUMERIC_DATES = [searched(p) for p, _ in DATE_PATTERNS[:2]]
MONTH_DATE = searched(r"[jfmasond][aepuco][nbrylgptvc][a-z]*\.?\s+\d")
NAMED_DATES = [searched(p, True) for p, _ in DATE_PATTERNS[2:]]
ISSUE_DATE, EXPIRY_DATE = searched(ISSUE_DATE_PATTERN), searched(EXPIRY_DATE_PATTERN)


def _styles(folded: bool) -> list[tuple[re.Pattern, list[str]]]:
    """Patterns with the names of the styles that share them."""
    names: dict[str, list[str]] = {}
    for name, regex, ignore_case in DATE_STYLE_PATTERNS:
        if ignore_case == folded:
            names.setdefault(regex, []).append(name)
    return [(searched(regex, folded), shared) for regex, shared in names.items()]


NUMERIC_STYLES, NAMED_STYLES = _styles(False), _styles(True)
CODE_ID = searched(r"[A-Z](?<!\w.)[A-Z]{1,3}-?\d{4,12}\b")
TAGGED_ID = searched(
    r"(?:i(?<!\w.)(?:nv-?|d-?)|b(?<!\w.)ill-?|p(?<!\w.)o-?|r(?<!\w.)ef-?|n(?<!\w.)(?:o|um)\.?|s(?<!\w.)n-?|t(?<!\w.)xn-?|#(?<=\w.))"
    r"\s*-?\d{3,12}\b")
NOT_IN_ID = searched("[^a-zA-Z0-9]")
ONE_CHARACTER = searched(r"^(.)\1{3,}$")
ID_PREFIX = searched("[A-Za-z-]+")
PAGE_REF = searched(r"p(?:age|\.?)\s*(\d+)")
PAGE_BREAK = searched(PAGE_BREAK_PATTERN)


def _section(regex: str) -> tuple[list[str], re.Pattern | None]:
    """Plain words of a section's pattern, and the pattern if it has more than those."""
    options = regex[3:-1].split("|") if re.fullmatch(r"\(\?:[^()]*\)", regex) else []
    words = [o for o in options if re.fullmatch("[a-z/]+", o)]
    return words, None if words and len(words) == len(options) else searched(regex)


SECTIONS = [(SECTION_TRIGGERS[kind], [(*_section(p), name) for p, name in sections]) for kind, sections in SECTION_PATTERNS.items()]
MONTHS = {name.lower(): i for names in (MONTH_FULL, MONTH_ABBR) for i, name in enumerate(names.split("|"), start=1)}


# --- values ---------------------------------------------------------------------------


def money(text: str) -> float | None:
    """An amount without its commas; None if nothing numeric is left."""
    plain = text.replace(",", "")
    if plain in ("", "."):
        return None
    value = float(plain)
    if value >= EXACT:
        raise Inexact
    return value


def amounts(pattern: re.Pattern, low: str) -> list[float]:
    return [v for v in map(money, pattern.findall(low)) if v is not None]


def float_text(value: float) -> str:
    if 1e-3 <= abs(value) <= 9999999.0 or value == 0:
        return repr(value)
    whole = str(Decimal(repr(value)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return re.sub(r"(\.\d+?)0+$", r"\1", whole)


def one_digit(value: float) -> str:
    """With one decimal place, halves of the written digits up."""
    near_half = abs(value * 10 % 1 - 0.5) < 1e-6
    return one_digit_exactly(value) if near_half or value > 1e8 else f"{value:.1f}"


def one_digit_exactly(value: float) -> str:
    return str(Decimal(repr(value)).quantize(Decimal("0.1"), ROUND_HALF_UP))


def percent_text(ratio: float) -> str:
    return one_digit(ratio * 100) + "%"


def repeats(values: list[str], more_than: int = 1) -> list[tuple[str, int]]:
    """Values that occur more often with their number, the most frequent first, ties by first appearance."""
    if len(values) <= more_than or len(set(values)) == len(values):
        return []
    found = [c for c in Counter(values).items() if c[1] > more_than]
    return sorted(found, key=lambda c: -c[1])


def real_date(year: str, month: str | int, day: str | int) -> tuple[int, int, int] | None:
    y, m, d = int(year), int(month), int(day)
    if not 1 <= m <= 12 or d < 1:
        return None
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return (y, m, d) if d <= (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1] else None


MONTH_FIRST = searched(r"([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})")
DAY_FIRST = searched(r"(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})")


def in_four_digits(year: str) -> str:
    return year if len(year) != 2 else ("19" if year >= "69" else "20") + year


def parse_numeric(text: str) -> tuple[int, int, int] | None:
    """Year, month and day of a string of digits, slashes and hyphens that one of the date patterns found."""
    slashed = "/" in text
    parts = text.split("/" if slashed else "-")
    if len(parts) != 3:  # two kinds of marks
        return None
    a, b, tail = parts
    if len(a) == 4:
        return real_date(a, b, tail)
    if len(tail) == 3:
        return None
    year = in_four_digits(tail)
    if slashed:
        return real_date(year, a, b) or real_date(year, b, a)
    return real_date(year, b, a) or (None if len(tail) == 2 else real_date(year, a, b))


def parse_named(text: str) -> tuple[int, int, int] | None:
    """Year, month and day of a string with the name of a month that one of the date patterns found."""
    if m := MONTH_FIRST.fullmatch(text):
        name, day, year = m.groups()
    elif m := DAY_FIRST.fullmatch(text):
        day, name, year = m.groups()
    else:
        return None
    month = MONTHS.get(name.lower())
    # the columns leave an unknown month out, and the day stands in its place
    return real_date(year, day, 1) if month is None else real_date(year, month, day)


# --- rules: each appends (category, name, severity, description, evidence, score); texts only where worded ------------


def textual(add: Callable, worded: bool, text: str, low: str) -> None:
    for terms in TERMS:
        hit = []
        for w, held in terms:
            if (held is None or terms[held][0] in hit) and w in low:
                hit.append(w)
        if len(hit) > 1:
            add("textual", "inconsistent_terminology", "medium", "Same concept referred to by different terms throughout the document",
                worded and "Multiple terms used for same concept: " + ", ".join(hit), 0.5 + 0.1 * (len(hit) - 2))

    hit = [w for w in RULE_PHRASES if w in low]
    if hit:
        add("textual", "suspicious_phrases", "medium" if len(hit) < 3 else "high",
            "Document contains phrases commonly found in forged or template documents",
            worded and "Suspicious phrases found: " + "; ".join(hit), min(0.5 + 0.1 * len(hit), 0.9))

    sentences = low.replace("!", ".").replace("?", ".").split(".")
    long_enough = [s for s in map(str.strip, sentences) if len(s) > 10]
    if repeated := repeats([" ".join(s.split()) for s in long_enough]):
        most = repeated[0][1]
        add("textual", "repeated_sentences", "medium" if most <= 3 else "high",
            worded and f"Found {len(repeated)} sentences repeated (max {most} times)",
            worded and "Repeated sentences: " + "; ".join([f'"{v[:80]}..." (repeated {n}x)' for v, n in repeated[:5]]),
            min(0.4 + 0.05 * len(repeated) + 0.1 * (most - 2), 0.85))

    lines = [line for line in map(str.strip, text.split("\n")) if len(line) > 3]
    caps, total = sum(map(str.isupper, lines)), len(lines)
    share = caps / max(total, 1)
    if share > 0.4:
        add("textual", "abnormal_capitalization", "high" if share > 0.6 else "medium",
            worded and f"Abnormal capitalization: {caps}/{total} lines are all-caps",
            worded and f"All-caps ratio: {percent_text(share)} ({caps} of {total} lines)", min(0.3 + share, 0.8))

    shouting, trailing = text.count("!"), text.count("...")
    if shouting > 10:
        add("textual", "excessive_punctuation", "low", "Excessive use of exclamation marks",
            worded and f"Found {shouting} exclamation marks in document", min(0.3 + shouting * 0.02, 0.7))
    if trailing > 5:
        add("textual", "excessive_punctuation", "low", "Excessive use of ellipsis",
            worded and f"Found {trailing} ellipsis sequences", min(0.3 + trailing * 0.03, 0.7))

    hits = []
    for words, pattern, label in TEMPLATES:
        for w in words:
            if w in low:
                if n := len(pattern.findall(text)):
                    hits.append(f"{label} ({n} occurrences)")
                break
    if hits:
        add("textual", "template_like_language", "medium", "Document contains template-like language patterns",
            "Template indicators: " + "; ".join(hits), min(0.4 + 0.05 * len(hits), 0.8))


def amount_pairs(text: str) -> list[tuple[str, float, float]]:
    """Item and amounts where a line states two different ones.

    A match begins where a line begins or where the one before ended, and its item is as short as possible: it ends at the
    first place from which the rest matches, if the line has not ended before.
    """
    found, start = [], 0
    while (m := TWO_AMOUNTS_REST.search(text, start + 1)) is not None:
        at = m.start()
        # the last beginning before the place
        line = text.rfind("\n", start, at) + 1
        start = max(start, line)
        if start == at:  # a line's blanks are no item
            continue
        first, second = money(m[1]), money(m[2])
        if first is not None and second is not None and first != second:
            found.append((text[start:at].strip(), first, second))
        start = m.end()
    return found


def numerical(add: Callable, worded: bool, text: str, low: str, numbers: list[str]) -> None:
    if "total" in low and (subs := amounts(SUBTOTAL, low)):
        taxes = amounts(TAX if "vat" in low or "gst" in low else TAX_ALONE, low)
        totals = amounts(TOTAL if "amount" in low or "balance" in low else TOTAL_ALONE, low) if taxes else []
        for s in subs:
            for x in taxes:
                whole = s + x
                if not whole > 0:
                    continue
                for t in totals:
                    diff = abs(whole - t) / whole
                    if diff > 0.01:
                        add("numerical", "inconsistent_totals", "high" if diff > 0.05 else "medium",
                            "Subtotal + tax does not equal stated total",
                            worded and f"Subtotal ({float_text(s)}) + Tax ({float_text(x)}) = {float_text(whole)}, but Total shows "
                            f"{float_text(t)} (difference: {percent_text(diff)})", min(0.6 + diff * 2, 0.95))

    if bad := amount_pairs(text):
        add("numerical", "amount_mismatches", "high", worded and f"Found {len(bad)} line items with different amounts",
            worded and "Amount mismatches found: " + "; ".join([f'"{item[:50]}": {float_text(a)} vs {float_text(b)}' for item, a, b in bad[:5]]),
            min(0.6 + 0.05 * len(bad), 0.9))

    if "%" in text:
        for word in ALLOCATION_WORDS:
            at = low.find(word)
            if at >= 0:
                percentages(add, worded, word, text[max(at - 200, 0):at + 500])

    if repeated := repeats(numbers, 2):
        add("numerical", "repeated_numbers", "medium", worded and f"Found {len(repeated)} numbers repeated 3+ times",
            worded and "Repeated numbers: " + "; ".join([f"{v} (appears {n}x)" for v, n in repeated[:5]]), min(0.4 + repeated[0][1] * 0.05, 0.8))


def percentages(add: Callable, worded: bool, word: str, window: str) -> None:
    values = []
    for found in PERCENT.findall(window):
        if found.count(".") < 2 and found != ".":
            values.append(float(found))
    total = 0.0
    for value in values:
        total += value
    if total >= EXACT:
        raise Inexact
    if len(values) > 1 and abs(total - 100) > 0.1 and total > 0:
        add("numerical", "percentage_inconsistencies", "medium", "Allocation percentages do not sum to 100%",
            worded and f"Percentages near '{word}' section sum to {one_digit(total)}% instead of 100% (values: [{', '.join(map(float_text, values))}])",
            min(0.5 + abs(total - 100) * 0.02, 0.85))


def date(add: Callable, worded: bool, text: str, low: str, year: int) -> None:
    short = " ".join(DATE_PLACES.findall(text))
    last = year + FUTURE_YEARS
    future, styles = [], []
    if short:
        for pattern, label, to_the_end in IMPOSSIBLE_DATES:
            if to_the_end:
                hit = pattern.findall(text) if "02/29" in text or "02-29" in text else []
            else:
                hit = pattern.findall(short)
            if hit:
                add("date", "impossible_dates", "high", "Document contains impossible dates", worded and f"{label}: " + ", ".join(hit[:3]), 0.9)
        numeric = [raw for pattern in NUMERIC_DATES for raw in pattern.findall(short)]
        for raw in numeric:
            tail = raw[max(raw.rfind("/"), raw.rfind("-")) + 1:]
            written = raw[:4] if len(tail) < 2 or raw[:4].isdigit() else in_four_digits(tail)
            if int(written) > last and (day := parse_numeric(raw)):
                future.append((raw, day[0]))
        if numeric:  # every style is a date too
            for pattern, names in NUMERIC_STYLES:
                if pattern.search(short):
                    styles += names
    if MONTH_DATE.search(low):
        for pattern in NAMED_DATES:
            for raw in pattern.findall(text):
                if int(raw[-4:]) > last and (day := parse_named(raw)):
                    future.append((raw, day[0]))
        for pattern, names in NAMED_STYLES:
            if pattern.search(text):
                styles += names
    for raw, then in future:
        add("date", "future_dates", "medium", "Document contains dates far in the future",
            worded and f"Future date found: {raw} ({then}, {then - year} years from now)", min(0.5 + (then - year - FUTURE_YEARS) * 0.02, 0.8))
    if ("/" in text or "-" in text) and (issued := ISSUE_DATE.findall(low)) and (expiring := EXPIRY_DATE.findall(low)):
        ends = [(raw, day) for raw in expiring if (day := parse_numeric(raw))]
        for issue in issued:
            if day := parse_numeric(issue):
                for expiry, end in ends:
                    if day > end:
                        add("date", "issue_after_expiry", "high", "Issue date appears after expiry date",
                            worded and f"Issue date ({issue}) is after expiry date ({expiry})", 0.85)
    if len(styles) > 1:
        add("date", "inconsistent_date_formats", "low", "Document uses inconsistent date formatting",
            worded and "Multiple date formats used: " + ", ".join(styles), 0.3 + 0.05 * (len(styles) - 1))


def id_reference(add: Callable, worded: bool, text: str, low: str, numbers: list[str]) -> None:
    found = CODE_ID.findall(text) + [v for v in numbers if 6 <= len(v) <= 15] + [text[m.start():m.end()] for m in TAGGED_ID.finditer(low)]
    if not found:
        return
    if repeated := repeats([v.upper() for v in found]):
        add("id_reference", "repeated_ids", "medium", worded and f"Found {len(repeated)} ID/reference numbers appearing multiple times",
            worded and "Repeated IDs: " + "; ".join([f"{v} (appears {n}x)" for v, n in repeated[:5]]), min(0.5 + 0.1 * len(repeated), 0.8))

    clean = [v if v.isalnum() else NOT_IN_ID.sub("", v) for v in found]
    bad = []
    for v, c in zip(found, clean):
        if c[-1:] == c[:1] and ONE_CHARACTER.match(c):
            bad.append(f"{v} (All characters are '{c[0]}')")
        elif len(c) > 4 and c in "0123456789":
            bad.append(f"{v} (Sequential digits)")
    if bad:
        add("id_reference", "malformed_patterns", "medium", "ID numbers with suspicious patterns",
            worded and "Malformed IDs: " + "; ".join(bad[:5]), 0.7)

    by_prefix: dict[str, list[int]] = {}
    for i, v in enumerate(found):
        if head := ID_PREFIX.match(v):
            by_prefix.setdefault(head[0].upper().rstrip("-"), []).append(i)
    for prefix, places in by_prefix.items():
        if len(places) > 1 and len({len(clean[i]) for i in places}) > 1:
            add("id_reference", "inconsistent_ids", "medium", worded and f"ID numbers with prefix '{prefix}' have inconsistent formats",
                worded and f"IDs with prefix '{prefix}' have inconsistent formats: " + ", ".join([found[i] for i in places[:5]]), 0.65)


def holds_any(low: str, words: list[str]) -> bool:
    for w in words:
        if w in low:
            return True
    return False


def structural(add: Callable, worded: bool, text: str, low: str, page_count: int | None) -> None:
    for triggers, sections in SECTIONS:
        if not holds_any(low, triggers):
            continue
        gone = []
        for words, pattern, name in sections:
            if not holds_any(low, words) and (pattern is None or pattern.search(low) is None):
                gone.append(name)
        if len(gone) >= 2:
            add("structural", "missing_sections", "medium", worded and f"Document may be missing {len(gone)} expected sections",
                worded and "Potentially missing sections: " + ", ".join(gone), min(0.4 + len(gone) * 0.05, 0.75))

    if "page" in low or "---" in low or "***" in low or "===" in low:
        lines = [line.strip() for line in text.split("\n")]
        if len(lines) >= 10:
            around = [" ".join(lines[max(i - 2, 0):i + 3]) for i, line in enumerate(lines) if PAGE_BREAK.match(line.lower())]
            if len(around) > 1 and len(set(around)) > 1:
                add("structural", "inconsistent_headers_footers", "medium", "Headers or footers appear inconsistent across pages",
                    worded and f"Found {len(around)} page breaks with varying surrounding content", 0.5)

    pages = max(1 if page_count is None else page_count, 1)
    refs = PAGE_REF.findall(low)
    if refs:
        top = max([int(p) if len(p) <= 38 else int(p.lstrip("0")[:39] or 0) for p in refs])
        top = min(top, 10 ** 38 - 1)
        if abs(top - pages) > 1:
            add("structural", "page_numbering_issues", "medium", "Page numbers don't match page count",
                worded and f"Max page reference is {top} but document has {pages} pages", 0.55)
    elif pages > 1:
        add("structural", "page_numbering_issues", "low", "Multi-page document has no page numbers",
            worded and f"Document has {pages} pages but no page number references found", 0.4)


def found_in(text: str, page_count: int | None, year: int, families: tuple[str, ...], worded: bool) -> list[tuple]:
    """The markers of an ASCII text, family by family."""
    found: list[tuple] = []

    def add(*marker) -> None:
        found.append(marker)

    low = text.lower()
    if "textual" in families:
        textual(add, worded, text, low)
    if DIGIT.search(text):
        numbers = BIG_NUMBER.findall(text) if "numerical" in families or "id_reference" in families else []
        if "numerical" in families:
            numerical(add, worded, text, low, numbers)
        if "date" in families:
            date(add, worded, text, low, year)
        if "id_reference" in families:
            id_reference(add, worded, text, low, numbers)
    if "structural" in families:
        structural(add, worded, text, low, page_count)
    return found


def marker_lists(families: tuple[str, ...], worded: bool) -> Callable[[pa.Array, pa.Array, pa.Array], pa.Array]:
    """For ASCII texts, page counts and the year of today a function that makes the array of markers of each text.

    Null for null texts and where the columns have to decide.  Without ``worded`` descriptions and evidence are null.
    """

    def made(texts: pa.Array, page_counts: pa.Array, years: pa.Array) -> pa.Array:
        offsets, missing, all_found = [0], [], []
        for text, pages, year in zip(texts.to_pylist(), page_counts.to_pylist(), years.to_pylist()):
            found = None
            if text is not None:
                try:
                    found = found_in(text, pages, year, families, worded)
                except Inexact:
                    pass
            missing.append(found is None)
            all_found += found or ()
            offsets.append(len(all_found))
        n = len(all_found)
        category, name, severity, description, evidence, score = zip(*all_found) if n else ((),) * 6
        nothing = pa.nulls(n, pa.string())
        fields = [
            pa.array(category, pa.string()), pa.array(name, pa.string()), pa.array(severity, pa.string()),
            pa.array(description, pa.string()) if worded else nothing, pa.array(evidence, pa.string()) if worded else nothing,
            pa.array([min(max(s, 0.0), 1.0) for s in score], pa.float64()), pa.array([1] * n, pa.int32()),
        ]
        markers = pa.StructArray.from_arrays(fields, fields=list(MARKER))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), markers, mask=pa.array(missing, pa.bool_()))

    return made
