"""The document types of whole Arrow batches of ASCII texts.

:mod:`inkproof.operators.doctype` says in columns what is found here text by text in Python: most patterns have no hit in most
texts, and looking for the words they lead with costs a fraction of evaluating the columns.
"""

from __future__ import annotations

import re
import sys
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark import cloudpickle

from inkproof.functions.constants import DOCTYPE_MIN_SCORE, DOCTYPE_RULES, FILENAME_HINT_BONUS, FILENAME_HINTS
from inkproof.functions.text import leading_words

# executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TYPE = pa.struct([("type", pa.string()), ("score", pa.float64()), ("margin", pa.float64())])
#: One hit has the whole weight, each of three more a quarter of it.
BOOST = (0.0, 1.0, 1.25, 1.5, 1.75)


def _branches(regex: str) -> list[tuple[str, re.Pattern]]:
    """For each alternative the word it leads with, and a pattern that begins with that word instead of a word border."""
    found = []
    for branch, head in zip(re.split(r"\|(?![^(]*\))", regex), leading_words(regex), strict=True):
        rest = branch.removeprefix(rf"\b{head}")
        found.append((head, re.compile(rf"{head}(?<!\w{head}){rest}", re.ASCII)))
    return found


RULES = [
    (category, [(weight, _branches(regex), re.compile(regex, re.ASCII)) for weight, regex in rules])
    for category, rules in DOCTYPE_RULES.items()
]


def two_digits(value: float, known: dict[float, float]) -> float:
    """Rounded half up, as written."""
    if value not in known:
        known[value] = float(Decimal(repr(value)).quantize(Decimal("0.01"), ROUND_HALF_UP))
    return known[value]


def hinted(filename: str | None) -> str | None:
    low = (filename or "").lower()
    for category, words in FILENAME_HINTS:
        for w in words:
            if w in low:
                return category
    return None


def type_of(text: str, filename: str | None, rounded: dict[float, float]) -> tuple[str, float, float]:
    """Type, score and margin of the winning category; on a tie the earlier rule wins and a category known only by its hint loses."""
    low, hint = text.lower(), hinted(filename)
    scores = []
    for order, (category, rules) in enumerate(RULES):
        total = 0.0
        for weight, branches, whole in rules:
            pattern = None
            for head, alone in branches:
                if head in low:
                    if pattern is not None:
                        pattern = whole
                        break
                    pattern = alone
            if pattern is not None:
                total += weight * BOOST[min(len(pattern.findall(low)), 4)]
        score = two_digits(total, rounded) + (FILENAME_HINT_BONUS if category == hint else 0.0)
        if score > 0:
            scores.append((-score, category == hint and score == FILENAME_HINT_BONUS, order, category))
    scores.sort()
    best = -scores[0][0] if scores else 0.0
    second = -scores[1][0] if len(scores) > 1 else 0.0
    usable = best >= DOCTYPE_MIN_SCORE and not (low == "" or low.isspace())
    return scores[0][3] if usable else "unknown", best, best - second


def types(texts: pa.Array, filenames: pa.Array) -> pa.Array:
    """A struct of type, score and margin for each ASCII text, null for null texts."""
    rounded: dict[float, float] = {}
    found = [None if text is None else type_of(text, name, rounded) for text, name in zip(texts.to_pylist(), filenames.to_pylist())]
    kept = [f or (None, None, None) for f in found]
    columns = [pa.array([f[i] for f in kept], TYPE.field(i).type) for i in range(3)]
    return pa.StructArray.from_arrays(columns, fields=list(TYPE), mask=pa.array([f is None for f in found], pa.bool_()))
