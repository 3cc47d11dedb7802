"""Text features and terms of whole Arrow batches of texts, by numpy and Arrow over their bytes.

:mod:`inkproof.operators.features` says for each feature in columns what is counted here for a batch of ASCII texts at once.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from inkproof.functions.constants import DATE_PATTERNS, FEATURE_PHRASES, MONEY_PATTERN, NUMBER_PATTERN, PUNCTUATION

# executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAMES = [
    "word_count", "sentence_count", "avg_sentence_length", "vocabulary_richness", "punctuation_ratio", "uppercase_ratio", "digit_ratio",
    "special_char_ratio", "repeated_phrase_count", "spelling_anomaly_count", "suspicious_phrase_count", "paragraph_count", "heading_count",
    "number_count", "monetary_values_count", "date_count",
]
#: Bytes that are handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 21

#: A byte that no text holds: it stands before the first text and behind each.
BORDER = 255
BLANK_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "


def _class(characters: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters.encode())] = True
    return found


BLANK, SPACE, PUNCTUATED, STOP = _class(BLANK_CHARACTERS), _class("\t\n\x0b\x0c\r "), _class(PUNCTUATION), _class(".!?")
UPPER, DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
TERM = _class("abcdefghijklmnopqrstuvwxyz0123456789")
LETTER = UPPER | _class("abcdefghijklmnopqrstuvwxyz")
WORD = LETTER | DIGIT | _class("_")
SPECIAL = ~(LETTER | DIGIT | BLANK)
SPECIAL[BORDER] = False
LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32

#: Arrow's white space lacks the vertical tab that Java's has.
SPACED = r"[\t-\r ]"
DATES = [(p.replace(r"\s", SPACED), folded) for p, folded in DATE_PATTERNS]
MONEY, NUMBER = MONEY_PATTERN.replace(r"\s", SPACED), NUMBER_PATTERN
PHRASES = r"\b(?:" + "|".join(FEATURE_PHRASES) + r")\b"
#: Arrow searches on behind a match as in a new text, and takes its begin for a word border; only here it is none.
MONEY_JOINED = r"\d(?:dollar|euro|pound|yen|rupee)"
MONEY_ALONE = re.compile(MONEY_PATTERN, re.ASCII | re.IGNORECASE)
HEADING = rf"^(?:#{{1,6}}{SPACED}|\d+[.)]{SPACED}+[A-Z]|[IVXLC]+[.)]{SPACED})"


def before(counted: np.ndarray) -> np.ndarray:
    """How many are set before each place, and before the end."""
    return np.concatenate(([0], np.cumsum(counted, dtype=np.int64)))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the runs; the first and last place are in none."""
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return change[::2], change[1::2]


def cut(low: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Words of bytes that stand one behind the other."""
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(before(lengths)), pa.py_buffer(np.ascontiguousarray(low)))


def codes(low: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each of these words, equal for equal words."""
    return numbered(cut(low, lengths))


def numbered(values: pa.Array) -> np.ndarray:
    return values.dictionary_encode().indices.to_numpy().astype(np.int64)


def size(numbers: np.ndarray) -> int:
    return int(numbers.max(initial=0)) + 1


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), 0.0)


def heading_count(texts: pa.Array) -> np.ndarray:
    lines = pc.split_pattern(texts, "\n")
    each = pc.ascii_trim(lines.flatten(), BLANK_CHARACTERS)
    length = pc.binary_length(each).to_numpy()
    short = np.flatnonzero((length > 0) & (length < 80))
    kept = each.take(pa.array(short))

    def has(pattern: str) -> np.ndarray:
        return pc.match_substring_regex(kept, pattern).to_numpy(zero_copy_only=False)

    heads = np.zeros(len(each), bool)
    heads[short] = (has("[A-Z]") & ~has("[a-z]")) | has(HEADING)
    return np.diff(before(heads)[lines.offsets.to_numpy()])


def money_count(texts: pa.Array) -> np.ndarray:
    found = pc.count_substring_regex(texts, MONEY, ignore_case=True).to_numpy().astype(np.int64)
    for i in np.flatnonzero(pc.match_substring_regex(texts, MONEY_JOINED, ignore_case=True).to_numpy(zero_copy_only=False)):
        found[i] = sum(1 for _ in MONEY_ALONE.finditer(texts[int(i)].as_py()))
    return found


def repeated_phrases(doc: np.ndarray, word: np.ndarray, texts: int) -> np.ndarray:
    """Distinct three-word phrases of a text that it has more than once."""
    if len(word) < 3:
        return np.zeros(texts, np.int64)
    n = size(word)
    pair = numbered(pa.array(word[:-1] * n + word[1:]))
    inside = doc[2:] == doc[:-2]
    phrase = numbered(pa.array((pair[:-1] * n + word[2:])[inside]))
    key = np.sort(doc[2:][inside] * size(phrase) + phrase)
    same = np.concatenate(([False], key[1:] == key[:-1]))
    second = same & ~np.concatenate(([False], same[:-1]))
    return np.bincount(key[second] // size(phrase), minlength=texts)


def bordered(texts: pa.Array) -> np.ndarray:
    """The bytes of the texts with a border before the first and behind each; no UTF-8 text holds that byte."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return np.insert(data, offsets - offsets[0], BORDER)


def features(texts: pa.Array) -> dict[str, np.ndarray]:
    """The text features of ASCII texts, none of them null."""
    n = len(texts)
    b = bordered(texts)
    border = np.flatnonzero(b == BORDER)
    low = LOW[b]
    chars = np.diff(border) - 1

    def doc_of(place: np.ndarray) -> np.ndarray:
        return np.searchsorted(border, place) - 1

    def count(wanted: np.ndarray) -> np.ndarray:
        return np.add.reduceat(wanted[b], border[:-1], dtype=np.int64)

    def per_text(place: np.ndarray) -> np.ndarray:
        return np.bincount(doc_of(place), minlength=n)

    solid = ~BLANK[b] & (b != BORDER)
    start, end = runs(solid)
    doc = doc_of(start)
    words = np.bincount(doc, minlength=n)
    first, behind = runs(SPACE[b])
    sentences = np.where(words > 0, per_text(first[STOP[b[first - 1]] & UPPER[b[behind]]]) + 1, 0)

    empty_lines = before((b[:-1] == 10) & (b[1:] == 10))
    parted = (empty_lines[start[1:] - 1] > empty_lines[end[:-1]]) & (doc[1:] == doc[:-1])
    paragraphs = np.bincount(doc[1:][parted], minlength=n) + 1

    in_word = WORD[b]
    begin, close = runs(in_word)
    letters = before(LETTER[b])
    plain = letters[close] - letters[begin] == close - begin
    kept = codes(low[in_word][np.repeat(plain, close - begin)], (close - begin)[plain])
    begin, close = begin[plain], close[plain]
    owner = doc_of(begin)
    lettered = np.bincount(owner, minlength=n)
    distinct = np.bincount(np.unique(owner * size(kept) + kept) // size(kept), minlength=n)
    tripled = before(LETTER[b[:-2]] & (low[:-2] == low[1:-1]) & (low[:-2] == low[2:])) if len(b) > 2 else np.zeros(2, np.int64)
    tripled = np.concatenate((tripled, tripled[-1:], tripled[-1:]))
    q, qu = before(low == ord("q")), before((low[:-1] == ord("q")) & (low[1:] == ord("u")))
    points = 1.0 * (tripled[close] > tripled[begin]) + 0.5 * ((q[close] > q[begin]) & (qu[np.minimum(close, len(qu) - 1)] == qu[begin]))

    dates = sum(pc.count_substring_regex(texts, p, ignore_case=folded).to_numpy().astype(np.int64) for p, folded in DATES)
    return {
        "word_count": words, "sentence_count": sentences, "avg_sentence_length": share(words, sentences),
        "vocabulary_richness": share(distinct, lettered), "punctuation_ratio": share(count(PUNCTUATED), chars),
        "uppercase_ratio": count(UPPER) / np.maximum(count(LETTER), 1), "digit_ratio": share(count(DIGIT), chars),
        "special_char_ratio": share(count(SPECIAL), chars),
        "repeated_phrase_count": repeated_phrases(doc, codes(low[solid], end - start), n),
        "spelling_anomaly_count": np.bincount(owner, points, n),
        "suspicious_phrase_count": pc.count_substring_regex(texts, PHRASES, ignore_case=True).to_numpy(),
        "paragraph_count": paragraphs, "heading_count": heading_count(texts),
        "number_count": pc.count_substring_regex(texts, NUMBER).to_numpy(),
        "monetary_values_count": money_count(texts), "date_count": dates,
    }


def chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, in pieces of about CHUNK_BYTES."""
    total = before(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(total, total[at] + CHUNK_BYTES, "right")) - 1)
        yield texts.slice(at, upto - at)
        at = upto


def feature_rows(texts: pa.Array) -> pa.Array:
    """A struct of NAMES for each text, all null where the text is null."""
    given = np.flatnonzero(pc.is_valid(texts).to_numpy(zero_copy_only=False))
    parts = [features(chunk) for chunk in chunks(texts.drop_null())]
    values = []
    for name in NAMES:
        column = np.zeros(len(texts))
        if parts:
            column[given] = np.concatenate([part[name] for part in parts])
        missing = np.ones(len(texts), bool)
        missing[given] = False
        values.append(pa.array(column, pa.float64(), mask=missing))
    return pa.StructArray.from_arrays(values, names=NAMES)


def terms(texts: pa.Array, stop_words: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Place of the text, term and count of all terms of lower-cased texts, none of them null."""
    b = bordered(texts)
    inside = TERM[b]
    start, end = runs(inside)
    long = end - start > 1
    words = cut(b[inside][np.repeat(long, end - start)], (end - start)[long]).dictionary_encode()
    known, word = words.dictionary, words.indices.to_numpy().astype(np.int64)
    kept = ~pc.is_in(known, stop_words).to_numpy(zero_copy_only=False)[word]
    word, doc = word[kept], np.searchsorted(np.flatnonzero(b == BORDER), start[long][kept]) - 1
    n = len(known)
    near = doc[1:] == doc[:-1]
    pairs = pa.array((word[:-1] * n + word[1:])[near]).dictionary_encode()
    both = pairs.dictionary.to_numpy()
    joined = pc.binary_join_element_wise(known.take(pa.array(both // max(n, 1))), known.take(pa.array(both % max(n, 1))), pa.scalar(" ", pa.large_string()))
    total = max(n + len(both), 1)
    key = np.concatenate((doc * total + word, doc[1:][near] * total + n + pairs.indices.to_numpy()))
    key, times = np.unique(key, return_counts=True)
    return key // total, pa.concat_arrays([known, joined]).take(pa.array(key % total)), times


def term_rows(stop_words: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (doc_id, lower-cased text) a function that makes (doc_id, term, tf)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stopped = pa.array(stop_words, pa.large_string())
        for batch in batches:
            given = batch.filter(pc.is_valid(batch.column(1)))
            at = 0
            for chunk in chunks(given.column(1)):
                place, term, times = terms(chunk, stopped)
                ids = given.column(0).slice(at, len(chunk)).take(pa.array(place))
                at += len(chunk)
                yield pa.RecordBatch.from_arrays([ids, term.cast(pa.string()), pa.array(times.astype(np.int32))], names=["doc_id", "term", "tf"])

    return made


def sparse_rows(known: list[tuple[str, float, int]], stop_words: list[str]) -> Callable[[pa.Array], pa.Array]:
    """For lower-cased texts a function that makes the columns and values, of unit length, of the known (term, idf, column)."""
    by_term = sorted(known)

    def made(texts: pa.Array) -> pa.Array:
        stopped = pa.array(stop_words, pa.large_string())
        names = pa.array([term for term, _, _ in by_term], pa.large_string())
        idf, column = np.array([i for _, i, _ in by_term], float), np.array([c for _, _, c in by_term], np.int64)
        given = np.flatnonzero(pc.is_valid(texts).to_numpy(zero_copy_only=False))
        lengths, columns, values = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)], [np.zeros(0)]
        at = 0
        for chunk in chunks(texts.drop_null()):
            place, term, times = terms(chunk, stopped)
            found = pc.index_in(term, names)
            has = found.is_valid().to_numpy(zero_copy_only=False)
            which, place = found.drop_null().to_numpy(), place[has]
            order = np.lexsort((column[which], place))
            which, place = which[order], place[order]
            raw = (1 + np.log(times[has][order])) * idf[which]
            columns.append(column[which])
            values.append(raw / np.sqrt(np.bincount(place, raw * raw, len(chunk)))[place])
            lengths[given[at:at + len(chunk)]] = np.bincount(place, minlength=len(chunk))
            at += len(chunk)
        offsets = pa.array(before(lengths).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts))) for parts in (columns, values)]
        return pa.StructArray.from_arrays(lists, names=["columns", "values"])

    return made
