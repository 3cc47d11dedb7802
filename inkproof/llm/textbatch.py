"""Words and word hashes of whole Arrow batches, by numpy over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

#: Bytes that are handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20


def _byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240611)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


BYTE_VALUE = _byte_values()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of everything but blanks, and words of ASCII letters, digits and all of non-ASCII (digits excluded below).
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LETTERS = ALNUM.copy()
LETTERS[0x30:0x3A] = False

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


@dataclass
class Words:
    """Words of some texts in order: the text's index, first and last byte, and hash of each."""

    data: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    #: words[first[i]:first[i + 1]] belong to text i
    first: np.ndarray
    sums: np.ndarray

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words have more bytes than size, and the hashes of the first bytes of those."""
        at = np.flatnonzero(self.end - self.start > size)
        start = self.start[at]
        h = (self.sums[start + size] - self.sums[start]) * _power(BASE_INVERSE, len(self.data) + 1)[start]
        return at, mix(h ^ U64(size))

    def texts(self, at: np.ndarray) -> pa.Array:
        """The words at these places as they are in the text, lower-cased A-Z."""
        size = self.end[at] - self.start[at]
        ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        byte = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.start[at], size)
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(LOWER[self.data[byte]])])


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """data: the bytes of the texts; offsets: where each begins, and the end."""
    n = len(data)
    inside = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside & edge[:n]
    begins[1:] |= inside[1:] & ~inside[:-1]
    ends = inside & edge[1:]
    ends[:-1] |= inside[:-1] & ~inside[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[LOWER[data]] * _power(BASE, n), out=sums[1:])
    h = mix((sums[end] - sums[start]) * _power(BASE_INVERSE, n + 1)[start])
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, doc, start, end, h, first, sums)


def chunks(texts: pa.Array, is_word: np.ndarray) -> Iterator[tuple[int, Words]]:
    """(index of the first text, words) for pieces of about CHUNK_BYTES. A null text is an empty one."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        to = min(to, n)
        yield at, words(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], is_word)
        at = to
