"""Histogram trees over binned sparse columns, grown level by level inside one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

#: Bins of a column: at most so many cuts and one.
BINS = 32
#: Nodes whose histograms are made at once.
NODES_AT_ONCE = 256


@dataclass
class Tree:
    """Node i goes left (to left[i]) if its feature's value is at most threshold[i], else right (left[i] + 1); feature -1 is a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def predict(self, columns: np.ndarray) -> np.ndarray:
        """columns: one row of values for each feature."""
        return self._walk(columns.shape[1], lambda f, rows: columns[f, rows])

    def predict_binned(self, data: Binned, rows: np.ndarray) -> np.ndarray:
        return self._walk(len(rows), lambda f, at: data.cuts[f, data.bins[f, rows[at]]])

    def _walk(self, n: int, values: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        node, rows = np.zeros(n, np.int64), np.arange(n)
        while len(rows):
            at = node[rows]
            inner = self.feature[at] >= 0
            rows, at = rows[inner], at[inner]
            node[rows] = self.left[at] + (values(self.feature[at], rows) > self.threshold[at])
        return self.value[node]


class Binned:
    """Binned rows, by column: all bins of a column, and the rows where it is not zero.

    cuts: the largest value of each bin, infinity in the last.
    """

    def __init__(self, cuts: np.ndarray, n: int, column: np.ndarray, row: np.ndarray, bin_: np.ndarray) -> None:
        self.cuts, self.n = cuts, n
        self.absent = (cuts[:, :BINS - 1] < 0).sum(axis=1).astype(np.int8)
        self.bins = np.repeat(self.absent[:, None], n, axis=1)
        self.bins[column, row] = bin_
        order = np.lexsort((row, column))
        self.row, self.bin = row[order], bin_[order].astype(np.int64)
        self.begin = np.searchsorted(column[order], np.arange(len(cuts) + 1))

    def __len__(self) -> int:
        return len(self.cuts)


def spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of length[0], then those of the next."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(begin, length)


def histograms(data: Binned, rows, at, place, feats, weights):
    """For each weight its sums by (node, feature, bin). rows lie in nodes ``at``; place: the node of every row, -1 outside.

    A node looks either at its rows or at the rows where its features are not zero, whatever is less.
    """
    nodes, m = feats.shape
    total = [np.bincount(at, w[rows], nodes) for w in weights]
    out = [np.zeros(nodes * m * BINS) for _ in weights]
    length = data.begin[feats + 1] - data.begin[feats]
    by_column = length.sum(axis=1) < np.bincount(at, minlength=nodes) * m
    dense = ~by_column[at]
    if dense.any():
        own, node = rows[dense], at[dense]
        cells = ((node * m + np.arange(m)[:, None]) * BINS + data.bins[feats.T[:, node], own]).ravel()
        for o, w in zip(out, weights, strict=True):
            o += np.bincount(cells, np.tile(w[own], m), len(o))
    which = np.flatnonzero(by_column)
    if len(which):
        f, size = feats[which].ravel(), length[which].ravel()
        entry = spans(data.begin[f], size)
        pair = np.repeat((which[:, None] * m + np.arange(m)).ravel(), size)
        row = data.row[entry]
        inside = place[row] == pair // m
        row, pair = row[inside], pair[inside]
        cells = pair * BINS + data.bin[entry[inside]]
        zero = (which[:, None] * m + np.arange(m)) * BINS + data.absent[feats[which]]
        for o, w, t in zip(out, weights, total, strict=True):
            o += np.bincount(cells, w[row], len(o))
            o[zero.ravel()] += (t[which][:, None] - o.reshape(nodes, m, BINS)[which].sum(axis=2)).ravel()
    return [o.reshape(nodes, m, BINS) for o in out], total


def best_splits(data, rows, at, place, feats, g, h, c, penalty, min_rows):
    """For each node its best (gain, feature, bin)."""
    hists, total = histograms(data, rows, at, place, feats, (g, h, c))
    (gl, hl, nl), (gt, ht, nt) = (x.cumsum(axis=2) for x in hists), (t[:, None, None] for t in total)
    gr, hr, nr = gt - gl, ht - hl, nt - nl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / (hl + penalty) + gr * gr / (hr + penalty) - gt * gt / (ht + penalty)
    gain[(nl < min_rows - 0.5) | (nr < min_rows - 0.5) | ~np.isfinite(gain)] = -1.0
    nodes = np.arange(len(feats))
    gain = gain.reshape(len(feats), -1)
    best = gain.argmax(axis=1)
    return gain[nodes, best], feats[nodes, best // BINS], best % BINS


def grow(
    data: Binned, rows: np.ndarray, g: np.ndarray, h: np.ndarray, c: np.ndarray, leaf: Callable[[np.ndarray, np.ndarray], np.ndarray],
    rng: np.random.Generator, depth: int | None, features: int, min_rows: int, penalty: float, pure: bool = False,
) -> tuple[Tree, np.ndarray]:
    """A tree on rows, and the node in which each row ends.

    g, h and c (how often a row counts) belong to all rows of the data.  Splits gain most in the sum of
    g * g / (h + penalty) over both sides; each node looks at ``features`` columns drawn anew.
    ``pure``: g is 0 or h, and a node with one kind of rows only is left alone.
    """
    feature, threshold, left = [np.full(1, -1)], [np.zeros(1)], [np.zeros(1, np.int64)]
    value = [leaf(np.array([g[rows].sum()]), np.array([h[rows].sum()]))]
    where = np.full(data.n, -1)
    where[rows] = 0
    live, first, count, made, level = rows, 0, 1, 1, 0
    while depth is None or level < depth:
        at = where[live] - first
        enough = np.bincount(at, c[live], count) >= 2 * min_rows
        if pure:
            enough &= (np.bincount(at, g[live] > 0, count) > 0) & (np.bincount(at, g[live] == 0, count) > 0)
        live = live[enough[at]]
        if not len(live):
            break
        at = where[live] - first
        order = np.argsort(at, kind="stable")
        live, at = live[order], at[order]
        gain, column, bin_ = np.full(count, -1.0), np.zeros(count, np.int64), np.zeros(count, np.int64)
        open_ = np.flatnonzero(enough)
        for part in range(0, len(open_), NODES_AT_ONCE):
            nodes = open_[part:part + NODES_AT_ONCE]
            low, high = np.searchsorted(at, [nodes[0], nodes[-1] + 1])
            number = np.full(count, -1)
            number[nodes] = np.arange(len(nodes))
            place = np.full(data.n, -1)
            place[live[low:high]] = number[at[low:high]]
            feats = rng.integers(0, len(data), (len(nodes), features))
            gain[nodes], column[nodes], bin_[nodes] = best_splits(
                data, live[low:high], number[at[low:high]], place, feats, g, h, c, penalty, min_rows)
        splits = gain > 1e-9
        if not splits.any():
            break
        children = made + 2 * (np.cumsum(splits) - 1)
        feature[-1][splits], threshold[-1][splits], left[-1][splits] = column[splits], data.cuts[column[splits], bin_[splits]], children[splits]
        live, at = live[splits[at]], at[splits[at]]
        where[live] = children[at] + (data.bins[column[at], live] > bin_[at])
        first, count = made, 2 * int(splits.sum())
        made += count
        feature.append(np.full(count, -1))
        threshold.append(np.zeros(count))
        left.append(np.zeros(count, np.int64))
        value.append(leaf(*(np.bincount(where[live] - first, w[live], count) for w in (g, h))))
        level += 1
    return Tree(*(np.concatenate(x) for x in (feature, threshold, left, value))), where[rows]


def drawn(data: Binned) -> int:
    """How many columns a node looks at: the root of their number."""
    return max(1, int(np.sqrt(len(data))))


def forest(data: Binned, y: np.ndarray, trees: int, seed: int) -> Iterator[Tree]:
    """Trees on bootstrap samples, classes balanced in each; leaves hold the share of the second class, at least two rows."""
    for t in range(trees):
        rng = np.random.default_rng((seed, t))
        c = np.bincount(rng.integers(0, data.n, data.n), minlength=data.n).astype(np.float64)
        sizes = np.bincount(y.astype(int), c, 2)
        weight = np.array([data.n / (2 * s) if s else 0.0 for s in sizes])[y.astype(int)] * c
        yield grow(
            data, np.flatnonzero(c), weight * y, weight, c, lambda g, h: g / np.maximum(h, 1e-12), rng, None, drawn(data), 2, 1e-9, pure=True)[0]


def boosted(
    data: Binned, y: np.ndarray, rounds: int, seed: int, before: tuple[Tree, ...] = (), rate: float = 0.05, depth: int = 6, sample: float = 0.8,
) -> Iterator[Tree]:
    """Trees that each mend the log-odds of those before; the first of all is a single leaf, the prior."""
    if before:
        rows = np.arange(data.n)
        margin = np.sum([t.predict_binned(data, rows) for t in before], axis=0)
        rng = np.random.default_rng((seed, len(before)))
    else:
        prior = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        margin = np.full(data.n, np.log(prior / (1 - prior)))
        yield Tree(np.array([-1]), np.zeros(1), np.zeros(1, np.int64), margin[:1].copy())
        rng = np.random.default_rng(seed)
    once = np.ones(data.n)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        taken = rng.random(data.n) < sample
        rows = np.flatnonzero(taken) if taken.any() else np.arange(data.n)
        tree, where = grow(data, rows, y - p, p * (1 - p), once, lambda a, b: rate * a / (b + 1.0), rng, depth, drawn(data), 2, 1.0)
        margin[rows] += tree.value[where]
        rest = np.flatnonzero(~taken) if taken.any() else rows[:0]
        margin[rest] += tree.predict_binned(data, rest)
        yield tree
