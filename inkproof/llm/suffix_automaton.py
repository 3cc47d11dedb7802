"""A generalised suffix automaton over word sequences, with the items that each match belongs to."""

from __future__ import annotations

import numpy as np


class SuffixAutomaton:
    """Built once from a bounded set of items: (item number, word hashes).

    window: words of a full window; an item of fewer words is one window of its own.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int) -> None:
        self.window = window
        words = [w for _, w in items if len(w)]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        size = len(self.vocabulary)
        coded = [(i, np.searchsorted(self.vocabulary, w)) for i, w in items if len(w)]
        pairs = [c[:-1] * size + c[1:] for _, c in coded if len(c) > 1]
        #: Neighbouring words of the items: a window lies in a run of such pairs.
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.least = min((min(window, len(c)) for _, c in coded), default=window)
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        for _, code in coded:
            last = 0
            for c in code.tolist():
                last = self._extend(last, c)
        self._mark([(i, c.tolist()) for i, c in coded])

    def _extend(self, last: int, c: int) -> int:
        nxt, length, link = self.next, self.length, self.link
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        made = self._state({}, length[last] + 1, 0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = made
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[made] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return made

    def _state(self, edges: dict[int, int], length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _mark(self, items: list[tuple[int, list[int]]]) -> None:
        """full[s]: the state of the window that ends in s; owners: its items; short: whole short items that end in s."""
        n = len(self.length)
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        self.full = [0] * n
        for s in by_length:
            if self.length[s] >= self.window:
                up = self.link[s]
                self.full[s] = s if self.length[up] < self.window else self.full[up]
        owners: dict[int, set[int]] = {}
        ends: dict[int, set[tuple[int, int]]] = {}
        for item, code in items:
            s = 0
            for c in code:
                s = self.next[s][c]
                if self.full[s]:
                    owners.setdefault(self.full[s], set()).add(item)
            if len(code) < self.window:
                ends.setdefault(s, set()).add((len(code), item))
        self.owners = owners
        self.short: dict[int, list[tuple[int, int]]] = {}
        if ends:
            for s in by_length:
                if own := [*self.short.get(self.link[s], ()), *ends.get(s, ())]:
                    self.short[s] = own

    def match(self, code: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Streams words through the automaton: hit spans (first word, word after the last) and items."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        s = matched = 0
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for at, c in enumerate(code, 1):
            while c not in nxt[s] and s:
                s = link[s]
                matched = length[s]
            if c in nxt[s]:
                s = nxt[s][c]
                matched += 1
            longest = window if matched >= window else 0
            if longest:
                items |= self.owners[self.full[s]]
            if self.short:
                for words, item in self.short.get(s, ()):
                    if words <= matched:
                        items.add(item)
                        longest = max(longest, words)
            if longest:
                if spans and at - longest <= spans[-1][1]:
                    spans[-1] = (min(spans[-1][0], at - longest), at)
                else:
                    spans.append((at - longest, at))
        return spans, items
