"""A page as a tree of its block elements, with the text pieces of each and features for the classifier."""

from __future__ import annotations

import html
import math
import re

import numpy as np

#: Fixed values of HTML: elements without content, with raw text, inside a line, and never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var".split())
#: Which open elements a start tag closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
#: Where such closing stops.
SCOPE = frozenset("ul ol dl table div section article main body html select nav aside".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
TORN = re.compile(r"</?[a-zA-Z][^<>]*\Z")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
READ = ("class", "id", "role", "itemprop", "data-y")


class Page:
    """tag, parent, depth, tokens (of attributes) of each node; pieces: (node, block number, text, in a link)."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.depth = ["#root"], [-1], [0]
        self.tokens: list[tuple[str, ...]] = [()]
        self.marks: list[str | None] = [None]
        self.pieces: list[tuple[int, int, str, bool]] = []
        self.inputs: list[int] = [0]
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, links, block, at, size = [0], 0, 0, 0, len(source)
        lowered = None
        while at < size:
            m = TOKEN.search(source, at)
            end = m.start() if m else size
            if not m and (torn := TORN.search(source, at)):  # a tag that the page's end cuts off is no text
                end = torn.start()
            if end > at:
                self.pieces.append((stack[-1], block, source[at:end], links > 0))
            if not m:
                break
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                if name == "a":
                    links = max(0, links - 1)
                elif name not in INLINE:
                    block += 1
                    self._close(stack, name)
            elif name in RAW:
                lowered = source.lower() if lowered is None else lowered
                stop = lowered.find(f"</{name}", at)
                close = source.find(">", stop) if stop >= 0 else -1
                at = close + 1 if close >= 0 else size
            elif name == "a":
                links += 1
            elif name == "br":
                self.pieces.append((stack[-1], block, " ", False))
            elif name in VOID:
                self.inputs[stack[-1]] += name == "input"
            elif name not in INLINE:
                block += 1
                self._open(stack, name, m[3])
                if m[3].endswith("/") and name not in ("p", "div", "li"):
                    stack.pop()

    def _open(self, stack: list[int], name: str, attributes: str) -> None:
        if name in ("html", "body") and len(stack) > 1 and any(self.tag[s] == name for s in stack):
            return
        closing = CLOSES.get(name, ())
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag == "p" or tag in closing:
                del stack[i:]
            elif tag in SCOPE:
                break
        tokens: list[str] = []
        mark = None
        if attributes:
            for k, a, b, c in ATTRIBUTE.findall(attributes):
                k = k.lower()
                if k == "data-y":
                    mark = a
                elif k in READ:
                    tokens += [p.lower() for p in PART.findall(a or b or c)]
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.depth.append(self.depth[stack[-1]] + 1)
        self.tokens.append(tuple(tokens))
        self.marks.append(mark)
        self.inputs.append(0)
        stack.append(len(self.tag) - 1)

    def _close(self, stack: list[int], name: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] == name:
                del stack[i:]
                return

    def text(self, chosen: list[bool]) -> str:
        """The text of the chosen nodes: one line a block, white space as one blank."""
        lines: list[str] = []
        last, parts = None, []
        for node, block, piece, _ in self.pieces:
            if chosen[node]:
                if block != last:
                    if parts:
                        lines.append("".join(parts))
                    last, parts = block, []
                parts.append(piece)
        if parts:
            lines.append("".join(parts))
        blocks = (" ".join(html.unescape(x).split()) for x in lines)
        return "\n".join(b for b in blocks if b)

    def features(self, vocabulary: dict[str, int]) -> np.ndarray:
        """A row for each node: density of the subtree, depth, siblings, place, and attribute tokens of it and above."""
        n = len(self.tag)
        own, linked, stops, words = [0] * n, [0] * n, [0] * n, [0] * n
        begin, end = [0] * n, [0] * n
        seen = 0
        for node, _, piece, link in self.pieces:
            k = len(piece) if not piece.isspace() else 0
            if k:
                if not own[node]:
                    begin[node] = seen
                own[node] += k
                seen += k
                end[node] = seen
                if link:
                    linked[node] += k
                stops[node] += piece.count(",") + piece.count(".")
                words[node] += piece.count(" ") + 1
        all_text, all_linked, all_stops, all_words, nodes, paragraphs, items, inputs = own[:], linked[:], stops[:], words[:], [1] * n, [0] * n, [0] * n, self.inputs[:]
        children, place = [0] * n, [0] * n
        first = [begin[i] if own[i] else 1 << 60 for i in range(n)]
        last = end[:]
        tag, parent = self.tag, self.parent
        for i in range(1, n):
            p = parent[i]
            children[p] += 1
            place[i] = children[p]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            all_text[p] += all_text[i]
            all_linked[p] += all_linked[i]
            all_stops[p] += all_stops[i]
            all_words[p] += all_words[i]
            nodes[p] += nodes[i]
            inputs[p] += inputs[i]
            paragraphs[p] += paragraphs[i] + (tag[i] == "p")
            items[p] += items[i] + (tag[i] == "li")
            first[p] = min(first[p], first[i])
            last[p] = max(last[p], last[i])
        total = max(1, all_text[0])
        size = len(vocabulary)
        out = np.zeros((n, 18 + 2 * size))
        for i in range(1, n):
            p, t = parent[i], all_text[i]
            out[i, :18] = (
                self.depth[i], math.log1p(t), all_linked[i] / max(1, t), all_stops[i] / max(1, all_words[i]), t / nodes[i], math.log1p(t / nodes[i]),
                own[i] / max(1, t), paragraphs[i], items[i] / nodes[i], inputs[i], t / total, t / max(1, all_text[p]), place[i], place[i] / children[p],
                children[p], children[i], min(first[i], total) / total, last[i] / total)
            out[i, 18 + size:] = np.maximum(out[p, 18 + size:], out[p, 18:18 + size])
            for token in (f"<{tag[i]}>", *self.tokens[i]):
                at = vocabulary.get(token)
                if at is not None:
                    out[i, 18 + at] = 1
        return out


#: States of a node, and which may stand below which.
MIXED, CONTENT, DROPPED = 0, 1, 2
BELOW = {MIXED: (MIXED, CONTENT, DROPPED), CONTENT: (CONTENT, DROPPED), DROPPED: (DROPPED,)}


def decode(page: Page, content: np.ndarray, mixed: np.ndarray, prior: np.ndarray, move: np.ndarray) -> list[int]:
    """Most likely states of all nodes that do not contradict each other.

    Below a mixed node anything goes, below content only content or dropped, below dropped only
    dropped. content: log odds of being content rather than dropped; mixed: of being mixed; prior: log
    share of each state; move: log probability of a state (column) below another (row).
    """
    n = len(page.tag)
    log = lambda x: -np.logaddexp(0, -x)
    not_mixed = log(-mixed)
    score = np.stack([log(mixed), not_mixed + log(content), not_mixed + log(-content)]) - prior[:, None]
    score[:, 0] = (0, -1e9, -1e9)
    table = score.T.tolist()
    step = move.tolist()
    for i in range(n - 1, 0, -1):
        own, up = table[i], table[page.parent[i]]
        for above, states in BELOW.items():
            up[above] += max(step[above][s] + own[s] for s in states)
    state = [MIXED] * n
    for i in range(1, n):
        above, own = state[page.parent[i]], table[i]
        state[i] = max(BELOW[above], key=lambda s: step[above][s] + own[s])
    return state


#: Elements that only hold the page, and such as only hold running text.
FRAME = ("#root", "html", "body")
RUNNING = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre")


def main_text(page: Page, states: list[int]) -> str:
    """The text of the content nodes.

    Of a page without any: what stands directly in its frame or in mixed nodes, and the running text right below those.
    """
    text = page.text([s == CONTENT for s in states])
    if text:
        return text
    bare = [s == MIXED or t in FRAME for s, t in zip(states, page.tag, strict=True)]
    return page.text([b or t in RUNNING and bare[up] for b, t, up in zip(bare, page.tag, page.parent, strict=True)])
