"""Main text of web pages: boosted trees over the nodes of the page, and states that do not contradict each other.

The model is trained on TRAINING_PAGES made-up pages (html_samples) before the job starts; its size
does not depend on the data. Pages are parsed and judged one by one in tasks; nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkproof.llm import html_samples
from inkproof.llm.boosting import BoostedTrees
from inkproof.llm.dom import Page, decode, main_text

TRAINING_PAGES, LEAST_PAGES = 500, 3


class Extractor:
    def __init__(self, training_pages: int = TRAINING_PAGES, seed: int = 1) -> None:
        pages = [Page(p) for p in html_samples.pages(training_pages, seed)]
        found = Counter(t for p in pages for t in {x for i in range(1, len(p.tag)) for x in (f"<{p.tag[i]}>", *p.tokens[i])})
        self.vocabulary = {t: i for i, t in enumerate(sorted(t for t, n in found.items() if n >= LEAST_PAGES))}
        rows = np.concatenate([p.features(self.vocabulary)[1:] for p in pages])
        marks = np.array([m for p in pages for m in inherited(p)[1:]])
        states = [["mcd".index(m) for m in inherited(p)] for p in pages]
        count, moves = np.ones(3), np.ones((3, 3))
        for p, own in zip(pages, states, strict=True):
            for i in range(1, len(own)):
                count[own[i]] += 1
                moves[own[p.parent[i]], own[i]] += 1
        self.prior, self.move = np.log(count / count.sum()), np.log(moves / moves.sum(axis=1, keepdims=True))
        self.mixed = BoostedTrees().fit(rows, (marks == "m").astype(float))
        whole = marks != "m"
        self.content = BoostedTrees().fit(rows[whole], (marks[whole] == "c").astype(float))

    def texts(self, sources: list[str]) -> list[str]:
        pages = [Page(s) for s in sources]
        rows = np.concatenate([p.features(self.vocabulary) for p in pages]) if pages else np.zeros((0, 0))
        content, mixed = self.content.decision_function(rows), self.mixed.decision_function(rows)
        out, at = [], 0
        for p in pages:
            to = at + len(p.tag)
            out.append(main_text(p, decode(p, content[at:to], mixed[at:to], self.prior, self.move)))
            at = to
        return out


def inherited(page: Page) -> list[str]:
    marks: list[str] = ["m"]
    for i in range(1, len(page.tag)):
        above = marks[page.parent[i]]
        marks.append(page.marks[i] or (above if above != "m" else "d"))
    return marks


@cache
def default_extractor() -> Extractor:
    """Trained once a process."""
    return Extractor()


def _extract(extractor: Extractor):
    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                piece = batch.slice(part, 64)
                texts = extractor.texts([s or "" for s in piece.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return run


def main_texts(pages: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of pages (page_id, url, html).

    Null and empty pages have an empty text. On a page where no element is main content, the text that
    stands directly in the page or in an element of mixed content is.
    """
    kinds = dict(pages.dtypes)
    run = _extract(extractor or default_extractor())
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
