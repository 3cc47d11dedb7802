"""Benchmark decontamination: training words stream through a suffix automaton of the test items.

The automaton is built on the driver from at most AUTOMATON_WORDS item words; more are dealt to
several automata, and the documents pass through one after the other. A document's words are
compared with the vocabulary and the word pairs of the items at once (numpy); only runs of known
pairs that are long enough to hold a window are streamed through the automaton.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkproof.llm.common import stored
from inkproof.llm.suffix_automaton import SuffixAutomaton
from inkproof.llm.textbatch import ALNUM, Words, chunks

AUTOMATON_WORDS, PIECE_WORDS = 200_000, 20_000


def _pieces(window: int):
    """(item_id, text) to (item_id, words as int64 list); long items in pieces that overlap by a window less one."""

    def run(batches):
        for batch in batches:
            ids, values = [], []
            with np.errstate(over="ignore"):
                for at, w in chunks(batch.column(1), ALNUM):
                    for i in range(len(w.first) - 1):
                        own = w.hash[w.first[i]:w.first[i + 1]].view(np.int64)
                        for a in range(0, max(1, len(own) - window + 1), PIECE_WORDS):
                            ids.append(batch.column(0)[at + i].as_py())
                            values.append(own[a:a + PIECE_WORDS + window - 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([v.tolist() for v in values], pa.list_(pa.int64()))], names=["item_id", "words"])

    return run


def runs_of_known_words(w: Words, automaton: SuffixAutomaton) -> list[tuple[int, int, list[int]]]:
    """(text, first word in it, codes) of the runs that can hold a window."""
    vocabulary = automaton.vocabulary
    code = np.searchsorted(vocabulary, w.hash)
    code[code == len(vocabulary)] = 0
    known = vocabulary[code] == w.hash
    if automaton.least == 1:
        same = known[1:] & known[:-1] & (w.doc[1:] == w.doc[:-1])
    else:
        same = known[1:] & known[:-1] & (w.doc[1:] == w.doc[:-1])
        at = np.flatnonzero(same)
        pair = code[at] * len(vocabulary) + code[at + 1]
        place = np.searchsorted(automaton.pairs, pair)
        place[place == len(automaton.pairs)] = 0
        same[at] = automaton.pairs[place] == pair
    edges = np.diff(np.concatenate(([False], same, [False])).astype(np.int8))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + 1  # words begin..end - 1
    if automaton.least == 1:
        alone = known.copy()
        alone[1:] &= ~same
        alone[:-1] &= ~same
        lone = np.flatnonzero(alone)
        begin, end = np.concatenate((begin, lone)), np.concatenate((end, lone + 1))
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
    else:
        long = end - begin >= automaton.least
        begin, end = begin[long], end[long]
    return [(int(w.doc[a]), int(a - w.first[w.doc[a]]), code[a:b].tolist()) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(automaton: SuffixAutomaton, names: list[str | None], max_span: int, coverage: float, keep_text: bool):
    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 1024):
                yield scan(batch.slice(part, 1024))

    def scan(batch):
        texts = batch.column(1)
        n = batch.num_rows
        earlier, counts = batch.column(3).to_pylist(), np.zeros(n, np.int64)
        found: list[list[tuple[int, int]]] = [list(zip(x[::2], x[1::2], strict=True)) for x in batch.column(2).to_pylist()]
        items: list[set[str]] = [set(x) for x in earlier]
        cleaned: list[str | None] = [None] * n
        with np.errstate(over="ignore"):
            for at, w in chunks(texts, ALNUM):
                counts[at:at + len(w.first) - 1] = np.diff(w.first)
                if len(automaton.vocabulary) and len(w.hash):
                    for doc, first, code in runs_of_known_words(w, automaton):
                        spans, own = automaton.match(code)
                        found[at + doc] += [(first + a, first + b) for a, b in spans]
                        items[at + doc] |= {names[i] for i in own if names[i] is not None}
                if keep_text:
                    for i in range(len(w.first) - 1):
                        spans = merged(found[at + i])
                        hit = sum(b - a for a, b in spans)
                        cut = spans if hit >= coverage * counts[at + i] else [x for x in spans if x[1] - x[0] > max_span]
                        cleaned[at + i] = without(texts[at + i].as_py(), w, w.first[i], cut, int(w.offsets[i])) if cut else texts[at + i].as_py()
        found = [merged(x) for x in found]
        hits = [sum(b - a for a, b in x) for x in found]
        spans = pa.array([[v for s in x for v in s] for x in found], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), texts if keep_text else pa.nulls(n, pa.string()), spans, pa.array([sorted(x) for x in items], pa.list_(pa.string())),
             pa.array(counts), pa.array(hits, pa.int64()), pa.array(cleaned, pa.string())],
            names=["doc_id", "text", "spans", "items", "n_words", "n_hit", "cleaned"])

    return run


def without(text: str, w: Words, first: int, spans: list[tuple[int, int]], base: int) -> str:
    """The text without the words of the spans; a blank stands for each."""
    raw, at, out = text.encode(), 0, []
    for a, b in spans:
        out.append(raw[at:int(w.start[first + a]) - base])
        at = int(w.end[first + b - 1]) - base
    out.append(raw[at:])
    return b" ".join(x.strip() for x in out).strip().decode("utf-8", "replace")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: float = 0.05, max_span: int = 1 << 30, keep_text: bool = False,
) -> DataFrame:
    """doc_id, n_words, n_hit, spans (word numbers: first, after the last, ...), items, contaminated and,
    if asked for, text and cleaned for every row of docs (doc_id, text).

    cleaned: the text without its hit spans if they cover the share `coverage` of its words, else
    without those longer than max_span words. Null and empty texts have no words and are clean; items
    without words are never found; items without an id count as hits but are not listed.
    """
    spark = docs.sparkSession
    pieces = stored(
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
        .mapInArrow(_pieces(window), "item_id string, words array<long>").filter(F.size("words") > 0).distinct(), "items")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = -(-2 * total // AUTOMATON_WORDS) if total > AUTOMATON_WORDS else 1
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text string, spans array<long>, items array<string>, n_words long, n_hit long, cleaned string"
    empty = F.array()
    out = docs.select("doc_id", "text", empty.cast("array<long>").alias("spans"), empty.cast("array<string>").alias("items"))
    for part in range(parts):
        own = pieces.filter(F.pmod(F.xxhash64("words"), F.lit(parts)) == part).collect()  # about half of AUTOMATON_WORDS at most
        automaton = SuffixAutomaton([(i, np.array(r.words, np.int64).view(np.uint64)) for i, r in enumerate(own)], window)
        last = part == parts - 1
        run = _scan(automaton, [r.item_id for r in own], max_span, coverage, keep_text or not last)
        out = out.select("doc_id", "text", "spans", "items").mapInArrow(run, schema)
        out = out if last else stored(out, f"scan-{part}")
    share = round(1 / coverage)
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    return out if keep_text else out.drop("text", "cleaned")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = decontaminate(docs, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")).cast("binary"), 256).alias("items_sha256"), "contaminated")
