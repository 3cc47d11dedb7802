"""Toxicity by the nearest labelled examples: exact TF-IDF cosine, block-max inverted index, weighted votes.

Terms are words and word beginnings (inflected forms share those) that labelled toxic texts have
more often than chance allows among so many candidates; equal texts count once. Each text becomes a short vector of such terms; the texts are read
once for the labelled statistics and once for the vectors. The labelled examples form an inverted
index in blocks with the largest weight of each term in a block, so that blocks which cannot reach
the nearest ones so far are skipped without changing the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.llm.common import bucket_of, labelled, stored
from inkproof.llm.textbatch import ALNUM, Words, chunks

#: Bounds of the fitted model: labelled rows, terms, examples in the index (toxic and other).
MAX_LABELLED, MAX_TERMS, MAX_EXAMPLES = 100_000, 20_000, 4_000
PREFIXES = (4, 5, 6)
NEIGHBOURS, BLOCK, FIRST_BLOCKS = 15, 64, 2
#: Chance may make so many terms in all, and the least ratio of a term's odds to those of all.
#: Equal texts count once, so that copies of one toxic text cannot make a term.
BY_CHANCE, LEAST_ODDS = 30.0, 10.0
#: Share assumed for one imaginary row where no labelled row says anything.
PRIOR = 0.05


def terms_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, term hash) of every occurrence."""
    docs, hashes = [w.doc], [w.hash]
    for size in PREFIXES:
        at, h = w.prefixes(size)
        docs.append(w.doc[at])
        hashes.append(h)
    return np.concatenate(docs), np.concatenate(hashes)


def _label_counts(batches):
    """(text, label) to (term, toxic texts, texts), added up for each few batches."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def flush():
        h = np.concatenate([p[0] for p in parts])
        y = np.concatenate([p[1] for p in parts])
        term, at = np.unique(h, return_inverse=True)
        n = len(term)
        return pa.RecordBatch.from_arrays(
            [pa.array(term.view(np.int64)), pa.array(np.bincount(at, weights=y, minlength=n).astype(np.int64)), pa.array(np.bincount(at, minlength=n))],
            names=["term", "toxic", "texts"])

    for batch in batches:
        labels = np.array(batch.column(1).to_pylist(), np.float64)
        with np.errstate(over="ignore"):
            for at, w in chunks(batch.column(0), ALNUM):
                doc, h = terms_of(w)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                parts.append((h[new], labels[at + doc[new]]))
                held += int(new.sum())
                if held > 2_000_000:
                    yield flush()
                    parts, held = [], 0
    if parts:
        yield flush()


def _vectors(vocabulary: np.ndarray):
    """(doc_id, text) to (doc_id, terms, counts) of the known terms."""

    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 2048):
                yield vectors(batch.slice(part, 2048))

    def vectors(batch):
        ends, terms, counts = [np.zeros(1, np.int64)], [], []
        base = 0
        with np.errstate(over="ignore"):
            for _, w in chunks(batch.column(1), ALNUM):
                doc, h = terms_of(w)
                if len(vocabulary):
                    at = np.searchsorted(vocabulary, h)
                    at[at == len(vocabulary)] = 0
                    hit = vocabulary[at] == h
                    key, n = np.unique(doc[hit] * len(vocabulary) + at[hit], return_counts=True)
                else:
                    key = n = np.zeros(0, np.int64)
                texts = len(w.first) - 1
                own = np.searchsorted(key, np.arange(1, texts + 1) * max(1, len(vocabulary)))
                ends.append(base + own)
                base += len(key)
                terms.append(key % max(1, len(vocabulary)))
                counts.append(n)
        at = pa.array(np.concatenate(ends), pa.int32())
        flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0), pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(at, flat(terms)), pa.ListArray.from_arrays(at, flat(counts))],
            names=["doc_id", "terms", "counts"])

    return run


def weights(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf[terms]
    norm = math.sqrt(float(w @ w))
    return w / norm if norm else w


class BlockMaxIndex:
    """Inverted lists of the examples' weights, with the largest weight of each term in each block."""

    def __init__(self, examples: list[tuple[object, int, np.ndarray, np.ndarray]], idf: np.ndarray) -> None:
        self.idf = idf
        self.ids = [e[0] for e in examples]
        self.labels = np.array([e[1] for e in examples], np.float64)
        self.blocks = -(-len(examples) // BLOCK)
        lists: dict[int, list[tuple[int, float]]] = {}
        for at, (_, _, terms, counts) in enumerate(examples):
            for t, x in zip(terms.tolist(), weights(terms, counts, idf).tolist(), strict=True):
                lists.setdefault(t, []).append((at, x))
        #: Of each term: examples, weights and the examples' blocks; the largest weight in each block.
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.most: dict[int, np.ndarray] = {}
        for t, entries in lists.items():
            at = np.array([e[0] for e in entries])
            x = np.array([e[1] for e in entries])
            self.lists[t] = at, x, at // BLOCK
            most = np.zeros(self.blocks)
            np.maximum.at(most, at // BLOCK, x)
            self.most[t] = most
        self.own: dict[object, list[int]] = {}
        for at, e in enumerate(self.ids):
            self.own.setdefault(e, []).append(at)

    def _scores(self, query: list[tuple[int, float]], blocks: np.ndarray, leave_out: object) -> np.ndarray:
        """Cosines with the examples of the marked blocks, 0 elsewhere."""
        at, x = [], []
        for t, q in query:
            own, w, block = self.lists[t]
            kept = blocks[block]
            at.append(own[kept])
            x.append(q * w[kept])
        scores = np.bincount(np.concatenate(at), np.concatenate(x), len(self.ids))
        if leave_out is not None:
            scores[self.own.get(leave_out, [])] = 0
        return scores

    def nearest(self, terms: np.ndarray, counts: np.ndarray, leave_out: object = None) -> list[tuple[float, int]]:
        """The NEIGHBOURS examples of largest cosine over 0, as (cosine, number); ties go to the lower number.

        The most promising blocks give a cosine that the nearest ones reach at least; blocks whose bound
        is lower are never looked at.
        """
        query = [(t, x) for t, x in zip(terms.tolist(), weights(terms, counts, self.idf).tolist(), strict=True) if t in self.lists]
        if not query:
            return []
        bound = sum(x * self.most[t] for t, x in query)
        blocks = bound > 0
        if self.blocks > FIRST_BLOCKS:
            first = np.zeros(self.blocks, bool)
            first[np.argpartition(-bound, FIRST_BLOCKS)[:FIRST_BLOCKS]] = True
            seen = self._scores(query, first & blocks, leave_out)
            if len(seen) > NEIGHBOURS:
                blocks &= bound >= np.partition(seen, -NEIGHBOURS)[-NEIGHBOURS] - 1e-12
        scores = self._scores(query, blocks, leave_out)
        found = np.flatnonzero(scores > 0)
        if len(found) > NEIGHBOURS:
            found = found[scores[found] >= np.partition(scores[found], -NEIGHBOURS)[-NEIGHBOURS]]
        best = found[np.lexsort((found, -scores[found]))][:NEIGHBOURS]
        return [(float(scores[i]), int(i)) for i in best]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Mean label weighted by the cosine; -1 without a neighbour."""
        mass = sum(c for c, _ in near)
        return float(sum(c * self.labels[i] for c, i in near) / mass) if mass else -1.0


def _votes(index: BlockMaxIndex, own: bool, score):
    """(doc_id, terms, counts) to (doc_id, vote, score, evidence). own: a row is not its own neighbour."""

    def run(batches):
        for batch in batches:
            ids, votes, scores, evidence = batch.column(0), [], [], []
            known = ids.to_pylist() if own else None
            for i, (terms, counts) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                t = terms.values.to_numpy()
                near = index.nearest(t, counts.values.to_numpy(), known[i] if own else None) if len(t) else []
                votes.append(index.vote(near))
                scores.append(score(votes[-1], len(t) > 0))
                evidence.append([{"doc_id": str(index.ids[a]), "cosine": c, "label": int(index.labels[a])} for c, a in near])
            kind = pa.list_(pa.struct([("doc_id", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(votes, pa.float64()), pa.array(scores, pa.float64()), pa.array(evidence, kind)],
                names=["doc_id", "vote", "score", "evidence"])

    return run


def calibration(counts: list[tuple[float, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps (vote, share toxic) through (vote, toxic rows, rows): pooled neighbours where shares fall."""
    steps: list[list[float]] = []
    for vote, toxic, rows in sorted(counts):
        steps.append([vote, toxic + PRIOR, rows + 1.0])
        while len(steps) > 1 and steps[-2][1] / steps[-2][2] >= steps[-1][1] / steps[-1][2]:
            last = steps.pop()
            steps[-1] = [last[0], steps[-1][1] + last[1], steps[-1][2] + last[2]]
    return np.array([s[0] for s in steps]), np.array([s[1] / s[2] for s in steps])


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: Column | None = None) -> DataFrame:
    """doc_id, vote, score and evidence for every row of docs (doc_id, text).

    Learns from the labels (doc_id, toxic) of rows that `fold` (a condition on doc_id) admits. Texts
    without a known term, and null and empty ones, get the share of toxic rows among such labelled texts.
    Without any labelled toxic text every score is small. Rows with equal ids are scored one by one.
    """
    spark = docs.sparkSession
    known = labelled(labels, "toxic", F.lit(True) if fold is None else fold, MAX_LABELLED)
    kind = dict(docs.dtypes)["doc_id"]
    own = docs.select("doc_id", "text").join(known, "doc_id")
    own = stored(own.groupBy("text").agg(F.max("label").cast("double").alias("label")), "labelled")
    rows, toxic = own.agg(F.count(F.lit(1)), F.sum("label")).first()
    share = min(max((toxic or 0.0) / rows if rows else 0.0, 1e-9), 1 - 1e-9)
    counted = stored(
        own.mapInArrow(_label_counts, "term long, toxic long, texts long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts")), "counts")
    candidates = counted.count()
    # the chance that so many of a term's texts are toxic is at most exp(-texts * divergence)
    part = F.col("toxic") / F.col("texts")
    divergence = part * F.log(part / share) + F.when(part < 1, (1 - part) * F.log((1 - part) / (1 - share))).otherwise(0.0)
    surprise = F.col("texts") * divergence
    odds = F.col("toxic") * (1 - share) / (share * (F.col("texts") - F.col("toxic")) + 1e-9)
    chosen = (
        counted.filter((F.col("toxic") > 0) & (odds >= LEAST_ODDS)).filter(surprise >= math.log(max(candidates, 1) / BY_CHANCE))
        .orderBy(surprise.desc(), "term").limit(MAX_TERMS).select("term").collect()
    )
    vocabulary = np.sort(np.array([r.term for r in chosen], np.int64).view(np.uint64))
    vectors = stored(
        docs.select("doc_id", "text").mapInArrow(_vectors(vocabulary), f"doc_id {kind}, terms array<int>, counts array<int>"), "vectors")
    total = vectors.count()
    df = np.zeros(len(vocabulary))
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each known term
        df[r["t"]] = r["count"]
    idf = np.log((1 + total) / (1 + df)) + 1

    marked = stored(vectors.join(known, "doc_id"), "marked")
    plain = marked.filter(F.size("terms") == 0).agg(F.count(F.lit(1)), F.sum("label")).first()
    base = ((plain[1] or 0) + PRIOR) / (plain[0] + 1)
    some = marked.filter(F.size("terms") > 0)
    per_class = {r["label"]: r["count"] for r in some.groupBy("label").count().collect()}
    examples = []
    for label, n in sorted(per_class.items()):
        part = some.filter(F.col("label") == label)
        if n > MAX_EXAMPLES // 2:
            part = part.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(MAX_EXAMPLES / 2 / n * (1 << 20)))
        examples += [(r.doc_id, label, np.array(r.terms), np.array(r.counts)) for r in part.collect()]
    # neighbours in a block should be alike: by first term, rarest first
    examples.sort(key=lambda e: (df[e[2]].min(), int(e[2][np.argmin(df[e[2]])]), str(e[0])))
    index = BlockMaxIndex(examples, idf)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a given number is not merged again: rows are few bytes but much work
    fields = f"doc_id {kind}, vote double, score double, evidence array<struct<doc_id: string, cosine: double, label: int>>"
    tried = some.select("doc_id", "terms", "counts").repartition(tasks, "doc_id").mapInArrow(_votes(index, True, lambda v, s: 0.0), fields)
    seen = (
        tried.select("doc_id", F.round("vote", 2).alias("vote")).join(known, "doc_id").groupBy("vote")
        .agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("rows")).collect()  # about 100 votes
    )
    steps = calibration([(r.vote, r.toxic, r.rows) for r in seen])

    def score(vote: float, some_terms: bool) -> float:
        if not some_terms or not len(steps[0]):
            return base
        return float(np.interp(vote, *steps))

    # the vectors lie in few small files: deal the rows with terms out, the others need no neighbours
    with_terms = vectors.filter(F.size("terms") > 0).repartition(tasks, "doc_id").mapInArrow(_votes(index, False, score), fields)
    evidence = dict(with_terms.dtypes)["evidence"]
    rest = vectors.filter(F.size("terms") == 0).select(
        "doc_id", F.lit(-1.0).alias("vote"), F.lit(float(base)).alias("score"), F.array().cast(evidence).alias("evidence"))
    return with_terms.unionByName(rest)


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence; rows whose crc32 of the id leaves `held` are never learnt from."""
    out = bucket_of(F.col("doc_id"), modulus) == held
    return score_toxicity(docs, labels, ~out).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "evidence")
