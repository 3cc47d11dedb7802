"""Quality by compression: how much smaller a text gets with a dictionary of good text than with one of bad text.

Two zstandard dictionaries are trained on a bounded sample of labelled texts. Each whole text is cut
into short blocks, so that a text cannot learn from itself, and compressed with either. The normalised
difference of the sizes, with the size itself, goes through a logistic curve that is fitted on
other labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.llm.common import bucket_of, labelled

#: Bounds of the fitted model: labelled rows in all, texts for a dictionary and for the curve, bytes of such a text.
MAX_LABELLED, DICTIONARY_TEXTS, CURVE_TEXTS, SAMPLE_BYTES = 100_000, 1_500, 20_000, 32_768
DICTIONARY_BYTES, DICTIONARY_BLOCK, BLOCK, LEVEL = 65_536, 256, 128, 3


def train(texts: list[bytes]) -> bytes:
    """A dictionary; of few texts, the texts themselves."""
    blocks = [t[i:i + DICTIONARY_BLOCK] for t in texts for i in range(0, len(t), DICTIONARY_BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[:DICTIONARY_BYTES]


class Sizes:
    """Compressed sizes of a text with both dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.tools = []
        for raw in (good, bad):
            kept = zstandard.ZstdCompressionDict(raw)
            kept.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(dict_data=kept, write_content_size=False, write_dict_id=False))

    def features(self, text: bytes) -> list[float]:
        """Normalised difference, log of size over length, log of the number of bytes; and some products."""
        with_good = with_bad = 0
        good, bad = self.tools
        for i in range(0, len(text), BLOCK):
            block = text[i:i + BLOCK]
            with_good += len(good.compress(block))
            with_bad += len(bad.compress(block))
        difference = (with_bad - with_good) / max(1, min(with_good, with_bad))
        ratio, size = np.log(max(1, with_good) / max(1, len(text))), np.log(1 + len(text)) / 10
        return [1.0, difference, ratio, size, difference * abs(difference), ratio * ratio, size * size, difference * ratio, size * ratio, ratio**3, difference * size]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic curve by Newton's method; columns are scaled, and the weights scaled back."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge * 1e-2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def _features(good: bytes, bad: bytes):
    def run(batches):
        sizes = Sizes(good, bad)
        for batch in batches:
            rows = [sizes.features(t.encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])

    return run


def _scores(good: bytes, bad: bytes, w: np.ndarray):
    def run(batches):
        sizes = Sizes(good, bad)
        for batch in batches:
            out = []
            for t in batch.column(1):
                text = (t.as_py() or "").encode()
                x = np.array(sizes.features(text)) if text.strip() else None
                out.append(0.0 if x is None else float(1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, fold: Column | None = None) -> DataFrame:
    """doc_id and score (0 to 1) for every row of docs (doc_id, text).

    Learns from labels (doc_id, quality) of the rows that `fold` admits: by a hash of the id, half of
    them for the dictionaries and half for the curve. Null and blank texts score 0. If one of the two
    kinds has no labelled text, every other score is the share of good labels, 0.5 without labels.
    """
    known = labelled(labels, "quality", F.lit(True) if fold is None else fold, MAX_LABELLED)
    kind = dict(docs.dtypes)["doc_id"]
    half = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)) == 0
    own = docs.select("doc_id", "text").join(known, "doc_id").filter(F.octet_length("text").between(1, SAMPLE_BYTES))
    sizes = {r["label"]: r["count"] for r in own.filter(half).groupBy("label").count().collect()}
    part = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 20))
    chosen = own.filter(half).filter(part < F.when(F.col("label") == 1, _share(sizes.get(1), DICTIONARY_TEXTS)).otherwise(_share(sizes.get(0), DICTIONARY_TEXTS)))
    texts = chosen.select("label", "text", "doc_id").collect()  # 2 * DICTIONARY_TEXTS of SAMPLE_BYTES at most
    pick = lambda label: [r.text.encode() for r in sorted(texts, key=lambda r: r.doc_id) if (r.label == 1) == label]
    good_texts, bad_texts = pick(True), pick(False)
    if not good_texts or not bad_texts:
        share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
        blank = F.length(F.btrim(F.coalesce("text", F.lit("")))) == 0
        return docs.select("doc_id", F.when(blank, 0.0).otherwise(share).alias("score"))
    good, bad = train(good_texts), train(bad_texts)
    rest = own.filter(~half)
    rows = rest.count()
    seen = rest.filter(part < _share(rows, CURVE_TEXTS)).select("label", "text").mapInArrow(_features(good, bad), "label int, x array<double>").collect()
    x = np.array([r.x for r in seen]) if seen else np.zeros((0, 11))
    y = np.array([1.0 if r.label == 1 else 0.0 for r in seen])
    # two imaginary rows at the origin keep the curve finite if one kind is missing
    weights = fit(np.vstack([x, np.eye(1, x.shape[1]), np.eye(1, x.shape[1])]), np.concatenate([y, [0.0, 1.0]]))
    return docs.select("doc_id", "text").mapInArrow(_scores(good, bad, weights), f"doc_id {kind}, score double")


def _share(rows: int | None, most: int) -> int:
    return 1 << 20 if not rows or rows <= most else int(most / rows * (1 << 20))


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted; rows whose crc32 of the id leaves `held` are never learnt from."""
    out = bucket_of(F.col("doc_id"), modulus) == held
    return score_quality(docs, labels, ~out).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
