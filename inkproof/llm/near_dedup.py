"""Near-duplicate groups by bottom-k sketches.

Every word shingle has one 64-bit hash; the k smallest of a text are its sketch. Inverted lists of
the retained values give the overlaps, the sketch of the union estimates the similarity of a
candidate pair, and the full sets decide.

1. Texts with equal sets become one class. 2. Sketches of SCREEN values: a class goes on only if
enough of them are found in another class (the share of 0.75 less 5.5 standard deviations; texts
with no more shingles than that are screened exactly). 3. The classes left get sketches of WIDE
values. Ordered by rarity, those beyond the least overlap that the similarity asks for (a prefix)
form the inverted lists. A pair can only reach the threshold if the values that each has left after
the first common one reach the overlap that their two sizes ask for, so hardly any other pair is
looked at. 4. In every list each class is tried against the most central one; what is linked
becomes a component. 5. Pairs from different components of a list are tried then, so a group of
thousands of copies costs one pair a copy, while no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.llm.common import stored
from inkproof.llm.components import components
from inkproof.llm.textbatch import NOT_BLANK, U64, chunks, mix

SCREEN, WIDE, UNION_SKETCH = 64, 1024, 256
#: Flips the top bit, so that the values are in the same order as signed numbers: Spark knows no others.
SIGN = U64(1 << 63)
DEVIATIONS = 5.5
_WEIGHTS = [U64(x) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3)]


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    weights = [_WEIGHTS[i % 5] + U64(2 * (i // 5)) for i in range(width)]
    for _, w in chunks(texts, NOT_BLANK):
        h, total = w.hash, len(w.hash)
        rolled = np.zeros(max(0, total - width + 1), np.uint64)
        for i, c in enumerate(weights):
            rolled += h[i:i + len(rolled)] * c
        rolled = mix(rolled)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a:b - width + 1])
            elif b > a:
                part = U64(b - a) * U64(0x2545F4914F6CDD1D)
                for x, c in zip(h[a:b], weights, strict=False):
                    part = part + x * c
                yield mix(np.array([part]))
            else:
                yield np.zeros(0, np.uint64)


def _signatures(keep: int | None):
    """Arrow batches (doc_id, text) to (doc_id, n, set_key, values): the smallest `keep` values, or all."""

    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                piece = batch.slice(part, 512)
                n, keys, values, ends = [], [], [], [0]
                with np.errstate(over="ignore"):
                    for s in shingle_sets(piece.column(1)):
                        n.append(len(s))
                        keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                        values.append(s[:keep] if keep else s)
                        ends.append(ends[-1] + len(values[-1]))
                flat = pa.array((np.concatenate(values) ^ SIGN).view(np.int64) if values else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                    names=["doc_id", "n", "set_key", "values"])

    return run


def signatures(docs: DataFrame, keep: int | None) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        _signatures(keep), f"doc_id {kind}, n long, set_key binary, values array<long>")


def least_overlap(n: Column, k: int) -> Column:
    """Retained values that a text of n shingles shares at least with any text it links with."""
    share = F.lit(k) / F.greatest(n / 0.75, F.lit(float(k)))
    sampled = 0.75 * k - DEVIATIONS * F.sqrt(0.1875 * k * (1 - share))
    return F.greatest(F.lit(1), F.least(F.ceil(0.75 * n), F.floor(F.when(n / 0.75 > k, sampled).otherwise(n))))


def pair_overlap(n_a: Column, n_b: Column) -> Column:
    """The same for a pair of known sizes among WIDE values: exact if neither has more shingles."""
    larger = F.greatest(n_a, n_b)
    exact = (n_a + n_b) * 3 / 7
    slack = DEVIATIONS * (0.1875 * WIDE) ** 0.5
    return F.when(larger <= WIDE, exact - 1e-6).otherwise(exact * WIDE / larger - slack)


def shared_values(sets: DataFrame) -> DataFrame:
    """(value, df, key, n, kept) of the retained values that more than one set has."""
    postings = sets.select("key", "n", F.size("values").alias("kept"), F.explode("values").alias("value"))
    often = postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    often = often.select((F.col("value").bitwiseXOR(F.lit(1))).alias("other"), "df")  # another key: dealt out anew, so hot values can be split
    return postings.join(often, F.col("value").bitwiseXOR(F.lit(1)) == F.col("other")).drop("other")


def inverted_lists(sets: DataFrame) -> DataFrame:
    """(value, key, n, left, central): the prefix of each set; left: the values from this one on."""
    own = shared_values(sets).groupBy("key", "n", "kept").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("own"), F.sum(F.log("df")).alias("logs"))
    need = least_overlap(F.col("n"), WIDE)
    prefix = F.size("own") - need + 1
    return (
        own.filter(prefix >= 1)
        .select("key", "n", (F.col("logs") / F.col("kept")).alias("central"), F.size("own").alias("shared"),
                F.posexplode(F.slice("own", F.lit(1), prefix.cast("int"))).alias("at", "entry"))
        .select(F.col("entry.value").alias("value"), "key", "n", "central", (F.col("shared") - F.col("at")).alias("left"))
    )


def may_link(a: str, b: str) -> Column:
    """The positional test for two rows of one list."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(f"{a}.left", f"{b}.left") >= pair_overlap(n_a, n_b)) & (4 * F.least(n_a, n_b) >= 3 * F.greatest(n_a, n_b))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the union sketch lets through and the full sets confirm."""
    side = lambda x: sets.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("values").alias(f"v_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    k = UNION_SKETCH
    a, b = F.slice("v_a", 1, k), F.slice("v_b", 1, k)
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    seen = F.size(F.array_intersect(F.array_intersect(union, a), b))
    least = percent / 100 * F.size(union) - DEVIATIONS * (percent / 100 * (1 - percent / 100) * k) ** 0.5
    common = F.size(F.array_intersect("v_a", "v_b"))
    exact = 100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)
    return both.filter(F.when(seen >= least, exact).otherwise(False)).select("a", "b")


def link(docs: DataFrame, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, set_key) of every row, and (set_key, component_id) of the classes with a set.

    Only percent = 75 is built into the overlap bounds.
    """
    if percent != 75:
        raise ValueError("the overlap bounds are those of 75 percent")
    marks = stored(signatures(docs, SCREEN), "sketches")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "n", "values")
    classes = stored(
        marks.filter("n > 0").groupBy("set_key").agg(F.min(rank).alias("r"))
        .select(F.col("set_key").alias("key"), F.col("r.id").alias("rep"), F.col("r.n").alias("n"), F.col("r.values").alias("values")),
        "classes")
    screened = shared_values(classes).groupBy("key", "n").agg(F.count(F.lit(1)).alias("shared"))
    alive = stored(
        screened.filter(F.col("shared") >= least_overlap(F.col("n"), SCREEN)).select("key")
        .join(classes.select("key", "rep"), "key"), "alive")
    texts = docs.select("doc_id", "text").join(alive.select("rep").distinct(), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    full = (
        signatures(texts, None).withColumnRenamed("set_key", "key")
        .join(alive.select("key"), "key", "left_semi").groupBy("key").agg(F.min(F.struct("n", "values")).alias("r"))
        .select("key", "r.n", "r.values")
    )
    full = stored(full, "sets")
    lists = stored(inverted_lists(full.withColumn("values", F.slice("values", 1, WIDE))), "lists")

    best = lists.groupBy("value").agg(
        F.max(F.struct("central", "key", "n", "left")).alias("best"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    best = best.select(F.col("value").bitwiseXOR(F.lit(1)).alias("at"), "best.key", "best.n", "best.left")
    tried = (
        lists.alias("x").join(best.alias("y"), (F.col("x.value").bitwiseXOR(F.lit(1)) == F.col("y.at")) & (F.col("x.key") != F.col("y.key")) & may_link("x", "y"))
        .select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
    )
    edges = stored(verified(stored(tried, "tried"), full, percent), "edges")
    part = components(edges)

    placed = stored(
        lists.join(part, "key", "left").select("value", "key", "n", "left", F.coalesce("root", "key").alias("root")), "placed")
    sizes = placed.groupBy("value", "root").agg(F.count(F.lit(1)).alias("rows"))
    mixed = stored(
        sizes.groupBy("value").agg(F.max(F.struct("rows", "root")).alias("main"), F.count(F.lit(1)).alias("parts"))
        .filter("parts > 1").select("value", F.col("main.root").alias("main")), "mixed")
    open_rows = stored(placed.join(mixed, "value"), "open")
    minor = open_rows.filter("root != main")
    across = (
        minor.alias("x").join(
            open_rows.alias("y"),
            (F.col("x.value") == F.col("y.value")) & (F.col("x.root") != F.col("y.root"))
            & ((F.col("y.root") == F.col("y.main")) | (F.col("x.key") < F.col("y.key"))) & may_link("x", "y"))
        .select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
    )
    more = stored(verified(stored(across, "across"), full, percent), "more")
    roots = components(edges.unionByName(more))
    least = roots.join(classes.select("key", "rep"), "key")
    ids = least.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = roots.join(stored(ids, "ids"), "root").select("key", "component_id")
    classes = stored(
        classes.select("key", "rep").join(named, "key", "left")
        .select(F.col("key").alias("set_key"), F.coalesce("component_id", "rep").alias("component_id")), "components")
    return marks.select("doc_id", "n", "set_key"), classes


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    Null or blank texts have no set and stand alone. Repeated rows share an id, so all of them are kept;
    a row without an id gets the smallest id of its group and is kept only if no row of it has one.
    """
    marks, classes = link(docs, percent)
    return (
        marks.join(classes, "set_key", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
