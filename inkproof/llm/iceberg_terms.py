"""How far sources diverge in their words: iceberg prefix refinement finds the terms, exact integer shares compare them.

A term counts if enough documents of its language hold it. Byte prefixes are refined level by level:
of the prefixes that survived the level before, the next level counts the longer ones in distinct
documents, and those below the threshold are dropped together with every word that begins with them.
What a level passes on is a bit field of fixed size over the survivors' hashes; a false hit only lets
a word through to the last pass, which counts whole terms by their bytes and decides. Counts are added
up in each task first, so neither a frequent word nor a large source gathers anywhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkproof.llm.common import stored
from inkproof.llm.textbatch import LETTERS, U64, chunks, mix

#: Bytes of the first level's prefixes; each level doubles them.
FIRST_LEVEL = 4
#: Bits that tell a level which prefixes survived: 16 MB, whatever survives.
FIELD_BITS = 27
#: Spark's bitmaps hold so many positions each.
BITMAP = 1 << 15
#: Counts that a task holds before it hands them on.
HELD = 1 << 20
#: Terms and sources of one block of the pairwise comparison.
TERM_BLOCK, SOURCE_BLOCK = 1024, 256


def salts(langs: pa.Array) -> np.ndarray:
    """A number for each row that depends on its language."""
    coded = langs.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    each = [int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    return np.array(each, np.uint64)[coded.indices.to_numpy(zero_copy_only=False)] if each else np.zeros(0, np.uint64)


def keys(hashes: np.ndarray, salt: np.ndarray, is_open: bool) -> np.ndarray:
    """Keys of prefixes (the last bit is set) or of whole terms (it is not)."""
    return (mix(hashes + salt) & ~U64(1)) | U64(is_open)


def marked(field: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = (key >> U64(64 - FIELD_BITS)).astype(np.int64)
    return ((field[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def documents_per_key(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, each with its number of distinct documents; documents rise among equal keys."""
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    pair = new.copy()
    pair[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    return key[first], np.add.reduceat(pair.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def level_counts(before: int, size: int, survivors):
    """(text, lang) to (key, documents) of the terms with more than `before` and at most `size` bytes, and of the
    prefixes of `size` bytes of longer ones, where the prefix of `before` bytes survived."""

    def run(batches):
        field = survivors.value if survivors else None
        held, n = [], 0

        def added_up():
            key, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            docs = np.bincount(at, weights=np.concatenate([h[1] for h in held]), minlength=len(key)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(docs)], names=["key", "documents"])

        for batch in batches:
            salt = salts(batch.column(1))
            with np.errstate(over="ignore"):
                for at, w in chunks(batch.column(0), LETTERS):
                    own = salt[at + w.doc]
                    alive = np.ones(len(w.doc), bool)
                    if field is not None:
                        longer, h = w.prefixes(before)
                        alive[:] = False
                        alive[longer[marked(field, keys(h, own[longer], True))]] = True
                    whole = np.flatnonzero(alive & (w.end - w.start <= size))
                    longer, h = w.prefixes(size)
                    kept = alive[longer]
                    longer, h = longer[kept], h[kept]
                    key = np.concatenate([keys(w.hash[whole], own[whole], False), keys(h, own[longer], True)])
                    held.append(documents_per_key(key, np.concatenate([w.doc[whole], w.doc[longer]])))
                    n += len(held[-1][0])
                    if n >= HELD:
                        yield added_up()
                        held, n = [], 0
        if n:
            yield added_up()

    return run


def bit_field(keys_: DataFrame) -> np.ndarray:
    """The survivors' bits: at most 2**FIELD_BITS / BITMAP rows of 4 KB reach the driver."""
    at = F.shiftrightunsigned("key", 64 - FIELD_BITS)
    parts = keys_.select(at.alias("at")).groupBy((F.col("at") / BITMAP).cast("long").alias("part")).agg(
        F.bitmap_construct_agg(F.col("at") % BITMAP).alias("bits"))
    field = np.zeros((1 << FIELD_BITS) // 8, np.uint8)
    for r in parts.toLocalIterator():
        field[r.part * BITMAP // 8:(r.part + 1) * BITMAP // 8] = np.frombuffer(r.bits, np.uint8)
    return field


def term_counts(candidates):
    """(text, lang, source) to (lang, source, term, n, documents) of the candidate terms."""

    def run(batches):
        field = candidates.value
        held, n = [], 0
        groups: dict[tuple[str, str], int] = {}
        spelt: list[tuple[np.ndarray, pa.Array]] = []

        def added_up():
            group, key, count, docs = (np.concatenate([h[i] for h in held]) for i in range(4))
            order = np.lexsort((key, group))
            group, key, count, docs = group[order], key[order], count[order], docs[order]
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])]))
            known, at = np.unique(np.concatenate([k for k, _ in spelt]), return_index=True)
            terms = pa.concat_arrays([t for _, t in spelt]).take(pa.array(at[np.searchsorted(known, key[first])]))
            lang, source = (pa.array([g[i] for g in groups], pa.string()).take(pa.array(group[first])) for i in range(2))
            return pa.RecordBatch.from_arrays(
                [lang, source, terms.cast(pa.string()), pa.array(np.add.reduceat(count, first)), pa.array(np.add.reduceat(docs, first))],
                names=["lang", "source", "term", "n", "documents"])

        for batch in batches:
            salt = salts(batch.column(1))
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            group_of = np.array([groups.setdefault(p, len(groups)) for p in pairs], np.int64)
            with np.errstate(over="ignore"):
                for at, w in chunks(batch.column(0), LETTERS):
                    row = at + w.doc
                    hit = np.flatnonzero(marked(field, keys(w.hash, salt[row], False)))
                    if not len(hit):
                        continue
                    key, doc = w.hash[hit], w.doc[hit]
                    order = np.argsort(key, kind="stable")
                    key, doc = key[order], doc[order]
                    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
                    count = np.diff(np.append(first, len(key)))
                    one = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    spelt.append((key[one], w.texts(hit[order[one]])))
                    held.append((group_of[at + doc[first]], key[first], count, np.ones(len(first), np.int64)))
                    n += len(first)
                    if n >= HELD:
                        yield added_up()
                        held, n = [], 0
                        spelt.clear()
        if n:
            yield added_up()

    return run


def kept_terms(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n) and (lang, term, n) of the terms that at least `least` documents of a language hold.

    docs: text, lang, source without nulls.
    """
    context = docs.sparkSession.sparkContext
    before, size, survivors = 0, FIRST_LEVEL, None
    candidates = np.zeros((1 << FIELD_BITS) // 8, np.uint8)
    while True:
        counted = docs.select("text", "lang").mapInArrow(level_counts(before, size, survivors), "key long, documents long")
        level = stored(counted.groupBy("key").agg(F.sum("documents").alias("documents")).filter(F.col("documents") >= least).select("key"), "level")
        candidates |= bit_field(level.filter("(key & 1) = 0"))
        prefixes = level.filter("(key & 1) = 1")
        if prefixes.isEmpty():
            break
        survivors = context.broadcast(bit_field(prefixes))
        before, size = size, size * 2
    counted = docs.select("text", "lang", "source").mapInArrow(
        term_counts(context.broadcast(candidates)), "lang string, source string, term string, n long, documents long")
    own = stored(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")), "terms")
    kept = own.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("documents").alias("documents")).filter(F.col("documents") >= least)
    return own, stored(kept.select("lang", "term", "lang_n"), "kept")


def share(count: Column, words: Column, terms: Column) -> Column:
    """1 + floor(10**9 (count + 5) / (words + 5 terms)), in whole numbers; null where there are no terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    whole = F.call_function("div", (wide(count) + 5) * F.lit(1_000_000_000).cast("decimal(10,0)"), F.nullif(wide(words) + 5 * wide(terms), F.lit(0)))
    return 1 + whole.cast("long")


def distances(table: pa.Table) -> pa.Table:
    """One block of terms and two blocks of sources: for each two sources the sum of differences and the terms summed over."""
    sid, p, p0 = (table[c].to_numpy() for c in ("sid", "p", "p0"))
    is_source = table["term"].is_null().to_numpy()
    term = table["term"].combine_chunks().dictionary_encode()
    ids, place = np.unique(sid, return_inverse=True)
    names: list = [None] * len(ids)
    base = np.zeros(len(ids), np.int64)
    source = table["source"].to_pylist()
    for i in np.flatnonzero(is_source).tolist():
        names[place[i]], base[place[i]] = source[i], p0[i]
    shares = np.repeat(base[:, None], len(term.dictionary), axis=1)
    shares[place[~is_source], term.indices.filter(pa.array(~is_source)).to_numpy(zero_copy_only=False)] = p[~is_source]
    a, b = table["a"][0].as_py(), table["b"][0].as_py()
    left = np.flatnonzero(ids // SOURCE_BLOCK == a)
    out: dict[str, list] = {"one": [], "other": [], "value": [], "terms": [], "gap": []}
    for i in left.tolist():
        others = np.flatnonzero((ids // SOURCE_BLOCK == b) & (ids > ids[i]))
        sums = np.abs(shares[others] - shares[i]).sum(axis=1)
        for j, v in zip(others.tolist(), sums.tolist(), strict=True):
            out["one"].append(names[i])
            out["other"].append(names[j])
            out["value"].append(v)
            out["terms"].append(len(term.dictionary))
            out["gap"].append(abs(int(base[i] - base[j])))
    fields = [("one", pa.string()), ("other", pa.string()), ("value", pa.int64()), ("terms", pa.int64()), ("gap", pa.int64())]
    made = pa.Table.from_pydict(out, pa.schema(fields))
    return made.add_column(0, "lang", pa.array([table["lang"][0].as_py()] * len(made), pa.string()))


def source_divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value and rank for every (lang, source) of docs (text, lang, source).

    part 'pair': how far each other source of the language lies, over all kept terms; part 'term': the
    terms that the source uses more than its language, the `top` of them. Nulls count as empty strings,
    every row is a document of its own, and equal values are ranked by item. A source without kept
    terms has the shares of zero counts; a language without any gives pairs of value 0. An empty
    table gives none. Other columns of docs are not looked at.
    """
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    own, kept = kept_terms(docs, least)
    counted = stored(own.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "counted")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_words"))
    words = counted.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    none = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(words, ["lang", "source"], "left").select(
        "lang", "source", *[F.coalesce(c, none).alias(c) for c in ("terms", "lang_words", "words")])
    # one row for each source of a language
    groups = groups.withColumn("sid", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"))
    groups = groups.withColumn("sids", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    groups = stored(groups.withColumn("p0", F.coalesce(share(none, F.col("words"), F.col("terms")), F.lit(1).cast("long"))), "groups")
    shares = counted.join(groups, ["lang", "source"]).select(
        "lang", "source", "sid", "sids", "term", "terms", "p0", share(F.col("n"), F.col("words"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_words"), F.col("terms")).alias("q"))

    ahead = shares.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ahead = ahead.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    blocks = F.greatest(F.ceil(F.col("terms") / TERM_BLOCK), F.lit(1))
    other_block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sids") - 1) / SOURCE_BLOCK)))
    mine = F.floor(F.col("sid") / SOURCE_BLOCK)

    def paired(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("mine", mine).withColumn("theirs", other_block)
        return rows.select("lang", "block", F.least("mine", "theirs").alias("a"), F.greatest("mine", "theirs").alias("b"), "sid", "source", "term", "p", "p0")

    in_blocks = paired(shares.withColumn("block", F.pmod(F.xxhash64("term"), blocks)).withColumn("source", F.lit(None).cast("string")))
    everywhere = paired(groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select(
        "*", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p")))
    partial = in_blocks.unionByName(everywhere).groupBy("lang", "block", "a", "b").applyInArrow(
        distances, "lang string, one string, other string, value long, terms long, gap long")
    pairs = partial.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"), F.sum("terms").alias("seen"), F.max("gap").alias("gap"))
    # terms that neither block of sources holds
    pairs = pairs.join(langs.select("lang", "terms"), "lang", "left").withColumn("value", F.col("value") + (F.coalesce("terms", none) - F.col("seen")) * F.col("gap"))
    ways = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item"))))
    pairs = pairs.select("lang", ways.alias("way"), "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ahead)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS a
  FROM documents
), o AS (
  SELECT r, lang, source, unnest(a) AS term FROM d
), k AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), l AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n) AS n FROM k GROUP BY lang
), s AS (
  SELECT DISTINCT lang, source FROM d
), g AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM o GROUP BY lang, source, term
), f AS (
  SELECT s.lang, s.source, k.term, coalesce(g.n, 0) AS n, k.n AS lang_n
  FROM s JOIN k ON k.lang = s.lang LEFT JOIN g ON g.lang = s.lang AND g.source = s.source AND g.term = k.term
), p AS (
  SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000 * (f.n + 5)) // (sum(f.n) OVER (PARTITION BY f.lang, f.source) + 5 * l.v)::HUGEINT AS p,
         1 + (1000000000 * (f.lang_n + 5)) // (l.n + 5 * l.v)::HUGEINT AS q
  FROM f JOIN l ON l.lang = f.lang
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(apart.value, 0)::BIGINT AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 50
"""
