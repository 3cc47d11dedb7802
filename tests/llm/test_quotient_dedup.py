"""Exact copies: the filter against a counter, the operator against a dictionary of whole texts."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np

from inkproof.llm.quotient_dedup import QuotientFilter, counted_fingerprints, exact_duplicates

DOCS = "doc_id long, text string, digest string, hot string, cold string, key string, route string, normal string, fingerprint string, group_size string, keep_id string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 9) for i, t in rows], DOCS)


def test_filters_merge_without_loss():
    r = np.random.default_rng(5)
    for bits in (0, 1, 3):
        top = np.uint64(0 if not bits else 1 << (64 - bits))
        pool = (r.integers(0, 1 << 63, 3000, dtype=np.uint64) >> np.uint64(bits)) | top
        pool[:40] = (pool[0] & ~np.uint64(63)) + np.arange(40, dtype=np.uint64)  # one crowded run
        draws = [r.choice(pool, 2500) for _ in range(4)]
        filters = []
        for d in draws:
            values, n = np.unique(d, return_counts=True)
            made = QuotientFilter.of_sorted(bits, values, n)
            filters.append(QuotientFilter.of_row(bits, made.row()))
        merged = QuotientFilter.merged(filters)
        want = collections.Counter(np.concatenate(draws).tolist())
        values, n = merged.fingerprints()
        assert dict(zip(values.tolist(), n.tolist())) == want and np.all(values[1:] > values[:-1])
        for x in [*pool[:60].tolist(), *(pool[:20] + np.uint64(1)).tolist()]:
            assert merged.count(x) == want.get(x, 0)


def test_counts_of_a_table(spark):
    rows = [random.Random(i).randrange(-(1 << 63), 1 << 63) for i in range(700)]
    rows = rows + rows[:300] + rows[:1] * 5000
    df = spark.createDataFrame([(x,) for x in rows], "x long").repartition(7)
    got = {r.fingerprint: r.n for r in counted_fingerprints(df, len(rows)).collect()}
    assert got == collections.Counter(rows)


def test_like_a_dictionary_of_texts(spark):
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(9)}" for _ in range(3)) for _ in range(300)]
    rows = list(enumerate(texts)) + [(1000 + i, "one large group") for i in range(400)]
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "\t\n "), (2004, " a"), (2005, "a"), (2006, "a  b"), (2007, "a\r\nb"), (2008, "a b"),
             (2009, "x " * 60_000), (2010, "x  " * 60_000), (None, "one large group"), (None, "alone"), (None, "pair"), (None, "pair"), (2011, "twice"), (2011, "twice")]
    r.shuffle(rows)
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = collections.defaultdict(list)
    for (i, _), n in zip(rows, normal):
        groups[n].append(i)
    want = collections.Counter()
    for (i, _), n in zip(rows, normal):
        known = [x for x in groups[n] if x is not None]
        keep = min(known) if known else None
        want[(i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest())] += 1
    got = exact_duplicates(documents(spark, rows).repartition(6)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert collections.Counter(tuple(x) for x in got.collect()) == want


def test_nothing(spark):
    assert exact_duplicates(documents(spark, []).limit(0)).count() == 0
