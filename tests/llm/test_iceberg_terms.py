"""Divergence of sources against a plain recount, with nulls, long words, many sources and no terms at all."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkproof.llm import iceberg_terms
from inkproof.llm.iceberg_terms import kept_terms, source_divergence
from inkproof.llm.textbatch import LETTERS, chunks

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in ("term", "n", "documents", "key", "words", "terms", "sid", "p", "q", "value", "rank"))


def documents(spark, rows):
    return spark.createDataFrame([(i, *r, *["x"] * 11) for i, r in enumerate(rows)], DOCS)


def recount(rows, least, top):
    found, held, occurs = set(), collections.Counter(), collections.Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found.add((lang, source))
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        for t in w:
            occurs[lang, source, t] += 1
        for t in set(w):
            held[lang, t] += 1
    kept = collections.defaultdict(list)
    for (lang, t), n in held.items():
        if n >= least:
            kept[lang].append(t)
    out = set()
    for lang in {g[0] for g in found}:
        terms, sources = kept[lang], sorted(s for g, s in found if g == lang)
        of = {s: [occurs[lang, s, t] for t in terms] for s in sources}
        p = {s: [1 + 10**9 * (n + 5) // (sum(c) + 5 * len(terms)) for n in c] for s, c in of.items()}
        total = [sum(of[s][i] for s in sources) for i in range(len(terms))]
        q = [1 + 10**9 * (n + 5) // (sum(total) + 5 * len(terms)) for n in total]
        for s in sources:
            parts = {
                "pair": [(-sum(abs(x - y) for x, y in zip(p[s], p[o])), o.encode(), o) for o in sources if o != s],
                "term": [(y - x, t.encode(), t) for x, y, t, n in zip(p[s], q, terms, of[s]) if n and x > y]}
            for part, items in parts.items():
                for rank, (v, _, item) in enumerate(sorted(items), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, -v, rank))
    return out


def rows():
    r = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("pre", "prefix", "prefixlong", "é", "ß", "Word", "x", "incomprehensibilities") for b in ("", "a", "bc", "ment", "öö", "y" * 40)]
    made = []
    for i in range(260):
        lang = ("en", "de", None)[min(i % 4, 2)]
        text = " ".join(r.choice(vocabulary) + ("3" if r.random() < 0.1 else "") for _ in range(r.randrange(30)))
        made.append((text, lang, f"s{r.randrange(7)}" if i % 9 else None))
    made += [(None, "en", "only empty"), ("", "en", "s1"), ("lone words here", "fr", "a"), ("other", "fr", "b"), ("one", "it", "c"), ("z" * 70_000, "en", "s1")]
    made += [("deep" * 300, "en", "s2")] * 12 + [("same same", "en", "s3")] * 90
    return made


@pytest.mark.parametrize("blocks", [(1024, 256), (7, 3)])
def test_like_a_recount(spark, monkeypatch, blocks):
    monkeypatch.setattr(iceberg_terms, "TERM_BLOCK", blocks[0])
    monkeypatch.setattr(iceberg_terms, "SOURCE_BLOCK", blocks[1])
    made = rows()
    got = source_divergence(documents(spark, made).repartition(5), least=6, top=4).collect()
    want = recount(made, 6, 4)
    assert len(got) == len(want) and {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got} == want
    assert {r.item for r in got if r.lang == "fr"} == {"a", "b"} and not [r for r in got if r.lang == "it"]


def test_refinement_keeps_words_of_every_length(spark):
    docs = documents(spark, rows()).select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = {r.term for r in kept_terms(docs, 10)[1].filter("lang = 'en'").collect()}
    assert "deep" * 300 in kept and "same" in kept and "incomprehensibilities" + "y" * 40 in kept and "z" * 70_000 not in kept


def test_words_of_a_chunk_are_spelt_at_once():
    texts = ["Ein Wort é1Ünd X", "", None, "x" * 300, "ß"]
    (at, w), = chunks(pa.array(texts, pa.string()), LETTERS)
    assert at == 0 and w.texts(np.array([4, 0, 2, 3, 6, 5])).to_pylist() == ["x", "ein", "é", "Ünd", "ß", "x" * 300]
    assert w.texts(np.zeros(0, np.int64)).to_pylist() == []


def test_nothing(spark):
    assert source_divergence(documents(spark, []).limit(0)).count() == 0
