"""The training-data operators on small tables: against brute force, and with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException  # noqa: F401

from inkproof.llm import html_samples, mix_weights, quotes
from inkproof.llm.compression_quality import quality_scores
from inkproof.llm.decision_rules import judge
from inkproof.llm.decontaminate import contamination_report, decontaminate
from inkproof.llm.dom import Page
from inkproof.llm.host_reputation import judge_urls, levels
from inkproof.llm.html_extract import default_extractor, inherited, main_texts
from inkproof.llm.near_dedup import near_duplicates
from inkproof.llm.suffix_automaton import SuffixAutomaton
from inkproof.llm.toxicity import BLOCK, BlockMaxIndex, score_toxicity, toxicity_scores, weights
from inkproof.llm.warc_index import archive_round_trip, parsed, record, url_key

DOCS = "doc_id long, text string, lang string, source string, n_chars long, at string, n string, label string, size string, key string, rule string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows):
    """rows: (doc_id, text, source); the other columns have names that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "x", "x", "x", "x", "x") for i, t, s in rows], DOCS)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


EDGES = [(None, "a b c d e f g", "s"), (90, None, None), (91, "", "s"), (92, " \t\n ", None), (93, "One two", "s"), (93, "One two", "s"), (94, "one TWO", "s")]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_like_brute_force(spark):
    base, rows = words(120, 1), []
    r = random.Random(2)
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(8)):
            w[r.randrange(len(w))] = f"new{r.randrange(10_000)}"
        rows.append((i, " ".join(w), "s"))
    shared = " ".join(words(60, 3))
    rows += [(100 + i, shared + " " + " ".join(words(90, 50 + i, 10**6)), "s") for i in range(30)]
    rows += [(200 + i, " ".join(words(3000, 7)), "s") for i in range(3)] + EDGES
    got = near_duplicates(documents(spark, rows)).collect()
    sets = collections.defaultdict(set)
    for i, t, _ in rows:
        sets[i] = shingles(t)
    parent = {i: i for i in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in parent if sets[i]]
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert len(got) == len(rows)
    for row in got:
        assert row.n_shingles == len(sets[row.doc_id])
        if row.doc_id is not None:
            assert row.component_id == find(row.doc_id) and row.kept == (row.doc_id == row.component_id)
    assert {r.kept for r in got if r.doc_id is None} == {True}


def test_near_duplicates_of_shortened_texts(spark):
    """Texts of 300 to 600 words and their first 75 to 80 percent: the union sketch must not lose a link."""
    rows, linked = [], 0
    for i in range(120):
        text = words(300 + 300 * i // 119, 7000 + i, 10**6)
        n = len(text) - 4
        cut = -(-n * (750 + i % 6 * 10) // 1000)
        rows += [(2 * i, " ".join(text), "a"), (2 * i + 1, " ".join(text[:cut + 4]), "a")]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        linked += 4 * len(a & b) >= 3 * len(a | b)
    assert linked == 120
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, rows)).collect()}
    assert [i for i in range(120) if got[2 * i + 1] != 2 * i] == []


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(documents(spark, []).limit(0)).count() == 0


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_decontamination_like_brute_force(spark):
    items = [("1", " ".join(words(30, 1))), ("2", "tiny item"), ("3", " ".join(words(13, 1))), ("4", None), ("5", "..."), ("6", "Äpfel")]
    hit = words(30, 1)
    rows = [(1, " ".join(words(50, 9) + hit[3:20] + words(40, 8)), "s"), (2, " ".join(hit[:12] + ["x"] + hit[13:]), "s"), (3, "A TINY, item; tiny äpfel Äpfel", "s"),
            (4, " ".join(hit * 3), "s"), (5, " ".join(hit[:13] + words(4000, 4)), "s"), *EDGES]
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit("x"))
    got = contamination_report(documents(spark, rows), bench).collect()
    windows = collections.defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a:a + n])].add(i)
    texts = collections.defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(t)
    assert len(got) == len(rows)
    for row in got:
        w = plain_words(texts[row.doc_id][0])
        at, found = set(), set()
        for a in range(len(w)):
            for n in {len(k) for k in windows}:
                if tuple(w[a:a + n]) in windows and a + n <= len(w):
                    at |= set(range(a, a + n))
                    found |= windows[tuple(w[a:a + n])]
        assert (row.n_words, row.n_hit, row.n_items) == (len(w), len(at), len(found))
        assert row.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert row.contaminated == (len(at) > 0 and 20 * len(at) >= len(w))
    assert contamination_report(documents(spark, rows), bench.limit(0)).filter("n_hit > 0").count() == 0
    cleaned = {r.doc_id: r.cleaned for r in decontaminate(documents(spark, rows), bench, keep_text=True).collect()}
    assert cleaned[4] == "" and "w" in cleaned[1] and len(cleaned[1].split()) == 90


def test_decontamination_with_several_automata(spark, monkeypatch):
    import inkproof.llm.decontaminate as module

    items = [(str(i), " ".join(words(30, i))) for i in range(20)]
    rows = [(i, " ".join(words(20, 99) + words(30, i)[:15]), "s") for i in range(20)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole = {r.doc_id: tuple(r) for r in contamination_report(documents(spark, rows), bench).collect()}
    monkeypatch.setattr(module, "AUTOMATON_WORDS", 300)
    assert {r.doc_id: tuple(r) for r in contamination_report(documents(spark, rows), bench).collect()} == whole


def test_automaton_lengths():
    r = np.random.default_rng(1)
    items = [(i, r.integers(0, 4, r.integers(1, 9)).astype(np.uint64)) for i in range(12)]
    automaton = SuffixAutomaton(items, 4)
    for _ in range(200):
        text = r.integers(0, 4, 20)
        code = np.searchsorted(automaton.vocabulary, text.astype(np.uint64)).tolist()
        spans, found = automaton.match(code)
        want, hit = set(), set()
        for i, w in items:
            n = min(4, len(w))
            for a in range(len(w) - n + 1):
                for b in range(20 - n + 1):
                    if (text[b:b + n] == w[a:a + n]).all():
                        want.add(i)
                        hit |= set(range(b, b + n))
        assert found == want and {x for a, b in spans for x in range(a, b)} == hit


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 90)), f"s{i % 4}") for i in range(800)] + [(1000 + i, "a b", None) for i in range(9)] + EDGES + [(2000, None, "empty")]
    got = mix_weights.mix(documents(spark, rows)).collect()
    again = mix_weights.mix(documents(spark, rows[::-1])).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == sorted((str(r.doc_id), r.size, r.taken) for r in again)
    per = collections.defaultdict(list)
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        per[r.source].append(r)
    sources = sorted((s for s in per if s is not None)) + [None]
    size = {s: sum(r.size for r in per[s]) for s in sources}
    left, open_ = 1.5 * sum(size.values()), dict(zip(sources, [3, 1, 2] * 9, strict=False))
    target = {}
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if open_[s] * level > 2 * size[s]]
        for s in full or list(open_):
            target[s] = 2 * size[s] if full else open_[s] * level
            left -= target[s]
            del open_[s]
    for s in sources:
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] for r in per[s])
        assert abs(sum(r.taken for r in per[s]) - target[s]) <= 2 * max(r.size for r in per[s])
    emitted = mix_weights.emit(documents(spark, rows)).groupBy("doc_id").count().collect()
    odd = documents(spark, rows).withColumns({"copies": F.lit("a"), "copy": F.lit("b"), "taken_id": F.lit("c")})
    again = mix_weights.emit(odd)
    assert again.columns == [*odd.columns, "copy_"] and again.filter("copies <> 'a' or copy <> 'b' or taken_id <> 'c'").isEmpty()
    assert {r.doc_id: r["count"] for r in again.groupBy("doc_id").count().collect()} == {r.doc_id: r["count"] for r in emitted}
    assert {r.doc_id: r["count"] for r in emitted if r.doc_id is not None and r.doc_id < 90} == {r.doc_id: r.copies for r in got if r.copies and r.doc_id is not None and r.doc_id < 90}
    assert mix_weights.mix(documents(spark, []).limit(0)).count() == 0


def test_quality_rules(spark):
    rows = [(i, " ".join(words(60 + i, i, 10**6)), "s") for i in range(120)]
    rows += [(300 + i, " ".join(w + "###" for w in words(80, i, 10**6)), "s") for i in range(60)]
    rows += [(500, "a b c d a b c d\nx\nx\n \nx", "s"), (501, "a b c " * 40, "s"), *EDGES]
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i, _, _ in rows if i is not None and i < 360 and i not in (90, 91, 92, 93, 94)], "doc_id long, quality int, toxic int")
    out = judge(documents(spark, rows), labels).collect()
    assert len(out) == len(rows)
    texts = {}
    for i, t, _ in rows:
        texts[i] = t or ""
    for r in out:
        t = texts[r.doc_id]
        if r.doc_id in (90, 91, 92, 93, 94, None) and t not in ("a b c d e f g",):
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        three = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if three[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    kept = {r.doc_id: r.kept for r in out}
    assert all(kept[i] for i in range(120) if i not in (90, 91, 92, 93, 94)) and not any(kept[300 + i] for i in range(60))
    assert judge(documents(spark, rows), labels.limit(0)).filter("kept = base_failed").count() == 0
    assert judge(documents(spark, []).limit(0), labels).count() == 0


def test_toxicity(spark):
    r = random.Random(4)
    bad = ["vile", "nastig", "nastiger", "scummy"]
    rows = []
    for i in range(400):
        w = words(60, i)
        toxic = i % 5 == 0
        if toxic:
            for b in r.sample(bad, 2):
                w.insert(r.randrange(60), b)
        rows.append((1000 + i, " ".join(w), "s"))
    labels = spark.createDataFrame([(1000 + i, 1, int(i % 5 == 0)) for i in range(400)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    out = {(x.doc_id): x for x in toxicity_scores(documents(spark, rows + EDGES), labels).collect()}
    held = [x for x in out.values() if x.held_out and x.doc_id is not None and x.doc_id >= 1000]
    assert held and all(x.predicted == int((x.doc_id - 1000) % 5 == 0) for x in held)
    assert all(out[i].predicted == 0 and 0 <= out[i].score <= 1 for i in (None, 90, 91, 92, 93, 94))
    assert any(out[1000].evidence) and all(e.label in (0, 1) for e in out[1000].evidence)
    assert score_toxicity(documents(spark, rows), labels.limit(0)).filter("score >= 0.3").count() == 0
    assert score_toxicity(documents(spark, []).limit(0), labels).count() == 0


def test_block_max_index_is_exact():
    r = np.random.default_rng(2)
    examples = []
    for i in range(5 * BLOCK + 7):
        t = np.sort(r.choice(40, r.integers(1, 6), replace=False))
        examples.append((i, int(i % 3 == 0), t, r.integers(1, 4, len(t))))
    idf = r.random(40) + 0.5
    index = BlockMaxIndex(examples, idf)
    for _ in range(100):
        t = np.sort(r.choice(40, 4, replace=False))
        n = r.integers(1, 3, 4)
        q = np.zeros(40)
        q[t] = weights(t, n, idf)
        every = []
        for i, (_, _, et, en) in enumerate(examples):
            e = np.zeros(40)
            e[et] = weights(et, en, idf)
            if q @ e > 0:
                every.append((float(q @ e), i))
        best = sorted(every, key=lambda x: -x[0])[:15]
        got = index.nearest(t, n)
        assert np.allclose([c for c, _ in got], [c for c, _ in best])


def test_compression_quality(spark):
    r = random.Random(3)
    good = [(i, " ".join(words(r.randrange(30, 200), i, 3000)), "s") for i in range(300)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in words(r.randrange(30, 200), i, 3000)), "s") for i in range(120)]
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _, _ in good + bad if i not in (90, 91, 92, 93, 94)], "doc_id long, quality int, toxic int")
    rows = [x for x in good if x[0] not in (90, 91, 92, 93, 94)] + bad + EDGES
    out = quality_scores(documents(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out)
    held = [x for x in out if x.held_out and x.doc_id is not None and not 90 <= x.doc_id <= 94]
    assert sum(x.predicted == int(x.doc_id < 1000) for x in held) >= 0.95 * len(held)
    assert {x.score for x in out if x.doc_id in (91, 92)} == {0.0}
    assert quality_scores(documents(spark, rows), labels.limit(0)).filter("score not in (0, 0.5)").count() == 0
    assert quality_scores(documents(spark, []).limit(0), labels).count() == 0


def test_host_rules_and_reputation(spark):
    rows = [(1, "https://www.Example.com/en/x?q"), (2, "http://a.example.com/en/"), (3, "http://a.example.com/de/"), (4, "http://x.net/es/1#a"), (5, "http://x.org"),
            (6, None), (7, "no scheme"), (8, "http://notexample.com/en/"), (9, "http://com"), (10, "http://bad.org/1"), (None, "http://bad.org/1"), (10, "http://bad.org/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("x")).withColumn("good", F.lit(1))
    seen = [("http://bad.org/%d" % i, 0) for i in range(40)] + [("http://fine%d.org/" % i, 1) for i in range(40)] + [(None, 1), ("http://bad.org/", None)]
    outcomes = spark.createDataFrame(seen, "url string, good int")
    out = {r.page_id: r for r in judge_urls(pages, outcomes).collect()}
    want = {1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/", "example.com/en/", "block"), 3: ("a.example.com", "/de/", "com/", "allow"),
            4: ("x.net", "/es/1", "net/es/", "block"), 5: ("x.org", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
            8: ("notexample.com", "/en/", "com/", "allow"), 9: ("com", "", None, "allow"), 10: ("bad.org", "/1", None, "block"), None: ("bad.org", "/1", None, "block")}
    for i, w in want.items():
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == w, i
    assert out[10].mean < 0.2 < out[5].mean
    assert judge_urls(pages, outcomes).count() == len(rows)
    assert judge_urls(pages, outcomes.limit(0)).filter("rule is null and verdict = 'block'").count() == 0
    assert judge_urls(pages.limit(0), outcomes).count() == 0
    names = spark.createDataFrame([("a.b.co.uk",), ("b.com",), ("com",), ("",), ("10.0.0.1",), ("x.y.org:80",)], "h string").select("h", *levels(F.col("h"))).collect()
    assert [tuple(r)[1:] for r in names] == [("b.co.uk", "co.uk"), ("b.com", "com"), ("com", "com"), ("", ""), ("10.0.0.1", ""), ("y.org", "org")]


def test_warc_round_trip(spark):
    long, same = "ä" * 40_000, "<p>" + "x" * 1200
    rows = [(1, "http://a.b.com/x?y#z", same), (2, "http://B.com/", same), (3, "http://b.com/", same + "!"), (4, None, None), (5, "odd url\n", ""), (6, "http://b.com/", "short"),
            (7, "http://b.com/", "short"), (8, "http://c.com/", long), (None, "http://c.com/", same), (9, "http://b.com/", same), (9, "http://b.com/", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("x")).withColumn("digest", F.lit("x"))
    got = collections.Counter(tuple(r) for r in archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = collections.Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        other = h == same and i != 9
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if other else "response", 9 if other else None)] += 1
    assert got == want
    assert archive_round_trip(pages.limit(0)).count() == 0
    keys = spark.createDataFrame([("https://www.A.com/P?q#f",), (None,), ("a.com",)], "u string").select(url_key(F.col("u"))).collect()
    assert [r[0] for r in keys] == ["com,a,www)/P?q", ")", "com,a)"]
    fields, http, payload = parsed(record(1, "http://a/", b"x\r\n\r\ny", "00" * 20, "response", None, "2000-01-01T00:00:00Z"))
    assert payload == b"x\r\n\r\ny" and fields["warc-type"] == "response" and b"200 OK" in http


def test_quotation_links(spark):
    rows = [
        (1, "Hello all.\nWho has the list?"), (2, "I have it.\n\nBob wrote:\n> Hello all.\n> Who has the list?"),
        (3, "Please send it.\n> I have it.\n>\n>> Hello all.\n> > Who has the list?"), (4, "Hello all.\nWho has the list?"), (5, "Me too\n> Who has the list?"),
        (6, None), (7, ""), (None, "> I have it."), (8, "> never said"), (9, "> Please send it."), (9, "> Please send it.")]
    out = {r.message_id: r for r in quotes.conversations(spark.createDataFrame(rows, "message_id long, body string").withColumn("hash", F.lit("x"))).collect()}
    assert {i: r.parent_id for i, r in out.items()} == {1: None, 2: 1, 3: 2, 4: None, 5: 1, 6: None, 7: None, 8: None, 9: 3}
    assert {i: (r.conversation_id, r.depth, r.position) for i, r in out.items() if r.conversation_id == 1} == {1: (1, 0, 0), 2: (1, 1, 1), 3: (1, 2, 2), 5: (1, 1, 3), 9: (1, 3, 4)}
    assert out[2].text == "I have it." and out[3].text == "Please send it." and out[8].text == ""
    assert quotes.conversations(spark.createDataFrame([], "message_id long, body string")).count() == 0
    turns = spark.createDataFrame([(1, 0, "a\nb"), (1, 1, "c"), (1, 2, "d"), (2, 0, None), (None, 1, "x"), (1, 2, "d")], "conv_id long, turn long, text string")
    assert {r.message_id % 4096: r.body for r in quotes.as_mail(turns).collect() if r.message_id < 8192} == {0: "a\nb", 1: "c\n> a\n> b", 2: "d\n> c\n>> a\n>> b"}


def test_mail_of_long_conversations_and_negative_turns(spark):
    """5 000 turns reach into the next number at a spacing of 4 096, negative turns into the one before."""
    rows = [(c, t, f"c{c}t{t}") for c, n in ((1, 5000), (2, 1000)) for t in range(n)] + [(2, -1, "c2t-1"), (3, -2, "c3t-2")]
    mail = quotes.as_mail(spark.createDataFrame(rows, "conv_id int, turn int, text string"))
    got = {r.message_id: r.body.split("\n") for r in mail.collect()}
    assert mail.count() == len(got) == len(rows)
    assert [got[i][0] for i in sorted(got)] == [t for *_, t in sorted(rows)]
    out = quotes.conversations(mail).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text")).collect()
    assert sorted(r.n for r in out) == [1, 1001, 5000]


@pytest.fixture(scope="module")
def extractor():
    return default_extractor()


def test_html_held_out_layouts(extractor):
    pages = html_samples.pages(120, seed=77)
    got = extractor.texts([re.sub(r' data-y="."', "", p) for p in pages])
    shares = []
    for page, text in zip(pages, got, strict=True):
        tree = Page(page)
        a, b = (collections.Counter(t.split()) for t in (tree.text([m == "c" for m in inherited(tree)]), text))
        shares.append(2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values())))
    assert np.mean(shares) > 0.85


def test_html_texts(spark, extractor):
    page = ('<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav>'
            '<div class="ad">Buy now</div><article><h1>A &amp; B</h1><p><b>First  line\n here, with &lt;tags&gt; and some more words.<br>next</p><p>Second one, which has a few words too.</article>'
            '<footer>&copy; x</footer>')
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "u", ""), (3, "u", "<p"), (3, "u", "<p")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    out = main_texts(pages, extractor).collect()
    assert len(out) == 5
    assert next(r.text for r in out if r.page_id == 1) == "A & B\nFirst line here, with <tags> and some more words. next\nSecond one, which has a few words too."
    assert all(r.text == "" and r.n_chars == 0 for r in out if r.page_id != 1)
    assert main_texts(pages.limit(0), extractor).count() == 0
    bare = ["<html><body>Bare text of a page</body></html>", "just &amp; text", "<body>a<p>b  c</p>d<nav><a href=x>menu</a></nav><script>no</script></body>"]
    assert extractor.texts(bare) == ["Bare text of a page", "just & text", "a\nb c\nd"]
