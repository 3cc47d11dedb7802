"""Text functions that search less of a text and find the same."""

from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.functions import text as T
from inkproof.operators.doctype import HEADS
from inkproof.operators.features import entities, entity_counts


def test_numeric_dates_hold_what_the_whole_text_holds(spark):
    texts = ["x12/1/2020 12/1/2020x a/12/1/2020, 1-2-99.", "é12/1/2020 12/1/2020é 2020-1-2/3", "١٢/١/١٩٩٩ 02/30/2001", "none", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for regex, _ in C.DATE_PATTERNS[:2]:
        whole = F.regexp_extract_all("t", F.lit(f"(?Ud){regex}"), F.lit(1))
        short = T.find_all(T.numeric_dates(F.col("t")), regex, 1)
        assert all(r.a == r.b for r in df.select(whole.alias("a"), short.alias("b")).collect())


def test_one_search_finds_the_leading_words(spark):
    df = spark.createDataFrame([("a certificate, two invoices; reinvoice accounts",)], "t string")
    assert df.select(T.begun_words(F.col("t"), HEADS).alias("w")).first().w == ["certificate", "invoice", "account"]


def test_repeats_are_the_counts_above_the_bound(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c", "a", "c"],), (["a", "b"],)], "v array<string>")
    found = [[(c.value, c.n, c.first) for c in r.c] for r in df.select(T.repeats(F.col("v"), 1).alias("c")).collect()]
    assert found == [[("a", 3, 0), ("c", 2, 3)], []]


def test_texts_of_ascii_are_searched_without_a_look_at_their_alphabet(spark):
    search = lambda t: T.count_matches(t, r"\bword\b")
    rows = spark.createDataFrame([("a word\x1fword",), ("é word wordé",), ("",), (None,)], "text string")
    found = rows.select(search(F.col("text")).alias("n"), T.by_text(F.col("text"), search).alias("m"), T.by_text(F.col("text"), T.strip).alias("s"))
    assert [(r.n, r.m) for r in found.collect()] == [(2, 2), (1, 1), (0, 0), (None, None)]
    with T.plain_texts():
        plain = rows.select(search(F.col("text")))
    assert "octet_length" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert not T._plain


def test_heads_of_patterns_decide_which_are_searched(spark):
    heads = ["bill", "billed", "in", "invoice"]
    rows = spark.createDataFrame([("billed to",), ("invoice no",), ("an offer",)], "text string")
    begun = T.as_line(T.begun_words(F.col("text"), heads))
    found = rows.select(*[T.where_begun(begun, heads, p, F.lit(1.0), 0.0).alias(n) for n, p in
                          (("bill", r"\bbill\s*to\b"), ("in", r"\bin\b"), ("invoice", r"\binvoice\b"))]).collect()
    assert [tuple(r) for r in found] == [(1.0, 0.0, 0.0), (0.0, 1.0, 1.0), (0.0, 0.0, 0.0)]


def test_entities_are_counted_inside_their_row(spark):
    texts = ["INV-12345 on 1/2/2020 and 1/2/2020, $5 $5 $6, 123456789", "é USD 12 dollars 7", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    counted = entity_counts(docs)
    whole = entities(docs).groupBy("doc_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(counted.collect()) == sorted(whole.collect()) != []
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
