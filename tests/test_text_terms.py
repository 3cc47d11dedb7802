"""Terms and sparse rows of a batch of texts at once are those of the columns."""

from pyspark.sql import functions as F

from inkproof.functions import text as T
from inkproof.operators import vectorize
from inkproof.operators.learning import clean_text, term_counts

TEXTS = [
    "The red fox, the RED fox_x9; a b2 B2 of", "Ünder Kelvin İstanbul ſs 10€", None, "", "the", "x1 x1 x1 x1", "one\x1ctwo　three\x85four five-six",
    "fox red fox red", "long " * 3000,
]
STOP = ["the", "of"]


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)


def test_terms_are_runs_of_the_cleaned_text(spark):
    words = F.filter(T.find_all(clean_text(F.col("text")), r"\b\w\w+\b"), lambda w: ~w.isin(STOP))
    expected = {}
    for row in docs(spark).select("doc_id", words.alias("w")).collect():
        for term in [*row.w, *(f"{a} {b}" for a, b in zip(row.w, row.w[1:]))]:
            expected[row.doc_id, term] = expected.get((row.doc_id, term), 0) + 1
    assert {(r.doc_id, r.term): r.tf for r in term_counts(docs(spark), STOP).collect()} == expected


def test_rows_need_no_shuffle_and_equal_those_of_the_join(spark, monkeypatch):
    model = vectorize.TextVectorizer(20, stop_words=STOP).fit(docs(spark))
    made = model.transform(docs(spark).where("doc_id >= 0"))
    stored = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert "Exchange" not in model.transform(stored)._jdf.queryExecution().executedPlan().toString()
    here = {r.doc_id: r for r in made.collect()}
    monkeypatch.setattr(vectorize, "BROADCAST_TERMS", 0)
    joined = {r.doc_id: r for r in model.transform(docs(spark)).collect()}
    assert len(here) == len(TEXTS) and sum(len(r["columns"]) for r in here.values()) > 20
    for k, row in joined.items():
        assert here[k]["columns"] == row["columns"]
        assert all(abs(a - b) < 1e-12 for a, b in zip(here[k]["values"], row["values"], strict=True))
