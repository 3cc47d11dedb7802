"""The markers that a batch of texts gets at once are those of the columns."""

import random

from pyspark.sql import functions as F

from inkproof.operators.features import stats_fields
from inkproof.operators.markers import batch, detect_markers, rule_families
from inkproof.operators.markers.base import wordless_markers

BITS = [
    "Invoice", "bill", "Receipt ", "total: $1,115.00", "Subtotal: 1,000.00\n", "sub total 1e", "Tax: 99.5 ", "VAT 10", "grand total 20000000.25 ", "Amount due ,",
    "\n", "\n", "\n\n", " ", "\t", "\x0b", "\x1c", "\x00", ".", "!", "?", "!!!!!!!!!!!!", "...", "... ... ... ... ... ...", "The goods are ours. ", "the  goods are ours! ",
    "THE LINE IS LOUD\n", "draft copy ", "Certified true copy, specimen copy ", "[Full Name]", "[date", "____", " XXX ", "N/A N/A", "Fill in the below ", "insert your ", "enter the ",
    "12 34 ", "widget 5.00 x 6.00\n", "widget 5.00 x 5\n", " $7 ", "allocation 40% 35% 20% ", "share 50 % 50%", "split 0.25%, .05%", "5.%", "1.2.3%", "12345 12345 12345 ", "x12345 ",
    "02/30/2024 ", "02-31-99 ", "04/31/2020 ", "02/29/2023", "02/29/1900", "13/13/2020 ", "1/5/69 ", "1/5/68 ", "2024-02-30 ", "2099-01-05 ", "5-6-2050 ", "5-6-50 ", "31/12/2060",
    "Jan 3, 2070 ", "January 5 2030 ", "5 Mar 2041 ", "5 March 2041 ", "Sept 5, 2050 ", "Mar. 5, 2050 ", "Issue Date: 03/04/2020 ", "from 12/12/2021 ", "valid until: 03/03/2020 ", "expires 1/1/2000 ",
    "INV-1234 ", "INV-123456 ", "inv 555 ", "REF 094321 and REF 094321 ", "77777777 ", "12345678 ", "#123 ", "a#456 ", "No. 88 ", "No.8888 ", "PO--123 ", "AB12345678 ", "_123456 ", "id-0000 ",
    "contract ", "certificate ", "signature ", "seal ", "name ", "page 2\n", "Page 9 ", "p. 3 ", "p12", "page " + "0" * 40 + "7 ", "page " + "9" * 45, "---\n", "===\n", "***\n", "Page 1\n", "a\nb\nc\nd\ne\nf\n",
    "line one\n", "client and customer ", "payment settlement ", "date effective date ", "%", "$", ",", "- ", "/", "9" * 20 + " ", "x", "7", "\r\n",
]


def corpus(spark, texts=500):
    dice = random.Random(11)
    rows = [("".join(dice.choice(BITS) for _ in range(dice.choice([1, 2, 3, 5, 8, 20, 60]))), dice.choice([None, 0, 1, 2, 9])) for _ in range(texts)]
    rows += [(None, 1), ("", 1), (" ", 3), ("café total 12 USD page 9", 1), ("Total: 9999999999999999999 Subtotal: 9999999999999999 Tax: 1 ", 1)]
    schema = "doc_id long, text string, stats struct<page_count:int,ocr_confidence:double>"
    return spark.createDataFrame([(i, t, (p, 1.0)) for i, (t, p) in enumerate(rows)], schema).withColumn(
        "metadata", F.create_map().cast("map<string,string>")).repartition(3)


def by_columns(docs, family):
    return {r.doc_id: r.m for r in docs.select("doc_id", rule_families(stats_fields(docs), "2025-06-01")[family].alias("m")).collect()}


def test_batches_and_columns_agree(spark):
    docs = corpus(spark)
    rank = {"high": 0, "medium": 1, "low": 2}
    for family in batch.FAMILIES:
        columns = by_columns(docs, family)
        found = {r.doc_id: r.markers for r in detect_markers(docs, "2025-06-01", (family,)).select("doc_id", "markers").collect()}
        assert len(found) == len(columns) == 505
        for k, markers in columns.items():
            ordered = markers and sorted(markers, key=lambda m: rank[m.severity])
            assert found[k] == ordered
        assert sum(len(m) for m in found.values() if m) > 20


def test_all_families_come_from_one_batch_function(spark):
    docs = detect_markers(corpus(spark, 5), "2025-06-01").select("doc_id", "markers")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_without_words_only_the_words_are_missing(spark):
    docs = corpus(spark, 100)
    bare = lambda df: {r.doc_id: r.m for r in df.select("doc_id", F.transform("markers", lambda m: F.struct(m["name"], m["severity"], m["score"])).alias("m")).collect()}
    lean = detect_markers(docs, "2025-06-01", worded=False)
    assert bare(lean) == bare(detect_markers(docs, "2025-06-01"))
    assert lean.where(F.exists("markers", lambda m: m["description"].isNotNull() | m["evidence"].isNotNull())).count() == 0


def test_wordless_columns_hold_no_words(spark):
    with wordless_markers():
        wordless = rule_families(("page_count",), "2025-06-01")
    assert "Suspicious phrases" not in str(wordless["textual"])
