"""The document types that a batch of texts gets at once are those of the columns."""

import random

from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.functions.text import leading_words
from inkproof.operators.doctype import classify, type_column

WORDS = sorted({w for rules in C.DOCTYPE_RULES.values() for _, regex in rules for w in leading_words(regex)})
BITS = [" ", " ", " ", "\n", "x", "s", " to ", " no ", " of ", "NUMBER ", "# ", ": ", "due ", " amount ", "balance ", "zip ", "card ", "account ", "nationality ", "form ", "statement "]
NAMES = [None, "", "INVOICE_1.pdf", "receipt-contract.txt", "letter.doc", "café-invoice.pdf", "x_statement.csv", "inv_2"]


def corpus(spark):
    dice = random.Random(5)
    texts = ["".join(dice.choice(WORDS if dice.random() < 0.5 else BITS) for _ in range(dice.choice([1, 2, 4, 9, 30, 120]))) for _ in range(600)]
    texts += [None, "", " \x1c\n", "Café receipt", "INVOICE NO 1 Invoice # 2 invoice number 3 invoice num 4 invoice no 5", "grade grades marks obtained roll no"]
    rows = [(i, t if t is None or i % 3 else t.upper(), dice.choice(NAMES)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, filename string").repartition(3)


def test_batches_and_columns_agree(spark):
    docs = corpus(spark)
    for name in ("filename", None):
        batched = {r.doc_id: (r.document_type, r.type_score, r.type_margin) for r in classify(docs, name).collect()}
        columns = {r.doc_id: tuple(r.t) for r in docs.select("doc_id", type_column(name).alias("t")).collect()}
        assert batched == columns and len(batched) == 606
        assert len({t for t, _, _ in batched.values()}) > 10


def test_types_come_from_one_batch_function(spark):
    plan = classify(corpus(spark)).select("document_type", F.col("type_score"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
