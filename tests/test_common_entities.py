"""Entities that two documents share: found once a document, and numbers without what stands before them."""

import random

from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.functions import text as T
from inkproof.operators import compare
from inkproof.plans.catalog.comparison import common_entities

BITS = ["1", "12", "345", "6789", ",", ",123", ".", ".5", ".55", " ", "\n", "$", "€ ", "₹", "Rs.", "Rs", "INR", "a", "٣", "٣٤", " ", "\x1c"]


def test_numbers_are_those_of_the_whole_pattern(spark):
    dice = random.Random(5)
    texts = ["".join(dice.choice(BITS) for _ in range(dice.choice([1, 2, 4, 8, 20]))) for _ in range(2000)]
    whole = F.array_distinct(F.filter(T.find_all(F.col("text"), C.COMPARE_NUMBER_PATTERN, 1), lambda v: F.length(v) > 1))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", whole.alias("a"), compare.numbers_of(F.col("text")).alias("b"))
    assert rows.where(F.size("a") > 1).count() > 500
    assert [r for r in rows.collect() if r.a != r.b] == []


def test_both_sides_read_what_was_found_once(spark):
    plan = common_entities(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "lineitem" not in plan
