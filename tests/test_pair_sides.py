"""Both documents of a pair are scored and typed once, whichever side they stand on."""

from inkproof.plans.catalog.comparison import business_pairs


def test_both_sides_read_what_was_scored_once(spark):
    pairs = business_pairs(spark, "/root/testdata/sf0.001")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "lineitem" not in plan
    assert pairs.count() > 0
