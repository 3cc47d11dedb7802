"""The scoring job: what a wanted column costs, and that pruning changes no value."""

import pytest

from inkproof.plans.scoring import READ_FAMILIES, assess
from test_rules import corpus

DAY = "2025-06-01"


def values(df, column):
    return {r.doc_id: r[column] for r in df.select("doc_id", column).collect()}


@pytest.mark.parametrize("column", [*READ_FAMILIES, "marker_risk_score", "decision"])
def test_a_wanted_column_alone_has_the_same_values(spark, column):
    docs = corpus(spark)
    assert values(assess(docs, DAY, wanted=[column]), column) == values(assess(docs, DAY), column)


def searches(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")


def test_only_the_families_that_are_read_are_looked_for(spark):
    docs = corpus(spark)
    every = searches(assess(docs, DAY, wanted=["decision"]))
    assert searches(assess(docs, DAY, wanted=["structural_risk_score"])) == 0
    assert 0 < searches(assess(docs, DAY, wanted=["id_inconsistencies"])) < every / 4
    assert searches(assess(docs, DAY, wanted=["consistency_risk_score"])) < every
