"""Scores need no descriptions: markers without them score the same."""

from inkproof.plans.scoring import assess
from tests.test_rules import corpus


def test_marker_risk_builds_no_texts_and_stays_the_same(spark):
    docs = corpus(spark)
    lean = assess(docs, "2025-06-01", wanted=["marker_risk_score"])
    whole = assess(docs, "2025-06-01", wanted=["marker_risk_score", "markers"])
    scores = lambda df: {r.doc_id: r.marker_risk_score for r in df.select("doc_id", "marker_risk_score").collect()}
    assert scores(lean) == scores(whole) and max(scores(lean).values()) > 0
    plan = lean._jdf.queryExecution().optimizedPlan().toString()
    assert "format_string" not in plan and "consistency" not in plan
