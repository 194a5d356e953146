"""Trigrams of whole texts are made once for each side, not once for each mention."""

from noticemill.plans.text_queries import content_similarity


def test_grams_are_evaluated_once(spark):
    plan = content_similarity(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 4  # two sides, whole and heads
