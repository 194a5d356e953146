"""Costly texts are evaluated once, and dates read so give what they gave."""

import re

from pyspark.sql import functions as F

from noticemill import constants as C
from noticemill.functions import dates as D
from noticemill.plans import report_queries, source_queries, text_queries

SMOKE = "/root/testdata/sf0.001"


def _pattern_mentions(df):
    return len(re.findall(r"regexp_\w+\(|RLIKE\(", df._jdf.queryExecution().optimizedPlan().toString()))


def test_extraction_mentions_each_pattern_few_times(spark):
    """A pattern behind a condition is evaluated at every mention: the plan of all fields had over 1,100 of them."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        assert _pattern_mentions(report_queries.structured_detail(spark, SMOKE)) < 400
        assert _pattern_mentions(text_queries.datetime_display(spark, SMOKE)) < 30
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_dates_of_odd_texts(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(
        ["2026-7-6", " 2026年07月16日起", "1970-01-01", "1970/1/12", "", None, "待定", "2026-07-06T09:05:00", "至 2026 年 7 月 6 日 9 时 05 分",
         "2026-02-31", "2026-13-40 10:00", "截止2026/7/6日8:30"])], "k int, v string")
    got = [tuple(r)[1:] for r in rows.select("k", D.cn_date(F.col("v")), D.cn_datetime(F.col("v")), D.normal_datetime(F.col("v")),
                                             D.lenient_date(F.col("v")).cast("string")).orderBy("k").collect()]
    missing = C.MISSING
    assert got == [
        ("2026年7月6日", "2026年7月6日", "2026年7月6日", "2026-07-06"),
        ("2026年7月16日", "2026年7月16日", "2026年7月16日", "2026-07-16"),
        (missing, missing, "1970-01-01", None), (missing, missing, "1970/1/12", None), (missing, missing, "", None), (missing, missing, "", None),
        ("待定", "待定", "待定", None),
        ("2026年7月6日", "2026年7月6日 09:05", "2026年7月6日 09:05", "2026-07-06"),
        ("至 2026 年 7 月 6 日 9 时 05 分", "至 2026 年 7 月 6 日 9 时 05 分", "2026年7月6日 09:05", None),
        ("2026年2月31日", "2026年2月31日", "2026年2月31日", None),
        ("2026年13月40日", "2026年13月40日 10:00", "2026年13月40日 10:00", None),
        ("截止2026/7/6日8:30", "截止2026/7/6日8:30", "2026年7月6日 08:30", "2026-07-06"),
    ]


def test_a_link_is_joined_from_one_evaluation(spark):
    """The plan had 51 mentions of patterns, as every part of an address was stripped again."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        assert _pattern_mentions(source_queries.list_page_rows(spark, SMOKE)) < 45
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
