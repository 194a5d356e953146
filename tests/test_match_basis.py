"""Why a notice matches: short forms of regions and other costly parts are made once for a row."""

from pyspark.sql import functions as F

from noticemill.operators import enrichment, matching
from noticemill.plans import views as V


def test_short_forms_are_made_once(spark):
    rows = spark.createDataFrame(
        [("安徽省广东项目", "合肥市", "正文提到安徽", ["安徽省", "合肥市", "上海市"]), ("浙江四川项目", None, "", ["安徽省"]), ("x", None, None, [])],
        "title string, region string, clean_content string, regions array<string>")
    basis = rows.select(enrichment.region_basis(*[F.col(c) for c in rows.columns]).alias("b"))
    assert [r.b for r in basis.collect()] == [
        "「安徽省」见于标题/正文；「合肥市」见于地区字段。注意：标题另含地区词「广东」，请结合正文核对是否属查询区域",
        "标题/正文/地区字段未检出查询区域词；若仍入选，可能因列表阶段区域字段缺失，请人工复核。标题出现其他地区：浙江、四川",
        "查询未指定区域"]
    plan = basis._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") < 15  # each mention of a short form is evaluated again: 76 of these before


def test_few_anchors_match_like_many(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"

    def pairs():
        return sorted(map(tuple, matching.match_subscriptions(V.notices(spark, sf), V.subscriptions(spark, sf)).select("notice_id", "task_id").collect()))

    few = pairs()
    monkeypatch.setattr(matching, "ANCHORS_SOUGHT", 0)
    assert few and few == pairs()


def test_words_at_the_end_of_a_long_text_are_found(spark):
    rows = spark.createDataFrame([("项目", "", "字" * 5000 + "服务器采购于安徽")], "title string, region string, clean_content string")
    t, g, c = (F.col(x) for x in rows.columns)
    got = rows.select(enrichment.keyword_basis(t, g, c, F.array(F.lit("服务器"))).alias("k"),
                      enrichment.region_basis(t, g, c, F.array(F.lit("安徽省"))).alias("r")).first()
    assert tuple(got) == ("「服务器」出现于正文", "「安徽省」见于正文")
