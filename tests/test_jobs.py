"""Filters, matching, delivery, sources, rules and corrections on known cases."""

from datetime import date, datetime

from pyspark.sql import functions as F

from noticemill import constants as C
from noticemill.operators import aggregates, delivery, enrichment, evidence, filters, matching, rules
from noticemill.sources import documents, pages, payloads, registry

ITEM = "seq long, title string, snippet string, region string, publish_time date"


def test_list_filter_reasons(spark):
    rows = [(1, "安徽省服务器采购公开招标公告", None, "安徽省", date(2026, 6, 1)), (2, "培训班招生广告", None, "安徽省", date(2026, 6, 2)),
            (3, "桌椅采购公告", None, None, None), (4, "服务器采购公告", None, "上海市", None), (5, "服务器采购公告", None, None, date(2020, 1, 1)),
            (6, "服务器采购公告", None, None, None)]
    crit = filters.Criteria(("服务器",), ("安徽省",), date(2026, 5, 1), date(2026, 7, 17))
    got = {r.seq: r.reason for r in filters.filter_list(spark.createDataFrame(rows, ITEM), crit).collect()}
    assert got == {1: None, 2: C.LIST_REASONS[0], 3: C.LIST_REASONS[1], 4: C.LIST_REASONS[2], 5: C.LIST_REASONS[3], 6: None}


def test_matching_equals_the_filter_for_every_task(spark):
    rows = [(i, f"{a}{b}采购公告", None, r, d) for i, (a, b, r, d) in enumerate(
        (a, b, r, d) for a in ("安徽", "") for b in ("服务器", "车", "桌椅") for r in (None, "安徽省合肥市", "上海市")
        for d in (None, date(2026, 6, 1), date(2025, 1, 15)))]
    items = spark.createDataFrame(rows, ITEM)
    tasks = [("a", ["服务器", "桌椅"], ["安徽省"], date(2026, 1, 1), date(2026, 12, 31)), ("b", ["车"], [], None, None),
             ("c", [], ["上海市"], date(2025, 1, 1), None), ("d", [""], None, None, None), ("e", None, None, None, date(2025, 12, 31))]
    got = sorted((r.task_id, r.seq) for r in matching.match_subscriptions(items, spark.createDataFrame(
        tasks, "task_id string, keywords array<string>, regions array<string>, start_date date, end_date date")).collect())
    want = []
    for t, k, r, s, e in tasks:
        ok = filters.filter_list(items, filters.Criteria(k or (), r or (), s, e)).where("accepted").collect()
        want += [(t, x.seq) for x in ok]
    assert got == sorted(want)


def test_cap_is_pruned_before_the_shuffle(spark):
    plan = filters.cap_details(spark.range(100).select(F.col("id").alias("seq"), (F.col("id") % 3).cast("string").alias(
        "source_name")), 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_delivery_moves_new_skip_update(spark):
    hist = spark.createDataFrame([], "task_id string, notice_id string, content_hash string, first_delivered_at string, "
                                     "last_delivered_at string, report_id string")

    def now(h):
        return spark.createDataFrame([("t", "n", h)], "task_id string, notice_id string, content_hash string")

    plan = delivery.plan_delivery(now("h1"), hist)
    assert plan.first().change == "new"
    hist = delivery.mark_delivered(hist, plan, "d1", "r1")
    assert delivery.plan_delivery(now("h1"), hist).first().change == "skipped"
    plan = delivery.plan_delivery(now("h2"), hist)
    assert (plan.first().change, plan.first().previous_hash) == ("update", "h1")
    assert delivery.mark_delivered(hist, plan, "d2", None).first().report_id == "r1"
    assert delivery.plan_delivery(now("h2"), hist, "full_snapshot").count() == 0
    assert not delivery.delivery_allowed("success", "incremental", True, False)


def test_pages(spark):
    html = ('<html><head><title>T</title></head><body><div class="site-nav">导航</div><div id="mainContent"><p>正文 &amp; 内容</p>'
            '<script>x</script><a href="/f/a.pdf">附件一</a></div><footer>页脚</footer></body></html>')
    lst = ('<ul class="vT-srch-result-list-bid"><li><a href="/d/1">安徽省服务器采购公告</a><span>2026.03.15 00:00:00|安徽省|x</span></li>'
           '<li><a href="">空</a></li></ul>')
    df = spark.createDataFrame([(1, "http://h/x", html, lst)], "page_id long, url string, html string, lst string")
    r = df.select(pages.main_text("html").alias("t"), pages.attachment_links(F.col("html"), F.lit("http://h/b/")).alias("a")).first()
    assert r.t == "正文 & 内容\n附件一" and r.a == ["http://h/f/a.pdf"]
    rows = pages.list_rows(df.select("page_id", F.col("lst").alias("html")), "http://www.ccgp.gov.cn").collect()
    assert [(x.title, x.source_url, str(x.publish_time), x.region) for x in rows] == [
        ("安徽省服务器采购公告", "http://www.ccgp.gov.cn/d/1", "2026-03-15", "安徽省")]
    got = pages.anchor_items(spark.createDataFrame([(1, "http://h/x", '<p>2026-05-01 <a href="/n/1">某单位服务器采购招标公告</a></p>'
                                                     '<a href="/l">用户登录注册入口页面</a>')], "page_id long, url string, html string"), "服务器").collect()
    assert [(x.source_url, str(x.publish_time)) for x in got] == [("http://h/n/1", "2026-05-01")]


def test_payload_identity(spark):
    good = '{"data":{"businessId":"b1","businessObjectName":"安徽省服务器采购公告","inner":{"tendererName":"甲","fileList":[{"u":"http://f/1.pdf"}]}}}'
    rows = [(1, "b1", "安徽省服务器采购公告", good), (2, "b2", "安徽省服务器采购公告", good), (3, "b1", "完全不同的项目名称", good)]
    df = spark.createDataFrame(rows, "payload_id long, business_id string, title string, body string")
    found = payloads.verified_details(df)
    assert [r.payload_id for r in found.collect()] == [1]
    text = payloads.detail_text(found.join(df.select("payload_id", "title"), "payload_id")).first().detail_text
    assert "招标人名称：甲" in text
    assert {r.url for r in payloads.attachment_urls(df).collect()} == {"http://f/1.pdf"}


def test_uploads(spark):
    files = [("a/x.html", b"<body><p>\xe9\xa1\xb9\xe7\x9b\xae ABC-12345</p></body>"), ("y.pdf", b"%PDF-1"), ("z.html", b"")]
    good, bad = documents.gate(spark.createDataFrame(files, "path string, content binary"))
    assert {r.code for r in bad.collect()} == {"unsupported_type", "empty_upload"}
    aims = spark.createDataFrame([(1, "别的标题", "ABC-12345")], "notice_id long, title string, project_code string")
    ok, no = documents.tie_to_notices(good.withColumn("notice_id", F.lit(1)), aims)
    assert ok.first().identity_basis == "project_code" and no.count() == 0


def test_source_isolation(spark):
    one = registry.Source("a", lambda s: s.createDataFrame([(1, "t", "u"), (2, "t", "u")], "seq long, title string, source_url string"))
    items, status = registry.read_sources(spark, [one, registry.Source("b", registry.landed("/nowhere/x")),
                                                  registry.Source("c", one.read, not_ready="登录失效"), registry.Source("d", one.read, enabled=False)])
    assert items.count() == 1
    assert {r.source_name: r.status for r in status.collect()} == {"a": "success", "b": "failed", "c": "skipped"}


def test_closure_and_rules(spark):
    names = aggregates.FUNNEL
    rows = [("ok", 80, 40, 10, 2, 20, 8, 3, 5, 0, 5, 4, 1, 0, 5), ("bad", 80, 48, 0, 0, 0, 8, 3, 5, 0, 5, 4, 1, 0, 5)]
    df = spark.createDataFrame(rows, "task_id string, " + ", ".join(f"{n} long" for n in names))
    got = {r.task_id: r.ok for r in aggregates.closure(df, ["task_id"]).collect()}
    assert got == {"ok": True, "bad": False}
    state, _note = rules.urgency(F.col("d"), date(2026, 7, 1))
    days = spark.createDataFrame([("2026年7月3日",), ("2026-06-30",), ("2026-02-31",)], "d string")
    assert [r.s for r in days.select(state.alias("s")).collect()] == ["紧急", "已过期", "未知"]
    warn = spark.range(1).select(enrichment.region_basis(F.lit("安徽广东服务器采购"), F.lit(None), F.lit(""), F.array(F.lit("安徽省"))).alias("r"))
    assert "广东" in warn.first().r


def test_corrections_and_chunks(spark):
    values = spark.createDataFrame([(1, "budget", "1元")], "notice_id long, field_name string, value string").withColumns({
        c: F.lit(None).cast("string") for c in ("source_label", "quote", "method", "status", "evidence_id", "confidence")}).withColumn(
        "page", F.lit(None).cast("int"))
    fixes = spark.createDataFrame([(1, "budget", "2元", "r", datetime(2026, 1, 1), 1), (1, "region", "皖", "r", datetime(2026, 1, 2), 2),
                                   (1, "budget", "3元", "r", datetime(2026, 1, 3), 3)],
                                  "notice_id long, field_name string, corrected_value string, reason string, corrected_at timestamp, correction_id long")
    got = {r.field_name: (r.value, r.evidence_id) for r in evidence.replay_corrections(values, fixes).collect()}
    assert got == {"budget": ("3元", "M-budget-3"), "region": ("皖", "M-region-2")}
    texts = spark.createDataFrame([(1, 1, "a" * 900), (1, 2, "b" * 500), (1, 3, "c" * 300)], "notice_id long, page int, text string")
    chunks = evidence.source_chunks(texts, chunk_chars=1100, max_chunks=1).collect()
    assert len(chunks) == 1 and chunks[0].truncated and chunks[0].text.startswith("[第1页]\naaa")


def test_anchor_passes_over_words_of_every_notice(spark):
    from noticemill.operators.matching import _rare_anchor

    rows = spark.createDataFrame([("采购服务器",), ("采购",), ("车",)], "term string")
    assert [r.a for r in rows.select(_rare_anchor(F.col("term")).alias("a")).collect()] == ["购服", "采购", "车"]


def test_many_subscriptions_with_equal_keywords(spark):
    from noticemill.operators.matching import match_subscriptions
    from noticemill.sources import schemas

    tasks = spark.range(3000).select(
        F.concat(F.lit("t"), "id").alias("task_id"),
        F.when(F.col("id") % 10 == 0, F.array(F.lit("采购服务器"))).otherwise(F.array(F.lit("采购桌椅"), F.lit("采购"))).alias("keywords"),
        F.array().cast("array<string>").alias("regions"), F.lit(None).cast("date").alias("start_date"),
        F.lit(None).cast("date").alias("end_date"))
    items = spark.createDataFrame([(1, "s", "单位采购服务器公告", "u", "i", None, None, None), (2, "s", "单位服务器招标公告", "u", "j", None, None, None)],
                                  schemas.LIST_ITEM)
    got = match_subscriptions(items, tasks)
    assert got.count() == 3000 and got.where("seq = 2").count() == 0


def test_broadcast_checks_bytes(spark):
    from noticemill.session import is_small

    rows = spark.createDataFrame([("x" * 100,)], "v string")
    assert is_small(rows) and not is_small(rows, max_bytes=50) and not is_small(rows.union(rows), limit=1)


def test_pages_with_unknown_marked_sections(spark):
    from noticemill.sources.pages import _Tree

    for lead in ("<![foo[bar]]>", "<![ ]>", "<![endif]>", "<!["):
        assert "text" in {t for _, t in _Tree(f"<p>text</p>{lead}").texts}


def test_payload_walk_in_one_stage(spark, monkeypatch):
    """Nodes of any depth are found, few stages store what is left, and of several hits the first in key order counts."""
    title = "安徽省服务器采购公告"

    def around(inner, depth):
        for i in range(depth):
            inner = '[0,%s]' % inner if i % 2 else '{"a":1,"z":%s}' % inner
        return inner

    own = '{"id":"b1","title":"%s","x":%%s}' % title
    two = own % '{"k":[{"content":"第二"}],"b":{"content":"第一","deep":{"content":"内"}}}'
    rows = [(d, "b1", title, around(own % '{"y":{"content":"深"}}', d)) for d in (0, 3, 7, 8, 20)] + [
        (100, "b1", title, two), (101, "b1", "短", own % '{"content":"x"}'), (102, "", title, two), (103, None, title, two),
        (104, "b1", title, "{"), (105, "b1", title, None), (106, "b1", title, '{"id":{"id":"b1"},"title":"%s","content":"x"}' % title),
        (107, "7", title, '{"businessId":null,"id":7,"title":"%s","content":"数"}' % title),
        (108, "b1", title, '{"businessId":"b2","id":"b1","title":"%s","content":"x"}' % title)]
    df = spark.createDataFrame(rows, "payload_id long, business_id string, title string, body string")
    stored = []
    monkeypatch.setattr(payloads, "cut_lineage", lambda d: stored.append(1) or d.localCheckpoint())
    found = payloads.verified_details(df).join(df.select("payload_id", "title"), "payload_id")
    got = {r.payload_id: r.detail_text for r in payloads.detail_text(found).collect()}
    deep = {d: f"项目名称：{title}\n公告正文：\n深" for d in (0, 3, 7, 8, 20)}
    assert got == deep | {100: f"项目名称：{title}\n公告正文：\n第一", 107: f"项目名称：{title}\n公告正文：\n数"}
    assert len(stored) <= 4
