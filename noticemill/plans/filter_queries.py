"""Registered queries: filters, subscription matching, incremental delivery, listings."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from noticemill.operators import delivery, filters, listing, matching
from noticemill.plans import views as V
from noticemill.session import cut_lineage
from noticemill.sources import registry

ONE = filters.Criteria(keywords=("BUILDING", "MACHINERY"), regions=("NATION_7", "NATION_12", "NATION_18"),
                       start_date=date(1996, 1, 1), end_date=date(1998, 12, 31))
RUN_AT = datetime(1998, 6, 15, 9, 0)


def _noisy(spark, sf):
    noise = F.when(F.col("notice_id") % 17 == 0, F.concat(F.col("title"), F.lit("培训班"))).otherwise(
        F.when(F.col("notice_id") % 19 == 0, F.regexp_replace("title", "采购公开招标公告", "公示")).otherwise(F.col("title")))
    return V.notices(spark, sf).withColumn("title", noise)


def list_filter_reason(spark, sf):
    return filters.filter_list(_noisy(spark, sf), ONE).select("notice_id", "reason")


def detail_filter_reason(spark, sf):
    rows = _noisy(spark, sf).withColumn("title", F.regexp_replace("title", "采购公开", "公开"))
    return filters.filter_details(rows, ONE).select("notice_id", "reason")


def detail_cap(spark, sf):
    kept = filters.filter_list(_noisy(spark, sf), ONE).where("reason IS NULL")
    return filters.cap_details(kept, filters.source_cap("incremental")).select("source_name", "notice_id")


def detail_cap_counts(spark, sf):
    kept = filters.filter_list(_noisy(spark, sf), ONE).where("reason IS NULL")
    return filters.cap_counts(kept, 8)


def within_source_dedup(spark, sf):
    """First row per source and list key (the title) in list order."""
    docs = V.view(spark, sf, "doc_notices").select("source_name", "seq", "title", F.lit("").alias("source_item_id"))
    return registry.first_per_key(docs, "source_item_id").select("source_name", "seq")


def subscription_match(spark, sf):
    return matching.match_subscriptions(V.notices(spark, sf), V.subscriptions(spark, sf)).select("task_id", "notice_id")


def _plan(spark, sf):
    current = cut_lineage(matching.match_subscriptions(V.notices(spark, sf), V.subscriptions(spark, sf)).select(
        "task_id", "notice_id", "content_hash"))  # the stored history is derived from it
    return current, _history(current)


def _history(current):
    """Stored deliveries: three of four matches, one of them with an older hash."""
    stale = F.when(F.col("notice_id") % 4 == 1, F.concat(F.lit("old"), F.col("content_hash")))
    return current.where("notice_id % 4 <> 0").select(
        "task_id", "notice_id", F.coalesce(stale, F.col("content_hash")).alias("content_hash"),
        F.lit("1998-01-01").alias("first_delivered_at"), F.lit("1998-02-01").alias("last_delivered_at"),
        F.when(F.col("notice_id") % 3 == 0, "r0").alias("report_id"))


def incremental_plan(spark, sf):
    current, history = _plan(spark, sf)
    return delivery.plan_delivery(current, history).select("task_id", "notice_id", "change", "previous_hash")


def plan_counts(spark, sf):
    return delivery.plan_counts(delivery.plan_delivery(*_plan(spark, sf)))


def mark_delivered(spark, sf):
    current, history = _plan(spark, sf)
    return delivery.mark_delivered(history, delivery.plan_delivery(current, history), "1998-06-15", None)


def change_labels(spark, sf):
    return delivery.plan_delivery(*_plan(spark, sf)).where("change <> 'skipped'").select(
        "task_id", "notice_id", delivery.change_label().alias("change_label"))


def _criteria_tasks(spark, sf):
    """One task per order with the faults its key implies."""
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    return V.load(spark, sf, "orders").select(
        k.alias("task_id"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("服务器"))).alias("keywords"),
        F.when(k % 7 == 0, F.lit(None).cast("array<string>")).otherwise(F.array(F.lit("安徽省"))).alias("regions"),
        F.when(k % 6 != 0, day).alias("start_date"),
        F.when(k % 4 == 1, F.date_sub(day, 3)).when(k % 4 != 2, F.date_add(day, 30)).alias("end_date"),
        (k % 2 == 0).alias("schedule_enabled"),
        F.when(k % 3 == 0, "once").when(k % 11 == 0, "yearly").otherwise("daily").alias("schedule_type"),
        F.when(k % 10 == 0, "").when(k % 14 == 0, "99:00").otherwise("08:30").alias("execute_time"),
        day.alias("execute_date"), (k % 8 == 0).alias("execute_immediately"))


def criteria_issues(spark, sf):
    return filters.criteria_issues(_criteria_tasks(spark, sf), RUN_AT).select("task_id", "code", "severity")


def criteria_suggestions(spark, sf):
    issues = filters.criteria_issues(_criteria_tasks(spark, sf), RUN_AT)
    return filters.criteria_suggestions(issues).groupBy("suggestion").agg(F.count(F.lit(1)).alias("n"))


def live_tasks(spark, sf):
    return filters.live_tasks(V.subscriptions(spark, sf)).select("task_id")


def page_flags(spark, sf):
    """Triage of the raw pages, with marker texts put into known ones."""
    marked = F.concat("html", F.when(F.col("page_id") % 4 == 0, "请登录").when(F.col("page_id") % 4 == 1, "退出登录")
                      .when(F.col("page_id") % 4 == 2, "CAPTCHA").otherwise("频繁访问"))
    front = F.when(F.col("page_id") % 8 == 0, F.concat(F.lit("登录"), marked)).otherwise(marked)
    return V.load(spark, sf, "pages").select("page_id", *filters.page_flags(front))


def notice_listing(spark, sf):
    page, _total = listing.list_notices(V.notices(spark, sf), source_name="ccgp", detail_status="full", limit=50, offset=20,
                                        newest="order_day")
    return page.select("notice_id", "title")


def notice_listing_total(spark, sf):
    _page, total = listing.list_notices(V.notices(spark, sf), source_name="ccgp", detail_status="full", newest="order_day")
    return total


def delivered_semi(spark, sf):
    current, history = _plan(spark, sf)
    page = listing.delivered_to(V.notices(spark, sf), history, 31)
    return page.select("notice_id")


N = V.cte("notices", "tasks")
_NOISY = """, noisy AS (SELECT * REPLACE (CASE WHEN notice_id % 17 = 0 THEN title || '培训班'
  WHEN notice_id % 19 = 0 THEN replace(title, '采购公开招标公告', '公示') ELSE title END AS title) FROM notices)"""
_LIST = _NOISY + """, flt AS (SELECT *, CASE
  WHEN contains(title, '培训班') OR NOT regexp_matches(title, '招标|采购|投标|中标|询价|磋商|谈判|比选|邀标|竞价') THEN '非招标/采购类标题'
  WHEN NOT (contains(title || ' ' || coalesce(region, ''), 'BUILDING') OR contains(title || ' ' || coalesce(region, ''), 'MACHINERY')) THEN '关键词不匹配'
  WHEN region IS NOT NULL AND NOT regexp_matches(region || ' ' || title, 'NATION_7|NATION_12|NATION_18') THEN '区域不匹配'
  WHEN publish_time IS NOT NULL AND NOT (publish_time BETWEEN DATE '1996-01-01' AND DATE '1998-12-31') THEN '发布时间不在范围内'
  END AS reason FROM noisy)"""
_HASH = "sha256(concat(n.title, '|', n.clean_content, '|', n.source_url))"
_MATCH = f""", m AS (SELECT t.task_id, n.notice_id, {_HASH} AS content_hash FROM notices n JOIN tasks t
  ON contains(n.title || ' ' || coalesce(n.region, ''), t.keyword)
  AND (n.region IS NULL OR EXISTS (SELECT 1 FROM nation x WHERE x.n_regionkey = t.region_key
    AND contains(n.region || ' ' || n.title, x.n_name)))
  AND (n.publish_time IS NULL OR ((t.start_date IS NULL OR n.publish_time >= t.start_date)
    AND (t.end_date IS NULL OR n.publish_time <= t.end_date))))"""
_PLAN = _MATCH + """, p AS (SELECT task_id, notice_id, content_hash,
  CASE notice_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'update' ELSE 'skipped' END AS change,
  CASE WHEN notice_id % 4 = 1 THEN 'old' || content_hash END AS previous_hash FROM m)"""
_ISSUES = """WITH t AS (SELECT o_orderkey AS k, cast(o_orderdate AS date) AS d FROM orders),
i AS (SELECT k, unnest([
  CASE WHEN k % 5 = 0 THEN 'missing_keywords' END, CASE WHEN k % 7 = 0 THEN 'missing_regions' END,
  CASE WHEN k % 6 <> 0 AND k % 4 = 1 THEN 'conflicting_dates' END,
  CASE WHEN k % 6 = 0 AND k % 4 = 2 THEN 'missing_date_range' END,
  CASE WHEN (k % 6 = 0) <> (k % 4 = 2) THEN 'incomplete_date_range' END,
  CASE WHEN k % 2 = 0 AND k % 10 = 0 THEN 'missing_execute_time' END,
  CASE WHEN k % 2 = 0 AND k % 3 = 0 AND k % 10 <> 0 AND k % 14 = 0 THEN 'invalid_execute_time' END,
  CASE WHEN k % 2 = 0 AND k % 3 = 0 AND k % 10 <> 0 AND k % 14 <> 0
    AND d + interval 510 minute <= TIMESTAMP '1998-06-15 09:00:00' THEN 'expired_schedule' END,
  CASE WHEN k % 2 = 0 AND k % 3 <> 0 AND k % 11 = 0 THEN 'invalid_schedule_type' END,
  CASE WHEN k % 8 = 0 THEN 'schedule_and_immediate' END]) AS code FROM t)"""

ENTRIES = {
    "incremental_plan": (incremental_plan, N + _PLAN + "SELECT task_id, notice_id, change, previous_hash FROM p"),
    "subscription_match": (subscription_match, N + _MATCH + "SELECT task_id, notice_id FROM m"),
    "list_filter_reason": (list_filter_reason, N + _LIST + "SELECT notice_id, reason FROM flt"),
    "detail_filter_reason": (detail_filter_reason, N + _NOISY + """, d AS (SELECT notice_id, publish_time, clean_content, region,
  replace(title, '采购公开', '公开') AS title FROM noisy), b AS (SELECT *, concat_ws(' ', title, region, clean_content) AS blob FROM d)
SELECT notice_id, CASE
  WHEN contains(title || substr(blob, 1, 200), '培训班')
    OR NOT regexp_matches(title || substr(blob, 1, 200), '招标|采购|投标|中标|询价|磋商|谈判|比选|邀标|竞价') THEN '详情非招标/采购类'
  WHEN NOT regexp_matches(blob, 'BUILDING|MACHINERY') THEN '详情关键词不匹配'
  WHEN NOT regexp_matches(blob, 'NATION_7|NATION_12|NATION_18') THEN '详情区域不匹配'
  WHEN publish_time IS NOT NULL AND NOT (publish_time BETWEEN DATE '1996-01-01' AND DATE '1998-12-31') THEN '详情发布时间不在范围内'
  END AS reason FROM b"""),
    "detail_cap": (detail_cap, N + _LIST + """SELECT source_name, notice_id FROM (SELECT *, row_number() OVER (
  PARTITION BY source_name ORDER BY seq) AS rn FROM flt WHERE reason IS NULL) WHERE rn <= 8"""),
    "detail_cap_counts": (detail_cap_counts, N + _LIST + """SELECT source_name, count(*) AS kept,
  greatest(count(*) - 8, 0) AS cap_skipped, false AS truncated FROM flt WHERE reason IS NULL GROUP BY source_name"""),
    "within_source_dedup": (within_source_dedup, V.cte("doc_notices") + """SELECT source_name, min(seq) AS seq
FROM doc_notices GROUP BY source_name, title"""),
    "plan_counts": (plan_counts, N + _PLAN + """SELECT task_id, count(*) FILTER (change = 'new') AS new_count,
  count(*) FILTER (change = 'update') AS update_count, count(*) FILTER (change = 'skipped') AS skipped_count
FROM p GROUP BY task_id"""),
    "mark_delivered": (mark_delivered, N + _PLAN + """SELECT task_id, notice_id, content_hash,
  CASE WHEN change = 'new' THEN '1998-06-15' ELSE '1998-01-01' END AS first_delivered_at,
  CASE WHEN change = 'skipped' THEN '1998-02-01' ELSE '1998-06-15' END AS last_delivered_at,
  CASE WHEN change <> 'new' AND notice_id % 3 = 0 THEN 'r0' END AS report_id FROM p"""),
    "change_labels": (change_labels, N + _PLAN + """SELECT task_id, notice_id,
  CASE change WHEN 'update' THEN '内容发生变化' ELSE '新增' END AS change_label FROM p WHERE change <> 'skipped'"""),
    "criteria_issues": (criteria_issues, _ISSUES + """SELECT k AS task_id, code,
  CASE WHEN code = 'schedule_and_immediate' THEN 'warning' ELSE 'error' END AS severity FROM i WHERE code IS NOT NULL"""),
    "criteria_suggestions": (criteria_suggestions, _ISSUES + """, s AS (SELECT DISTINCT k, CASE code
  WHEN 'missing_keywords' THEN '在问题中写明采购主题，或在确认页手动填写关键词。'
  WHEN 'missing_regions' THEN '写明省/市名称，或在确认页从区域列表选择。'
  WHEN 'missing_date_range' THEN '使用「最近N个月」或「YYYY年M月份」等明确表达。'
  WHEN 'incomplete_date_range' THEN '使用「最近N个月」或「YYYY年M月份」等明确表达。'
  WHEN 'expired_schedule' THEN '勾选「立即执行」，或把单次任务改到明天同一时间 / 每日定时。'
  WHEN 'conflicting_dates' THEN '检查开始日期是否早于或等于结束日期。' END AS suggestion FROM i)
SELECT suggestion, count(*) AS n FROM s WHERE suggestion IS NOT NULL GROUP BY suggestion"""),
    "live_tasks": (live_tasks, N + "SELECT task_id FROM tasks WHERE task_id % 7 <> 0"),
    "page_flags": (page_flags, """SELECT page_id,
  page_id % 4 = 0 AND (page_id % 8 = 0 OR contains(lower(substr(html, 1, 5000)), 'login') OR length(html) < 4998) AS login_wall,
  page_id % 4 = 1 AS logged_in, page_id % 4 = 2 AS needs_verification, page_id % 4 = 3 AS rate_limited FROM pages"""),
    "notice_listing": (notice_listing, N + """SELECT notice_id, title FROM notices WHERE source_name = 'ccgp'
  AND detail_status = 'full' ORDER BY order_day DESC, notice_id LIMIT 50 OFFSET 20"""),
    "notice_listing_total": (notice_listing_total, N + """SELECT count(*) AS total FROM notices
WHERE source_name = 'ccgp' AND detail_status = 'full'"""),
    "delivered_semi": (delivered_semi, N + _MATCH + """SELECT notice_id FROM m WHERE task_id = 31 AND notice_id % 4 <> 0"""),
}
