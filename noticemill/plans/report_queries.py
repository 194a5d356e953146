"""Registered queries: counters, run status, report tables, listings of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticemill.operators import aggregates as A
from noticemill.operators import extraction, listing, reports
from noticemill.plans import rule_queries as R
from noticemill.plans import views as V

KEYS = ["task_id"]


def outcomes(spark, sf):
    """One run per market segment: what became of every raw notice of it."""
    k = F.col("notice_id")
    stage = (F.when(k % 5 == 0, "list_filtered").when(k % 7 == 0, "cap_skipped").when(k % 11 == 0, "detail_failed")
             .when(k % 13 == 0, "detail_filtered").when(k % 3 == 0, "merged").otherwise("primary"))
    return V.notices(spark, sf).select(
        F.regexp_extract("title", "^([A-Z]+)", 1).alias("task_id"), "notice_id", "seq", "title", "source_name", "detail_status",
        stage.alias("outcome"), (k % 2 == 0).alias("store_matched"),
        F.when(stage == "primary", F.when(k % 4 == 0, "new").when(k % 4 == 1, "update").otherwise("skipped")).alias("change"))


def statuses(spark, sf):
    """Read status of every source of every run; one failed, one skipped."""
    tasks = outcomes(spark, sf).select("task_id").distinct()
    rows = [("ccgp", "success", "检索完成"), ("cebpub", "success", "检索完成"), ("login_portal", "success", "检索完成"),
            ("broken", "failed", "读取失败"), ("gate", "skipped", "登录态不可用")]
    names = F.array(*[F.struct(F.lit(a).alias("source_name"), F.lit(b).alias("status"), F.lit(c).alias("message")) for a, b, c in rows])
    return tasks.select("task_id", F.inline(names))


def items(spark, sf):
    return outcomes(spark, sf).where("outcome = 'primary' AND change IN ('new', 'update')")


def funnel(spark, sf):
    return A.funnel(outcomes(spark, sf), KEYS)


def funnel_closure(spark, sf):
    """Balanced counters for most runs; two are broken on purpose."""
    rows = A.funnel(outcomes(spark, sf), KEYS).withColumns({
        "raw_result_count": F.col("raw_result_count") + F.when(F.col("task_id") == "BUILDING", 3).otherwise(0),
        "report_item_count": F.col("report_item_count") + F.when(F.col("task_id") == "MACHINERY", 1).otherwise(0)})
    return A.closure(rows, KEYS).select("task_id", "ok", "note")


def detail_counts(spark, sf):
    return A.detail_counts(outcomes(spark, sf), KEYS)


def source_stats(spark, sf):
    return A.source_stats(outcomes(spark, sf), statuses(spark, sf), A.contributions(items(spark, sf), KEYS), KEYS)


def source_table(spark, sf):
    return reports.source_table(source_stats(spark, sf), KEYS)


def zero_contribution(spark, sf):
    few = items(spark, sf).where("source_name <> 'cebpub' OR task_id <> 'BUILDING'")
    return A.zero_contribution(statuses(spark, sf), few, KEYS)


def runs(spark, sf):
    found = statuses(spark, sf).groupBy("task_id").agg(
        F.count(F.lit(1)).alias("sources_requested"), F.count_if(F.col("status") == "success").alias("sources_succeeded"),
        F.count_if(F.col("status") != "success").alias("sources_failed"))
    clean = F.col("task_id") == "BUILDING"
    base = A.detail_counts(outcomes(spark, sf), KEYS).join(found, "task_id").join(A.funnel(outcomes(spark, sf), KEYS).drop("detail_failed"), "task_id")
    none = {c: F.when(clean, 0).otherwise(F.col(c)) for c in (
        "sources_failed", "detail_failed_count", "detail_metadata_count", "detail_human_verification_count")}
    out = base.withColumns({**none, "truncated": F.col("task_id") == "MACHINERY", "report_mode": F.lit("incremental"),
                            "start_date": F.when(clean, F.lit("1996-01-01").cast("date")), "end_date": F.lit(None).cast("date"),
                            "sources_succeeded": F.when(F.col("task_id") == "FURNITURE", 0).otherwise(F.col("sources_succeeded"))})
    return out.withColumn("status", A.run_status(out))


def run_status(spark, sf):
    return runs(spark, sf).select("task_id", "status")


def run_warnings(spark, sf):
    return A.warnings(runs(spark, sf), statuses(spark, sf), KEYS).select("task_id", "warning")


def data_modes(spark, sf):
    k = F.col("notice_id")
    rows = outcomes(spark, sf).withColumn("data_mode", F.when(F.col("task_id") == "BUILDING", "fixture").when(
        (F.col("task_id") == "MACHINERY") & (k % 2 == 0), "fixture").when(k % 3 == 0, "live"))
    return A.data_mode(rows, KEYS)


def cover(spark, sf):
    return reports.cover(runs(spark, sf))


def funnel_table(spark, sf):
    full = A.funnel(outcomes(spark, sf), KEYS).join(A.detail_counts(outcomes(spark, sf), KEYS), "task_id")
    return reports.funnel_table(full, KEYS).select("task_id", "stage_no", "stage", "n")


def _graded_items(spark, sf):
    marks = R.graded(spark, sf).select("notice_id", "priority", "deadline_urgency", "decision", "gaps", "recommended_actions")
    return outcomes(spark, sf).join(marks, "notice_id").withColumn(
        "completeness_percent", F.when(F.col("detail_status") == "full", (F.col("notice_id") % 50 + 50).cast("int")))


def top3(spark, sf):
    return reports.top_opportunities(_graded_items(spark, sf), KEYS).select("task_id", "rank", "notice_id", "priority")


def preview3(spark, sf):
    return reports.preview(_graded_items(spark, sf), KEYS).select("task_id", "rank", "notice_id")


def decision_table(spark, sf):
    return reports.decision_table(_graded_items(spark, sf), KEYS).select("task_id", "rank", "title", "decision")


def _overview_fields():
    return [f for f in reports.OVERVIEW_FIELDS]


def overview(spark, sf):
    """Numbered overview of every run's items with extracted fields."""
    from noticemill.operators.rules import pivot_fields

    values = extraction.field_values(extraction.extract_wide(V.notices(spark, sf)), fields=_overview_fields())
    rows = _graded_items(spark, sf).join(pivot_fields(values, _overview_fields()), "notice_id", "left")
    return reports.overview(rows, KEYS).select("task_id", "item_no", "notice_id", "purchaser", "budget", "region", "detail_label", "source")


def structured_detail(spark, sf):
    names = [n for n, _ in reports.DETAIL_LABELS if n != "document_acquisition"] + ["document_acquisition_start", "document_acquisition_end", "deadline"]
    values = extraction.field_values(extraction.extract_wide(V.notices(spark, sf)), fields=names)
    return reports.structured_detail(values).where("label IN ('采购人', '预算金额', '项目地区', '资金来源')").select("notice_id", "label", "value")


def evidence_table(spark, sf):
    values = extraction.field_values(extraction.extract_wide(V.notices(spark, sf)), fields=["purchaser", "budget"])
    return reports.evidence_table(values).select("notice_id", "evidence_id", "source_label", "page", "quote")


def failed_sources(spark, sf):
    return reports.failed_sources(statuses(spark, sf), KEYS)


def data_quality(spark, sf):
    values = extraction.field_values(extraction.extract_wide(V.notices(spark, sf)), fields=["purchaser", "budget", "project_code"])
    return A.data_quality(values, V.notices(spark, sf)).select("notice_id", "assessable", "evidence_field_count",
                                                               F.size("needs_review_fields").alias("reviews"))


def _executions(spark, sf):
    k = F.col("o_orderkey")
    return V.load(spark, sf, "orders").select(
        k.alias("execution_id"), F.col("o_custkey").alias("task_id"), F.col("o_orderdate").cast("date").alias("created_at"),
        F.when(k % 3 == 0, "snapshot").otherwise("incremental").alias("report_scope"),
        F.when(k % 5 == 0, "incremental").alias("report_mode"), F.when(k % 7 == 0, False).alias("deduplicate"),
        F.when(k % 2 == 0, F.concat(F.lit("/r/"), k.cast("string"))).alias("report_path"),
        (k % 90).alias("raw_result_count"), (k % 9).alias("filtered_result_count"), (k % 4).alias("duplicate_count"),
        (k % 6).alias("item_count"))


def execution_history(spark, sf):
    return listing.execution_history(_executions(spark, sf)).select("execution_id", "report_mode", "deduplicate")


def report_catalogue(spark, sf):
    tasks = V.load(spark, sf, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_name").alias("query"))
    return listing.report_catalogue(_executions(spark, sf), tasks).select("execution_id", "query")


def latest_execution(spark, sf):
    rows = _executions(spark, sf).withColumn("at", F.struct("created_at", "execution_id"))
    return listing.latest(rows, "at", ["task_id"]).select("task_id", "execution_id")


def rebuilt_funnel(spark, sf):
    return A.rebuilt_funnel(_executions(spark, sf))


N = V.cte("notices")
_O = f"""{N}, o AS (SELECT regexp_extract(title, '^([A-Z]+)', 1) AS task_id, notice_id, seq, title, source_name, detail_status AS st, notice_id % 2 = 0 AS sm,
  CASE WHEN notice_id % 5 = 0 THEN 'list_filtered' WHEN notice_id % 7 = 0 THEN 'cap_skipped' WHEN notice_id % 11 = 0 THEN 'detail_failed'
    WHEN notice_id % 13 = 0 THEN 'detail_filtered' WHEN notice_id % 3 = 0 THEN 'merged' ELSE 'primary' END AS oc,
  CASE notice_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'update' ELSE 'skipped' END AS ch, buyer, price, region FROM notices),
src AS (SELECT * FROM (SELECT DISTINCT task_id FROM o), (VALUES ('ccgp', 'success', '检索完成'), ('cebpub', 'success', '检索完成'),
  ('login_portal', 'success', '检索完成'), ('broken', 'failed', '读取失败'), ('gate', 'skipped', '登录态不可用')) v(source_name, status, message)),
items AS (SELECT * FROM o WHERE oc = 'primary' AND ch <> 'skipped'),
fu AS (SELECT task_id, count(*) AS raw_result_count, count(*) FILTER (oc = 'list_filtered') AS list_filtered_out,
  count(*) FILTER (oc = 'cap_skipped') AS detail_cap_skipped, count(*) FILTER (oc = 'detail_failed') AS detail_failed,
  count(*) FILTER (oc = 'detail_filtered') AS detail_filtered_out, count(*) FILTER (oc IN ('merged', 'primary')) AS candidates_count,
  count(*) FILTER (oc = 'merged') AS cross_source_merge_count, count(*) FILTER (oc = 'primary') AS primary_count,
  count(*) FILTER (oc = 'primary' AND sm) AS db_merge_count, count(*) FILTER (oc = 'primary' AND NOT sm) AS saved_count,
  count(*) FILTER (oc = 'primary' AND ch = 'new') AS incremental_count, count(*) FILTER (oc = 'primary' AND ch = 'update') AS update_count,
  count(*) FILTER (oc = 'primary' AND ch = 'skipped') AS skipped_already_delivered,
  count(*) FILTER (oc = 'primary' AND ch <> 'skipped') AS report_item_count FROM o GROUP BY 1),
dc AS (SELECT task_id, count(*) FILTER (op AND st = 'full') AS detail_full_count, count(*) FILTER (op AND st = 'metadata_only') AS detail_metadata_count,
  count(*) FILTER (oc = 'detail_failed' OR (op AND st = 'failed')) AS detail_failed_count,
  count(*) FILTER (op AND st = 'needs_human_verification') AS detail_human_verification_count
  FROM (SELECT *, oc IN ('detail_filtered', 'merged', 'primary') AS op FROM o) GROUP BY 1),
ss AS (SELECT s.task_id, s.source_name, s.status, s.message, count(o.oc) AS raw_count, count(*) FILTER (oc <> 'list_filtered') AS list_kept,
  count(*) FILTER (oc IN ('detail_filtered', 'merged', 'primary') AND st = 'full') AS detail_success,
  count(*) FILTER (oc IN ('detail_filtered', 'merged', 'primary') AND st <> 'full') AS detail_metadata_only,
  count(*) FILTER (oc = 'primary' AND ch <> 'skipped') AS final_contributed
  FROM src s LEFT JOIN o USING (task_id, source_name) GROUP BY 1, 2, 3, 4),
rs AS (SELECT task_id, CASE WHEN task_id = 'FURNITURE' THEN 'failed' WHEN task_id = 'BUILDING' THEN 'success' ELSE 'partial' END AS status FROM fu)
"""
_NAME = """CASE source_name WHEN 'ccgp' THEN '中国政府采购网' WHEN 'cebpub' THEN '中国招标投标公共服务平台' WHEN 'login_portal' THEN '登录态招采门户'
  ELSE source_name END"""
_GR = R._G + f""", o AS (SELECT regexp_extract(title, '^([A-Z]+)', 1) AS task_id, notice_id, seq, title, ok, {R._PRI} AS priority,
  CASE WHEN NOT ok THEN '信息不足' WHEN kind IN ('中标公告', '终止公告') OR urg = '已过期' THEN '不建议参与' WHEN NOT cl OR no_deadline THEN '信息不足'
  ELSE '有条件参与' END AS decision, CASE WHEN ok THEN notice_id % 50 + 50 ELSE 0 END AS pct FROM g)"""

ENTRIES = {
    "funnel": (funnel, _O + "SELECT * FROM fu"),
    "funnel_closure": (funnel_closure, _O + """, x AS (SELECT *, raw_result_count + CASE WHEN task_id = 'BUILDING' THEN 3 ELSE 0 END AS raw,
  report_item_count + CASE WHEN task_id = 'MACHINERY' THEN 1 ELSE 0 END AS rep FROM fu)
SELECT task_id, task_id NOT IN ('BUILDING', 'MACHINERY') AS ok, CASE WHEN task_id = 'BUILDING' THEN
  '列表漏斗未闭合：原始' || raw || ' − 列表过滤' || list_filtered_out || ' − 上限跳过' || detail_cap_skipped || ' − 详情失败' || detail_failed
  || ' − 详情过滤' || detail_filtered_out || ' − 候选' || candidates_count || ' = 3（应为0）'
  WHEN task_id = 'MACHINERY' THEN '报告条目' || rep || ' ≠ 新增' || incremental_count || ' + 更新' || update_count
  ELSE '闭合校验通过：' || raw || ' = ' || list_filtered_out || '+' || detail_cap_skipped || '+' || detail_failed || '+' || detail_filtered_out
  || '+' || candidates_count || '；候选' || candidates_count || ' → 合并' || cross_source_merge_count || ' + 主记录' || primary_count
  || '；报告' || rep || ' = 新增' || incremental_count || '+更新' || update_count END AS note FROM x"""),
    "detail_counts": (detail_counts, _O + "SELECT * FROM dc"),
    "source_stats": (source_stats, _O + "SELECT * FROM ss"),
    "source_table": (source_table, _O + f"""SELECT task_id, {_NAME} AS source, CASE status WHEN 'success' THEN '成功' WHEN 'failed' THEN '失败' ELSE '跳过' END AS status,
  raw_count, detail_success, detail_metadata_only, final_contributed, message FROM ss"""),
    "zero_contribution": (zero_contribution, _O + """SELECT task_id, source_name FROM src s WHERE status = 'success' AND NOT EXISTS (
  SELECT 1 FROM items i WHERE i.task_id = s.task_id AND i.source_name = s.source_name AND (i.source_name <> 'cebpub' OR i.task_id <> 'BUILDING'))"""),
    "run_status": (run_status, _O + "SELECT * FROM rs"),
    "run_warnings": (run_warnings, _O + f"""SELECT task_id, '存在失败或跳过的数据源，报告覆盖范围不完整，详见数据源执行情况表。' AS warning FROM rs WHERE status = 'partial'
UNION ALL SELECT task_id, {_NAME} || '：' || message FROM src WHERE status <> 'success'
UNION ALL SELECT task_id, cast(detail_human_verification_count AS string) || ' 条详情要求人工完成安全验证；系统未绕过验证，该类记录不按完整正文分析。' FROM dc
  WHERE detail_human_verification_count > 0 AND task_id <> 'BUILDING'
UNION ALL SELECT task_id, '本次快照已达每源 500 条安全上限，truncated=true；报告不声称为完整覆盖。' FROM rs WHERE task_id = 'MACHINERY'"""),
    "data_modes": (data_modes, _O + """SELECT DISTINCT task_id, CASE task_id WHEN 'BUILDING' THEN '演示数据' WHEN 'MACHINERY' THEN '实时数据+演示数据'
  ELSE '实时数据' END AS data_mode_label FROM o"""),
    "cover": (cover, _O + """SELECT task_id, CASE WHEN task_id = 'BUILDING' THEN '1996年1月1日 至 不限' ELSE '未指定统计周期' END AS period,
  report_item_count AS items, CASE WHEN task_id = 'FURNITURE' THEN '0 / 5' ELSE '3 / 5' END AS sources, incremental_count, update_count,
  '增量交付（新增与变化）' AS scope, CASE status WHEN 'failed' THEN '失败' WHEN 'success' THEN '成功（全部请求数据源已完成）'
  ELSE '部分成功（存在失败或跳过的数据源）' END AS status_label FROM fu JOIN rs USING (task_id)"""),
    "funnel_table": (funnel_table, _O + """SELECT task_id, stage_no, stage, n FROM (SELECT task_id, unnest([
  {'stage_no': 1, 'stage': '原始列表结果', 'n': raw_result_count}, {'stage_no': 2, 'stage': '列表阶段过滤排除', 'n': list_filtered_out},
  {'stage_no': 3, 'stage': '详情上限未抓取', 'n': detail_cap_skipped}, {'stage_no': 4, 'stage': '详情抓取失败', 'n': detail_failed},
  {'stage_no': 5, 'stage': '仅列表元数据', 'n': detail_metadata_count}, {'stage_no': 6, 'stage': '详情内容失败', 'n': 0},
  {'stage_no': 7, 'stage': '待人工安全验证', 'n': detail_human_verification_count}, {'stage_no': 8, 'stage': '详情阶段过滤排除', 'n': detail_filtered_out},
  {'stage_no': 9, 'stage': '进入去重候选', 'n': candidates_count}, {'stage_no': 10, 'stage': '跨源合并减少', 'n': cross_source_merge_count},
  {'stage_no': 11, 'stage': '去重后主记录', 'n': primary_count}, {'stage_no': 12, 'stage': '库内已存在合并', 'n': db_merge_count},
  {'stage_no': 13, 'stage': '历史已交付跳过', 'n': skipped_already_delivered}, {'stage_no': 14, 'stage': '本次新增', 'n': incremental_count},
  {'stage_no': 15, 'stage': '本次内容更新', 'n': update_count}, {'stage_no': 16, 'stage': '本报告条目', 'n': report_item_count}], recursive := true)
  FROM fu JOIN dc USING (task_id))"""),
    "top3": (top3, _GR + """SELECT task_id, rank, notice_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY
  CASE priority WHEN '高' THEN 4 WHEN '中' THEN 3 WHEN '待核验' THEN 2 ELSE 1 END DESC, pct DESC, seq) AS rank FROM o) WHERE rank <= 3"""),
    "preview3": (preview3, _GR + """SELECT task_id, rank, notice_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS rank FROM o) WHERE rank <= 3"""),
    "decision_table": (decision_table, _GR + """SELECT task_id, rank, substr(title, 1, 36) AS title, decision FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS rank FROM o) WHERE rank <= 8"""),
    "overview": (overview, _O + f"""SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS item_no, notice_id, buyer AS purchaser,
  cast(cast(floor(price) AS bigint) AS string) || '元' AS budget, coalesce(region, '原文未明确说明') AS region,
  CASE st WHEN 'full' THEN '已核验详情' WHEN 'metadata_only' THEN '仅元数据' WHEN 'failed' THEN '详情失败' ELSE '待人工验证' END AS detail_label,
  {_NAME} AS source FROM o"""),
    "structured_detail": (structured_detail, N + """SELECT notice_id, '采购人' AS label, buyer AS value FROM notices
UNION ALL SELECT notice_id, '预算金额', cast(cast(floor(price) AS bigint) AS string) || '元' FROM notices
UNION ALL SELECT notice_id, '项目地区', coalesce(region, '原文未明确说明') FROM notices
UNION ALL SELECT notice_id, '资金来源', CASE WHEN detail_status = 'full' THEN '原文未明确说明' ELSE '详情未获取，无法提取' END FROM notices"""),
    "evidence_table": (evidence_table, N + """SELECT notice_id, 'E-purchaser-0' AS evidence_id, '采购人' AS source_label, '—' AS page,
  '采购人：' || buyer AS quote FROM notices UNION ALL
SELECT notice_id, 'E-budget-0', 'budget', '—', '预算金额：' || cast(cast(floor(price) AS bigint) AS string) || '元' FROM notices"""),
    "failed_sources": (failed_sources, _O + "SELECT task_id, source_name, source_name AS source, message AS reason FROM src WHERE status <> 'success'"),
    "data_quality": (data_quality, N + "SELECT notice_id, detail_status = 'full' AS assessable, 2 AS evidence_field_count, 0 AS reviews FROM notices"),
    "execution_history": (execution_history, """SELECT o_orderkey AS execution_id, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 <> 0 THEN 'incremental'
  ELSE 'full_snapshot' END AS report_mode, CASE WHEN o_orderkey % 7 = 0 THEN false ELSE o_orderkey % 3 <> 0 END AS deduplicate FROM orders"""),
    "report_catalogue": (report_catalogue, """SELECT o_orderkey AS execution_id, c_name AS query FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey % 2 = 0"""),
    "latest_execution": (latest_execution, """SELECT o_custkey AS task_id, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS execution_id
FROM orders GROUP BY 1"""),
    "rebuilt_funnel": (rebuilt_funnel, """WITH e AS (SELECT o_orderkey AS execution_id, o_orderkey % 90 AS raw, o_orderkey % 9 AS fin0, o_orderkey % 4 AS dup, o_orderkey % 6 AS n FROM orders),
f AS (SELECT *, CASE WHEN fin0 > 0 THEN fin0 ELSE least(8, n) END AS fin FROM e),
g AS (SELECT *, fin - CASE WHEN dup > fin THEN 0 ELSE dup END AS prim, least(n, CASE WHEN fin > 0 THEN fin ELSE n END) AS shown FROM f)
SELECT execution_id, raw AS raw_result_count, greatest(0, raw - fin) AS list_filtered_out, fin AS candidates_count, fin - prim AS cross_source_merge_count,
  prim AS primary_count, shown AS incremental_count, greatest(0, prim - shown) AS skipped_already_delivered FROM g"""),
}
