"""Registered queries: decision rules, matrix, match basis, completeness, enrichment."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from noticemill import constants as C
from noticemill.operators import enrichment, extraction, rules
from noticemill.plans import views as V

TODAY = date(2000, 6, 15)


def graded(spark, sf):
    """Rule input of every notice, straight from its columns, and the assessment."""
    k = F.col("notice_id")
    day = F.date_add(F.col("order_day"), 20)
    kinds = F.element_at(F.array(F.lit("公开招标"), F.lit("中标公告"), F.lit("终止公告"), F.lit("询价"), F.lit("公开招标")),
                         (k % 5 + 1).cast("int"))
    clause = F.when(k % 4 == 0, F.array(F.lit("须具有营业执照"), F.lit("不接受联合体")))
    items = V.notices(spark, sf).select(
        "notice_id", "seq", "title", "source_name", "detail_status",
        F.when(k % 9 != 0, F.col("buyer")).alias("purchaser"), F.when(k % 4 == 0, "须具有营业执照").alias("qualification"),
        F.when(k % 7 != 0, F.date_format(day, "yyyy年M月d日")).alias("deadline"),
        F.when(k % 7 != 0, F.date_format(day, "yyyy年M月d日")).alias("bid_deadline"), kinds.alias("announcement_type"),
        F.lit(None).cast("string").alias("document_acquisition_end"), F.lit(None).cast("string").alias("opening_time"),
        F.when(k % 4 == 0, "不允许").alias("joint_venture_allowed"), F.when(k % 6 == 0, "允许").alias("agent_allowed"),
        F.when(k % 8 == 0, "需要").alias("platform_registration_required"), F.when(k % 10 == 0, "需要").alias("ca_required"),
        clause.alias("clauses"))
    return rules.assess(items, TODAY)


def deadline_urgency(spark, sf):
    return graded(spark, sf).select("notice_id", "deadline_urgency", "deadline_note")


def priority(spark, sf):
    return graded(spark, sf).select("notice_id", "priority", "priority_reason")


def decision(spark, sf):
    return graded(spark, sf).select("notice_id", "decision", "qualification_readiness")


def information_gaps(spark, sf):
    return graded(spark, sf).select("notice_id", F.array_join("gaps", "；").alias("gaps"))


def recommended_actions(spark, sf):
    return graded(spark, sf).select("notice_id", F.array_join("recommended_actions", "；").alias("actions"))


def risks_materials(spark, sf):
    return graded(spark, sf).select("notice_id", F.array_join("technical_business_risks", "；").alias("risks"),
                                    F.array_join("missing_materials", "；").alias("materials"))


def portfolio(spark, sf):
    return rules.portfolio(graded(spark, sf), ["source_name"])


def priority_counts(spark, sf):
    return rules.priority_counts(graded(spark, sf))


def _profile(spark, sf):
    """Latest company profile: the customer with the highest key, known for ISO work."""
    rows = V.load(spark, sf, "customer").select(
        F.array(F.lit("ISO"), F.col("c_mktsegment")).alias("qualifications"),
        F.array("c_name").alias("cases"), F.lit("").alias("extra"), F.col("c_custkey").alias("updated_at"))
    from noticemill.operators.listing import latest
    return latest(rows, "updated_at")


def qualification_matrix(spark, sf):
    clauses = extraction.clause_rows(extraction.extract_wide(V.notices(spark, sf)))
    return rules.qualification_matrix(clauses, _profile(spark, sf)).select("notice_id", "clause_id", "status", "profile_basis")


def milestone_timeline(spark, sf):
    values = extraction.field_values(extraction.extract_wide(_dated(spark, sf)), fields=["bid_deadline", "opening_time"])
    return rules.milestones(values).select("notice_id", "milestone", "time", "evidence_id")


def _dated(spark, sf):
    day = F.col("order_day") + F.expr("interval 12 year")
    return V.notices(spark, sf).withColumn("clean_content", F.concat(
        F.lit("投标截止时间："), F.date_format(day, "yyyy-MM-dd"),
        F.when(F.col("notice_id") % 2 == 0, F.concat(F.lit("\n开标时间："), F.date_format(day, "yyyy-MM-dd"))).otherwise("")))


def evidence_ids(spark, sf):
    values = extraction.field_values(extraction.extract_wide(V.notices(spark, sf)), fields=list(rules.EVIDENCE_KEYS))
    return rules.evidence_keys(values).select("notice_id", F.array_join("evidence_fields", ",").alias("fields"),
                                              F.array_join("evidence_ids", ",").alias("ids"))


def project_analysis(spark, sf):
    """Texts to decisions in one go: extraction, clauses, matrix, rules."""
    notices = V.notices(spark, sf)
    wide = extraction.extract_wide(notices)
    values = extraction.field_values(wide, fields=list(dict.fromkeys([*rules.RULE_FIELDS, *rules.EVIDENCE_KEYS])))
    out = rules.project_analysis(values, extraction.clause_rows(wide), notices, date(1998, 1, 1), _profile(spark, sf))
    return out.select("notice_id", "priority", "decision", F.array_join("evidence_ids", ",").alias("ids"))


def note_validation(spark, sf):
    """Outside notes per notice, some with foreign evidence or forbidden words."""
    k = F.col("notice_id")
    analyses = graded(spark, sf).select("notice_id", F.array(F.lit("deadline")).alias("evidence_fields"),
                                        F.array(F.lit("E-deadline-0")).alias("evidence_ids"))
    none = F.lit(None).cast("array<string>")
    notes = V.notices(spark, sf).select(
        "notice_id", F.when(k % 4 == 0, "预算充足").when(k % 4 == 1, F.repeat(F.lit("长"), 181)).otherwise("时间可行").alias("analysis"),
        F.when(k % 3 == 0, F.array(F.lit("deadline"))).otherwise(none).alias("evidence_fields"),
        F.when(k % 3 == 1, F.array(F.lit("E-deadline-0"))).when(k % 3 == 2, F.array(F.lit("E-budget-0"))).alias("evidence_ids"))
    return rules.validated_notes(notes, analyses)


def completeness(spark, sf):
    k = F.col("notice_id")
    cols = {n: F.when(k % (i + 2) != 0, F.lit("x")) for i, n in enumerate(C.CORE_FIELDS)}
    rows = V.notices(spark, sf).withColumns(cols)
    pct, level = enrichment.completeness(F.size("attachment_links") > 0, F.col("detail_status"))
    return rows.select("notice_id", pct.alias("percent"), level.alias("level"))


def attachment_states(spark, sf):
    k = F.col("notice_id")
    status, label = enrichment.attachment_status(F.col("attachment_links"), k % 4 != 1, k % 7 == 0, k % 5 == 0)
    return V.notices(spark, sf).select("notice_id", status.alias("state"), label.alias("label"))


def match_basis(spark, sf):
    """Why each matched notice fits its subscription."""
    from noticemill.operators.matching import match_subscriptions
    from noticemill.session import broadcast_if_small

    tasks = V.subscriptions(spark, sf)
    pairs = match_subscriptions(V.notices(spark, sf), tasks)
    rows = pairs.join(broadcast_if_small(tasks), "task_id")
    return enrichment.match_basis(rows).select("task_id", "notice_id", "keyword_basis", "region_basis", "time_basis")


def foreign_regions(spark, sf):
    k = F.col("notice_id")
    title = F.concat(F.element_at(F.array(F.lit("广东省"), F.lit("安徽省"), F.lit("")), (k % 3 + 1).cast("int")), F.col("title"))
    region = F.when(k % 2 == 0, "安徽省合肥市")
    basis = enrichment.region_basis(title, region, F.lit(""), F.array(F.lit("安徽省")))
    return V.view(spark, sf, "notices").select("notice_id", basis.alias("basis"))


N = V.cte("notices")
_CN = "cast(year(d) AS string) || '年' || cast(month(d) AS string) || '月' || cast(day(d) AS string) || '日'"
_G = f"""{N}, g0 AS (SELECT notice_id, seq, source_name, title, buyer, detail_status, detail_status = 'full' AS ok,
  CASE WHEN notice_id % 7 <> 0 AND year(order_day + interval 20 day) >= 2000 THEN cast(order_day + interval 20 day AS date) END AS d,
  notice_id % 7 = 0 AS no_deadline,
  ['公开招标', '中标公告', '终止公告', '询价', '公开招标'][notice_id % 5 + 1] AS kind, notice_id % 4 = 0 AS cl,
  notice_id % 9 = 0 AS no_buyer FROM notices),
g1 AS (SELECT *, date_diff('day', DATE '2000-06-15', d) AS n FROM g0),
g2 AS (SELECT *, CASE WHEN d IS NULL THEN '未知' WHEN n < 0 THEN '已过期' WHEN n <= 3 THEN '紧急' WHEN n <= 7 THEN '一周内'
  WHEN n <= 14 THEN '两周内' ELSE '时间相对充足' END AS urg FROM g1),
g AS (SELECT *, CASE WHEN kind = '中标公告' THEN 1 WHEN urg = '已过期' THEN 2 WHEN NOT ok THEN 3 WHEN urg IN ('紧急', '一周内') THEN 4
  WHEN cl THEN 5 ELSE 6 END AS c FROM g2)"""
_PRI = "CASE WHEN c <= 2 THEN '低' WHEN c = 4 THEN '高' WHEN c = 5 THEN '中' ELSE '待核验' END"

from noticemill.plans.filter_queries import _MATCH as _MATCH_SQL  # noqa: E402

ENTRIES = {
    "deadline_urgency": (deadline_urgency, _G + """SELECT notice_id, urg AS deadline_urgency, CASE urg
  WHEN '未知' THEN '公告原文未提取到可解析的投标/报名截止日期。'
  WHEN '已过期' THEN '原文截止日期为 ' || cast(d AS string) || '，需先核对是否仍有效。'
  WHEN '紧急' THEN '距原文截止日期约 ' || cast(n AS string) || ' 天，应优先核验并决定是否立项。'
  WHEN '一周内' THEN '距原文截止日期约 ' || cast(n AS string) || ' 天，建议本周完成资格与资源评估。'
  WHEN '两周内' THEN '距原文截止日期约 ' || cast(n AS string) || ' 天，可同步准备资格和方案材料。'
  ELSE '距原文截止日期约 ' || cast(n AS string) || ' 天，仍应以公告原文及后续澄清为准。' END AS deadline_note FROM g"""),
    "priority": (priority, _G + f"""SELECT notice_id, {_PRI} AS priority, CASE c WHEN 1 THEN '公告类型显示为结果/废标类，通常不作为新的投标机会'
  WHEN 2 THEN '已提取到可能过期的截止日期，需先人工核验' WHEN 3 THEN '未获得可验证详情，不能据此判断资格与可投性'
  WHEN 4 THEN '时间窗口较短，适合优先做 Go/No-Go 核验' WHEN 5 THEN '已提取资格要求，可发起资质符合性初审'
  ELSE '详情存在但资格要求未提取完整' END AS priority_reason FROM g"""),
    "decision": (decision, _G + """SELECT notice_id, CASE WHEN NOT ok THEN '信息不足' WHEN kind IN ('中标公告', '终止公告') OR urg = '已过期'
  THEN '不建议参与' WHEN NOT cl OR no_deadline THEN '信息不足' ELSE '有条件参与' END AS decision,
  CASE WHEN cl THEN '已提取待比对' ELSE '待补充' END AS qualification_readiness FROM g"""),
    "information_gaps": (information_gaps, _G + """SELECT notice_id, concat_ws('；', CASE WHEN NOT ok THEN '尚未获得可验证的公告详情，仅有列表元数据' END,
  CASE WHEN no_buyer THEN '招标人/采购人原文未提取' END, CASE WHEN NOT cl THEN '资格要求原文未提取' END,
  CASE WHEN no_deadline THEN '投标或报名截止时间原文未提取' END) AS gaps FROM g"""),
    "recommended_actions": (recommended_actions, _G + """SELECT notice_id, concat_ws('；', CASE WHEN NOT ok THEN '打开官方详情页，补充并核验公告正文' END,
  CASE WHEN cl THEN '将资格条款与本企业资质、业绩、人员和联合体条件逐项比对' ELSE '定位原文资格章节后再进行资质符合性判断' END,
  CASE WHEN urg IN ('紧急', '一周内', '两周内') THEN '核对公告的投标截止、文件获取及澄清时间，形成倒排计划'
    WHEN urg = '已过期' THEN '确认是否存在延期、更正或重新招标公告' END,
  CASE WHEN NOT no_buyer THEN '结合招标人/采购人和项目内容确认客户覆盖与项目匹配度' END) AS actions FROM g"""),
    "risks_materials": (risks_materials, _G + """SELECT notice_id, concat_ws('；', CASE WHEN notice_id % 4 = 0 THEN '不接受联合体，需确认能否独立满足全部资格与交付要求。' END,
  CASE WHEN notice_id % 6 = 0 THEN '允许代理商参与，仍需核对原厂授权、售后和供货责任。' END,
  CASE WHEN notice_id % 8 = 0 THEN '需提前完成交易平台注册。' END,
  CASE WHEN notice_id % 10 = 0 THEN '需预留 CA 数字证书办理和电子签章时间。' END) AS risks,
  concat_ws('；', CASE WHEN notice_id % 4 = 0 THEN '营业执照/法人资格证明' END,
  CASE WHEN notice_id % 6 = 0 THEN '原厂授权与售后服务承诺（如适用）' END, CASE WHEN notice_id % 10 = 0 THEN 'CA 数字证书/电子签章' END) AS materials FROM g"""),
    "portfolio": (portfolio, _G + f""", p AS (SELECT source_name, ok, {_PRI} AS pr FROM g),
s AS (SELECT source_name, count(*) AS n, count(*) FILTER (pr = '高') AS a, count(*) FILTER (pr = '中') AS b,
  count(*) FILTER (pr = '待核验') AS c, count(*) FILTER (pr = '低') AS d, count(*) FILTER (NOT ok) AS e FROM p GROUP BY 1)
SELECT source_name, concat_ws('，', '共 ' || n || ' 个项目', CASE WHEN a > 0 THEN '高优先级 ' || a || ' 个' END,
  CASE WHEN b > 0 THEN '中优先级 ' || b || ' 个' END, CASE WHEN c > 0 THEN '待核验优先级 ' || c || ' 个' END,
  CASE WHEN d > 0 THEN '低优先级 ' || d || ' 个' END, CASE WHEN e > 0 THEN '其中 ' || e || ' 个仍需补齐官方详情' END) || '。' AS portfolio_summary FROM s"""),
    "priority_counts": (priority_counts, _G + f"SELECT {_PRI} AS priority, count(*) AS n FROM g GROUP BY 1"),
    "qualification_matrix": (qualification_matrix, f"""{N} SELECT notice_id, 'Q' || cast(n AS string) AS clause_id,
  CASE WHEN n = 1 AND notice_id % 4 = 0 THEN '可匹配，待核验有效期' ELSE '待核验' END AS status,
  CASE WHEN n = 1 AND notice_id % 4 = 0 THEN '企业画像命中：ISO' ELSE '企业画像未找到可直接证明该条款的材料。' END AS profile_basis
FROM notices, (VALUES (1), (2)) t(n) WHERE detail_status = 'full' AND notice_id % 2 = 0"""),
    "milestone_timeline": (milestone_timeline, f"""{N}, x AS (SELECT notice_id, order_day + interval 12 year AS d FROM notices)
SELECT notice_id, '完成投标文件递交' AS milestone, {_CN} AS time, 'E-bid_deadline-0' AS evidence_id FROM x UNION ALL
SELECT notice_id, '准备开标', {_CN}, 'E-opening_time-0' FROM x WHERE notice_id % 2 = 0"""),
    "evidence_ids": (evidence_ids, f"""{N}, e AS (SELECT notice_id, notice_id % 2 = 0 AS q, order_day + interval 20 day >= DATE '2000-01-01' AS dl FROM notices)
SELECT notice_id, concat_ws(',', 'purchaser', CASE WHEN q THEN 'qualification' END, CASE WHEN dl THEN 'deadline' END) AS fields,
  concat_ws(',', 'E-purchaser-0', CASE WHEN q THEN 'E-qualification-0' END, CASE WHEN dl THEN 'E-deadline-0' END) AS ids FROM e"""),
    "project_analysis": (project_analysis, f"""{N}, e AS (SELECT notice_id, detail_status = 'full' AS ok, notice_id % 2 = 0 AS q,
  cast(order_day + interval 20 day AS date) AS d FROM notices), u AS (SELECT *, d >= DATE '2000-01-01' AS parsed FROM e)
SELECT notice_id, CASE WHEN NOT ok THEN '待核验' WHEN q THEN '中' ELSE '待核验' END AS priority,
  CASE WHEN NOT ok OR NOT q OR NOT parsed THEN '信息不足' ELSE '有条件参与' END AS decision,
  concat_ws(',', 'E-purchaser-0', CASE WHEN q THEN 'E-qualification-0' END, CASE WHEN parsed THEN 'E-deadline-0' END) AS ids FROM u"""),
    "note_validation": (note_validation, f"{N} SELECT notice_id, '时间可行' AS analysis FROM notices WHERE notice_id % 4 >= 2 AND notice_id % 3 < 2"),
    "completeness": (completeness, f"""{N}, f AS (SELECT notice_id, detail_status, notice_id % 6 = 0 AS att,
  (SELECT count(*) FROM (VALUES (2), (3), (4), (5), (6), (7), (8)) t(m) WHERE notice_id % m <> 0) AS n FROM notices),
p AS (SELECT notice_id, CASE WHEN detail_status = 'full' THEN cast(round_even(CASE WHEN att THEN (n + 0.5) / 7.5 ELSE n / 7.0 END * 100, 0) AS int) END AS percent FROM f)
SELECT notice_id, percent, CASE WHEN percent IS NULL THEN '不可评估' WHEN percent >= 80 THEN '较完整' WHEN percent >= 50 THEN '部分完整'
  ELSE '信息偏少' END AS level FROM p"""),
    "attachment_states": (attachment_states, f"""{N}, s AS (SELECT notice_id, CASE WHEN notice_id % 7 = 0 THEN 'extract_failed'
  WHEN notice_id % 4 = 1 THEN 'detail_missing' WHEN notice_id % 6 = 0 THEN 'found' WHEN notice_id % 5 = 0 THEN 'login_required'
  ELSE 'none_public' END AS state FROM notices)
SELECT notice_id, state, CASE state WHEN 'extract_failed' THEN '提取失败' WHEN 'detail_missing' THEN '详情未获取' WHEN 'found' THEN '发现 1 个公开附件'
  WHEN 'login_required' THEN '登录后可见' ELSE '未发现公开附件' END AS label FROM s"""),
    "match_basis": (match_basis, V.cte("notices", "tasks") + _MATCH_SQL + f""", j AS (SELECT m.task_id, n.*, t.keyword, t.region_key, t.start_date, t.end_date FROM m JOIN notices n USING (notice_id) JOIN tasks t USING (task_id))
SELECT task_id, notice_id, '「' || keyword || '」出现于标题' AS keyword_basis,
  CASE WHEN region IS NOT NULL THEN (SELECT string_agg('「' || x.n_name || '」见于地区字段', '；' ORDER BY x.n_name) FROM nation x
      WHERE x.n_regionkey = j.region_key AND contains(j.region, x.n_name))
    ELSE '标题/正文/地区字段未检出查询区域词；若仍入选，可能因列表阶段区域字段缺失，请人工复核' END AS region_basis,
  CASE WHEN start_date IS NULL AND end_date IS NULL THEN '查询未指定统计周期'
    WHEN publish_time IS NULL THEN '原文未提供可解析的发布时间，时间条件无法严格核验'
    ELSE concat_ws('；', '发布日期 ' || {_CN.replace('(d)', '(publish_time)')}, '不早于 ' || {_CN.replace('(d)', '(start_date)')},
      '不晚于 ' || {_CN.replace('(d)', '(end_date)')}) END AS time_basis FROM j"""),
    "foreign_regions": (foreign_regions, f"""{N}, b AS (SELECT notice_id, notice_id % 3 AS t, notice_id % 2 = 0 AS r FROM notices)
SELECT notice_id, CASE WHEN t = 1 OR r THEN '「安徽省」见于' || concat_ws('/', CASE WHEN t = 1 THEN '标题' END, CASE WHEN r THEN '地区字段' END)
    || CASE WHEN t = 0 THEN '。注意：标题另含地区词「广东」，请结合正文核对是否属查询区域' ELSE '' END
  ELSE '标题/正文/地区字段未检出查询区域词；若仍入选，可能因列表阶段区域字段缺失，请人工复核'
    || CASE WHEN t = 0 THEN '。标题出现其他地区：广东' ELSE '' END END AS basis FROM b"""),
}
