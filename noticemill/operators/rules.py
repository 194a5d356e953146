"""Decision rules: urgency, gaps, priority, actions, decision, qualification matrix."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill import constants as C
from noticemill.functions import dates as D
from noticemill.functions.text import matches, strip, text_or_empty


def _missing(c: Column) -> Column:
    return text_or_empty(c).isin("", C.MISSING, C.NOT_EXTRACTED, C.DETAIL_UNAVAILABLE)


def _listed(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def _say(cond: Column, text: str) -> Column:
    return F.when(cond, F.lit(text))


def pivot_fields(values: DataFrame, names: list[str]) -> DataFrame:
    """One row per notice with the named fields as columns (one aggregate, fixed columns)."""
    return values.where(F.col("field_name").isin(*names)).groupBy("notice_id").agg(
        *[F.max(F.when(F.col("field_name") == n, F.col("value"))).alias(n) for n in names])


def urgency(deadline: Column, today: date) -> tuple[Column, Column]:
    """(state, note) of a deadline text relative to ``today``."""
    day = D.lenient_date(deadline)
    days = F.datediff(day, F.lit(today))
    left = days.cast("string")
    state = (F.when(day.isNull(), "未知").when(days < 0, "已过期").when(days <= 3, "紧急").when(days <= 7, "一周内")
             .when(days <= 14, "两周内").otherwise("时间相对充足"))

    def note(before: str, value: Column, after: str) -> Column:
        return F.concat(F.lit(before), value, F.lit(after))

    text = (
        F.when(day.isNull(), "公告原文未提取到可解析的投标/报名截止日期。")
        .when(days < 0, note("原文截止日期为 ", day.cast("string"), "，需先核对是否仍有效。"))
        .when(days <= 3, note("距原文截止日期约 ", left, " 天，应优先核验并决定是否立项。"))
        .when(days <= 7, note("距原文截止日期约 ", left, " 天，建议本周完成资格与资源评估。"))
        .when(days <= 14, note("距原文截止日期约 ", left, " 天，可同步准备资格和方案材料。"))
        .otherwise(note("距原文截止日期约 ", left, " 天，仍应以公告原文及后续澄清为准。")))
    return state, text


def risks() -> Column:
    return _listed(
        _say(F.col("joint_venture_allowed") == "不允许", "不接受联合体，需确认能否独立满足全部资格与交付要求。"),
        _say(F.col("agent_allowed") == "允许", "允许代理商参与，仍需核对原厂授权、售后和供货责任。"),
        _say(F.col("platform_registration_required") == "需要", "需提前完成交易平台注册。"),
        _say(F.col("ca_required") == "需要", "需预留 CA 数字证书办理和电子签章时间。"))


def materials() -> Column:
    text = F.array_join("clauses", "\n")
    return F.array_distinct(_listed(
        _say(matches(text, "营业执照|法人"), "营业执照/法人资格证明"),
        _say(matches(text, "业绩|合同"), "同类项目合同及验收/业绩证明"),
        _say(matches(text, "信用|失信"), "信用查询及无失信证明"),
        _say(F.col("agent_allowed") == "允许", "原厂授权与售后服务承诺（如适用）"),
        _say(F.col("ca_required") == "需要", "CA 数字证书/电子签章")))


RULE_FIELDS = ["purchaser", "qualification", "deadline", "bid_deadline", "announcement_type", "document_acquisition_end",
               "opening_time", "joint_venture_allowed", "agent_allowed", "platform_registration_required", "ca_required"]
EVIDENCE_KEYS = ("purchaser", "qualification", "deadline", "project_code")


def evidence_keys(values: DataFrame) -> DataFrame:
    """Per notice the key fields with evidence and their ids, in fixed order (at most four)."""
    order = F.array_position(F.array(*[F.lit(k) for k in EVIDENCE_KEYS]), F.col("field_name"))
    rows = values.where(F.col("field_name").isin(*EVIDENCE_KEYS) & F.col("evidence_id").isNotNull())
    packed = rows.groupBy("notice_id").agg(F.array_sort(F.collect_list(
        F.struct(order.alias("o"), "field_name", "evidence_id"))).alias("e"))
    return packed.select("notice_id", F.transform("e", lambda x: x["field_name"]).alias("evidence_fields"),
                         F.transform("e", lambda x: x["evidence_id"]).alias("evidence_ids"))


def milestones(values: DataFrame) -> DataFrame:
    """Long timeline (notice_id, step, milestone, time, evidence_id)."""
    steps = F.expr("CASE field_name WHEN 'document_acquisition_end' THEN 1 WHEN 'bid_deadline' THEN 2 "
                   "WHEN 'opening_time' THEN 3 END")
    names = F.element_at(F.array(F.lit("完成招标文件获取"), F.lit("完成投标文件递交"), F.lit("准备开标")), F.col("step"))
    return values.withColumn("step", steps).where("step IS NOT NULL").where(~_missing(F.col("value"))).select(
        "notice_id", "step", names.alias("milestone"), F.col("value").alias("time"), "evidence_id")


def assess(items: DataFrame, today: date, profile_known: bool = False, unresolved: DataFrame | None = None) -> DataFrame:
    """Rule columns for rows holding notice_id, detail_status, clauses and ``RULE_FIELDS``.

    ``unresolved`` (notice_id) lists notices with an unproven clause of the matrix.
    """
    state, note = urgency(F.col("deadline"), today)
    df = items.withColumns({
        "deadline_urgency": state, "deadline_note": note,
        "has_clauses": F.size(F.coalesce("clauses", F.array().cast("array<string>"))) > 0})
    full = F.coalesce(F.col("detail_status") == "full", F.lit(False))
    kind, urgent = text_or_empty(F.col("announcement_type")), F.col("deadline_urgency")
    clauses = F.col("has_clauses")
    cases = (
        (kind.isin(*C.RESULT_TYPES), "低", "公告类型显示为结果/废标类，通常不作为新的投标机会"),
        (urgent == "已过期", "低", "已提取到可能过期的截止日期，需先人工核验"),
        (~full, "待核验", "未获得可验证详情，不能据此判断资格与可投性"),
        (urgent.isin("紧急", "一周内"), "高", "时间窗口较短，适合优先做 Go/No-Go 核验"),
        (clauses, "中", "已提取资格要求，可发起资质符合性初审"),
        (F.lit(True), "待核验", "详情存在但资格要求未提取完整"),
    )
    graded = F.coalesce(*[F.when(cond, F.struct(F.lit(p).alias("p"), F.lit(r).alias("r"))) for cond, p, r in cases])
    gaps = _listed(
        _say(~full, "尚未获得可验证的公告详情，仅有列表元数据"),
        _say(_missing(F.col("purchaser")), "招标人/采购人原文未提取"),
        _say(~clauses & _missing(F.col("qualification")), "资格要求原文未提取"),
        _say(_missing(F.col("deadline")), "投标或报名截止时间原文未提取"))
    actions = _listed(
        _say(~full, "打开官方详情页，补充并核验公告正文"),
        F.when(clauses, "将资格条款与本企业资质、业绩、人员和联合体条件逐项比对").otherwise("定位原文资格章节后再进行资质符合性判断"),
        F.when(urgent.isin("紧急", "一周内", "两周内"), "核对公告的投标截止、文件获取及澄清时间，形成倒排计划")
        .when(urgent == "已过期", "确认是否存在延期、更正或重新招标公告"),
        _say(~_missing(F.col("purchaser")), "结合招标人/采购人和项目内容确认客户覆盖与项目匹配度"))
    if profile_known and unresolved is not None:
        flags = unresolved.select("notice_id").distinct().withColumn("_open", F.lit(True))
        df = df.join(flags, "notice_id", "left")
        settled = F.when(F.col("_open"), "有条件参与").otherwise("建议参与")
    else:
        settled = F.lit("有条件参与")
    decision = (F.when(~full, "信息不足").when(kind.isin(*C.CLOSED_TYPES), "不建议参与").when(urgent == "已过期", "不建议参与")
                .when(~clauses | _missing(F.col("bid_deadline")), "信息不足").otherwise(settled))
    out = df.withColumn("_graded", graded).withColumns({
        "priority": F.col("_graded.p"), "priority_reason": F.col("_graded.r"), "gaps": gaps,
        "recommended_actions": F.slice(actions, 1, 4), "decision": decision,
        "qualification_readiness": F.when(clauses, "已提取待比对").otherwise("待补充"),
        "technical_business_risks": risks(), "missing_materials": materials()})
    return out.drop("_graded", "_open", "has_clauses")


def project_analysis(values: DataFrame, clauses: DataFrame, notices: DataFrame, today: date,
                     profile: DataFrame | None = None) -> DataFrame:
    """The full analysis row of every notice: rules, evidence ids, decision."""
    listed = clauses.groupBy("notice_id").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("clause_no", "clause"))), lambda c: c["clause"]).alias("clauses"))
    items = notices.select("notice_id", "title", "detail_status").join(
        pivot_fields(values, RULE_FIELDS), "notice_id", "left").join(listed, "notice_id", "left")
    open_rows = None
    if profile is not None:
        open_rows = qualification_matrix(clauses, profile).where("status = '待核验'")
    graded = assess(items, today, profile is not None, open_rows)
    return graded.join(evidence_keys(values), "notice_id", "left")


def profile_text(profile: DataFrame) -> DataFrame:
    """All texts of the profile row, one per line (one row)."""
    parts = []
    for f in profile.schema.fields:
        if f.name == "updated_at":
            continue
        is_list = f.dataType.typeName() == "array"
        parts.append(F.array_join(f.name, "\n") if is_list else F.col(f.name).cast("string"))
    return profile.select(F.concat_ws("\n", *parts).alias("profile_text"))


def qualification_matrix(clauses: DataFrame, profile: DataFrame | None) -> DataFrame:
    """Each clause with status and basis; the text of the latest profile is a constant."""
    base = clauses.select("notice_id", F.concat(F.lit("Q"), F.col("clause_no").cast("string")).alias("clause_id"),
                          F.col("clause").alias("requirement"))
    if profile is None:
        return base.withColumns({"status": F.lit("待企业画像"),
                                 "profile_basis": F.lit("未配置企业画像，仅保留公告条款供人工核对。")})
    tokens = F.filter(F.regexp_extract_all("requirement", F.lit(C.TOKEN_PATTERN), F.lit(0)),
                      lambda t: ~t.isin(*C.TOKEN_STOPWORDS))
    known = F.lit(profile_text(profile).first()[0])  # one row: the latest profile
    joined = base.withColumn("hits", F.filter(tokens, lambda t: F.contains(known, t)))
    hit = F.size("hits") > 0
    return joined.select(
        "notice_id", "clause_id", "requirement",
        F.when(hit, "可匹配，待核验有效期").otherwise("待核验").alias("status"),
        F.when(hit, F.concat(F.lit("企业画像命中："), F.array_join(F.slice("hits", 1, 5), "、")))
        .otherwise("企业画像未找到可直接证明该条款的材料。").alias("profile_basis"))


def validated_notes(notes: DataFrame, analyses: DataFrame) -> DataFrame:
    """Outside notes (notice_id, analysis, evidence_fields, evidence_ids) that are fully backed."""
    known = analyses.select(
        "notice_id", F.coalesce("evidence_fields", F.array().cast("array<string>")).alias("_fields"),
        F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("_ids"))
    text = strip(text_or_empty(F.col("analysis")))
    empty = F.array().cast("array<string>")
    ids, names = F.coalesce("evidence_ids", empty), F.coalesce("evidence_fields", empty)
    by_id = (F.size("_ids") > 0) & (F.size(F.array_except(ids, F.col("_ids"))) == 0)
    by_name = (F.size(names) > 0) & (F.size(F.array_except(names, F.col("_fields"))) == 0)
    backed = F.when(F.size(ids) > 0, by_id).otherwise(by_name)
    return notes.join(known, "notice_id").where(
        (text != "") & (F.length(text) <= 180) & backed & ~matches(text, C.NOTE_FORBIDDEN)
    ).select("notice_id", text.alias("analysis"))


def portfolio(analyses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Summary sentence of a set of analyses: counts by priority, and missing details."""
    counts = [F.count_if(F.col("priority") == p).alias(f"n{i}") for i, p in enumerate(C.PRIORITY_ORDER)]
    lacking = F.count_if(F.exists("gaps", lambda g: F.contains(g, F.lit("尚未获得可验证"))))
    agg = analyses.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("total"), *counts, lacking.alias("lacking"))

    def part(n: Column, before: str, after: str) -> Column:
        return F.when(n > 0, F.concat(F.lit(before), n.cast("string"), F.lit(after)))

    text = F.concat(F.concat_ws(
        "，", F.concat(F.lit("共 "), F.col("total").cast("string"), F.lit(" 个项目")),
        *[part(F.col(f"n{i}"), f"{p}优先级 ", " 个") for i, p in enumerate(C.PRIORITY_ORDER)],
        part(F.col("lacking"), "其中 ", " 个仍需补齐官方详情")), F.lit("。"))
    return agg.select(*(keys or []), F.when(F.col("total") == 0, "本轮没有形成可报告的公告条目。").otherwise(text)
                      .alias("portfolio_summary"))


def priority_counts(analyses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return analyses.groupBy(*(keys or []), F.coalesce("priority", F.lit("待核验")).alias("priority")).agg(
        F.count(F.lit(1)).alias("n"))
