"""Report tables: what a report shows, as DataFrames keyed by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticemill import constants as C
from noticemill.functions import dates as D
from noticemill.functions import text as X
from noticemill.functions.text import text_or_empty
from noticemill.operators.extraction import shown_value
from noticemill.operators.store_merge import number_rows

OVERVIEW_FIELDS = ["region", "purchaser", "announcement_type", "deadline", "budget", "publish_time_cn", "short_title"]
DETAIL_LABELS = (
    ("project_code", "项目编号"), ("purchaser", None), ("tenderer", None), ("agency", "招标/采购代理机构"),
    ("transaction_platform", "交易平台"), ("region", "项目地区"), ("announcement_type", "公告类型"),
    ("content", "采购内容"), ("budget", "预算金额"), ("document_price", "招标文件售价"), ("funding_source", "资金来源"),
    ("publish_time_cn", "发布时间"), ("notice_end_time", "公告结束时间"), ("document_acquisition", "招标文件获取时间"),
    ("bid_deadline", "投标截止时间"), ("opening_time", "开标时间"), ("qualification", "资格要求"),
)
FUNNEL_STAGES = (
    ("raw_result_count", "原始列表结果", "各成功数据源列表页合计"), ("list_filtered_out", "列表阶段过滤排除", "关键词/区域/时间/相关性"),
    ("detail_cap_skipped", "详情上限未抓取", "超过每源详情抓取上限"), ("detail_failed", "详情抓取失败", "打开详情页异常"),
    ("detail_metadata_count", "仅列表元数据", "未验证详情，不作为公告正文"), ("detail_status_failed_count", "详情内容失败", "已保留来源记录与失败状态"),
    ("detail_human_verification_count", "待人工安全验证", "系统未绕过验证机制"), ("detail_filtered_out", "详情阶段过滤排除", "详情二次条件不匹配"),
    ("candidates_count", "进入去重候选", "待跨源去重"), ("cross_source_merge_count", "跨源合并减少", "同项目多来源合并"),
    ("primary_count", "去重后主记录", "本批唯一主记录"), ("db_merge_count", "库内已存在合并", "与历史库记录合并"),
    ("skipped_already_delivered", "历史已交付跳过", "增量：已推送且无变化"), ("incremental_count", "本次新增", "首次交付"),
    ("update_count", "本次内容更新", "已推送但内容变化"), ("report_item_count", "本报告条目", "新增 + 更新"),
)


def top_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per report; pruned to ``n`` inside every partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def priority_rank(priority: Column) -> Column:
    out = None
    for label, rank in C.PRIORITY_RANK.items():
        out = F.when(priority == label, rank) if out is None else out.when(priority == label, rank)
    return out.otherwise(0)


def top_opportunities(items: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """Best opportunities: priority, then completeness, then report order."""
    return top_rows(items, keys, [priority_rank(F.col("priority")).desc(),
                                  F.coalesce("completeness_percent", F.lit(0)).desc(), F.col("seq").asc()], n)


def preview(items: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    return top_rows(items, keys, [F.col("seq").asc()], n).select(*keys, "rank", "notice_id", "title", "priority", "deadline_urgency")


def decision_table(items: DataFrame, keys: list[str]) -> DataFrame:
    gaps = F.when(F.size("gaps") > 0, F.array_join("gaps", "；")).otherwise("无明显缺口")
    return top_rows(items, keys, [F.col("seq").asc()], 8).select(
        *keys, "rank", F.substring(text_or_empty(F.col("title")), 1, 36).alias("title"), "decision", "deadline_urgency",
        F.substring(gaps, 1, 60).alias("gaps"), F.substring(F.array_join("recommended_actions", "；"), 1, 80).alias("actions"))


def source_table(stats: DataFrame, keys: list[str]) -> DataFrame:
    return stats.select(
        *keys, X.source_display(F.col("source_name")).alias("source"),
        X.label_of(F.col("status"), C.SOURCE_STATUS_LABELS, F.col("status")).alias("status"), "raw_count", "detail_success",
        "detail_metadata_only", "final_contributed",
        F.substring(F.coalesce(X.blank_to_null(F.col("message")), F.lit("—")), 1, 40).alias("message"))


def funnel_table(counters: DataFrame, keys: list[str]) -> DataFrame:
    """The sixteen funnel stages in long form."""
    rows = [F.struct(F.lit(i).alias("stage_no"), F.lit(label).alias("stage"),
                     (F.col(c) if c in counters.columns else F.lit(0)).cast("long").alias("n"), F.lit(note).alias("note"))
            for i, (c, label, note) in enumerate(FUNNEL_STAGES, 1)]
    return counters.select(*keys, F.inline(F.array(*rows)))


def overview(items: DataFrame, keys: list[str]) -> DataFrame:
    """The project overview, one row per item, missing values as their fixed text."""
    shown = {n: F.coalesce(X.blank_to_null(F.col(n)), F.lit(C.MISSING)) for n in OVERVIEW_FIELDS}
    return number_rows(items, "seq", "item_no", keys).select(
        *keys, "item_no", "notice_id", *[c.alias(n) for n, c in shown.items()],
        F.coalesce("priority", F.lit("待核验")).alias("priority"),
        X.label_of(F.col("detail_status"), C.DETAIL_STATUS_LABELS, F.lit("状态未知")).alias("detail_label"),
        X.source_display(F.col("source_name")).alias("source"))


def structured_detail(values: DataFrame) -> DataFrame:
    """Long form (notice_id, ord, label, value) of the structured detail."""
    names = [n for n, _ in DETAIL_LABELS] + ["document_acquisition_start", "document_acquisition_end", "deadline"]
    cells = values.where(F.col("field_name").isin(*names)).groupBy("notice_id").agg(*[
        F.max(F.when(F.col("field_name") == n, F.struct(
            F.lit(1).alias("k"), "value", shown_value(F.col("value"), F.col("status")).alias("shown"), "source_label"))).alias(n)
        for n in names])

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name + ".shown"), F.lit(C.MISSING))

    lo, hi = F.col("document_acquisition_start.value"), F.col("document_acquisition_end.value")
    window = F.when(lo.isNotNull() & hi.isNotNull(), F.concat(lo, F.lit(" 至 "), hi)).otherwise(
        F.coalesce(hi, lo, F.col("document_acquisition_end.shown"), F.lit(C.MISSING)))
    rows = []
    for i, (name, label) in enumerate(DETAIL_LABELS, 1):
        value = {"document_acquisition": window, "bid_deadline": F.coalesce(
            F.col("bid_deadline.value"), F.col("deadline.value"), shown("bid_deadline"))}.get(name)
        if value is None:
            value = shown(name)
        title = F.lit(label) if label else F.coalesce(
            F.col(name + ".source_label"), F.lit("采购人/招标人" if name == "purchaser" else "招标人"))
        row = F.struct(F.lit(i).alias("ord"), title.alias("label"), value.alias("value"))
        if name == "tenderer":
            row = F.when(F.col("tenderer.value").isNotNull()
                         & ~F.col("tenderer.value").eqNullSafe(F.col("purchaser.value")), row)
        rows.append(row)
    return cells.select("notice_id", F.inline_outer(F.array_compact(F.array(*rows)))).where("ord IS NOT NULL")


def evidence_table(values: DataFrame, limit: int = 18) -> DataFrame:
    """Quotes of each notice, at most 18, in field order."""
    rows = values.where("coalesce(quote, '') <> ''")
    return top_rows(rows, ["notice_id"], [F.col("field_name").asc()], limit, "row_no").select(
        "notice_id", "row_no", F.coalesce("evidence_id", "field_name").alias("evidence_id"),
        F.coalesce("source_label", "field_name").alias("source_label"),
        F.coalesce(F.col("page").cast("string"), F.lit("—")).alias("page"), F.substring("quote", 1, 220).alias("quote"))


def related_links(urls: DataFrame, limit: int = 5) -> DataFrame:
    """Up to five further source URLs of each kept notice; the full trail stays in the long table."""
    others = urls.where(F.col("at")[0] != 0)
    return top_rows(others, ["slot_seq"], [F.col("at").asc()], limit, "link_no").select("slot_seq", "link_no", "source_url")


def cover(runs: DataFrame) -> DataFrame:
    """Key figures of a run."""
    span = F.when(F.col("start_date").isNull() & F.col("end_date").isNull(), "未指定统计周期").otherwise(F.concat(
        F.when(F.col("start_date").isNull(), "不限").otherwise(D.cn_date_of(F.col("start_date"))), F.lit(" 至 "),
        F.when(F.col("end_date").isNull(), "不限").otherwise(D.cn_date_of(F.col("end_date")))))
    succ, req = F.col("sources_succeeded"), F.coalesce(F.nullif(F.col("sources_requested"), F.lit(0)), "sources_succeeded")
    scope = F.when(F.col("report_mode") == "full_snapshot", F.when(
        F.col("truncated"), "本轮未去重快照（已达安全上限，结果截断）").otherwise("本轮原始完整快照（不去重）")).otherwise("增量交付（新增与变化）")
    return runs.select(
        "task_id", span.alias("period"), F.col("report_item_count").alias("items"),
        F.when(req > 0, F.concat(succ.cast("string"), F.lit(" / "), req.cast("string"))).otherwise(succ.cast("string")).alias("sources"),
        "incremental_count", "update_count", scope.alias("scope"),
        X.label_of(F.col("status"), C.RUN_STATUS_LABELS, F.col("status")).alias("status_label"))


def failed_sources(statuses: DataFrame, keys: list[str]) -> DataFrame:
    return statuses.where(F.col("status") != "success").select(
        *keys, "source_name", X.source_display(F.col("source_name")).alias("source"),
        F.coalesce(X.blank_to_null(F.col("message")), F.lit("未知原因")).alias("reason"))


def write_tables(tables: dict[str, DataFrame], folder: str, partition_by: tuple[str, ...] = ("task_id", "execution_id")) -> list[str]:
    """Write each report table as Parquet, partitioned by the run keys it has."""
    paths = []
    for name, table in tables.items():
        keys = [k for k in partition_by if k in table.columns]
        writer = table.write.mode("overwrite")
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{folder}/{name}")
        paths.append(f"{folder}/{name}")
    return paths
