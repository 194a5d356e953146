"""Row predicates and first-failing-reason filters for list items and details."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticemill import constants as C
from noticemill.functions.text import (any_of, blank_to_null, contains_any, matches, short_region, text_or_empty)


@dataclass(frozen=True)
class Criteria:
    """One subscription's conditions; empty lists and missing dates do not restrict."""

    keywords: Sequence[str] = field(default_factory=tuple)
    regions: Sequence[str] = field(default_factory=tuple)
    start_date: date | None = None
    end_date: date | None = None


def _words(values: Sequence[str] | Column) -> Column:
    if isinstance(values, Column):
        return F.coalesce(values, F.array().cast("array<string>"))
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def tender_like(text: Column, terms: Sequence[str] = C.TENDER_TERMS,
                noise: Sequence[str] = C.NOISE_TERMS) -> Column:
    return contains_any(text, terms) & ~contains_any(text, noise)


def keyword_match(text: Column, keywords: Sequence[str] | Column) -> Column:
    words = _words(keywords)
    hit = F.exists(words, lambda k: (k != "") & F.contains(text_or_empty(text), k))
    return (F.size(words) == 0) | F.coalesce(hit, F.lit(False))


def region_match(text: Column, regions: Sequence[str] | Column) -> Column:
    names = _words(regions)
    t = text_or_empty(text)
    hit = F.exists(names, lambda r: F.contains(t, r)
                   | ((short_region(r) != "") & F.contains(t, short_region(r))))
    return (F.size(names) == 0) | (t == "") | F.coalesce(hit, F.lit(False))


def in_date_range(day: Column, start, end) -> Column:
    """Inclusive by calendar day; a missing day passes, a missing bound is open."""
    d = day.cast("date")
    lo = start if isinstance(start, Column) else F.lit(start)
    hi = end if isinstance(end, Column) else F.lit(end)
    return d.isNull() | ((lo.isNull() | (d >= lo.cast("date"))) & (hi.isNull() | (d <= hi.cast("date"))))


def _first_failing(checks: Sequence[tuple[Column, str]]) -> Column:
    out = None
    for passed, reason in checks:
        out = F.when(~passed, reason) if out is None else out.when(~passed, reason)
    return out.otherwise(F.lit(None).cast("string"))


def list_blob() -> Column:
    return F.concat_ws(" ", blank_to_null(F.col("title")), blank_to_null(F.col("snippet")),
                       blank_to_null(F.col("region")))


def detail_blob() -> Column:
    content = F.coalesce(blank_to_null(F.col("clean_content")), blank_to_null(F.col("raw_content")))
    return F.concat_ws(" ", blank_to_null(F.col("title")), blank_to_null(F.col("region")), content)


def list_reason(crit: Criteria) -> Column:
    region = F.col("region")
    where = F.concat(region, F.lit(" "), F.col("title"))
    return _first_failing([
        (tender_like(list_blob()), C.LIST_REASONS[0]),
        (keyword_match(list_blob(), crit.keywords), C.LIST_REASONS[1]),
        ((text_or_empty(region) == "") | region_match(where, crit.regions), C.LIST_REASONS[2]),
        (in_date_range(F.col("publish_time"), crit.start_date, crit.end_date), C.LIST_REASONS[3]),
    ])


def detail_reason(crit: Criteria) -> Column:
    blob = detail_blob()
    head = F.concat(text_or_empty(F.col("title")), F.substring(blob, 1, 200))
    return _first_failing([
        (tender_like(head), C.DETAIL_REASONS[0]),
        (keyword_match(blob, crit.keywords), C.DETAIL_REASONS[1]),
        (region_match(blob, crit.regions), C.DETAIL_REASONS[2]),
        (in_date_range(F.col("publish_time"), crit.start_date, crit.end_date), C.DETAIL_REASONS[3]),
    ])


def filter_list(items: DataFrame, crit: Criteria) -> DataFrame:
    """Items with ``reason`` (NULL when accepted) and ``accepted``."""
    return items.withColumn("reason", list_reason(crit)).withColumn("accepted", F.col("reason").isNull())


def filter_details(details: DataFrame, crit: Criteria) -> DataFrame:
    return details.withColumn("reason", detail_reason(crit)).withColumn("accepted", F.col("reason").isNull())


def source_cap(mode: str) -> int:
    """The cap that spared remote detail pages, as an option: 500 in a snapshot, else 8."""
    return 500 if mode == "full_snapshot" else 8


def cap_details(kept: DataFrame, cap: int, keys: Sequence[str] = ("source_name",),
                order: str = "seq") -> DataFrame:
    """First ``cap`` kept items per source in list order.

    ``row_number() <= cap`` is pruned inside every input partition before the
    shuffle, so a source that holds most rows costs at most ``cap`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(order))
    return kept.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def cap_counts(kept: DataFrame, cap: int, mode: str = "incremental",
               keys: Sequence[str] = ("source_name",)) -> DataFrame:
    """Per source: kept, skipped beyond the cap, and the truncation flag."""
    n = F.col("kept")
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept")).select(
        *keys, n, F.greatest(n - F.lit(cap), F.lit(0)).alias("cap_skipped"),
        (F.lit(mode == "full_snapshot") & (n >= 500)).alias("truncated"))


def page_flags(html: Column) -> list[Column]:
    """Login wall, logged-in, human-verification and rate-limit flags of a page."""
    t = text_or_empty(html)
    hits = sum((F.contains(t, F.lit(m)).cast("int") for m in C.LOGIN_WALL_MARKERS[1:]),
               F.contains(t, F.lit(C.LOGIN_WALL_MARKERS[0])).cast("int"))
    head = F.substring(t, 1, 5000)
    wall = (hits >= 1) & (F.contains(head, F.lit("登录")) | F.contains(F.lower(head), F.lit("login")) | (hits >= 2))
    return [
        wall.alias("login_wall"),
        contains_any(t, C.LOGGED_IN_MARKERS).alias("logged_in"),
        matches(t, "(?i)" + any_of(C.VERIFY_MARKERS)).alias("needs_verification"),
        contains_any(t, C.RATE_LIMIT_MARKERS).alias("rate_limited"),
    ]


# --- subscription criteria ---------------------------------------------------------

def live_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status") != "deleted")


def criteria_issues(tasks: DataFrame, now: datetime) -> DataFrame:
    """One row per failed rule of a subscription, in rule order."""
    start, end = F.col("start_date"), F.col("end_date")
    on = F.coalesce(F.col("schedule_enabled"), F.lit(False))
    kind, clock = F.col("schedule_type"), F.col("execute_time")
    has_clock = text_or_empty(clock) != ""
    once = on & (F.coalesce(kind, F.lit("")) == "once") & has_clock
    hours = F.regexp_extract(clock, r"^\s*(\d{1,2})\s*:\s*(\d{1,2})\s*(?::.*)?\z", 1).try_cast("int")
    minutes = F.regexp_extract(clock, r"^\s*(\d{1,2})\s*:\s*(\d{1,2})\s*(?::.*)?\z", 2).try_cast("int")
    good = F.coalesce((hours <= 23) & (minutes <= 59), F.lit(False))
    day = F.coalesce(F.col("execute_date"), F.lit(now.date()))
    run_at = F.concat(
        F.date_format(day, "yyyy-MM-dd"), F.lit(" "), F.lpad(hours.cast("string"), 2, "0"), F.lit(":"),
        F.lpad(minutes.cast("string"), 2, "0"))
    now_text = now.strftime("%Y-%m-%d %H:%M:%S")
    crossed = start.isNotNull() & end.isNotNull() & (start > end)

    def issue(cond: Column, code: str, message, fld: str, severity: str = "error") -> Column:
        text = message if isinstance(message, Column) else F.lit(message)
        return F.when(cond, F.struct(F.lit(code).alias("code"), text.alias("message"),
                                     F.lit(fld).alias("field"), F.lit(severity).alias("severity")))

    rules = F.array(
        issue(F.coalesce(F.size("keywords"), F.lit(0)) <= 0, "missing_keywords",
              "未识别到主题/关键词。请补充，例如：服务器、充电桩。", "keywords"),
        issue(F.coalesce(F.size("regions"), F.lit(0)) <= 0, "missing_regions",
              "未识别到区域。请补充，例如：安徽省、上海市、北京市。", "regions"),
        issue(crossed, "conflicting_dates",
              F.concat(F.lit("时间范围冲突：开始日期 "), start.cast("string"), F.lit(" 晚于结束日期 "),
                       end.cast("string"), F.lit("。")), "date_range"),
        issue(start.isNull() & end.isNull(), "missing_date_range",
              "未识别到明确时间范围。请指定，例如：最近1个月、2026年3月份。", "date_range"),
        issue(start.isNull() != end.isNull(), "incomplete_date_range",
              "时间范围不完整，请同时确认开始与结束日期。", "date_range"),
        issue(on & ~has_clock, "missing_execute_time",
              "已启用定时任务但未指定执行时间，请填写如 09:00。", "schedule.execute_time"),
        issue(once & ~good, "invalid_execute_time",
              F.concat(F.lit("执行时间格式无效："), clock), "schedule.execute_time"),
        issue(once & good & (F.concat(run_at, F.lit(":00")) <= now_text), "expired_schedule",
              F.concat(F.lit("指定的执行时间 "), day.cast("string"), F.lit(" "), clock,
                       F.lit(" 已过期，不得静默创建过期任务。请选择立即执行，或改为明天/其他有效时间。")),
              "schedule"),
        issue(on & kind.isNotNull() & ~kind.isin("once", "daily", "weekly", "monthly"),
              "invalid_schedule_type", F.concat(F.lit("不支持的调度类型："), kind), "schedule.schedule_type"),
        issue(on & F.coalesce(F.col("execute_immediately"), F.lit(False)), "schedule_and_immediate",
              "同时开启了定时与立即执行：确认后将按你的选择执行；默认定时任务不会在过期时刻静默运行。",
              "execute_immediately", "warning"),
    )
    rows = F.filter(rules, lambda r: r.isNotNull())
    return tasks.select("task_id", F.posexplode_outer(rows).alias("pos", "issue")).where("issue IS NOT NULL").select(
        "task_id", (F.col("pos") + 1).alias("issue_no"), "issue.*")


def criteria_suggestions(issues: DataFrame) -> DataFrame:
    """Advice per subscription, in fixed order, from the codes of its issues (at most ten)."""
    codes = F.col("codes")

    def tip(names: Sequence[str], text: str) -> Column:
        return F.when(F.arrays_overlap(codes, F.array(*[F.lit(n) for n in names])), F.lit(text))

    tips = F.array(
        tip(["missing_keywords"], "在问题中写明采购主题，或在确认页手动填写关键词。"),
        tip(["missing_regions"], "写明省/市名称，或在确认页从区域列表选择。"),
        tip(["missing_date_range", "incomplete_date_range"], "使用「最近N个月」或「YYYY年M月份」等明确表达。"),
        tip(["expired_schedule"], "勾选「立即执行」，或把单次任务改到明天同一时间 / 每日定时。"),
        tip(["conflicting_dates"], "检查开始日期是否早于或等于结束日期。"),
    )
    return (issues.groupBy("task_id").agg(F.collect_set("code").alias("codes"))
            .select("task_id", F.posexplode_outer(F.filter(tips, lambda t: t.isNotNull())).alias("pos", "suggestion"))
            .where("suggestion IS NOT NULL")
            .select("task_id", (F.col("pos") + 1).alias("tip_no"), "suggestion"))
