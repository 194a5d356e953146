"""Match basis, completeness, attachment status and the enriched report row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill import constants as C
from noticemill.functions import dates as D
from noticemill.functions import text as X
from noticemill.functions.text import blank_to_null, text_or_empty

_EMPTY = "array<string>"


def completeness(has_attachments: Column, detail_status: Column) -> tuple[Column, Column]:
    """(percent, level) over the seven core fields held as columns; half to even."""
    filled = None
    for name in C.CORE_FIELDS:
        v = text_or_empty(F.col(name))
        one = F.when(v.isin("", C.MISSING, C.NOT_EXTRACTED, C.EXTRACTION_FAILED, "—", "-"), 0.0).otherwise(1.0)
        filled = one if filled is None else filled + one
    n = float(len(C.CORE_FIELDS))
    ratio = F.when(has_attachments, (filled + 0.5) / (n + 0.5)).otherwise(filled / n)
    pct = F.when(detail_status == "full", F.bround(ratio * 100, 0).cast("int"))
    level = F.when(pct.isNull(), "不可评估").when(pct >= 80, "较完整").when(pct >= 50, "部分完整").otherwise("信息偏少")
    return pct, level


def completeness_label(percent: Column, level: Column) -> Column:
    return F.when(percent.isNull(), "不可评估（详情正文未获取）").otherwise(
        F.concat(percent.cast("string"), F.lit("%（"), level, F.lit("）")))


def attachment_status(links: Column, fetched: Column, failed: Column, login: Column) -> tuple[Column, Column]:
    """(status, label) of a notice's attachments."""
    n = F.size(F.filter(F.coalesce(links, F.array().cast(_EMPTY)), lambda u: text_or_empty(u) != ""))
    status = (F.when(F.coalesce(failed, F.lit(False)), "extract_failed").when(~F.coalesce(fetched, F.lit(True)), "detail_missing")
              .when(n > 0, "found").when(F.coalesce(login, F.lit(False)), "login_required").otherwise("none_public"))
    label = (F.when(status == "extract_failed", "提取失败").when(status == "detail_missing", "详情未获取")
             .when(status == "found", F.concat(F.lit("发现 "), n.cast("string"), F.lit(" 个公开附件")))
             .when(status == "login_required", "登录后可见").otherwise("未发现公开附件"))
    return status, label


def attachment_note(status: Column) -> Column:
    return X.label_of(status, {
        "extract_failed": "详情页附件链接解析失败，非确认无附件",
        "detail_missing": "未成功打开详情页，附件情况未知",
        "login_required": "公开页未提供附件链接，完整附件可能需登录后查看",
        "none_public": "详情页已获取，但未解析到可公开访问的附件链接"}, F.lit(""))


def _places(word_in, title: Column, region: Column, content: Column) -> Column:
    where = F.array_compact(F.array(
        F.when(word_in(title), "标题"), F.when(word_in(region), "地区字段"), F.when(word_in(content), "正文")))
    return F.coalesce(blank_to_null(F.array_join(where, "/")), F.lit("文本"))


def _blob(title: Column, region: Column, content: Column) -> Column:
    """All that a word may stand in, the whole content included."""
    return F.concat_ws(" ", blank_to_null(title), blank_to_null(region), blank_to_null(content))


def keyword_basis(title: Column, region: Column, content: Column, keywords: Column) -> Column:
    t, g, c = text_or_empty(title), text_or_empty(region), text_or_empty(content)
    words = F.coalesce(keywords, F.array().cast(_EMPTY))

    def told(hits: Column) -> Column:
        each = F.transform(hits, lambda k: F.concat(F.lit("「"), k, F.lit("」出现于"), _places(lambda s: F.contains(s, k), t, g, c)))
        return F.when(F.size(hits) > 0, F.array_join(each, "；")).otherwise("正文/标题未直接命中查询关键词（可能由列表摘要阶段入选）")

    found = X.let(_blob(t, g, c), lambda blob: X.let(F.filter(words, lambda k: (k != "") & F.contains(blob, k)), told))
    return F.when(F.size(words) == 0, "查询未指定关键词，未做关键词过滤").otherwise(found)


def region_basis(title: Column, region: Column, content: Column, regions: Column) -> Column:
    t, g, c = text_or_empty(title), text_or_empty(region), text_or_empty(content)
    names = F.coalesce(regions, F.array().cast(_EMPTY))

    def seen(r: Column):
        return lambda s: F.contains(s, r["name"]) | ((r["short"] != "") & F.contains(s, r["short"]))

    # what follows mentions these again and again, so each is evaluated once: names with their short forms, hits, other provinces
    shortened = F.transform(names, lambda r: F.struct(r.alias("name"), X.short_region(r).alias("short")))
    hits = X.let(shortened, lambda pairs: X.let(_blob(t, g, c), lambda blob: F.filter(pairs, lambda r: seen(r)(blob))))
    provinces = F.filter(F.array(*[F.lit(p) for p in C.PROVINCE_NAMES]), lambda p: F.contains(t, p))
    foreign = X.let(provinces, lambda named: F.when(F.size(named) == 0, named).otherwise(X.let(
        F.concat(names, F.transform(names, lambda r: X.short_region(r, ("省", "市", "自治区")))),
        lambda asked: F.filter(named, lambda p: ~F.exists(asked, lambda q: F.contains(q, p))))))
    nothing = F.lit("标题/正文/地区字段未检出查询区域词；若仍入选，可能因列表阶段区域字段缺失，请人工复核")

    def told(found: Column, others: Column) -> Column:
        few = F.array_join(F.slice(others, 1, 3), "、")
        each = F.transform(found, lambda r: F.concat(F.lit("「"), r["name"], F.lit("」见于"), _places(seen(r), t, g, c)))
        warn = F.when(F.size(others) > 0, F.concat(F.lit("。注意：标题另含地区词「"), few, F.lit("」，请结合正文核对是否属查询区域"))).otherwise("")
        other = F.when(F.size(others) > 0, F.concat(F.lit("。标题出现其他地区："), few)).otherwise("")
        return F.when(F.size(found) > 0, F.concat(F.array_join(each, "；"), warn)).otherwise(F.concat(nothing, other))

    return F.when(F.size(names) == 0, "查询未指定区域").otherwise(
        X.let(hits, lambda found: X.let(foreign, lambda others: told(found, others))))


def time_basis(publish_time: Column, start: Column, end: Column) -> Column:
    parts = F.concat_ws("；", F.concat(F.lit("发布日期 "), D.cn_date_of(publish_time)),
                        F.when(start.isNotNull(), F.concat(F.lit("不早于 "), D.cn_date_of(start))),
                        F.when(end.isNotNull(), F.concat(F.lit("不晚于 "), D.cn_date_of(end))))
    return (F.when(start.isNull() & end.isNull(), "查询未指定统计周期")
            .when(publish_time.isNull(), "原文未提供可解析的发布时间，时间条件无法严格核验").otherwise(parts))


def match_basis(rows: DataFrame) -> DataFrame:
    """Auditable reasons for rows holding a notice and its subscription's criteria."""
    t, g, c = F.col("title"), F.col("region"), F.col("clean_content")
    out = rows.withColumns({
        "keyword_basis": keyword_basis(t, g, c, F.col("keywords")),
        "region_basis": region_basis(t, g, c, F.col("regions")),
        "time_basis": time_basis(F.col("publish_time"), F.col("start_date"), F.col("end_date"))})
    return out.withColumn("match_basis", F.concat(
        F.lit("关键词："), "keyword_basis", F.lit("；区域："), "region_basis", F.lit("；时间："), "time_basis"))


def enrich(items: DataFrame) -> DataFrame:
    """Display columns of report items holding pivoted fields, criteria and attachments."""
    status, label = attachment_status(F.col("attachment_links"), F.col("detail_status") == "full", F.lit(False), F.lit(False))
    pct, level = completeness(status == "found", F.col("detail_status"))
    same = (F.col("project_name") == F.col("title")) | (F.col("project_name") == F.col("short_title"))
    df = match_basis(items).withColumns({
        "completeness_percent": pct, "completeness_level": level, "attachment_state": status, "attachment_label": label,
        "source_display": X.source_display(F.col("source_name")),
        "project_name_display": F.when(F.coalesce(same, F.lit(False)), "").otherwise(text_or_empty(F.col("project_name")))})
    return df.withColumns({
        "completeness_label": completeness_label(F.col("completeness_percent"), F.col("completeness_level")),
        "attachment_note": attachment_note(F.col("attachment_state"))})
