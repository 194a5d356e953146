"""Run counters, closure checks, source statistics, run status and warnings.

Input of the counters is the *outcome table*: one row per raw list item of a run with
its source, ``outcome`` (list_filtered, cap_skipped, detail_failed, detail_filtered,
merged, primary), ``detail_status``, ``store_matched`` and ``change``. Everything
comes from the same rows, so the numbers add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill.functions import text as X

FUNNEL = ("raw_result_count", "list_filtered_out", "detail_cap_skipped", "detail_failed", "detail_filtered_out",
          "candidates_count", "cross_source_merge_count", "primary_count", "db_merge_count", "saved_count",
          "incremental_count", "update_count", "skipped_already_delivered", "report_item_count")


def _is(value: str) -> Column:
    return F.col("outcome") == value


def funnel(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """One row of counters per run."""
    top = _is("primary")
    stored = F.coalesce("store_matched", F.lit(False))
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw_result_count"), F.count_if(_is("list_filtered")).alias("list_filtered_out"),
        F.count_if(_is("cap_skipped")).alias("detail_cap_skipped"), F.count_if(_is("detail_failed")).alias("detail_failed"),
        F.count_if(_is("detail_filtered")).alias("detail_filtered_out"),
        F.count_if(top | _is("merged")).alias("candidates_count"),
        F.count_if(_is("merged")).alias("cross_source_merge_count"), F.count_if(top).alias("primary_count"),
        F.count_if(top & stored).alias("db_merge_count"), F.count_if(top & ~stored).alias("saved_count"),
        F.count_if(top & (F.col("change") == "new")).alias("incremental_count"),
        F.count_if(top & (F.col("change") == "update")).alias("update_count"),
        F.count_if(top & (F.col("change") == "skipped")).alias("skipped_already_delivered"),
        F.count_if(top & F.col("change").isin("new", "update")).alias("report_item_count"))


def _text(parts: list) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def closure(counters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ok, note_no, note): one row per broken balance, else one passing row."""
    raw, lst, cap, failed, filt, cand, merged, prim, db, _saved, new, upd, skip, rep = (F.col(c) for c in FUNNEL)
    left = raw - lst - cap - failed - filt - cand
    notes = F.array_compact(F.array(
        F.when(left != 0, _text(["列表漏斗未闭合：原始", raw, " − 列表过滤", lst, " − 上限跳过", cap, " − 详情失败", failed,
                                 " − 详情过滤", filt, " − 候选", cand, " = ", left, "（应为0）"])),
        F.when((cand != merged + prim) & (cand > 0), _text(["去重漏斗：候选", cand, " ≠ 跨源合并", merged, " + 主记录", prim])),
        F.when(rep != new + upd, _text(["报告条目", rep, " ≠ 新增", new, " + 更新", upd])),
        F.when((prim > 0) & (new + upd + skip > prim + db),
               _text(["增量合计(", new, "+", upd, "+", skip, ") 大于主记录", prim, "，请核对"]))))
    passed = _text(["闭合校验通过：", raw, " = ", lst, "+", cap, "+", failed, "+", filt, "+", cand, "；候选", cand, " → 合并",
                    merged, " + 主记录", prim, "；报告", rep, " = 新增", new, "+更新", upd])
    staged = counters.withColumn("notes", notes)
    return staged.select(*keys, (F.size("notes") == 0).alias("ok"), F.posexplode_outer(
        F.when(F.size("notes") == 0, F.array(passed)).otherwise(F.col("notes"))).alias("pos", "note")).select(
        *keys, "ok", (F.col("pos") + 1).alias("note_no"), "note")


def detail_counts(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Full / metadata / failed / human-verification counts of the opened details."""
    opened = F.col("outcome").isin("detail_filtered", "merged", "primary")
    status = F.col("detail_status")
    return outcomes.groupBy(*keys).agg(
        F.count_if(opened & (status == "full")).alias("detail_full_count"),
        F.count_if(opened & ~status.isin("full", "failed", "needs_human_verification")).alias("detail_metadata_count"),
        F.count_if(_is("detail_failed") | (opened & (status == "failed"))).alias("detail_failed_count"),
        F.count_if(opened & (status == "needs_human_verification")).alias("detail_human_verification_count"))


def source_stats(outcomes: DataFrame, statuses: DataFrame, contributions: DataFrame, keys: list[str]) -> DataFrame:
    """Per run and source: counters, read status and message, and report contribution.

    ``statuses`` (keys, source_name, status, message) has a row for failed sources too.
    """
    by = [*keys, "source_name"]
    opened = F.col("outcome").isin("detail_filtered", "merged", "primary")
    full = F.col("detail_status") == "full"
    counted = outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("raw_count"), F.count_if(~_is("list_filtered")).alias("list_kept"),
        F.count_if(opened & full).alias("detail_success"), F.count_if(opened & ~full).alias("detail_metadata_only"))
    joined = statuses.join(counted, by, "left").join(contributions, by, "left")
    zero = ("raw_count", "list_kept", "detail_success", "detail_metadata_only", "final_contributed")
    return joined.select(*by, "status", "message", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero])


def contributions(report_items: DataFrame, keys: list[str]) -> DataFrame:
    return report_items.groupBy(*keys, "source_name").agg(F.count(F.lit(1)).alias("final_contributed"))


def zero_contribution(statuses: DataFrame, report_items: DataFrame, keys: list[str]) -> DataFrame:
    """Sources that were read but put nothing into the report."""
    by = [*keys, "source_name"]
    return statuses.where(F.col("status") == "success").select(*by).join(
        report_items.select(*by).distinct(), by, "left_anti")


def run_status(runs: DataFrame) -> Column:
    """failed / partial / success from sources read, sources failed and detail counts."""
    quality = ((F.col("sources_failed") > 0) | (F.col("detail_failed_count") > 0) | (F.col("detail_metadata_count") > 0)
               | (F.col("detail_human_verification_count") > 0) | F.col("truncated"))
    return F.when(F.col("sources_succeeded") == 0, "failed").when(quality, "partial").otherwise("success")


def data_mode(items: DataFrame, keys: list[str]) -> DataFrame:
    """Label of the data modes present in the output of a run."""
    mode = F.coalesce(X.blank_to_null(F.col("data_mode")), F.lit("live"))
    fixture, live = F.max((mode == "fixture").cast("int")), F.max((mode == "live").cast("int"))
    label = F.when((fixture == 1) & (live == 1), "实时数据+演示数据").when(fixture == 1, "演示数据").otherwise("实时数据")
    return items.groupBy(*keys).agg(label.alias("data_mode_label"))


def warnings(runs: DataFrame, statuses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, warning): one row per condition, each failed source on its own."""
    human = F.col("detail_human_verification_count")
    flags = F.array_compact(F.array(
        F.when(F.col("status") == "partial", F.struct(F.lit(1).alias("rank"), F.lit(
            "存在失败或跳过的数据源，报告覆盖范围不完整，详见数据源执行情况表。").alias("warning"))),
        F.when(human > 0, F.struct(F.lit(3).alias("rank"), F.concat(
            human.cast("string"), F.lit(" 条详情要求人工完成安全验证；系统未绕过验证，该类记录不按完整正文分析。")).alias("warning"))),
        F.when(F.col("truncated"), F.struct(F.lit(4).alias("rank"), F.lit(
            "本次快照已达每源 500 条安全上限，truncated=true；报告不声称为完整覆盖。").alias("warning")))))
    failed = statuses.where(F.col("status") != "success").select(*keys, F.lit(2).alias("rank"), F.concat(
        X.source_display(F.col("source_name")), F.lit("："), "message").alias("warning"))
    return runs.select(*keys, F.inline_outer(flags)).where("rank IS NOT NULL").unionByName(failed)


def data_quality(values: DataFrame, notices: DataFrame) -> DataFrame:
    """Evidence count, fields to review and whether the notice can be assessed."""
    per = values.groupBy("notice_id").agg(
        F.count_if(F.col("evidence_id").isNotNull() & (F.col("status") != "extraction_failed")).alias("evidence_field_count"),
        F.array_sort(F.collect_set(F.when(F.col("status") == "extraction_failed", F.col("field_name")))).alias("needs_review_fields"))
    return notices.select("notice_id", (F.col("detail_status") == "full").alias("assessable")).join(per, "notice_id", "left")


def rebuilt_funnel(executions: DataFrame) -> DataFrame:
    """Closable counters for old runs that stored no stage counts.

    Needs raw_result_count, filtered_result_count, duplicate_count and item_count.
    """
    raw, items = F.coalesce("raw_result_count", F.lit(0)), F.col("item_count")
    final = F.when(F.coalesce("filtered_result_count", F.lit(0)) > 0, F.col("filtered_result_count")).otherwise(F.least(F.lit(8), items))
    dup = F.coalesce("duplicate_count", F.lit(0))
    merge = F.when(dup > final, 0).otherwise(dup)
    prim = F.when((final > 0) & (merge + final != final), F.greatest(F.lit(0), final - merge)).otherwise(final)
    shown = F.least(items, F.when(final > 0, final).otherwise(items))
    return executions.select(
        "execution_id", raw.alias("raw_result_count"), F.greatest(F.lit(0), raw - final).alias("list_filtered_out"),
        final.alias("candidates_count"), (final - prim).alias("cross_source_merge_count"), prim.alias("primary_count"),
        shown.alias("incremental_count"), F.greatest(F.lit(0), prim - shown).alias("skipped_already_delivered"))
