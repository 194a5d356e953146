"""Incremental delivery: what is new or changed for a subscription, and marking it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["task_id", "notice_id"]
HISTORY_COLUMNS = ["task_id", "notice_id", "content_hash", "first_delivered_at", "last_delivered_at",
                   "report_id"]


def plan_delivery(current: DataFrame, history: DataFrame, mode: str = "incremental") -> DataFrame:
    """Each current (task, notice) with ``change`` new / update / skipped.

    A full snapshot neither reads nor writes the history: its plan is empty.
    """
    prior = history.select(*KEY, F.col("content_hash").alias("previous_hash"), F.lit(True).alias("_known"))
    plan = current.select(*KEY, "content_hash").join(prior, KEY, "left").select(
        *KEY, "content_hash",
        F.when(F.col("_known").isNull(), "new")
        .when(F.col("previous_hash").eqNullSafe(F.col("content_hash")), "skipped")
        .otherwise("update").alias("change"),
        F.when(~F.col("previous_hash").eqNullSafe(F.col("content_hash")), F.col("previous_hash"))
        .alias("previous_hash"))
    return plan.where(F.lit(False)) if mode == "full_snapshot" else plan


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("task_id").agg(
        F.count_if(F.col("change") == "new").alias("new_count"),
        F.count_if(F.col("change") == "update").alias("update_count"),
        F.count_if(F.col("change") == "skipped").alias("skipped_count"))


def change_label(mode: str = "incremental"):
    if mode == "full_snapshot":
        return F.lit("本轮原始记录（未去重）")
    return F.when(F.col("change") == "update", "内容发生变化").when(F.col("change") == "new", "新增").otherwise("")


def delivery_allowed(status: str, mode: str, planned: bool, report_written: bool) -> bool:
    """History may move only after a written, non-empty incremental report."""
    return status in ("success", "partial") and mode == "incremental" and planned and report_written


def mark_delivered(history: DataFrame, plan: DataFrame, delivered_at, report_id: str | None) -> DataFrame:
    """The next state of the history once the planned rows were handed over."""
    due = plan.where(F.col("change") != "skipped").select(
        *KEY, F.col("content_hash").alias("_hash"), F.lit(True).alias("_due"))
    ts, rid = F.lit(delivered_at), F.lit(report_id).cast("string")
    now_due = F.col("_due").isNotNull()
    return history.join(due, KEY, "full_outer").select(
        *KEY,
        F.when(now_due, F.col("_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.coalesce(F.col("first_delivered_at"), ts).alias("first_delivered_at"),
        F.when(now_due, ts).otherwise(F.col("last_delivered_at")).alias("last_delivered_at"),
        F.when(now_due, F.coalesce(rid, F.col("report_id"))).otherwise(F.col("report_id")).alias("report_id"))


def delivered_rows(history: DataFrame, plan: DataFrame, delivered_at, report_id: str | None) -> DataFrame:
    """Only the rows of the history that handing over the plan adds or replaces."""
    due = plan.where(F.col("change") != "skipped").select(*KEY, "content_hash")
    before = history.select(*KEY, F.col("first_delivered_at").alias("_first"), F.col("report_id").alias("_report"))
    ts = F.lit(delivered_at)
    return due.join(before, KEY, "left").select(
        *KEY, "content_hash", F.coalesce("_first", ts).alias("first_delivered_at"), ts.alias("last_delivered_at"),
        F.coalesce(F.lit(report_id).cast("string"), "_report").alias("report_id"))
