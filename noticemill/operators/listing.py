"""Listings: notices, deliveries, executions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delivered_to(notices: DataFrame, history: DataFrame, task_id) -> DataFrame:
    """Notices that were delivered to one subscription."""
    return notices.join(history.where(F.col("task_id") == task_id).select("notice_id"), "notice_id", "left_semi")


def list_notices(notices: DataFrame, history: DataFrame | None = None, *, source_name: str | None = None,
                 data_mode: str | None = None, task_id=None, detail_status: str | None = None,
                 limit: int = 50, offset: int = 0, newest: str = "first_seen_at") -> tuple[DataFrame, DataFrame]:
    """One page, newest first, without the large text columns, and the total count."""
    wanted = {"source_name": source_name, "data_mode": data_mode, "detail_status": detail_status}
    rows = notices
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if task_id is not None:
        rows = delivered_to(rows, history, task_id)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    slim = rows.drop("clean_content", "raw_content", "source_metadata", "extraction_data")
    page = slim.orderBy(F.col(newest).desc(), "notice_id").offset(offset).limit(max(limit, 1))
    return page, total


def execution_history(executions: DataFrame, task_id=None) -> DataFrame:
    """Runs, newest first; a missing mode follows from the scope."""
    rows = executions if task_id is None else executions.where(F.col("task_id") == task_id)
    snapshot = F.col("report_scope") == "snapshot"
    return rows.withColumn("report_mode", F.coalesce(
        "report_mode", F.when(snapshot, "full_snapshot").otherwise("incremental"))).withColumn(
        "deduplicate", F.coalesce("deduplicate", ~snapshot)).orderBy("task_id", F.col("created_at").desc())


def report_catalogue(executions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs that wrote a report, with their subscription, newest first."""
    return executions.where(F.col("report_path").isNotNull()).join(tasks, "task_id").orderBy(F.col("created_at").desc())


def latest(rows: DataFrame, by: str, keys: list[str] | None = None) -> DataFrame:
    """Latest row overall, or per key, without a sort."""
    packed = rows.groupBy(*(keys or [])).agg(F.max_by(F.struct(*rows.columns), F.col(by)).alias("row"))
    return packed.where("row IS NOT NULL").select("row.*")
