"""Extracting stored texts again: named notices, or all rows of an older version.

Only the rows concerned are read and changed. Corrections by hand are replayed over what the rules find, and win. A row gets
the current version only where its text was really extracted; a row without a verified text is refused (if it was named)
or marked for another crawl (if its version is old).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill.functions import text as X
from noticemill.functions.text import blank_to_null, strip, text_or_empty
from noticemill.operators import evidence, extraction
from noticemill.session import broadcast_if_small, cut_lineage

#: Fields that also stand in the notice's row.
_ROW_FIELDS = ("project_code", "announcement_type")
VERSION, RECRAWL = "v2", "needs_recrawl"
NO_TEXT = "当前没有已验证的详情正文，请先使用「重新采集并解析」"


@dataclass
class Reextraction:
    """Changed notices, all their fields, and what could not be extracted with the reason."""

    notices: DataFrame
    fields: DataFrame
    refused: DataFrame


def has_text() -> F.Column:
    return (F.col("detail_status") == "full") & (strip(text_or_empty(F.col("clean_content"))) != "")


def extracted_fields(notices: DataFrame, corrections: DataFrame | None = None, pages: DataFrame | None = None,
                     fields: Sequence[str] | None = None) -> DataFrame:
    """The fields of the notices with their corrections on top; corrections of other notices are left out.

    Naming the ``fields`` needed prunes the scans of others, but for the two that rows take over.
    """
    ids = broadcast_if_small(notices.select("notice_id").distinct())
    if pages is not None:
        pages = pages.join(ids, "notice_id", "left_semi")
    names = tuple(dict.fromkeys([*fields, *_ROW_FIELDS])) if fields else None
    values = extraction.field_values(extraction.extract_wide(notices), pages, names)
    if corrections is not None:
        values = evidence.replay_corrections(values, corrections.join(ids, "notice_id", "left_semi"))
    return cut_lineage(values)


def with_fields(rows: DataFrame, fields: DataFrame, code: bool) -> DataFrame:
    """Rows with the current version, and with the type (and code) that their fields say."""
    found = fields.where(F.col("field_name").isin(*_ROW_FIELDS)).groupBy("notice_id").agg(
        F.max(F.when(F.col("field_name") == "project_code", blank_to_null(F.col("value")))).alias("_code"),
        F.max(F.when(F.col("field_name") == "announcement_type", F.col("value"))).alias("_type"))
    joined = rows.join(found, "notice_id", "left").withColumns({
        "announcement_type": F.col("_type"), "extraction_version": F.lit(VERSION)})
    if code:
        joined = joined.withColumn("project_code", F.coalesce("_code", "project_code"))
    return joined.select(*rows.columns)


def reextract(notices: DataFrame, ids: DataFrame, corrections: DataFrame | None = None, pages: DataFrame | None = None,
              fields: Sequence[str] | None = None) -> Reextraction:
    """Extract the notices named in ``ids`` again; ids without a stored notice are refused too."""
    named = ids.select("notice_id").distinct()
    chosen = notices.join(broadcast_if_small(named), "notice_id", "left_semi")
    ready = chosen.where(has_text())
    values = extracted_fields(ready, corrections, pages, fields)
    known = chosen.select("notice_id", F.coalesce(has_text(), F.lit(False)).alias("_ready"))
    refused = named.join(known, "notice_id", "left").where(~F.coalesce("_ready", F.lit(False))).select(
        "notice_id", F.when(F.col("_ready").isNull(), "公告不存在").otherwise(NO_TEXT).alias("error"))
    return Reextraction(with_fields(ready, values, code=True), values, refused)


def outdated(notices: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """Rows below the current version, without a detail address, or (given the stored ``fields``) never extracted."""
    old = (F.coalesce("extraction_version", F.lit("")) != VERSION) | F.col("detail_url").isNull()
    if fields is None:
        return notices.where(old)
    done = fields.select("notice_id").distinct().withColumn("_done", F.lit(True))
    return notices.join(done, "notice_id", "left").where(old | F.col("_done").isNull()).drop("_done")


def backfill(notices: DataFrame, stored_fields: DataFrame | None = None, corrections: DataFrame | None = None,
             pages: DataFrame | None = None, fields: Sequence[str] | None = None) -> Reextraction:
    """Extract all outdated rows that have a text; the others wait for another crawl and are listed as refused."""
    mapped = F.when((F.col("source_name") == "cebpub") & (text_or_empty(F.col("source_item_id")) != ""),
                    X.detail_url(F.col("source_item_id"))).otherwise(F.col("detail_url"))
    old = outdated(notices, stored_fields).withColumn("detail_url", mapped)
    ready, wait = old.where(has_text()), old.where(~F.coalesce(has_text(), F.lit(False)))
    values = extracted_fields(ready, corrections, pages, fields)
    marked = wait.withColumns({
        "extraction_version": F.lit(RECRAWL),
        "detail_status": F.when(F.col("detail_status").isin("unknown", "failed"), "metadata_only").otherwise(F.col("detail_status"))})
    return Reextraction(with_fields(ready, values, code=False).unionByName(marked), values,
                        wait.select("notice_id", F.lit(NO_TEXT).alias("error")))
