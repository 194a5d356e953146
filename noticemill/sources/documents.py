"""Uploaded documents: the gate every file passes, and the tie to its notice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticemill import constants as C
from noticemill.functions.text import blank_to_null, identity_text, strip, text_or_empty
from noticemill.sources.pages import main_text


def read_uploads(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def gate(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of files (path, content). Only HTML can be read here."""
    name = F.element_at(F.split(F.regexp_replace("path", r"\\", "/"), "/"), -1)
    size = F.length("content")
    suffix = F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    pdf = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    early = (F.when(size == 0, "empty_upload").when(size > C.UPLOAD_MAX_BYTES, "upload_too_large")
             .when(~suffix.isin(".html", ".htm") | pdf, "unsupported_type"))
    first = uploads.withColumn("filename", F.coalesce(blank_to_null(F.substring(name, 1, 255)), F.lit("official-document")))
    first = first.withColumn("code", early).withColumn("sha256", F.sha2("content", 256)).withColumn("size_bytes", size)
    html = F.when(F.col("code").isNull(), F.replace(F.col("content").cast("string"), F.lit("\u0000"), F.lit("")))
    text = strip(F.regexp_replace(F.regexp_replace(text_or_empty(main_text(html)), "[ \t]+", " "), "\n{3,}", "\n\n"))
    read = first.withColumn("text", text).drop("content")
    body = F.concat(F.lit("【第1页】\n"), "text")
    late = F.when(F.col("text") == "", "empty_html").when(F.length(body) > C.UPLOAD_MAX_CHARS, "content_too_large")
    coded = read.withColumn("code", F.coalesce("code", late)).withColumn("clean_content", body)
    return (coded.where("code IS NULL").drop("code").withColumn("content_format", F.lit("html")),
            coded.where("code IS NOT NULL").select("path", "filename", "size_bytes", "code"))


def identity_basis(text: Column, title: Column, code: Column) -> Column:
    """title / project_code when the document belongs to the notice, else NULL."""
    body, name, number = identity_text(text), identity_text(title), identity_text(code)
    return (F.when((name != "") & F.contains(body, name), "title")
            .when((F.length(number) >= 5) & F.contains(body, number), "project_code"))


def tie_to_notices(documents: DataFrame, notices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents aimed at ``notice_id``: those that match it, and identity rejects."""
    target = notices.select("notice_id", F.col("title").alias("_title"), F.col("project_code").alias("_code"))
    joined = documents.join(target, "notice_id", "left").withColumn("identity_basis", identity_basis(
        F.col("clean_content"), F.col("_title"), F.col("_code"))).drop("_title", "_code")
    return (joined.where("identity_basis IS NOT NULL"),
            joined.where("identity_basis IS NULL").withColumn("code", F.lit("identity_mismatch")))
