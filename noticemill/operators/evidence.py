"""Page-aware chunks, validation of proposed values, and human corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill import constants as C
from noticemill.functions.text import blank_to_null, compact, strip, text_or_empty
from noticemill.operators.store_merge import number_rows


def source_chunks(pages: DataFrame, chunk_chars: int = C.CHUNK_CHARS, max_chunks: int | None = None) -> DataFrame:
    """Greedy packing of a notice's page segments into chunks, in page order.

    All chunks are kept; ``max_chunks`` (16 suits one call of an outside extractor) drops later ones and flags it.
    The fold runs over the segment *lengths* of one notice, so the packing state is a
    few numbers per segment; texts are joined per chunk afterwards.
    """
    body = max(1000, chunk_chars - 40)
    text = strip(text_or_empty(F.col("text")))
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length("t") - 1) / F.lit(body)), F.lit(0)).cast("int"))
    segments = (pages.select("notice_id", "page", text.alias("t")).where("t <> ''")
                .select("notice_id", "page", F.posexplode(F.transform(
                    starts, lambda i: F.substring("t", i * body + 1, F.lit(body)))).alias("part", "s"))
                .select("notice_id", "page", "part", F.concat(
                    F.lit("[第"), F.col("page").cast("string"), F.lit("页]\n"), "s").alias("segment")))
    lengths = segments.groupBy("notice_id").agg(F.array_sort(F.collect_list(
        F.struct("page", "part", F.length("segment").alias("n")))).alias("list"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("used"), F.array().cast(
        "array<struct<page:int,part:int,chunk:int>>").alias("out"))

    def step(acc, seg):
        full = (acc["used"] > 0) & (acc["used"] + seg["n"] + 2 > chunk_chars)
        chunk = acc["chunk"] + F.when(full, 1).otherwise(0)
        used = F.when(full | (acc["used"] == 0), seg["n"]).otherwise(acc["used"] + 2 + seg["n"])
        return F.struct(chunk.alias("chunk"), used.alias("used"), F.array_append(acc["out"], F.struct(
            seg["page"].cast("int").alias("page"), seg["part"].alias("part"), chunk.alias("chunk"))).alias("out"))

    placed = lengths.select("notice_id", F.inline_outer(F.aggregate("list", start, step, lambda a: a["out"])))
    total = placed.groupBy("notice_id").agg(F.max("chunk").alias("last"))
    packed = segments.join(placed, ["notice_id", "page", "part"])
    if max_chunks is not None:
        packed = packed.where(F.col("chunk") < max_chunks)
    chunks = packed.groupBy("notice_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("page", "part", "segment"))), lambda s: s["segment"]), "\n\n").alias("text"))
    return chunks.join(total, "notice_id").select(
        "notice_id", (F.col("chunk") + 1).alias("chunk_no"), "text", (F.lit(max_chunks is not None) & (F.col("last") >= (max_chunks or 0))).alias("truncated"))


def validate_proposals(proposals: DataFrame, notices: DataFrame, pages: DataFrame) -> DataFrame:
    """Proposals (notice_id, position, field_name, value, quote, source_label, page) with ``error``.

    The quote must stand on the stated page (or, without a known page, in the text) and
    the value in the quote or the text. Texts come by equi-join on the notice.
    """
    rows = proposals.select(
        "notice_id", "position", "field_name", strip(text_or_empty(F.col("value"))).alias("value"),
        strip(text_or_empty(F.col("quote"))).alias("quote"),
        F.coalesce(blank_to_null(strip(F.col("source_label"))), "field_name").alias("source_label"), "page")
    texts = notices.select("notice_id", compact(text_or_empty(F.col("clean_content"))).alias("_whole"))
    by_page = pages.select("notice_id", "page", compact(text_or_empty(F.col("text"))).alias("_page_text"))
    joined = rows.join(texts, "notice_id", "left").join(by_page, ["notice_id", "page"], "left")
    whole = text_or_empty(F.col("_whole"))
    q, v = compact(F.col("quote")), compact(F.col("value"))
    source = F.coalesce("_page_text", whole)
    known = F.coalesce(F.col("field_name").isin(*C.PROPOSABLE_FIELDS), F.lit(False))
    error = (
        F.when(~known | (F.col("value") == "") | (F.col("quote") == ""), F.concat(
            F.coalesce(blank_to_null(F.col("field_name")), F.col("position").cast("string")),
            F.lit(": 字段名、值或原文片段无效")))
        .when(~F.contains(source, q), F.concat("field_name", F.lit(": quote 无法在声明的原文页中定位")))
        .when(~F.contains(q, v) & ~F.contains(whole, v), F.concat("field_name", F.lit(": value 无法在原文中定位"))))
    return joined.withColumn("error", error).drop("_whole", "_page_text")


def merge_proposals(values: DataFrame, validated: DataFrame) -> DataFrame:
    """Field values with the accepted proposals laid over them.

    First proposal per field (longest for the qualification); a rule-made
    qualification that is at least as long stays; the bid deadline carries over to the
    deadline and a tenderer fills a missing purchaser.
    """
    good = validated.where("error IS NULL")
    longest = F.when(F.col("field_name") == "qualification", -F.length("value")).otherwise(0)
    first = good.groupBy("notice_id", "field_name").agg(F.min_by(
        F.struct("value", "source_label", "quote", "page"), F.struct(longest, F.col("position"))).alias("new"))
    joined = values.join(first, ["notice_id", "field_name"], "full_outer")
    keeps = (F.col("field_name") == "qualification") & (
        F.length(text_or_empty(F.col("value"))) >= F.length("new.value")) & (text_or_empty(F.col("value")) != "")
    take = F.col("new").isNotNull() & ~keeps

    def pick(new, old):
        return F.when(take, new).otherwise(F.col(old))

    page = F.coalesce(F.col("new.page"), F.lit(0)).cast("string")
    merged = joined.select(
        "notice_id", "field_name", pick(F.col("new.value"), "value").alias("value"),
        pick(F.col("new.source_label"), "source_label").alias("source_label"),
        pick(F.col("new.page").cast("int"), "page").alias("page"), pick(F.col("new.quote"), "quote").alias("quote"),
        pick(F.lit("proposal_validated"), "method").alias("method"), pick(F.lit("verified"), "status").alias("status"),
        pick(F.concat(F.lit("E-"), "field_name", F.lit("-"), page), "evidence_id").alias("evidence_id"),
        pick(F.lit("direct_source"), "confidence").alias("confidence"))
    return _carry(_carry(merged, "bid_deadline", "deadline", always=True), "tenderer", "purchaser", always=False)


def _carry(values: DataFrame, source: str, target: str, always: bool) -> DataFrame:
    """Copy one field's row onto another of the same notice."""
    columns = ["value", "source_label", "page", "quote", "method", "status", "evidence_id", "confidence"]
    usable = values.where((F.col("field_name") == source) & (text_or_empty(F.col("value")) != ""))
    donor = usable.select("notice_id", F.lit(target).alias("field_name"),
                          F.struct(*columns).alias("_from"))
    joined = values.join(donor, ["notice_id", "field_name"], "left")
    empty = (text_or_empty(F.col("value")) == "") | (F.col("status") == "extraction_failed")
    move = F.col("_from").isNotNull() if always else (F.col("_from").isNotNull() & empty)
    return joined.select("notice_id", "field_name", *[
        F.when(move, F.col("_from." + c)).otherwise(F.col(c)).alias(c) for c in columns])


def numbered_corrections(corrections: DataFrame) -> DataFrame:
    """Corrections with their running number inside the notice, in time order."""
    ordered = corrections.where("coalesce(field_name, '') <> ''").withColumn(
        "_order", F.struct("corrected_at", "correction_id"))
    return number_rows(ordered, "_order", "n", ["notice_id"]).drop("_order")


def replay_corrections(values: DataFrame, corrections: DataFrame) -> DataFrame:
    """The last correction of a field wins over anything extracted."""
    last = numbered_corrections(corrections).groupBy("notice_id", "field_name").agg(F.max_by(
        F.struct("corrected_value", "reason", "corrected_at", "n"), "n").alias("fix"))
    joined = values.join(last, ["notice_id", "field_name"], "full_outer")
    fixed = F.col("fix").isNotNull()

    def pick(new, old):
        return F.when(fixed, new).otherwise(F.col(old))

    none = F.lit(None).cast("string")
    return joined.select(
        "notice_id", "field_name", pick(F.col("fix.corrected_value"), "value").alias("value"),
        pick(F.lit("人工校正"), "source_label").alias("source_label"), pick(F.lit(None).cast("int"), "page").alias("page"),
        pick(none, "quote").alias("quote"), pick(F.lit("manual_correction"), "method").alias("method"),
        pick(F.lit("corrected"), "status").alias("status"),
        pick(F.concat(F.lit("M-"), "field_name", F.lit("-"), F.col("fix.n").cast("string")), "evidence_id").alias("evidence_id"),
        pick(none, "confidence").alias("confidence"))


def check_corrections(requests: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requested corrections into accepted ones (with the previous value) and rejects."""
    known = F.col("field_name").isin(*C.CORRECTABLE_FIELDS)
    previous = values.select("notice_id", "field_name", F.col("value").alias("previous_value"))
    accepted = requests.where(known).join(previous, ["notice_id", "field_name"], "left")
    rejected = requests.where(~F.coalesce(known, F.lit(False))).withColumn(
        "error", F.concat(F.lit("不允许校正的字段: "), "field_name"))
    return accepted, rejected
