"""Field extraction from notice texts into a long table of field values.

Each pattern scans the text at most once, only if one of its words occurs and no pattern
before it has found the field; labels and values are then read from the short quote.
Whatever is mentioned more than once is staged or goes through ``let``. Values that are missing stay NULL and
carry a status; the fixed missing texts appear only in report tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill import constants as C
from noticemill.functions import dates as D
from noticemill.functions import text as X
from noticemill.functions.text import blank_to_null, clean_capture, extract, let, nonblank, rx, strip, text_or_empty

_HIT = "struct<value:string,source_label:string,quote:string,confidence:string>"
EVIDENCE_FIELDS = (
    "purchaser", "qualification", "agency", "project_code", "budget", "tenderer", "transaction_platform",
    "funding_source", "document_price", "notice_end_time", "bid_deadline", "opening_time", "deadline",
    "document_acquisition_start", "document_acquisition_end",
)
PLAIN_FIELDS = (
    "purchaser_source_label", "tenderer_source_label", "region", "content", "announcement_type",
    "joint_venture_allowed", "agent_allowed", "platform_registration_required", "ca_required", "project_name",
    "short_title", "publish_time_cn",
)
_SEPARATOR = r"^[ \t]*(?:[：:][ \t]*|为[ \t]*|是[ \t]*|[ \t]+)"
FIELD_VALUES_COLUMNS = ("notice_id", "field_name", "value", "source_label", "page", "quote", "method", "status",
                        "evidence_id", "confidence")


def _hit(value: Column, label, quote: Column, confidence: str) -> Column:
    """A found field, NULL when its value is empty."""
    label = F.lit(label) if isinstance(label, str) else label
    return let(value, lambda v: F.when(text_or_empty(v) != "", F.struct(
        v.alias("value"), label.alias("source_label"), quote.alias("quote"),
        F.lit(confidence).alias("confidence"))))


def _found(q: Column, use) -> Column:
    """``use`` of a quote that was found; NULL without one, at no further cost."""
    return let(q, lambda v: F.when(v.isNotNull(), use(v)))


def _scan(blob: Column, pattern: str, words: Sequence[str]) -> Column:
    """Whole first match, looked for only where one of the words occurs."""
    present = F.contains(blob, F.lit(words[0]))
    for w in words[1:]:
        present = present | F.contains(blob, F.lit(w))
    return F.when(present, extract(blob, pattern, 0))


def labelled_line(blob: Column, labels: Sequence[str], limit: int = 240) -> tuple[Column, str]:
    """Match of the first labelled line and the pattern to read its parts from."""
    pattern = (f"({X.any_of(X.longest_first(labels))})" + r"\s*(?:[：:]\s*|为\s*|是\s*|\s+)"
               + r"([^\n，,。；;]{1," + str(limit) + "})")
    return _scan(blob, pattern, labels), pattern


def by_priority(blob: Column, labels: Sequence[str], limit: int = 180) -> Column:
    """Struct (quote, label) of the first label, in priority order, that has a value."""
    tail = r"[ \t]*(?:[：:][ \t]*|为[ \t]*|是[ \t]*|[ \t]+)[^\n，,。；;]{1," + str(limit) + "}"
    return F.coalesce(*[_found(_scan(blob, X.quote(label) + tail, [label]), lambda q, label=label: F.struct(
        q.alias("quote"), F.lit(label).alias("label"))) for label in labels])


def _priority_hit(pair: Column, confidence: str = "direct_label") -> Column:
    def hit(p: Column) -> Column:
        q = p["quote"]
        rest = F.regexp_replace(F.substring(q, F.length(p["label"]) + 1, F.length(q)), rx(_SEPARATOR), "")
        return _hit(clean_capture(rest), p["label"], clean_capture(q), confidence)

    return _found(pair, hit)


def date_after_labels(blob: Column, labels: Sequence[str], choose_last: bool = False) -> tuple[Column, str]:
    pattern = (f"({X.any_of(X.longest_first(labels))})" + r"[^\n]{0,45}?(?:为|[：:])?\s*(" + C.DATE_VALUE + ")")
    if not choose_last:
        return _scan(blob, pattern, labels), pattern
    every = F.regexp_extract_all(blob, F.lit(rx(pattern)), F.lit(0))
    return F.try_element_at(every, F.lit(-1)), pattern


def split_clauses(value: Column) -> Column:
    """Complete top-level clauses; without any, lines and numbered fragments. Distinct, in order."""
    numbered = r"^\s*\d+\.\d+(?:\.\d+)?(?:[、．.]|\s)"

    def parts(body: Column) -> Column:
        top = F.filter(F.split(body, rx("(?m)(?=" + numbered + ")")), lambda p: F.rlike(p, F.lit(rx(numbered))))
        loose = F.split(body, rx(C.FRAGMENT_SPLIT))
        cleaned = F.transform(F.when(X.matches(body, C.TOP_CLAUSE), top).otherwise(loose), lambda p: clean_capture(p))
        return F.array_distinct(F.filter(cleaned, lambda p: p != ""))

    return F.when(text_or_empty(value) == "", F.array().cast("array<string>")).otherwise(
        let(F.regexp_replace(value, rx(r"(?m)^\s*【第\d+页】\s*$"), ""), parts))


def _section_lines(rest: Column) -> Column:
    """Lines that still belong to a qualification section, after its first line."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(False).alias("stop"),
                     F.lit(0).alias("n"))

    def step(acc: Column, raw: Column) -> Column:
        return F.when(acc["stop"], acc).otherwise(let(strip(raw), lambda line: added(acc, line)))

    def added(acc: Column, line: Column) -> Column:
        skip = (line == "") | F.rlike(line, F.lit(rx(r"^【第\d+页】\z")))
        ends = F.rlike(line, F.lit(rx(C.SECTION_STOP))) | F.rlike(line, F.lit(rx(C.SECTION_NEXT_HEADING)))
        total = acc["n"] + F.length(line)
        return (
            F.when(skip, acc)
            .when(ends, F.struct(acc["lines"].alias("lines"), F.lit(True).alias("stop"), acc["n"].alias("n")))
            .otherwise(F.struct(F.array_append(acc["lines"], line).alias("lines"),
                                (total > C.SECTION_MAX_CHARS).alias("stop"), total.alias("n"))))

    return F.aggregate(F.slice(let(rest, X.lines_of), 1, C.SECTION_MAX_LINES), start, step, lambda a: a["lines"])


def _with_qualification(df: DataFrame) -> DataFrame:
    """Add ``_qual`` (hit) and ``_clauses`` from a section, else from one line."""
    blob = F.col("_blob")
    label = f"({X.any_of(X.longest_first(C.QUALIFICATION_LABELS))})"
    head = r"(?m)^\s*(?:\d+[.、．]\s*)?" + label + r"\s*(?:[：:]\s*)?(.*)$"
    present = F.contains(blob, F.lit("资格"))
    staged = (
        df.withColumn("_q0", F.when(present, extract(blob, head, 0)))
        .withColumn("_rest", F.when(F.col("_q0").isNotNull(), extract(blob, head + r"([\s\S]*)", 3)))
        .withColumn("_more", F.when(F.col("_q0").isNotNull(), _section_lines(text_or_empty(F.col("_rest")))))
        .withColumn("_first", strip(F.regexp_extract("_q0", rx(head), 2)))
        .withColumn("_raw", strip(F.array_join(F.concat(F.array("_first"), F.col("_more")), "\n")))
        .withColumn("_items", split_clauses(F.col("_raw")))
    )
    value = F.when(F.size("_items") > 0, F.substring(F.array_join("_items", "；"), 1, 5000)).otherwise(
        clean_capture(F.col("_raw")))
    proof = F.substring(strip(F.array_join(F.concat(F.array(strip(F.col("_q0"))), F.col("_more")), "\n")), 1,
                        C.QUOTE_CHARS)
    section = F.when(F.col("_q0").isNotNull(), _hit(value, extract(F.col("_q0"), head), proof, "direct_section"))
    line = F.when(F.col("_qual").isNull(), _scan(blob, C.QUALIFICATION_PATTERN, ["资格"]))
    out = staged.withColumn("_qual", section).withColumn("_qual_line", _found(
        line, lambda q: nonblank(clean_capture(extract(q, C.QUALIFICATION_PATTERN)))))
    return out.withColumn("_clauses", F.when(F.col("_qual").isNotNull(), F.col("_items")).otherwise(
        split_clauses(F.col("_qual_line")))).drop("_q0", "_rest", "_more", "_first", "_raw", "_items")


def _constraints(clauses: Column) -> dict[str, Column]:
    def told(word: str, tests) -> Column:
        return F.when(F.size(clauses) > 0, let(F.array_join(clauses, "\n"), lambda t: F.when(F.contains(t, F.lit(word)), tests(t))))

    return {
        "joint_venture_allowed": told("联合体", lambda t: F.when(X.matches(t, C.JOINT_VENTURE_NO), "不允许").otherwise("需人工核对条款")),
        "agent_allowed": told("代理", lambda t: F.when(X.matches(t, C.AGENT_YES), "允许").when(X.matches(t, C.AGENT_NO), "不允许")),
        "platform_registration_required": told("平台", lambda t: F.when(X.matches(t, C.PLATFORM_YES), "需要")),
        "ca_required": told("", lambda t: F.when(X.matches(t, C.CA_YES), "需要")),
    }


def extract_wide(notices: DataFrame) -> DataFrame:
    """One row per notice: ``f_<field>`` hits or texts, ``clauses``, and the kept input columns."""
    title, content = F.col("title"), F.col("clean_content")
    summary = F.col("summary") if "summary" in notices.columns else F.lit(None).cast("string")
    df = notices.withColumn("_blob", F.concat_ws("\n", blank_to_null(title), blank_to_null(summary),
                                                 blank_to_null(content)))
    df = _with_qualification(df)
    blob = F.col("_blob")

    line_q, line_pattern = labelled_line(blob, C.PURCHASER_LABELS)
    bid_q, bid_pattern = date_after_labels(blob, C.BID_DEADLINE_LABELS)
    open_q, open_pattern = date_after_labels(blob, C.OPENING_LABELS)
    scans = {
        "_bid": bid_q, "_open": open_q,
        "_code": _scan(blob, C.CODE_PATTERN, ["编号"]),
        "_budget": _scan(blob, C.BUDGET_PATTERN, ["预算", "限价", "控制价"]),
        "_deadline": _scan(blob, C.DEADLINE_PATTERN, ["截止"]),
        "_region": _scan(blob, C.REGION_PATTERN, ["地", "区"]),
        "_content": _scan(blob, C.CONTENT_PATTERN, ["采购内容", "项目内容", "招标内容", "采购项目名称", "项目概况"]),
        "_type": extract(blob, C.TYPE_PATTERN, 1),
        "_name": _scan(blob, C.PROJECT_NAME_PATTERN, ["项目名称", "采购项目"]),
        "_body_name": _scan(text_or_empty(content), C.BODY_NAME_PATTERN, ["项目名称"]),
        "_acquire": _scan(blob, C.ACQUISITION_PATTERN, ["招标文件的获取", "获取招标文件", "招标文件获取时间"]),
        "_published": _scan(blob, C.PUBLISH_LINE_PATTERN, ["公告发布时间"]),
    }
    for name, labels in (("_s_explicit", C.EXPLICIT_PURCHASER_LABELS), ("_s_tenderer", C.TENDERER_LABELS),
                         ("_s_agency", C.AGENCY_LABELS), ("_s_platform", C.PLATFORM_LABELS),
                         ("_s_funding", C.FUNDING_LABELS), ("_s_price", C.PRICE_LABELS),
                         ("_s_end", C.NOTICE_END_LABELS)):
        scans[name] = by_priority(blob, labels)
    df = df.withColumns(scans)

    def read(q: Column, pattern: str, group: int, label, confidence: str, value=clean_capture) -> Column:
        """Hit of one group of a quote; its label is a text or the group that holds it."""
        return _found(q, lambda v: _hit(value(extract(v, pattern, group)),
                                        extract(v, pattern, label) if isinstance(label, int) else label, clean_capture(v), confidence))

    def pattern_hit(q: Column, pattern: str, field: str) -> Column:
        return read(q, pattern, 1, field, "pattern")

    def price(q: Column) -> Column:
        number = extract(q, C.PRICE_PATTERN, 3)
        unit = F.coalesce(extract(q, C.PRICE_PATTERN, 4),
                          F.when(F.contains(extract(q, C.PRICE_PATTERN, 2), F.lit("万元")), "万元"), F.lit("元"))
        return _hit(F.concat(F.regexp_replace(number, r"^(\d+)\.0+\z", "$1"), unit),
                    extract(q, C.PRICE_PATTERN), clean_capture(q), "direct_label")

    given_code = nonblank(strip(F.col("project_code")))
    company = F.coalesce(extract(title, C.TITLE_COMPANY), extract(title, C.TITLE_ORGANISATION))
    # a hit that needs no later pattern leaves that pattern alone
    df = df.withColumns({
        "f_tenderer": _priority_hit(F.col("_s_tenderer")),
        "f_purchaser": F.coalesce(
            _priority_hit(F.col("_s_explicit")), _priority_hit(F.col("_s_tenderer"), "normalised_tenderer"),
            read(line_q, line_pattern, 2, 1, "direct_label"),
            pattern_hit(_scan(blob, C.PURCHASER_PATTERN, ["采购人", "招标人", "采购单位", "建设单位", "甲方", "招标单位"]),
                        C.PURCHASER_PATTERN, "purchaser"),
            _hit(clean_capture(company), C.TITLE_INFERRED, F.substring(title, 1, 200), "title_inference")),
        "f_agency": F.coalesce(
            _priority_hit(F.col("_s_agency")), pattern_hit(_scan(blob, C.AGENCY_PATTERN, ["代理机构"]), C.AGENCY_PATTERN, "agency"),
            read(_scan(blob, C.ENTRUSTED_AGENCY_PATTERN, ["受招标人委托"]), C.ENTRUSTED_AGENCY_PATTERN, 1, "受招标人委托",
                 "semantic_context")),
        "f_transaction_platform": _priority_hit(F.col("_s_platform")),
        "f_notice_end_time": _priority_hit(F.col("_s_end")),
        "f_funding_source": F.coalesce(
            _priority_hit(F.col("_s_funding")),
            read(_scan(blob, C.FUNDING_PATTERN, ["资金"]), C.FUNDING_PATTERN, 2, 1, "direct_label")),
        "f_document_price": F.coalesce(
            _priority_hit(F.col("_s_price")), _found(_scan(blob, C.PRICE_PATTERN, ["售价"]), price)),
        "f_project_code": let(given_code, lambda given: F.when(
            given.isNull(), pattern_hit(F.col("_code"), C.CODE_PATTERN, "project_code"))),
        "f_budget": pattern_hit(F.col("_budget"), C.BUDGET_PATTERN, "budget"),
        "f_bid_deadline": read(F.col("_bid"), bid_pattern, 2, 1, "direct_label", D.normal_datetime),
        "f_opening_time": read(F.col("_open"), open_pattern, 2, 1, "direct_label", D.normal_datetime),
        "f_qualification": F.col("_qual"),
        **{f"f_document_acquisition_{part}": read(F.col("_acquire"), C.ACQUISITION_PATTERN, group, 1, "direct_range", D.normal_datetime)
           for part, group in (("start", 2), ("end", 3))},
    })
    def known(c: Column) -> Column:
        return let(c, lambda v: F.when(v != C.MISSING, v))

    def captured(name: str, pattern: str) -> Column:
        return _found(F.col(name), lambda q: nonblank(clean_capture(extract(q, pattern))))

    def project_name(q: Column) -> Column:
        return let(clean_capture(extract(q, C.PROJECT_NAME_PATTERN)), lambda named: F.when(
            named.isin(*C.NOT_A_NAME) & (text_or_empty(title) != ""), strip(title)).otherwise(named))

    body_name = strip(extract(F.col("_body_name"), C.BODY_NAME_PATTERN))

    def without_suffix(c: Column) -> Column:
        return nonblank(F.substring(strip(F.regexp_replace(c, C.CONTENT_TITLE_SUFFIX, "")), 1, 180))

    published = F.when(F.col("_published").isNotNull(),
                       D.cn_date(strip(extract(F.col("_published"), C.PUBLISH_LINE_PATTERN))))
    shown = F.when(F.col("publish_time").isNotNull(), D.cn_date_of(F.col("publish_time"))).otherwise(published)
    df = df.withColumns({
        "f_deadline": F.col("f_bid_deadline"),
        "p_deadline": _found(captured("_deadline", C.DEADLINE_PATTERN), lambda d: known(D.cn_date(d))),
        "p_project_code": given_code,
        "p_qualification": F.col("_qual_line"),
        "p_purchaser_source_label": F.when(F.col("f_purchaser.confidence") != "pattern", F.col("f_purchaser.source_label")),
        "p_tenderer_source_label": F.col("f_tenderer.source_label"),
        "p_region": F.coalesce(nonblank(strip(F.col("region"))), captured("_region", C.REGION_PATTERN)),
        "p_content": F.coalesce(captured("_content", C.CONTENT_PATTERN), without_suffix(body_name), without_suffix(title)),
        "p_announcement_type": F.col("_type"),
        "p_project_name": F.when(F.col("_name").isNotNull(), project_name(F.col("_name"))).otherwise(nonblank(strip(title))),
        "p_short_title": known(X.short_title(title)),
        "p_publish_time_cn": known(shown),
        **{"p_" + k: v for k, v in _constraints(F.col("_clauses")).items()},
        "clauses": F.when(F.col("detail_status") == "full", F.col("_clauses")).otherwise(
            F.array().cast("array<string>")),
    })
    return _consistent_purchaser(df).drop(*[c for c in df.columns if c.startswith("_")])


def _consistent_purchaser(df: DataFrame) -> DataFrame:
    """A full text with a purchaser label must yield a purchaser or ask for review."""
    content = text_or_empty(F.col("clean_content"))
    due = (F.col("detail_status") == "full") & F.col("f_purchaser").isNull() & X.matches(content, C.SPACED_PURCHASER)
    ahead = C.SPACED_PURCHASER + r"(?=([\s\S]{0,240}))"
    labels = F.regexp_extract_all(content, F.lit(rx(ahead)), F.lit(1))
    tails = F.regexp_extract_all(content, F.lit(rx(ahead)), F.lit(2))

    def found(label: Column, tail: Column) -> Column:
        value = clean_capture(F.regexp_extract(tail, rx(C.SPACED_VALUE), 1))
        usable = (value != "") & ~F.rlike(value, F.lit("^(?:" + X.any_of(C.REJECTED_PREFIXES) + ")"))
        return F.when(usable, F.struct(
            value.alias("value"), X.compact(label).alias("source_label"),
            strip(F.concat(label, F.regexp_extract(tail, rx(C.SPACED_VALUE), 0))).alias("quote"),
            F.lit("fallback").alias("confidence")))

    first_line = C.SPACED_PURCHASER + r"([^\n]*)(\n?)"
    marker, line, end = (F.regexp_extract(content, rx(first_line), i) for i in (1, 2, 3))
    failed = F.struct(
        F.lit(C.EXTRACTION_FAILED).alias("value"), X.compact(marker).alias("source_label"),
        strip(F.concat(marker, F.when(end == "", F.substring(line, 1, 240)).otherwise(line))).alias("quote"),
        F.lit("check").alias("confidence"))
    staged = df.withColumn("_try", F.when(due, F.array_compact(F.zip_with(labels, tails, found))))
    fixed = F.when(due, F.coalesce(F.try_element_at("_try", F.lit(1)), failed))
    return (staged.withColumn("f_purchaser", F.coalesce("f_purchaser", fixed))
            .withColumn("p_purchaser_source_label", F.when(
                due, F.col("f_purchaser.source_label")).otherwise(F.col("p_purchaser_source_label")))
            .withColumn("quality_status", F.when(F.col("f_purchaser.confidence") == "check", "needs_review")
                        .when(F.col("detail_status") == "full", "assessable").otherwise("not_assessable")))


def _marker_page(content: Column, q: Column) -> Column:
    """Last page marker before a quote inside a text that carries markers."""
    at = F.instr(content, q)
    marks = F.regexp_extract_all(F.substring(content, F.lit(1), at - 1), F.lit(C.PAGE_MARKER), F.lit(1))
    return F.when(content.isNotNull() & (at > 0), F.try_element_at(marks, F.lit(-1)).cast("int"))


def field_values(wide: DataFrame, pages: DataFrame | None = None, fields: Sequence[str] | None = None) -> DataFrame:
    """The long table, one row per notice and field, with page-aware evidence.

    Naming only the ``fields`` needed prunes the scans of all others.
    """
    marked = F.when(F.contains(F.col("clean_content"), F.lit("【第")), F.col("clean_content"))
    rows = []
    for name in fields or EVIDENCE_FIELDS + PLAIN_FIELDS:
        hit = F.col("f_" + name) if "f_" + name in wide.columns else F.lit(None).cast(_HIT)
        plain = F.col("p_" + name) if "p_" + name in wide.columns else F.lit(None).cast("string")
        rows.append(F.struct(F.lit(name).alias("field_name"), hit.alias("hit"), plain.alias("plain")))
    # everything below works on the exploded rows, behind the generator
    listed = wide.select("notice_id", "detail_status", marked.alias("marked"), F.inline_outer(F.array(*rows)))
    gated = (F.col("detail_status") != "full") & F.col("field_name").isin(*C.DETAIL_ONLY_FIELDS)
    held = F.when(gated & (F.col("hit.confidence") == "title_inference"), F.lit(None).cast(_HIT)).otherwise(F.col("hit"))
    long = listed.withColumn("hit", held).select(
        "notice_id", "field_name", F.coalesce("hit.value", "plain").alias("value"), "hit.source_label",
        F.substring("hit.quote", 1, C.QUOTE_CHARS).alias("quote"), "hit.confidence", gated.alias("gated"),
        F.when(F.col("hit.quote").isNotNull(), _marker_page(F.col("marked"), F.col("hit.quote"))).alias("marker_page"))
    long = long.withColumn("unavailable", F.col("gated") & F.col("value").isNull())
    if pages is not None:
        long = long.join(quote_pages(long, pages), ["notice_id", "field_name"], "left")
    else:
        long = long.withColumn("found_page", F.lit(None).cast("int"))
    page = F.coalesce("found_page", "marker_page")
    how = F.col("confidence")
    proven = how.isNotNull()
    return long.select(
        "notice_id", "field_name", "value", "source_label", F.when(proven, page).alias("page"), "quote",
        F.when(how == "fallback", "rule_consistency_fallback").when(how == "check", "rule_consistency_check")
        .otherwise("rule").alias("method"),
        F.when(how == "title_inference", "inferred").when(how == "check", "extraction_failed").when(proven, "verified")
        .when(F.col("unavailable"), "unavailable_no_detail").when(text_or_empty(F.col("value")) == "", "missing")
        .otherwise("structured_metadata").alias("status"),
        F.when(proven, F.concat(F.lit("E-"), F.col("field_name"), F.lit("-"),
                                F.coalesce(page, F.lit(0)).cast("string"))).alias("evidence_id"),
        "confidence")


def quote_pages(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """First page of each notice whose squeezed text holds the squeezed quote (or its first 160)."""
    wanted = quotes.where("quote IS NOT NULL").select("notice_id", "field_name", X.compact(F.col("quote")).alias("q"))
    texts = pages.select("notice_id", "page", X.compact(F.col("text")).alias("t"))
    head = (F.length("q") > 160) & F.contains("t", F.substring("q", 1, 160))
    return wanted.join(texts, "notice_id").where((F.col("q") != "") & (F.contains("t", F.col("q")) | head)).groupBy(
        "notice_id", "field_name").agg(F.min("page").cast("int").alias("found_page"))


def clause_rows(wide: DataFrame) -> DataFrame:
    """(notice_id, clause_no, clause)."""
    return wide.select("notice_id", F.posexplode_outer("clauses").alias("pos", "clause")).where("clause IS NOT NULL").select(
        "notice_id", (F.col("pos") + 1).alias("clause_no"), "clause")


def shown_value(value: Column, status: Column) -> Column:
    """Display text of a field: its value, else the fixed text for why it is missing."""
    return F.when(text_or_empty(value) != "", value).when(status == "unavailable_no_detail", C.DETAIL_UNAVAILABLE).otherwise(
        C.MISSING)
