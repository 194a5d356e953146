"""Registered queries: field extraction, evidence, proposals, corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticemill import constants as C
from noticemill.operators import evidence, extraction, reextraction
from noticemill.plans import views as V


def _wide(spark, sf, code=False):
    rows = V.notices(spark, sf)
    return extraction.extract_wide(rows if code else rows.withColumn("project_code", F.lit(None).cast("string")))


def _one(field):
    def run(spark, sf):
        return extraction.field_values(_wide(spark, sf), fields=[field]).select(
            "notice_id", "value", "source_label", "status", "evidence_id")
    return run


def field_values_all(spark, sf):
    """How often each field has which status over all notices."""
    return extraction.field_values(_wide(spark, sf)).groupBy("field_name", "status").agg(F.count(F.lit(1)).alias("n"))


def qualification_clauses(spark, sf):
    return extraction.clause_rows(_wide(spark, sf))


def constraint_flags(spark, sf):
    return _wide(spark, sf).select("notice_id", F.col("p_joint_venture_allowed").alias("joint"),
                                   F.col("p_agent_allowed").alias("agent"),
                                   F.col("p_platform_registration_required").alias("platform"),
                                   F.col("p_ca_required").alias("ca"))


def context_fallbacks(spark, sf):
    """Agency, funding and price that only the context tells."""
    k = F.col("notice_id")
    text = F.concat(F.lit("建设资金为"), F.when(k % 2 == 0, "国有资金100%").otherwise("企业自筹资金"), F.lit("，"),
                    F.concat(F.lit("代理"), F.col("buyer"), F.lit("有限公司受招标人委托。\n招标文件售价")),
                    F.when(k % 3 == 0, "（万元）：").otherwise("人民币（元）："), (k % 50).cast("string"), F.lit(".0"))
    wide = extraction.extract_wide(V.notices(spark, sf).withColumn("clean_content", text))
    return wide.select("notice_id", F.col("f_agency.value").alias("agency"), F.col("f_funding_source.value").alias("funding"),
                       F.col("f_document_price.value").alias("price"))


def acquisition_window(spark, sf):
    day = F.col("order_day")
    text = F.concat(F.lit("招标文件的获取时间为"), F.date_format(day, "yyyy年M月d日"), F.lit("9时00分至"),
                    F.date_format(F.date_add(day, 7), "yyyy年M月d日"), F.lit("17时30分。\n开标时间："),
                    F.date_format(F.date_add(day, 30), "yyyy-MM-dd"), F.lit(" 10:00"))
    wide = extraction.extract_wide(V.notices(spark, sf).withColumn("order_day", F.col("order_day") + F.expr("interval 12 year"))
                                   .withColumn("clean_content", text))
    return wide.select("notice_id", F.col("f_document_acquisition_start.value").alias("start_text"),
                       F.col("f_document_acquisition_end.value").alias("end_text"), F.col("f_opening_time.value").alias("opening"))


def title_purchaser(spark, sf):
    title = F.concat(F.col("buyer"), F.when(F.col("notice_id") % 2 == 0, "有限公司").otherwise("管理局"), F.lit("设备采购"))
    rows = V.notices(spark, sf).withColumn("title", title).withColumn("clean_content", F.lit("正文"))
    values = extraction.field_values(extraction.extract_wide(rows), fields=["purchaser"])
    return values.where("field_name = 'purchaser'").select("notice_id", "value", "status")


def purchaser_consistency(spark, sf):
    text = F.concat(F.lit("采 购 人 ："), F.when(F.col("notice_id") % 2 == 0, F.col("buyer")).otherwise(F.lit("联系方式")), F.lit("\n完"))
    rows = V.notices(spark, sf).withColumn("title", F.lit("公告")).withColumn("clean_content", text)
    values = extraction.field_values(extraction.extract_wide(rows), fields=["purchaser"])
    return values.where("field_name = 'purchaser' AND status <> 'unavailable_no_detail'").select("notice_id", "value", "status", "method")


def _pages(spark, sf, size=500):
    text = F.col("text")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size) - 1, F.lit(0)).cast("int"))
    return V.load(spark, sf, "documents").select(F.col("doc_id").alias("notice_id"), F.posexplode(
        F.transform(starts, lambda i: F.substring(text, i * size + 1, F.lit(size)))).alias("pos", "text")).select(
        "notice_id", (F.col("pos") + 1).alias("page"), "text")


def evidence_page(spark, sf):
    """Page of a quote taken from each document at one third of its length."""
    at = F.floor(F.length("text") / 3).cast("int")
    quotes = V.load(spark, sf, "documents").select(
        F.col("doc_id").alias("notice_id"), F.lit("q").alias("field_name"), F.substring("text", at + 1, F.lit(40)).alias("quote"))
    return extraction.quote_pages(quotes, _pages(spark, sf)).select("notice_id", "found_page")


def source_chunks(spark, sf):
    chunks = evidence.source_chunks(_pages(spark, sf), chunk_chars=1500)
    return chunks.select("notice_id", "chunk_no", F.length("text").alias("chars"), "truncated")


def _proposals(spark, sf):
    """Quotes cut from each document; every third is altered, every fifth names an unknown field."""
    k = F.col("doc_id")
    cut = F.substring("text", 1, 30)
    return V.load(spark, sf, "documents").select(
        k.alias("notice_id"), F.lit(0).alias("position"),
        F.when(k % 5 == 0, "colour").when(k % 2 == 0, "budget").otherwise("purchaser").alias("field_name"),
        F.when(k % 7 == 0, "§§").otherwise(F.substring("text", 1, 10)).alias("value"),
        F.when(k % 3 == 0, F.concat(F.lit("§"), cut)).otherwise(cut).alias("quote"), F.lit("").alias("source_label"),
        F.lit(1).alias("page"))


def _documents(spark, sf):
    return V.load(spark, sf, "documents").select(F.col("doc_id").alias("notice_id"), F.col("text").alias("clean_content"))


def proposal_validation(spark, sf):
    return evidence.validate_proposals(_proposals(spark, sf), _documents(spark, sf), _pages(spark, sf)).select(
        "notice_id", "field_name", "error")


def proposal_merge(spark, sf):
    """Accepted proposals over rule values that exist for every second document."""
    docs = V.load(spark, sf, "documents")
    none = F.lit(None).cast("string")
    base = docs.where("doc_id % 2 = 0").select(
        F.col("doc_id").alias("notice_id"), F.lit("budget").alias("field_name"), F.lit("0元").alias("value"),
        F.lit("l").alias("source_label"), F.lit(None).cast("int").alias("page"), none.alias("quote"),
        F.lit("rule").alias("method"), F.lit("verified").alias("status"), none.alias("evidence_id"), none.alias("confidence"))
    good = evidence.validate_proposals(_proposals(spark, sf), _documents(spark, sf), _pages(spark, sf))
    return evidence.merge_proposals(base, good).select("notice_id", "field_name", "method", "status")


def _corrections(spark, sf):
    names = F.element_at(F.array(F.lit("purchaser"), F.lit("budget"), F.lit("colour")), (F.col("event_id") % 3 + 1).cast("int"))
    return V.load(spark, sf, "events").where("event_type = 'error'").select(
        F.col("user_id").alias("notice_id"), names.alias("field_name"), F.col("value").cast("string").alias("corrected_value"),
        F.lit("核对").alias("reason"), F.col("ts").alias("corrected_at"), F.col("event_id").alias("correction_id"))


def correction_replay(spark, sf):
    values = extraction.field_values(_wide(spark, sf), fields=["purchaser", "budget"])
    fixed = evidence.replay_corrections(values, _corrections(spark, sf))
    return fixed.where("status = 'corrected'").select("notice_id", "field_name", F.col("value").cast("double").alias("value"),
                                                      "evidence_id")


def correction_check(spark, sf):
    accepted, rejected = evidence.check_corrections(
        _corrections(spark, sf), extraction.field_values(_wide(spark, sf), fields=["purchaser", "budget"]))
    return accepted.select("correction_id", "previous_value", F.lit(None).cast("string").alias("error")).unionByName(
        rejected.select("correction_id", F.lit(None).cast("string").alias("previous_value"), "error"))


def _versioned(spark, sf):
    k = F.col("notice_id")
    return V.notices(spark, sf).withColumns({
        "extraction_version": F.when(k % 2 == 0, "v2").when(k % 3 == 0, "v1"),
        "detail_url": F.when(k % 5 != 0, F.col("source_url"))})


def version_backfill(spark, sf):
    """Old rows after the backfill: extracted where they have a text, else marked."""
    done = reextraction.backfill(_versioned(spark, sf), fields=["announcement_type"])
    return done.notices.select("notice_id", "extraction_version", "detail_status", "detail_url", "announcement_type")


def _number_corrections(spark, sf):
    return _corrections(spark, sf).where("field_name <> 'colour'")


def backfill_fields(spark, sf):
    """Purchaser and budget of the backfilled rows, with the corrections by hand on top."""
    done = reextraction.backfill(_versioned(spark, sf), corrections=_number_corrections(spark, sf), fields=["purchaser", "budget"])
    return done.fields.where("field_name IN ('purchaser', 'budget')").select("notice_id", "field_name", "value", "status", "evidence_id")


def named_reextraction(spark, sf):
    """Every customer's latest order is asked for again: its fields, or why it is refused."""
    ids = V.load(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("notice_id"))
    done = reextraction.reextract(_versioned(spark, sf), ids, _number_corrections(spark, sf), fields=["purchaser"])
    none = F.lit(None).cast("string")
    return done.fields.where("field_name = 'purchaser'").join(
        done.notices.select("notice_id", "extraction_version", "project_code"), "notice_id").select(
        "notice_id", "value", "method", "extraction_version", "project_code", none.alias("error")).unionByName(
        done.refused.select("notice_id", none.alias("value"), none.alias("method"), none.alias("extraction_version"),
                            none.alias("project_code"), "error"))


N = V.cte("notices")
_FULL = "detail_status = 'full'"
_PRICE = "cast(cast(floor(price) AS bigint) AS string) || '元'"


def _field(field, value, label, gated=True):
    return f"""{N} SELECT notice_id, {value} AS value, '{label}' AS source_label, 'verified' AS status,
  'E-{field}-0' AS evidence_id FROM notices"""


_PAGES = """WITH pg AS (SELECT doc_id, unnest(range(0, greatest(cast(ceil(length(text) / 500) AS bigint), 1))) AS i, text FROM documents),
pages_cut AS (SELECT doc_id, i + 1 AS page, substr(text, i * 500 + 1, 500) AS t FROM pg)"""
_DEADLINE = "cast(order_day + interval 20 day AS date)"
_CN = "cast(year({d}) AS string) || '年' || cast(month({d}) AS string) || '月' || cast(day({d}) AS string) || '日'"
_CODE_RULES = "CASE WHEN notice_id % 5 = 0 THEN 'colour' WHEN notice_id % 2 = 0 THEN 'budget' ELSE 'purchaser' END"
_ERR = """e AS (SELECT doc_id AS k, CASE WHEN doc_id % 5 = 0 THEN 'colour' WHEN doc_id % 2 = 0 THEN 'budget' ELSE 'purchaser' END AS f,
  length(regexp_replace(substr(text, 1, 30), '\\s', '', 'g')) = 0 AS blank FROM documents),
v AS (SELECT k AS notice_id, f AS field_name, CASE WHEN f = 'colour' OR (blank AND k % 3 <> 0) THEN f || ': 字段名、值或原文片段无效'
  WHEN k % 3 = 0 THEN f || ': quote 无法在声明的原文页中定位' WHEN k % 7 = 0 THEN f || ': value 无法在原文中定位' END AS error FROM e)"""

#: The last correction of each notice and field, as text; numbers run over all corrections of a notice.
_LAST_FIX = """c AS (SELECT notice_id, field_name, arg_max(value, n) AS value, max(n) AS n FROM (
  SELECT user_id AS notice_id, ['purchaser', 'budget', 'colour'][event_id % 3 + 1] AS field_name, cast(value AS string) AS value,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error' AND event_id % 3 <> 2)
  GROUP BY notice_id, field_name)"""

ENTRIES = {
    "field_values_purchaser": (_one("purchaser"), _field("purchaser", "buyer", "采购人")),
    "field_values_project_code": (_one("project_code"), _field(
        "project_code", "'ORD' || lpad(cast(notice_id AS string), 8, '0')", "project_code")),
    "field_values_budget": (_one("budget"), _field("budget", _PRICE, "budget")),
    "field_values_deadline": (_one("deadline"), f"""{N} SELECT notice_id,
  CASE WHEN {_DEADLINE} >= DATE '2000-01-01' THEN {_CN.replace('{d}', _DEADLINE)} ELSE {_CN.replace('{d}', _DEADLINE)} END AS value,
  CASE WHEN {_DEADLINE} >= DATE '2000-01-01' THEN '投标截止时间' END AS source_label,
  CASE WHEN {_DEADLINE} >= DATE '2000-01-01' THEN 'verified' ELSE 'structured_metadata' END AS status,
  CASE WHEN {_DEADLINE} >= DATE '2000-01-01' THEN 'E-deadline-0' END AS evidence_id FROM notices"""),
    "field_values_region": (_one("region"), f"""{N} SELECT notice_id, region AS value, NULL AS source_label,
  CASE WHEN region IS NULL THEN 'missing' ELSE 'structured_metadata' END AS status, NULL AS evidence_id FROM notices"""),
    "field_values_content": (_one("content"), f"""{N} SELECT notice_id, replace(title, '公开招标公告', '') AS value,
  NULL AS source_label, 'structured_metadata' AS status, NULL AS evidence_id FROM notices"""),
    "field_values_publish_time": (_one("publish_time_cn"), f"""{N} SELECT notice_id, {_CN.replace('{d}', 'publish_time')} AS value,
  NULL AS source_label, CASE WHEN publish_time IS NULL THEN 'missing' ELSE 'structured_metadata' END AS status,
  NULL AS evidence_id FROM notices"""),
    "field_values_all": (field_values_all, None),
    "qualification_clauses": (qualification_clauses, f"""{N} SELECT notice_id, n AS clause_no, CASE
  WHEN n = 1 AND notice_id % 4 = 0 THEN '3.1 投标人须具备ISO体系认证及营业执照' WHEN n = 1 THEN '3.1 投标人须具备CMMI认证及同类业绩'
  WHEN notice_id % 4 = 0 THEN '3.2 本项目不接受联合体投标且须办理数字证书' ELSE '3.2 允许代理商投标且须在平台完成注册' END AS clause
FROM notices, (VALUES (1), (2)) t(n) WHERE {_FULL} AND notice_id % 2 = 0"""),
    "constraint_flags": (constraint_flags, f"""{N} SELECT notice_id, CASE WHEN notice_id % 4 = 0 THEN '不允许' END AS joint,
  CASE WHEN notice_id % 4 = 2 THEN '允许' END AS agent, CASE WHEN notice_id % 4 = 2 THEN '需要' END AS platform,
  CASE WHEN notice_id % 4 = 0 THEN '需要' END AS ca FROM notices"""),
    "context_fallbacks": (context_fallbacks, f"""{N} SELECT notice_id, '代理' || buyer || '有限公司' AS agency,
  CASE WHEN notice_id % 2 = 0 THEN '国有资金100%' ELSE '企业自筹资金' END AS funding,
  cast(notice_id % 50 AS string) || CASE WHEN notice_id % 3 = 0 THEN '万元' ELSE '元' END AS price FROM notices"""),
    "acquisition_window": (acquisition_window, f"""{N}, d AS (SELECT notice_id, order_day + interval 12 year AS a FROM notices)
SELECT notice_id, {_CN.replace('{d}', 'a')} || ' 09:00' AS start_text,
  {_CN.replace('{d}', '(a + interval 7 day)')} || ' 17:30' AS end_text, {_CN.replace('{d}', '(a + interval 30 day)')} || ' 10:00' AS opening FROM d"""),
    "title_purchaser": (title_purchaser, f"""{N} SELECT notice_id,
  CASE WHEN {_FULL} THEN buyer || CASE WHEN notice_id % 2 = 0 THEN '有限公司' ELSE '管理局' END END AS value,
  CASE WHEN {_FULL} THEN 'inferred' ELSE 'unavailable_no_detail' END AS status FROM notices"""),
    "purchaser_consistency": (purchaser_consistency, f"""{N} SELECT notice_id,
  CASE WHEN notice_id % 2 = 0 THEN buyer ELSE '{C.EXTRACTION_FAILED}' END AS value,
  CASE WHEN notice_id % 2 = 0 THEN 'verified' ELSE 'extraction_failed' END AS status,
  CASE WHEN notice_id % 2 = 0 THEN 'rule_consistency_fallback' ELSE 'rule_consistency_check' END AS method
FROM notices WHERE {_FULL}"""),
    "evidence_page": (evidence_page, _PAGES + r""", q AS (SELECT doc_id, regexp_replace(substr(text, cast(floor(length(text) / 3) AS bigint) + 1, 40), '\s+', '', 'g') AS q FROM documents)
SELECT q.doc_id AS notice_id, min(page) AS found_page FROM q JOIN pages_cut p USING (doc_id)
WHERE q <> '' AND contains(regexp_replace(t, '\s+', '', 'g'), q) GROUP BY 1"""),
    "source_chunks": (source_chunks, r"""WITH RECURSIVE pg AS (SELECT doc_id AS notice_id, p AS page,
  regexp_replace(substr(text, (p - 1) * 500 + 1, 500), '^\s+|\s+$', '', 'g') AS t FROM (SELECT doc_id, text,
  unnest(range(1, greatest(1, cast(ceil(length(text) / 500.0) AS bigint)) + 1)) AS p FROM documents)),
s AS (SELECT notice_id, row_number() OVER (PARTITION BY notice_id ORDER BY page) AS i,
  length('[第' || page || '页]' || chr(10) || t) AS n FROM pg WHERE t <> ''),
r AS (SELECT notice_id, i, n AS used, 1 AS chunk FROM s WHERE i = 1 UNION ALL
  SELECT s.notice_id, s.i, CASE WHEN used + s.n + 2 > 1500 THEN s.n ELSE used + 2 + s.n END,
    CASE WHEN used + s.n + 2 > 1500 THEN chunk + 1 ELSE chunk END FROM r JOIN s ON s.notice_id = r.notice_id AND s.i = r.i + 1)
SELECT notice_id, chunk AS chunk_no, cast(sum(n) + 2 * (count(*) - 1) AS integer) AS chars, false AS truncated
FROM r JOIN s USING (notice_id, i) GROUP BY notice_id, chunk"""),
    "proposal_validation": (proposal_validation, "WITH " + _ERR + " SELECT notice_id, field_name, error FROM v"),
    "proposal_merge": (proposal_merge, "WITH " + _ERR + """, g AS (SELECT notice_id, field_name FROM v WHERE error IS NULL),
b AS (SELECT doc_id AS notice_id, 'budget' AS field_name FROM documents WHERE doc_id % 2 = 0)
SELECT notice_id, field_name, CASE WHEN g.field_name IS NULL THEN 'rule' ELSE 'proposal_validated' END AS method, 'verified' AS status
FROM b FULL JOIN g USING (notice_id, field_name)"""),
    "correction_replay": (correction_replay, """WITH c AS (SELECT user_id, event_id, value, ['purchaser', 'budget', 'colour'][event_id % 3 + 1] AS f,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error')
SELECT user_id AS notice_id, f AS field_name, arg_max(value, n) AS value, 'M-' || f || '-' || cast(max(n) AS string) AS evidence_id
FROM c GROUP BY user_id, f"""),
    "correction_check": (correction_check, N + """, c AS (SELECT event_id, user_id, ['purchaser', 'budget', 'colour'][event_id % 3 + 1] AS f
  FROM events WHERE event_type = 'error')
SELECT event_id AS correction_id, CASE f WHEN 'purchaser' THEN buyer WHEN 'budget' THEN """ + _PRICE + """ END AS previous_value,
  CASE WHEN f = 'colour' THEN '不允许校正的字段: colour' END AS error FROM c LEFT JOIN notices n ON n.notice_id = c.user_id"""),
    "version_backfill": (version_backfill, f"""{N} SELECT notice_id, CASE WHEN {_FULL} THEN 'v2' ELSE 'needs_recrawl' END AS extraction_version,
  CASE WHEN detail_status = 'failed' THEN 'metadata_only' ELSE detail_status END AS detail_status,
  CASE WHEN source_name = 'cebpub' THEN '{C.DETAIL_URL_BASE}?uuid=' || source_item_id || '&inpvalue=&dataSource=0&tenderAgency='
    WHEN notice_id % 5 <> 0 THEN source_url END AS detail_url, '公开招标' AS announcement_type
FROM notices WHERE notice_id % 2 = 1 OR notice_id % 5 = 0"""),
    "backfill_fields": (backfill_fields, f"""{N}, {_LAST_FIX},
f AS (SELECT notice_id, 'purchaser' AS field_name, buyer AS value, '采购人' AS label FROM notices
  UNION ALL SELECT notice_id, 'budget', {_PRICE}, 'budget' FROM notices)
SELECT notice_id, f.field_name, coalesce(c.value, f.value) AS value, CASE WHEN c.value IS NULL THEN 'verified' ELSE 'corrected' END AS status,
  CASE WHEN c.value IS NULL THEN 'E-' || f.field_name || '-0' ELSE 'M-' || f.field_name || '-' || cast(c.n AS string) END AS evidence_id
FROM f JOIN notices USING (notice_id) LEFT JOIN c USING (notice_id, field_name)
WHERE {_FULL} AND (notice_id % 2 = 1 OR notice_id % 5 = 0)"""),
    "named_reextraction": (named_reextraction, f"""{N}, {_LAST_FIX},
ids AS (SELECT max(o_orderkey) AS notice_id FROM orders GROUP BY o_custkey)
SELECT notice_id, CASE WHEN {_FULL} THEN coalesce(c.value, buyer) END AS value,
  CASE WHEN {_FULL} THEN CASE WHEN c.value IS NULL THEN 'rule' ELSE 'manual_correction' END END AS method,
  CASE WHEN {_FULL} THEN 'v2' END AS extraction_version,
  CASE WHEN {_FULL} THEN 'ORD' || lpad(cast(notice_id AS string), 8, '0') END AS project_code,
  CASE WHEN {_FULL} THEN NULL WHEN buyer IS NULL THEN '公告不存在' ELSE '{reextraction.NO_TEXT}' END AS error
FROM ids LEFT JOIN notices USING (notice_id) LEFT JOIN (SELECT * FROM c WHERE field_name = 'purchaser') c USING (notice_id)"""),
}
