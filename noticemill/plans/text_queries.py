"""Registered queries: scalar text, hash, date and region functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticemill import constants as C
from noticemill.functions import dates as D
from noticemill.functions import text as X
from noticemill.plans import views as V

_NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({e},
  '[\[【(（][^\]】)）]*[\]】)）]', '', 'g'), '[，,。．.\-—_：:；;！!？?、/\\|]+', '', 'g'), '\s+', '', 'g'),
  '(?:公开招标公告|竞争性磋商公告|竞争性谈判公告|询价公告|中标公告|成交公告|更正公告|招标公告|采购公告|公告)$', '')"""


def normal_sql(expr: str) -> str:
    """Title normalisation without NFKC, for titles that NFKC leaves alone."""
    return _NORMAL.replace("{e}", f"lower(trim({expr}))")


def title_normal(spark, sf):
    return V.notices(spark, sf).select("notice_id", X.normalize_title(F.col("title")).alias("nt"))


def content_hash(spark, sf):
    return V.doc_candidates(spark, sf).select("notice_id", "content_hash")


def dedup_key(spark, sf):
    docs = V.doc_candidates(spark, sf)
    item = F.when(F.col("notice_id") % 2 == 0, F.col("source_item_id"))
    url = F.when(F.col("notice_id") % 3 != 0, F.col("source_url"))
    return docs.select("notice_id", X.source_key(F.col("source_name"), item, url, F.col("title")).alias("dkey"))


def bid_codes(spark, sf):
    return V.notices(spark, sf).select("notice_id", X.bid_code(F.concat_ws(
        " ", "title", F.regexp_replace("clean_content", "ORD", "ord"))).alias("code"))


def lifecycle(spark, sf):
    kinds = F.expr("element_at(array('', '中标公告', '更正公告', '其他', '终止'), cast(notice_id % 5 as int) + 1)")
    title = F.when(F.col("notice_id") % 2 == 0, F.regexp_replace("title", "公开招标公告", "")).otherwise(F.col("title"))
    return V.view(spark, sf, "notices").select("notice_id", X.lifecycle_type(kinds, title).alias("kind"))


def date_display(spark, sf):
    return V.view(spark, sf, "notices").select(
        "notice_id", D.cn_date(F.col("publish_time").cast("string")).alias("from_text"),
        D.cn_date_of(F.col("publish_time")).alias("from_date"))


def datetime_display(spark, sf):
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    spaced = F.concat(F.date_format("ts", "yyyy 年 M 月 d 日"), F.date_format("ts", " H 时 mm 分"))
    bad = F.when(F.col("event_id") % 5 == 0, F.lit("截止 2026-02-31")).otherwise(F.concat(F.lit("至 "), ts))
    return V.load(spark, sf, "events").select(
        "event_id", D.cn_datetime(ts).alias("shown"), D.normal_datetime(spaced).alias("normal"),
        D.lenient_date(bad).cast("string").alias("parsed"))


def region_tags(spark, sf):
    text = F.concat_ws(" ", F.col("n_name"), F.expr(
        "element_at(array('安徽省合肥市', '上海', '江苏省与浙江省', '广西壮族自治区', '无'), cast(notice_id % 5 as int) + 1)"))
    rows = V.view(spark, sf, "notices").select("notice_id", F.col("region").alias("n_name"))
    return rows.select("notice_id", F.array_join(X.region_tags(text), "、").alias("tags"),
                       F.trim(X.strip_regions(text)).alias("rest"))


def region_lookup(spark, sf):
    """Alias table joined to the notices' region words."""
    lookup = spark.createDataFrame(X.region_alias_pairs(), "alias string, canonical string")
    words = V.view(spark, sf, "notices").select("notice_id", F.expr(
        "element_at(array('皖', '沪', '深圳', '内蒙', '别处'), cast(notice_id % 5 as int) + 1)").alias("alias"))
    return words.join(F.broadcast(lookup), "alias").groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))


def summaries(spark, sf):
    return V.view(spark, sf, "notices").select(
        "notice_id", X.simple_summary(F.col("title"), F.col("clean_content")).alias("summary"))


def short_titles(spark, sf):
    long = F.concat(F.col("title"), F.when(F.col("notice_id") % 2 == 0, F.repeat(F.lit("续"), 20)).otherwise(""))
    return V.view(spark, sf, "notices").select("notice_id", X.short_title(long).alias("short"))


def display_names(spark, sf):
    name = F.when(F.col("notice_id") % 7 == 0, F.lit(None)).otherwise(F.col("source_name"))
    return V.view(spark, sf, "notices").select(
        "notice_id", X.source_display(name).alias("source_display"),
        X.label_of(F.col("detail_status"), C.DETAIL_STATUS_LABELS, F.lit("状态未知")).alias("status_label"))


def detail_urls(spark, sf):
    ident = F.when(F.col("notice_id") % 9 == 0, "").otherwise(F.md5("source_item_id"))
    return V.view(spark, sf, "notices").select("notice_id", X.detail_url(ident).alias("detail_url"))


def text_similarity(spark, sf):
    """Bigram and trigram Jaccard of each document with its text one source over."""
    docs = V.view(spark, sf, "documents").select("doc_id", F.col("text").alias("t"))
    other = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("t").alias("o"))
    both = F.col("t"), F.col("o")
    return docs.join(other, "doc_id").select("doc_id", F.round(X.bigram_jaccard(*both), 6).alias("bigram_jaccard"),
                                             F.round(X.trigram_jaccard(*both), 6).alias("jaccard"))


def content_similarity(spark, sf):
    """Similarity of each document's body with the next one's: whole, and of the first characters only."""
    docs = V.view(spark, sf, "documents").select("doc_id", F.col("text").alias("t"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("o"))
    # the grams are staged, as each mention of an unstaged one would be evaluated again
    pairs = docs.join(other, "doc_id").select("doc_id", "t", "o", *[
        X.char_ngrams(F.col(c) if n is None else F.substring(c, 1, n), 3).alias(name)
        for name, c, n in (("a", "t", None), ("b", "o", None), ("u", F.col("t"), C.SIMILARITY_CHARS), ("v", F.col("o"), C.SIMILARITY_CHARS))])
    blank = (X.text_or_empty(F.col("t")) == "") | (X.text_or_empty(F.col("o")) == "")
    return pairs.select("doc_id", *[F.round(F.when(blank, F.lit(0.0)).otherwise(X.jaccard(F.col(a), F.col(b))), 6).alias(name)
                                    for a, b, name in (("a", "b", "whole"), ("u", "v", "heads"))])


def attachment_sets(spark, sf):
    links = F.array(F.concat(F.lit("http://f/"), F.col("source_item_id"), F.lit("/A.PDF?v=1")),
                    F.concat(F.lit("http://f/x/"), (F.col("notice_id") % 3).cast("string"), F.lit(".doc/")))
    other = F.array(F.lit("http://g/1.doc"), F.lit("http://g/"))
    rows = V.view(spark, sf, "notices").select("notice_id", X.attachment_names(links).alias("a"),
                                               X.attachment_names(other).alias("b"))
    return rows.select("notice_id", F.array_join("a", ",").alias("names"),
                       F.arrays_overlap("a", "b").alias("shared"))


def identity_texts(spark, sf):
    return V.load(spark, sf, "documents").select("doc_id", F.md5(X.identity_text(F.col("text"))).alias("identity"))


def metadata_text(spark, sf):
    empty = F.lit("")
    rows = V.view(spark, sf, "notices")
    return rows.select("notice_id", X.metadata_text(
        F.col("title"), F.col("region"), F.lit("平台"), F.col("source_item_id"), empty,
        F.col("order_day").cast("string"), F.lit(None).cast("string")).alias("body"))


N = V.cte("notices")
_BIGRAMS = "list_distinct(list_transform(range(1, greatest(length(t), 2)), lambda i: substr(t, i, 2)))"
_GRAMS = "list_distinct(list_transform(range(1, greatest(length({t}) - 1, 2)), lambda i: substr({t}, i, 3)))"

ENTRIES = {
    "title_normal": (title_normal, f"{N} SELECT notice_id, {normal_sql('title')} AS nt FROM notices"),
    "content_hash": (content_hash, V.cte("doc_notices") + """
SELECT notice_id, sha256(concat(title, '|', clean_content, '|', source_url)) AS content_hash
FROM doc_notices"""),
    "dedup_key": (dedup_key, V.cte("doc_notices") + """
SELECT notice_id, source_name || ':' || CASE WHEN notice_id % 2 = 0 THEN source_item_id
  WHEN notice_id % 3 <> 0 THEN md5(source_url) ELSE md5(title) END AS dkey FROM doc_notices"""),
    "bid_codes": (bid_codes, f"{N} SELECT notice_id, 'ORD' || lpad(cast(notice_id AS string), 8, '0') AS code FROM notices"),
    "lifecycle_type": (lifecycle, f"""{N} SELECT notice_id, CASE notice_id % 5 WHEN 1 THEN '中标公告' WHEN 2 THEN '更正公告'
  ELSE CASE WHEN notice_id % 2 = 1 THEN '招标公告' WHEN notice_id % 5 = 3 THEN '其他' WHEN notice_id % 5 = 4 THEN '终止'
  ELSE '未知' END END AS kind FROM notices"""),
    "date_display": (date_display, f"""{N}, d AS (SELECT notice_id, CASE WHEN publish_time IS NULL THEN '{C.MISSING}' ELSE
  cast(year(publish_time) AS string) || '年' || cast(month(publish_time) AS string) || '月'
  || cast(day(publish_time) AS string) || '日' END AS x FROM notices)
SELECT notice_id, x AS from_text, x AS from_date FROM d"""),
    "datetime_display": (datetime_display, """SELECT event_id,
  strftime(ts, '%Y年%-m月%-d日 %H:%M') AS shown, strftime(ts, '%Y年%-m月%-d日 %H:%M') AS normal,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS parsed FROM events"""),
    "region_tags": (region_tags, f"""{N} SELECT notice_id,
  CASE notice_id % 5 WHEN 0 THEN '安徽省、合肥市' WHEN 1 THEN '上海市' WHEN 2 THEN '江苏省、浙江省'
    WHEN 3 THEN '广西壮族自治区' ELSE '' END AS tags,
  trim(coalesce(region || ' ', '') || CASE notice_id % 5 WHEN 2 THEN ' 与 ' WHEN 4 THEN '无' ELSE ' ' END) AS rest
FROM notices"""),
    "region_lookup": (region_lookup, f"""{N}, w AS (SELECT CASE notice_id % 5 WHEN 0 THEN '安徽省' WHEN 1 THEN '上海市'
  WHEN 2 THEN '深圳市' WHEN 3 THEN '内蒙古自治区' END AS canonical FROM notices)
SELECT canonical, count(*) AS n FROM w WHERE canonical IS NOT NULL GROUP BY canonical"""),
    "extractive_summary": (summaries, f"""{N} SELECT notice_id, '标题：' || title || chr(10) || '采购人：' || buyer || chr(10)
  || '预算金额：' || cast(cast(floor(price) AS bigint) AS string) || '元' || chr(10) || '投标截止时间：'
  || cast(cast(order_day + interval 20 day AS date) AS string)
  || CASE WHEN notice_id % 2 = 0 THEN chr(10) || '3. 投标人资格要求' ELSE '' END AS summary FROM notices"""),
    "short_title": (short_titles, f"""{N}, t AS (SELECT notice_id, CASE WHEN notice_id % 2 = 0 THEN
  title || repeat('续', 20) ELSE regexp_replace(title, '公开招标公告$', '') END AS x FROM notices)
SELECT notice_id, CASE WHEN length(x) <= 28 THEN x ELSE substr(x, 1, 27) || '…' END AS short FROM t"""),
    "display_names": (display_names, f"""{N} SELECT notice_id, CASE WHEN notice_id % 7 = 0 THEN '{C.MISSING}'
  WHEN source_name = 'ccgp' THEN '中国政府采购网' WHEN source_name = 'cebpub' THEN '中国招标投标公共服务平台'
  ELSE '登录态招采门户' END AS source_display,
  CASE detail_status WHEN 'full' THEN '已核验详情' WHEN 'metadata_only' THEN '仅元数据' WHEN 'failed' THEN '详情失败'
  ELSE '待人工验证' END AS status_label FROM notices"""),
    "detail_url": (detail_urls, f"""{N} SELECT notice_id, CASE WHEN notice_id % 9 = 0 THEN '{C.DETAIL_URL_ROOT}'
  ELSE '{C.DETAIL_URL_BASE}?uuid=' || md5(source_item_id) || '&inpvalue=&dataSource=0&tenderAgency=' END AS detail_url
FROM notices"""),
    "text_similarity": (text_similarity, f"""WITH d AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
g AS MATERIALIZED (SELECT doc_id, {_GRAMS.replace('{t}', 't')} AS x, {_BIGRAMS} AS v FROM d),
p AS (SELECT a.doc_id, a.x, b.x AS y, a.v, b.v AS w FROM g a JOIN g b ON a.doc_id = b.doc_id + 1)
SELECT doc_id, round(len(list_intersect(v, w)) / (len(v) + len(w) - len(list_intersect(v, w))), 6) AS bigram_jaccard,
  round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS jaccard FROM p"""),
    "content_similarity": (content_similarity, f"""WITH d AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t,
  regexp_replace(substr(text, 1, {C.SIMILARITY_CHARS}), '^\\s+|\\s+$', '', 'g') AS u FROM documents),
g AS MATERIALIZED (SELECT doc_id, {_GRAMS.replace('{t}', 't')} AS x, {_GRAMS.replace('{t}', 'u')} AS v FROM d),
p AS (SELECT a.doc_id, a.x, b.x AS y, a.v, b.v AS w FROM g a JOIN g b ON a.doc_id = b.doc_id - 1)
SELECT doc_id, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS whole,
  round(len(list_intersect(v, w)) / (len(v) + len(w) - len(list_intersect(v, w))), 6) AS heads FROM p"""),
    "attachment_names": (attachment_sets, f"""{N} SELECT notice_id, 'a.pdf,' || cast(notice_id % 3 AS string) || '.doc' AS names,
  notice_id % 3 = 1 AS shared FROM notices"""),
    "identity_text": (identity_texts, """SELECT doc_id,
  md5(lower(regexp_replace(text, '[^0-9A-Za-z\\x{4e00}-\\x{9fff}]+', '', 'g'))) AS identity FROM documents"""),
    "metadata_text": (metadata_text, f"""{N} SELECT notice_id, '项目名称：' || title || chr(10) || '区域：'
  || coalesce(region, '{C.MISSING}') || chr(10) || '交易平台：平台' || chr(10) || '项目编号：' || source_item_id || chr(10)
  || '行业：{C.MISSING}' || chr(10) || '公告发布时间：' || cast(order_day AS string) || chr(10) || '公告结束时间：{C.MISSING}'
  || chr(10) || '说明：本条仅使用公开检索接口元数据；完整正文以官方公告详情为准。' AS body FROM notices"""),
}
