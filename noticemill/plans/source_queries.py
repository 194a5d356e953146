"""Registered queries: pages, list payloads, details, attachments, uploads, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticemill.plans import views as V
from noticemill.sources import documents, pages, payloads, registry

BASE = "http://www.example.org/list/"


def page_text(spark, sf):
    return V.load(spark, sf, "pages").select("page_id", pages.main_text("html").alias("body"))


def page_links(spark, sf):
    return pages.anchor_items(V.load(spark, sf, "pages")).select("page_id", "row_no", "title", "source_url")


def page_attachments(spark, sf):
    extra = F.concat(F.col("html"), F.lit('<a class="x" href="../f/'), F.col("page_id").cast("string"),
                     F.lit('.PDF?v=1">文件</a><a href=\'/d/./y/../z\'>下载 全文</a><a href="mailto:a@b.doc">附件</a>'))
    links = pages.attachment_links(extra, F.lit("https://h.example/a/b/c.html"))
    return V.load(spark, sf, "pages").select("page_id", F.array_join(links, " ").alias("links"))


def _grouped(spark, sf, cell):
    """Ten notices per page, in list order."""
    rows = V.view(spark, sf, "notices").select(F.floor(F.col("notice_id") / 10).alias("page_id"), "notice_id", cell.alias("cell"))
    return rows.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("notice_id", "cell"))),
                                                   lambda r: r["cell"]).alias("cells"))


def list_page_rows(spark, sf):
    """Rows of list pages built from the notices."""
    k = F.col("notice_id")
    day = F.coalesce(F.date_format(F.col("order_day") + F.expr("interval 12 year"), "yyyy.MM.dd"), F.lit(""))
    cell = F.concat(F.lit('<li><a href="'), F.when(k % 2 == 0, "/n/").otherwise("http://x.org/"), k.cast("string"), F.lit('" target=_blank> '),
                    F.col("title"), F.lit("</a><p>摘要</p><span>"), day, F.lit(" 00:00:00 | 采购人："), F.col("buyer"),
                    F.when(k % 3 == 0, " | 安徽省 | x市").otherwise(" | 无"), F.lit("</span></li>"))
    html = F.concat(F.lit('<ul class="nav"><li><a href="/h">首页</a></li></ul><ul class="vT-srch-result-list-bid">'),
                    F.array_join("cells", "\n"), F.lit("</ul>"))
    rows = pages.list_rows(_grouped(spark, sf, cell).select("page_id", html.alias("html")), BASE)
    return rows.select("page_id", "row_no", "title", "source_url", F.col("publish_time").cast("string").alias("day"), "region")


def list_payload_items(spark, sf):
    k = F.col("notice_id")
    cell = F.struct(
        F.when(k % 7 == 0, " ").otherwise(F.col("title")).alias("businessObjectName"), F.col("source_item_id").alias("businessId"),
        F.col("region").alias("regionName"),
        F.when(k % 5 == 0, "1970-01-01").otherwise((F.col("order_day") + F.expr("interval 12 year")).cast("date").cast("string"))
        .alias("receiveTime"), F.col("buyer").alias("transactionPlatfName"))
    body = F.to_json(F.struct(F.struct(F.col("cells").alias("returnlist")).alias("object")))
    rows = payloads.list_items(_grouped(spark, sf, cell).select(F.col("page_id").alias("payload_id"), body.alias("body")))
    return rows.select("source_item_id", "title", "region", F.col("publish_time").cast("string").alias("day"), "snippet")


def _detail_payloads(spark, sf):
    """Nested detail payloads; every fifth carries another id, every seventh another title."""
    k = F.col("notice_id")
    inner = F.struct(F.concat(F.lit("<div class='nav'>x</div><p>"), F.col("buyer"), F.lit("</p>")).alias("bulletinContent"),
                     F.array(F.struct(F.concat(F.lit("http://f/"), F.col("source_item_id"), F.lit(".pdf")).alias("u"))).alias("annexList"))
    wrap = F.struct(F.when(k % 5 == 0, "other").otherwise(F.col("source_item_id")).alias("businessId"),
                    F.when(k % 7 == 0, "别的项目").otherwise(F.col("title")).alias("title"), F.lit("http://no/1").alias("link"),
                    F.array(inner).alias("rows"))
    return V.view(spark, sf, "notices").select(
        k.alias("payload_id"), F.col("source_item_id").alias("business_id"), "title",
        F.to_json(F.struct(F.struct(wrap.alias("wrap")).alias("data"))).alias("body"))


def verified_detail(spark, sf):
    rows = _detail_payloads(spark, sf)
    found = payloads.verified_details(rows).join(rows.select("payload_id", "title"), "payload_id")
    return payloads.detail_text(found).select("payload_id", "detail_text")


def payload_attachments(spark, sf):
    return payloads.attachment_urls(_detail_payloads(spark, sf))


def _uploads(spark, sf):
    """Pages as uploaded files: some empty, some of another type."""
    k = F.col("page_id")
    name = F.concat(F.lit("dir\\"), k.cast("string"), F.when(k % 5 == 0, ".docx").otherwise(".HTML"))
    content = F.when(k % 7 == 0, "").when(k % 11 == 0, "<script>1</script>").otherwise(F.col("html")).cast("binary")
    return V.load(spark, sf, "pages").select(k.alias("notice_id"), name.alias("path"), content.alias("content"))


def upload_gate(spark, sf):
    good, bad = documents.gate(_uploads(spark, sf))
    return good.select("filename", F.lit("ok").alias("code"), "sha256").unionByName(
        bad.select("filename", "code", F.lit(None).cast("string").alias("sha256")))


def document_identity(spark, sf):
    """Which uploads match the notice they are aimed at: by title, by code, or not."""
    k = F.col("page_id")
    aims = V.load(spark, sf, "pages").select(
        k.alias("notice_id"), F.when(k % 3 == 0, "完全不同的标题").otherwise(pages.plain(F.regexp_extract("html", "(?is)<h1>(.*?)</h1>", 1))).alias("title"),
        F.lit("NOPE-12345").alias("project_code"))
    good, bad = documents.tie_to_notices(documents.gate(_uploads(spark, sf))[0], aims)
    return good.select("notice_id", "identity_basis").unionByName(bad.select("notice_id", F.lit(None).cast("string").alias("identity_basis")))


def source_union(spark, sf):
    """Three sources, one of them unreadable: items of the others and a row for each."""
    def part(n):
        return lambda s: V.view(s, sf, "notices").where(F.col("notice_id") % 3 == n).select(
            "seq", "title", "source_url", "source_item_id")

    items, statuses = registry.read_sources(spark, [
        registry.Source("a", part(0)), registry.Source("b", part(1)),
        registry.Source("gone", registry.landed(sf + "/not_there")), registry.Source("login", part(2), not_ready="登录失效")])
    counts = items.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))
    return statuses.join(counts, "source_name", "left").select("source_name", "status", F.coalesce("n", F.lit(0)).alias("n"))


N = V.cte("notices")
_D = "(order_day + interval 12 year)"

ENTRIES = {
    "page_text": (page_text, r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS h FROM pages),
t AS (SELECT page_id, list_transform(string_split(regexp_replace(h, '<[^>]*>', chr(1), 'g'), chr(1)),
  lambda x: regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '^\s+|\s+$', '', 'g')) AS p FROM a)
SELECT page_id, regexp_replace(array_to_string(list_filter(p, lambda x: x <> ''), chr(10)), '[ \t]{2,}', ' ', 'g') AS body FROM t"""),
    "page_links": (page_links, r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS m,
  unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')))) AS pos FROM pages),
b AS (SELECT page_id, pos, trim(regexp_extract(m, '>([^<]*)<', 1)) AS title, regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_extract(m, 'href="([^"]*)"', 1) AS source_url FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS row_no FROM b WHERE length(title) >= 8)
SELECT page_id, row_no, title, source_url FROM c"""),
    "page_attachments": (page_attachments, """SELECT page_id, 'https://h.example/a/f/' || page_id || '.PDF?v=1 https://h.example/d/z' AS links FROM pages"""),
    "list_page_rows": (list_page_rows, f"""{N} SELECT notice_id // 10 AS page_id, row_number() OVER (PARTITION BY notice_id // 10 ORDER BY notice_id) AS row_no, title,
  CASE WHEN notice_id % 2 = 0 THEN 'http://www.example.org/n/' ELSE 'http://x.org/' END || notice_id AS source_url, strftime({_D}, '%Y-%m-%d') AS day,
  CASE WHEN notice_id % 3 = 0 THEN '安徽省' END AS region FROM notices"""),
    "list_payload_items": (list_payload_items, f"""{N} SELECT source_item_id, title, region,
  CASE WHEN notice_id % 5 = 0 OR year({_D}) < 2000 THEN NULL ELSE strftime({_D}, '%Y-%m-%d') END AS day, buyer AS snippet FROM notices WHERE notice_id % 7 <> 0"""),
    "verified_detail": (verified_detail, N + """SELECT notice_id AS payload_id, '项目名称：' || title || chr(10) || '公告正文：' || chr(10) || buyer AS detail_text
FROM notices WHERE notice_id % 5 <> 0 AND notice_id % 7 <> 0"""),
    "payload_attachments": (payload_attachments, N + "SELECT notice_id AS payload_id, 'http://f/' || source_item_id || '.pdf' AS url FROM notices"),
    "upload_gate": (upload_gate, """SELECT cast(page_id AS string) || CASE WHEN page_id % 5 = 0 THEN '.docx' ELSE '.HTML' END AS filename,
  CASE WHEN page_id % 7 = 0 THEN 'empty_upload' WHEN page_id % 5 = 0 THEN 'unsupported_type' WHEN page_id % 11 = 0 THEN 'empty_html' ELSE 'ok' END AS code,
  CASE WHEN page_id % 7 <> 0 AND page_id % 5 <> 0 AND page_id % 11 <> 0 THEN sha256(html) END AS sha256 FROM pages"""),
    "document_identity": (document_identity, """SELECT page_id AS notice_id, CASE WHEN page_id % 3 <> 0
  AND regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '[^0-9A-Za-z]', '', 'g') <> '' THEN 'title' END AS identity_basis
FROM pages WHERE page_id % 7 <> 0 AND page_id % 5 <> 0 AND page_id % 11 <> 0"""),
    "source_union": (source_union, N + """SELECT s AS source_name, st AS status, (SELECT count(*) FROM notices WHERE notice_id % 3 = m) AS n
FROM (VALUES ('a', 'success', 0), ('b', 'success', 1), ('gone', 'failed', 9), ('login', 'skipped', 9)) v(s, st, m)"""),
}
