"""Views over the provided tables, written once as SQL that Spark and DuckDB both run.

``view(spark, sf_dir, name)`` evaluates one in Spark; ``cte(*names)`` gives the same
text as a WITH clause for the oracle. Names in braces are tables or other views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
TODAY = "1998-06-15"

SQL = {
    "notices": """
SELECT o.o_orderkey AS notice_id, o.o_orderkey AS seq,
  c.c_mktsegment || cast(o.o_orderkey % 500 AS string) || '服务器采购公开招标公告' AS title,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'ccgp' WHEN 1 THEN 'cebpub' ELSE 'login_portal' END AS source_name,
  'http://' || CASE o.o_orderkey % 3 WHEN 0 THEN 'ccgp' WHEN 1 THEN 'cebpub' ELSE 'login_portal' END
    || '/' || cast(o.o_orderkey AS string) AS source_url,
  cast(o.o_orderkey AS string) AS source_item_id,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE cast(o.o_orderdate AS date) END AS publish_time,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE n.n_name END AS region,
  CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'full' WHEN '2' THEN 'full' WHEN '3' THEN 'metadata_only'
    WHEN '4' THEN 'failed' ELSE 'needs_human_verification' END AS detail_status,
  '采购人：' || c.c_name || chr(10) || '项目编号：ORD' || lpad(cast(o.o_orderkey AS string), 8, '0') || chr(10)
    || '预算金额：' || cast(cast(floor(o.o_totalprice) AS bigint) AS string) || '元' || chr(10)
    || '投标截止时间：' || cast(cast(cast(o.o_orderdate AS date) + interval 20 day AS date) AS string)
    || CASE o.o_orderkey % 4
         WHEN 0 THEN chr(10) || '3. 投标人资格要求' || chr(10) || '3.1 投标人须具备ISO体系认证及营业执照'
           || chr(10) || '3.2 本项目不接受联合体投标且须办理数字证书'
         WHEN 2 THEN chr(10) || '3. 投标人资格要求' || chr(10) || '3.1 投标人须具备CMMI认证及同类业绩'
           || chr(10) || '3.2 允许代理商投标且须在平台完成注册'
         ELSE '' END AS clean_content,
  c.c_name AS buyer, o.o_totalprice AS price, cast(o.o_orderdate AS date) AS order_day
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
""",
    "tasks": """
SELECT t.task_id, t.keyword, t.region_key,
  CASE WHEN t.task_id % 9 = 0 THEN NULL ELSE make_date(cast(1995 + t.task_id % 6 AS int), 1, 1) END AS start_date,
  CASE WHEN t.task_id % 8 = 0 THEN NULL ELSE make_date(cast(1995 + t.task_id % 6 AS int), 12, 31) END AS end_date
FROM (SELECT cast(s.region_key * 10 + dense_rank() OVER (PARTITION BY s.region_key ORDER BY s.keyword) AS bigint) AS task_id,
    s.keyword, s.region_key
  FROM (SELECT DISTINCT n.n_regionkey AS region_key, c.c_mktsegment AS keyword
    FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey) s) t
""",
    "doc_notices": """
SELECT doc_id AS notice_id, doc_id AS seq, substr(split_part(text, chr(10), 1), 1, 60) AS title,
  source AS source_name, 'http://' || source || '/' || cast(doc_id AS string) AS source_url,
  cast(doc_id AS string) AS source_item_id, text AS clean_content, lang AS region
FROM {documents}
""",
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return load(spark, sf_dir, name)
    sql = SQL[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _names(sql)})


def cte(*names: str) -> str:
    """WITH clause of the named views and the views they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for used in _names(SQL[name]):
            visit(used)
        order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({SQL[n].format(**{u: u for u in _names(SQL[n])})})" for n in order]
    return "WITH " + ",\n".join(parts)


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with their keyword and region lists."""
    nations = load(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region_key")).agg(
        F.array_sort(F.collect_list("n_name")).alias("regions"))
    return view(spark, sf_dir, "tasks").join(nations, "region_key", "left").select(
        "task_id", F.array("keyword").alias("keywords"), "regions", "start_date", "end_date",
        F.when(F.col("task_id") % 7 == 0, "deleted").otherwise("active").alias("status"))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored notices with the columns every job expects."""
    from noticemill.functions.text import content_hash, source_key

    base = view(spark, sf_dir, "notices")
    return base.select(
        "*", F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("string").alias("raw_content"),
        content_hash(F.col("title"), F.col("clean_content"), F.col("source_url")).alias("content_hash"),
        source_key(F.col("source_name"), F.col("source_item_id"), F.col("source_url"), F.col("title"))
        .alias("deduplication_key"),
        F.concat(F.lit("ORD"), F.lpad(F.col("notice_id").cast("string"), 8, "0")).alias("project_code"),
        F.lit("公开招标").alias("announcement_type"),
        F.when(F.col("notice_id") % 6 == 0, F.array(F.concat(F.lit("http://files/"), F.col("source_item_id"),
                                                             F.lit(".pdf"))))
        .otherwise(F.array().cast("array<string>")).alias("attachment_links"))


def mirrored(base: DataFrame) -> DataFrame:
    """Notices plus copies of every fifth one as a second source shows it."""
    copy = base.where(F.col("notice_id") % 5 == 0).select(
        *[F.col(c) for c in base.columns if c not in (
            "seq", "source_name", "source_url", "source_item_id", "clean_content", "region", "detail_status")],
        (F.col("seq") + 1_000_000_000_000).alias("seq"), F.lit("mirror").alias("source_name"),
        F.concat(F.lit("http://mirror/"), F.col("source_item_id")).alias("source_url"),
        F.concat(F.lit("m"), F.col("source_item_id")).alias("source_item_id"),
        F.concat(F.col("clean_content"), F.lit("\n备注：镜像来源全文。")).alias("clean_content"),
        F.lit("镜像地区").alias("region"),
        F.when(F.col("notice_id") % 10 == 0, "full").otherwise(F.col("detail_status")).alias("detail_status"))
    return base.unionByName(copy.select(*base.columns))


def doc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts as candidates; their exact and near copies are real duplicates."""
    from noticemill.functions.text import content_hash

    base = view(spark, sf_dir, "doc_notices")
    return base.select(
        "*", F.lit(None).cast("date").alias("publish_time"), F.lit("full").alias("detail_status"),
        F.array().cast("array<string>").alias("attachment_links"),
        content_hash(F.col("title"), F.col("clean_content"), F.col("source_url")).alias("content_hash"),
        F.lit(None).cast("string").alias("project_code"), F.lit(None).cast("string").alias("announcement_type"))
