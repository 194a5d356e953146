"""JSON payloads: list rows, verified details, attachment URLs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill import constants as C
from noticemill.functions import dates as D
from noticemill.functions import text as X
from noticemill.functions.text import blank_to_null, strip, text_or_empty
from noticemill.sources.pages import main_text
from noticemill.session import cut_lineage
from noticemill.sources.schemas import LIST_PAYLOAD

# fixed values: keys of the detail payload, in order of preference
ID_KEYS = ("businessId", "businessID", "id")
TITLE_KEYS = ("businessObjectName", "title", "projectName", "tenderProjectName")
DETAIL_KEYS = ("bulletinContent", "content", "noticeContent", "htmlContent", "tendererName", "tenderAgencyName",
               "qualificationRequirements")
BODY_KEYS = ("bulletinContent", "content", "noticeContent", "htmlContent")
LABEL_KEYS = (
    ("项目名称", ("businessObjectName", "projectName", "tenderProjectName")),
    ("招标人名称", ("tendererName", "tenderName", "purchaserName", "purchaser")),
    ("招标代理机构", ("tenderAgencyName", "agencyName", "tenderAgentName")),
    ("项目编号", ("tenderProjectCode", "projectCode", "tenderCode")),
    ("公告发布时间", ("receiveTime", "publishTime", "bulletinIssueTime")),
    ("公告结束时间", ("bulletinEndTime", "endTime")),
    ("投标人资格要求", ("qualificationRequirements", "qualificationRequirement", "qualification")),
)
BODY_CHARS = 30_000
TITLE_PROBE = 16
TITLE_PROBE_MIN = 6
#: Levels of a payload that are walked before what is left is stored.
LEVELS = 8


def list_items(payloads: DataFrame) -> DataFrame:
    """Rows of list payloads (payload_id, body): one item per entry with a title."""
    rows = payloads.select("payload_id", F.posexplode_outer(F.from_json("body", LIST_PAYLOAD)["object"]["returnlist"])
                           .alias("pos", "r")).where("r IS NOT NULL")
    title = strip(text_or_empty(F.col("r.businessObjectName")))
    return rows.select(
        "payload_id", (F.col("pos") + 1).alias("row_no"), title.alias("title"),
        X.detail_url(F.col("r.businessId")).alias("source_url"), blank_to_null(F.col("r.businessId")).alias("source_item_id"),
        D.list_date(F.when(~F.startswith("r.receiveTime", F.lit("1970")), F.col("r.receiveTime"))).alias("publish_time"),
        F.substring(text_or_empty(F.col("r.transactionPlatfName")), 1, 200).alias("snippet"),
        blank_to_null(strip(F.col("r.regionName"))).alias("region"),
        X.metadata_text(title, blank_to_null(strip(F.col("r.regionName"))), F.col("r.transactionPlatfName"),
                        F.col("r.tenderProjectCode"), F.col("r.industriesType"), F.col("r.receiveTime"),
                        F.col("r.bulletinEndTime")).alias("metadata_text"),
    ).where("title <> ''")


def _scalar(node: Column, key: str) -> Column:
    """Text of a key that holds a plain value."""
    text = F.try_variant_get(node, "$." + key, "string")
    # most keys are absent, and what a key holds is only looked at where it has a text
    return F.when(text.isNotNull() & ~_is_container(F.try_variant_get(node, "$." + key, "variant")), blank_to_null(strip(text)))


def first_value(node: Column, keys) -> Column:
    return F.coalesce(*[_scalar(node, k) for k in keys])


def _children(level: DataFrame, keep: list[str]) -> DataFrame:
    """One row per child of every object or array node."""
    cols = ", ".join(f"n.{c}" for c in keep)
    return level.sparkSession.sql(
        "SELECT " + cols + ", n.path AS up, c.pos, c.key, c.value AS node FROM {nodes} n, LATERAL variant_explode(n.node) c",
        nodes=level)


def _is_container(node: Column) -> Column:
    return F.rlike(F.schema_of_variant(node), F.lit("^(OBJECT|ARRAY)"))


def _next_level(children: DataFrame) -> DataFrame | None:
    """The children that hold further nodes, computed once; None when there are none."""
    deeper = cut_lineage(children.where(_is_container(F.col("node"))).withColumn("node", F.to_json("node")))
    return None if deeper.isEmpty() else deeper.withColumn("node", F.parse_json("node"))


def _any_key(node: Column, keys) -> Column:
    """Whether a node holds one of the keys, with any value but null."""
    return F.coalesce(*[F.try_variant_get(node, "$." + k, "variant") for k in keys]).isNotNull()


def _says(node: Column, keys, value: Column) -> Column:
    """Whether the first key that holds a plain value holds this one; most nodes have none, and are told by it at once."""
    some = [strip(F.try_variant_get(node, "$." + k, "string")) == value for k in keys]
    return F.coalesce(functools.reduce(lambda x, y: x | y, [F.coalesce(c, F.lit(False)) for c in some])
                      & (first_value(node, keys) == value), F.lit(False))


def _down(level: DataFrame) -> DataFrame:
    """Nodes judged and replaced by their children; a hit stays as it is, as it stands before all nodes inside it."""
    node = F.col("node")
    titled = F.coalesce(F.contains(X.word_text(F.coalesce(first_value(node, TITLE_KEYS), F.lit(""))), F.col("probe")), F.lit(False))
    told = level.withColumn("verified", F.when(F.col("verified"), True).otherwise(_says(node, ID_KEYS, F.col("business_id")) & titled))
    judged = told.withColumn("hit", F.when(F.col("hit"), True).when(F.col("verified"), _any_key(node, DETAIL_KEYS)).otherwise(False))
    below = F.coalesce(F.map_values(F.try_variant_get(node, "$", "map<string,variant>")), F.try_variant_get(node, "$", "array<variant>"))
    ids = ["payload_id", "business_id", "probe", "verified", "hit"]
    kids = judged.select(*ids, F.col("path").alias("up"), F.posexplode(F.when(F.col("hit"), F.array(node)).otherwise(below)).alias("pos", "node"))
    return kids.select(*ids, F.when(F.col("hit"), F.col("up")).otherwise(F.array_append("up", F.col("pos"))).alias("path"), "node")


def verified_details(payloads: DataFrame) -> DataFrame:
    """First detail node of each payload that can be tied to its list item.

    Needs payload_id, business_id, title, body. A node counts if its id is equal and
    the head of the item's title occurs in its title, or if a node around it does.
    ``LEVELS`` levels are walked in one stage, until no container is left; siblings come in key order.
    """
    probe = F.substring(X.word_text(F.col("title")), 1, TITLE_PROBE)
    level = payloads.select("payload_id", "business_id", probe.alias("probe"), "body").where(
        (F.col("business_id") != "") & (F.length("probe") >= TITLE_PROBE_MIN)).select(
        "payload_id", "business_id", "probe", F.lit(False).alias("verified"), F.lit(False).alias("hit"),
        F.array().cast("array<int>").alias("path"), F.try_parse_json("body").alias("node"))
    found = None
    while True:
        for _ in range(LEVELS):
            level = _down(level)
        left = level.where(F.col("hit") | _is_container(F.col("node"))).withColumn("node", F.to_json("node"))
        walked = cut_lineage(left)
        hits = walked.where("hit").select("payload_id", "path", F.col("node").alias("body"))
        found = hits if found is None else found.unionByName(hits)
        level = walked.where("NOT hit")
        if level.isEmpty():
            break
        level = level.withColumn("node", F.parse_json("node"))
    return found.groupBy("payload_id").agg(F.min_by("body", "path").alias("detail"))


def detail_text(details: DataFrame, title: str = "title") -> DataFrame:
    """Labelled lines of a verified detail plus its body text (column ``detail_text``)."""
    node = F.parse_json("detail")
    staged = details.withColumn("_node", node).withColumns({
        "_body": F.substring(main_text(first_value(F.col("_node"), BODY_KEYS)), 1, BODY_CHARS),
        "_values": F.array(*[first_value(F.col("_node"), keys) for _label, keys in LABEL_KEYS])})
    lines = []
    for i, (label, _keys) in enumerate(LABEL_KEYS):
        value = F.get("_values", F.lit(i))
        lines.append(F.concat(F.lit(label + "："), F.coalesce(value, F.col(title)) if i == 0 else value))
    body = text_or_empty(F.col("_body"))
    others = F.array_compact(F.slice("_values", 2, len(LABEL_KEYS) - 1))
    text = F.concat_ws("\n", *lines, F.when(body != "", F.concat(F.lit("公告正文：\n"), body)))
    empty = (body == "") & (F.size(others) == 0)
    return staged.withColumn("detail_text", F.when(empty, "").otherwise(text)).drop("_node", "_body", "_values")


def attachment_urls(payloads: DataFrame) -> DataFrame:
    """(payload_id, url) of http texts below keys that name attachments, any depth."""
    level = payloads.select("payload_id", F.lit("").alias("path"), F.lit(False).alias("inside"),
                            F.try_parse_json("body").alias("node"))
    found = None
    while True:
        below = _children(level, ["payload_id", "inside"]).withColumn(
            "inside", F.col("inside") | X.matches(F.col("key"), "(?i)" + C.ATTACHMENT_KEY_PATTERN))
        url = strip(F.try_variant_get("node", "$", "string"))
        hits = below.where("inside").where(~_is_container(F.col("node"))).select("payload_id", url.alias("url")).where(
            F.rlike("url", F.lit("^https?://")))
        found = hits if found is None else found.unionByName(hits)
        deeper = _next_level(below)
        if deeper is None:
            break
        level = deeper.select("payload_id", F.lit("").alias("path"), "inside", "node")
    return found.distinct()
