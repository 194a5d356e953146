"""Subscriptions joined to notices without a cross join.

A keyword can only occur in a text that holds each of its bigrams. One of them, not
part of the words that every listed text contains (such as 采购) where the keyword has
such a one, is its anchor. A text's bigrams are narrowed to the anchors in use before the
row is widened, meet the *distinct* keywords by equi-join, and only keywords that do
occur meet the subscriptions. Each side is broadcast only while its checked size
allows it; beyond that the same equi-joins shuffle and AQE splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill import constants as C
from noticemill.functions.text import short_region, text_or_empty
from noticemill.operators import filters
from noticemill.session import broadcast_if_small

_TASK_COLUMNS = ("task_id", "keywords", "regions", "start_date", "end_date")


#: Anchors up to which a text's bigrams are narrowed by a list inside the plan.
ANCHOR_LIST = 5_000
#: Anchors up to which each is looked for in a text; cutting the text into bigrams costs as much as some dozens of these.
ANCHORS_SOUGHT = 64
_COMMON = sorted({w[i:i + 2] for w in C.TENDER_TERMS for i in range(len(w) - 1)})


def _rare_anchor(term):
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(term) - 1, F.lit(1))), lambda i: F.substring(term, i, F.lit(2)))
    return F.coalesce(F.try_element_at(F.filter(grams, lambda g: ~g.isin(_COMMON)), F.lit(1)), F.substring(term, 1, 2))


def _anchors(texts: str, with_single: bool):
    t = F.col(texts)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))),
                        lambda i: F.substring(t, i, F.lit(2)))
    if with_single:
        grams = F.concat(grams, F.split(t, ""))
    return F.array_distinct(grams)


def _region_probes():
    """Regions and their short forms, worked out once per subscription, not per pair."""
    names = F.coalesce("regions", F.array().cast("array<string>"))
    short = F.filter(F.transform(names, lambda r: short_region(r)), lambda r: r != "")
    return F.array_distinct(F.concat(names, short))


def _accepted(df: DataFrame) -> DataFrame:
    """The region and date conditions of the list stage for item × subscription rows."""
    region = F.col("region")
    where = F.concat(region, F.lit(" "), F.col("title"))
    return df.where(
        ((text_or_empty(region) == "") | (F.size("t_regions") == 0)
         | F.exists("t_regions", lambda p: F.contains(where, p)))
        & filters.in_date_range(F.col("publish_time"), F.col("t_start"), F.col("t_end"))
    )


def match_subscriptions(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every (item, subscription) pair that passes all list-stage conditions.

    ``items`` keeps its columns and gains ``task_id``. A pair appears once: the row
    kept is the one whose keyword is the first of the subscription's keywords found.
    """
    side = tasks.select(
        "task_id", F.coalesce("keywords", F.array().cast("array<string>")).alias("t_keywords"),
        _region_probes().alias("t_regions"), F.col("start_date").cast("date").alias("t_start"),
        F.col("end_date").cast("date").alias("t_end"))
    keep = [F.col(c) for c in items.columns] + [F.col("task_id")]
    texts = items.withColumn("_blob", filters.list_blob()).where(filters.tender_like(F.col("_blob")))

    terms = (side.where(F.size("t_keywords") > 0)
             .withColumn("term", F.explode(F.array_distinct("t_keywords"))).where("term <> ''"))
    words = terms.select("term").distinct().withColumn("anchor", _rare_anchor(F.col("term")))
    single = not terms.where(F.length("term") == 1).isEmpty()
    used = [r.anchor for r in words.select("anchor").distinct().limit(ANCHOR_LIST + 1).collect()]
    listed = F.array(*[F.lit(a) for a in used]).cast("array<string>")
    if len(used) <= ANCHORS_SOUGHT:
        grams = F.filter(listed, lambda a: F.contains(F.col("_blob"), a))
    elif len(used) <= ANCHOR_LIST:
        grams = F.array_intersect(_anchors("_blob", single), listed)
    else:
        grams = _anchors("_blob", single)
    by_term = (
        texts.withColumn("anchor", F.explode_outer(grams))
        .join(broadcast_if_small(words), "anchor").drop("anchor")
        .where(F.contains("_blob", F.col("term")))
        .join(broadcast_if_small(terms), "term")
        .where(F.element_at(F.filter("t_keywords", lambda k: (k != "") & F.contains(F.col("_blob"), k)), 1)
               == F.col("term"))
    )
    out = _accepted(by_term).select(*keep)

    wild = side.where(F.size("t_keywords") == 0)
    if not wild.isEmpty():
        out = out.unionByName(_match_by_month(texts, wild).select(*keep))
    return out


def _match_by_month(texts: DataFrame, wild: DataFrame) -> DataFrame:
    """Subscriptions without keywords meet the notices of their months by equi-join."""
    month = F.trunc(F.col("publish_time").cast("date"), "month")
    lo, hi = texts.agg(F.min(month), F.max(month)).first()
    first = F.trunc(F.coalesce(F.greatest("t_start", F.lit(lo)), F.lit(lo)), "month")
    last = F.trunc(F.coalesce(F.least("t_end", F.lit(hi)), F.lit(hi)), "month")
    months = F.when(first <= last, F.transform(
        F.sequence(first, F.greatest(first, last), F.expr("interval 1 month")), lambda d: d.cast("string")))
    buckets = wild.withColumn("bucket", F.explode(F.concat(
        F.coalesce(months, F.array().cast("array<string>")), F.array(F.lit("none")))))
    return _accepted(texts.withColumn("bucket", F.coalesce(month.cast("string"), F.lit("none")))
                     .join(broadcast_if_small(buckets), "bucket"))


def match_reasons(items: DataFrame, task: filters.Criteria) -> DataFrame:
    """Items against one subscription with the first failing reason."""
    return filters.filter_list(items, task)
