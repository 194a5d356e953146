"""One run from landed items to delivered report tables.

items → list conditions → details → detail conditions → merged batch → store →
what is new per subscription → report tables → history, committed last.

Duplicates are merged once per batch over everything any subscription accepted; a
kept notice is delivered to each subscription that accepted one of its members.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticemill.functions import text as X
from noticemill.operators import aggregates, dedup, delivery, filters, matching, reextraction, reports, store_merge
from noticemill.session import broadcast_if_small, cut_lineage
from noticemill.sources import schemas
from noticemill.sources.store import Table, VersionedStore

STATE = {"notices": Table(schemas.NOTICE, "keyed", ("notice_id",)), "sources": Table(schemas.NOTICE_SOURCE, "rows"),
         "reasons": Table(schemas.NOTICE_REASON, "rows"), "attachments": Table(schemas.NOTICE_LINK, "rows"),
         "lifecycle": Table(schemas.LIFECYCLE, "rows"), "history": Table(schemas.HISTORY, "keyed", ("task_id", "notice_id")),
         "pending": Table(schemas.PENDING, "keyed", ("item_key",)), "corrections": Table(schemas.CORRECTION, "rows"),
         "fields": Table(schemas.FIELD, "keyed", ("notice_id", "field_name"))}
#: By what a record finds its stored notice and its siblings.
MATCH_COLUMNS = ["notice_id", "is_primary", "project_code", "announcement_type", "deduplication_key", "content_hash",
                 "source_name", "source_url"]
#: Waiting items go before those of the next batch; this shift keeps their numbers apart.
PENDING_SHIFT = 1 << 40


@dataclass
class RunResult:
    outcomes: DataFrame
    report: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)


def open_state(spark: SparkSession, root: str) -> VersionedStore:
    return VersionedStore(spark, root, STATE)


def chosen_details(details: DataFrame, urls: DataFrame) -> DataFrame:
    """One detail for each URL of the batch: a full one before others, then the longest, then by its text.

    The landed details are narrowed to the batch's URLs before anything wide moves.
    """
    mine = details.drop("source_name").join(broadcast_if_small(urls.select("source_url").distinct()), "source_url", "left_semi")
    text = X.text_or_empty(F.col("clean_content"))
    best = F.struct(F.coalesce(F.col("detail_status") == "full", F.lit(False)), F.length(text), F.sha2(text, 256),
                    F.coalesce("title", F.lit("")), F.coalesce(F.col("publish_time").cast("string"), F.lit("")))
    rest = [c for c in mine.columns if c != "source_url"]
    return mine.groupBy("source_url").agg(F.max_by(F.struct(*rest), best).alias("d")).select("source_url", "d.*")


def due_items(state: VersionedStore, details: DataFrame) -> DataFrame:
    """Waiting items whose turn it is: held back by a cap, or waiting for a detail that has landed since."""
    waiting = state.read("pending").withColumn("seq", F.col("seq") - PENDING_SHIFT)
    urls = waiting.where("why = 'detail'").select("source_url").distinct()
    landed = details.where("detail_status IS NOT NULL").select("source_url").join(
        broadcast_if_small(urls), "source_url", "left_semi").distinct().withColumn("_landed", F.lit(True))
    joined = waiting.join(broadcast_if_small(landed), "source_url", "left")
    return joined.where("why = 'cap' OR _landed").select(*waiting.columns)


def item_key() -> F.Column:
    """What makes an item that comes again the same while it waits."""
    return F.sha2(F.to_json(F.struct("source_name", "source_url", "source_item_id", "title")), 256)


def waiting_changes(items: DataFrame, due: DataFrame, trail: DataFrame) -> DataFrame:
    """Changes of the waiting items: those that no longer wait, and those that now do, once each.

    An item waits as long as a task that wants it found no place below its cap or no detail.
    """
    why = trail.where("outcome IN ('cap_skipped', 'detail_failed')").groupBy("seq").agg(
        F.min(F.when(F.col("outcome") == "cap_skipped", "cap").otherwise("detail")).alias("why"))
    waits = items.join(why, "seq").withColumn("item_key", item_key()).withColumn("is_gone", F.lit(False))
    first = waits.groupBy("item_key").agg(F.min_by(F.struct(*[c for c in waits.columns if c != "item_key"]), "seq").alias("i"))
    first = first.select("item_key", "i.*")
    over = due.join(first.select("item_key"), "item_key", "left_anti").withColumn("is_gone", F.lit(True))
    return first.unionByName(over.select(*first.columns))


def accepted_details(items: DataFrame, details: DataFrame, tasks: DataFrame, cap: int | None) -> tuple[DataFrame, DataFrame]:
    """(outcome and reason of each task × item that passed the list, accepted items once each)."""
    pairs = matching.match_subscriptions(items.select(
        "seq", "source_name", "title", "source_url", "source_item_id", "publish_time", "snippet", "region"), tasks)
    wanted = pairs.select("task_id", "source_name", "seq", "source_url", "source_item_id", F.col("title").alias("_title"),
                          F.col("publish_time").alias("_day"), F.col("region").alias("_region"))
    skipped = None
    if cap is not None:
        wanted = cut_lineage(wanted)
        kept = filters.cap_details(wanted.select("task_id", "source_name", "seq"), cap, keys=("task_id", "source_name"))
        skipped = wanted.join(kept.select("task_id", "seq"), ["task_id", "seq"], "left_anti").select(
            "task_id", "seq", "source_name", F.lit("cap_skipped").alias("outcome"), F.lit(None).cast("string").alias("reason"),
            F.lit(None).cast("string").alias("detail_status"))
        wanted = wanted.join(kept.select("task_id", "seq"), ["task_id", "seq"], "left_semi")
    # a missing detail is an exception of the detail stage
    joined = wanted.join(chosen_details(details, items), "source_url", "left").withColumns({
        "region": F.coalesce("region", "_region"), "title": F.coalesce("title", "_title")})
    side = broadcast_if_small(tasks.select("task_id", "keywords", "regions", "start_date", "end_date"))
    reason = filters.detail_reason(filters.Criteria(*[F.col(c) for c in ("keywords", "regions", "start_date", "end_date")]))
    both = joined.join(side, "task_id").withColumn("reason", F.when(F.col("detail_status").isNotNull(), reason))
    verdict = F.when(F.col("detail_status").isNull(), "detail_failed").when(F.col("reason").isNull(), "candidate").otherwise(
        "detail_filtered")
    judged = cut_lineage(both.withColumn("outcome", verdict).drop("keywords", "regions", "start_date", "end_date", "_title",
                                                                 "_day", "_region"))
    chosen = judged.where("outcome = 'candidate'").drop("task_id", "outcome", "reason").dropDuplicates(["seq"])
    trail = judged.select("task_id", "seq", "source_name", "outcome", "reason", "detail_status")
    return trail if skipped is None else trail.unionByName(skipped), chosen


def run_funnel(items: DataFrame, tasks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Counts of each task from the first raw item on; what the list conditions drop is counted, not listed."""
    def n(*names: str) -> F.Column:
        return F.count_if(F.col("outcome").isin(*names))

    raw = items.agg(F.count(F.lit(1)).alias("raw_count"))
    per_task = outcomes.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("kept"), n("cap_skipped").alias("cap_skipped"), n("detail_failed").alias("detail_failed"),
        n("detail_filtered").alias("detail_filtered"), n("primary", "merged").alias("candidates"), n("merged").alias("merged"),
        n("primary").alias("primaries"))
    counts = [c for c in per_task.columns if c not in ("task_id", "kept")]
    return (tasks.select("task_id").join(per_task, "task_id", "left").withColumn("raw_count", F.lit(raw.first().raw_count))
            .select("task_id", "raw_count", (F.col("raw_count") - F.coalesce("kept", F.lit(0))).alias("list_filtered"),
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in counts]))


def as_candidates(accepted: DataFrame) -> DataFrame:
    t, c, u = F.col("title"), F.col("clean_content"), F.col("source_url")
    code = X.bid_code(F.concat_ws(" ", t, X.text_or_empty(c)))
    kind = F.regexp_extract(F.concat_ws("\n", t, c), "(?Ud)" + _type_pattern(), 1)
    return accepted.withColumns({
        "content_hash": X.content_hash(t, c, u),
        "deduplication_key": X.source_key(F.col("source_name"), F.col("source_item_id"), u, t),
        "detail_url": F.when((F.col("source_name") == "cebpub") & (X.text_or_empty(F.col("source_item_id")) != ""),
                             X.detail_url(F.col("source_item_id"))).otherwise(u),
        "summary": X.simple_summary(t, c), "project_code": code, "announcement_type": X.blank_to_null(kind),
        "attachment_links": F.coalesce("attachment_links", F.array().cast("array<string>"))})


def _type_pattern() -> str:
    from noticemill.constants import TYPE_PATTERN

    return TYPE_PATTERN


def run_batch(state: VersionedStore, version: int, items: DataFrame, details: DataFrame, tasks: DataFrame, now: str,
              report_root: str | None = None, mode: str = "incremental", cap: int | None = None,
              fold_limit: int = dedup.FOLD_LIMIT, status: str = "success", extract: bool = True) -> RunResult | None:
    """Process one batch as ``version`` of the state; a committed version is not run again.

    With a ``cap`` at most so many items of a task and source are looked up; the others wait in the state for the next
    version. Items whose detail has not landed wait for it. The fields of new and changed notices are extracted, with the
    corrections made to them on top, unless ``extract`` is off. ``status`` is that of the sources' reading (success, partial, failed); a failed one delivers nothing.
    """
    if state.is_committed(version):
        return None
    live = filters.live_tasks(tasks)
    due = cut_lineage(due_items(state, details))
    items = cut_lineage(items.select(*schemas.LIST_ITEM.fieldNames()).unionByName(due.select(*schemas.LIST_ITEM.fieldNames())))
    trail, accepted = accepted_details(items, details, live, cap)
    candidates = cut_lineage(as_candidates(accepted))
    merged = dedup.deduplicate(candidates, fold_limit)
    ids = merged.primaries.withColumn("notice_id", F.substring(F.sha2(F.concat_ws(
        "|", F.lit(str(version)), "deduplication_key", F.col("seq").cast("string")), 256), 1, 32))
    records = cut_lineage(ids)

    def held(keys: DataFrame) -> DataFrame:
        return state.read("notices", among=keys)

    delta = store_merge.upsert(records, state.read("notices", MATCH_COLUMNS), now, held)
    matches = cut_lineage(delta.matches)
    changed = cut_lineage(delta.changed)
    if extract:
        corrections = state.read("corrections").join(broadcast_if_small(changed.select("notice_id")), "notice_id", "left_semi")
        fields = state.stage_changes(version, "fields", reextraction.extracted_fields(changed, corrections))
        changed = reextraction.with_fields(changed, fields, code=False)
    notices = state.stage_changes(version, "notices", changed)
    slots = matches.select(F.col("seq").alias("slot_seq"), "notice_id", "matched")
    absorbed = cut_lineage(dedup.absorbed_sources(merged, candidates).join(slots, "slot_seq"))
    sources = delta.sources.unionByName(absorbed.select("notice_id", "seq", "source_name", "source_url", "reason"))

    def add(table: str, rows: DataFrame, keys: list[str]) -> None:
        state.stage_changes(version, table, store_merge.new_rows(state.read(table), rows, keys))

    add("sources", sources, ["notice_id", "source_url", "source_name"])
    # a stored notice that is met again without a merge of its own says so
    merges = absorbed.where("reason IS NOT NULL").select("notice_id", "reason").distinct()
    add("reasons", merges.unionByName(delta.reasons.join(merges.select("notice_id"), "notice_id", "left_anti")), ["notice_id", "reason"])
    attachments = delta.attachments
    if merged.more_links is not None:
        attachments = attachments.unionByName(merged.more_links.join(slots, "slot_seq").select("notice_id", "link"))
    add("attachments", attachments, ["notice_id", "link"])
    add("lifecycle", delta.lifecycle, ["notice_id", "announcement_id"])
    state.stage_changes(version, "pending", waiting_changes(items, due, trail))

    slot_of = merged.members.select("seq", "slot_seq", "is_primary")
    placed = slot_of.join(slots, "slot_seq")
    delivered_to = trail.where("outcome = 'candidate'").join(placed, "seq")
    hashes = notices.select("notice_id", "content_hash")
    current = delivered_to.select("task_id", "notice_id").distinct().join(hashes, "notice_id")
    history = state.read("history", among=current)
    plan = cut_lineage(delivery.plan_delivery(current, history, mode))

    # one row per (task, raw item); members of one slot count as merged for that task
    lead = delivered_to.groupBy("task_id", "slot_seq").agg(F.min(F.struct(~F.col("is_primary"), "seq")).alias("lead"))
    done = (delivered_to.join(lead, ["task_id", "slot_seq"])
            .join(plan.select("task_id", "notice_id", "change"), ["task_id", "notice_id"], "left")
            .select("task_id", "seq", "source_name", "detail_status", "notice_id", F.col("matched").alias("store_matched"),
                    "change", F.when(F.col("seq") == F.col("lead.seq"), "primary").otherwise("merged").alias("outcome")))
    outcomes = trail.where("outcome <> 'candidate'").unionByName(done, allowMissingColumns=True)

    due = plan.where("change <> 'skipped'").withColumn("change_label", delivery.change_label(mode))
    report = due.join(notices.drop("content_hash"), "notice_id")
    tables = {"items": report, "plan_counts": delivery.plan_counts(plan), "detail_counts": aggregates.detail_counts(outcomes, ["task_id"]),
              "members": merged.members, "funnel": run_funnel(items, live, outcomes)}
    if mode == "full_snapshot":
        tables = {"items": store_merge.snapshot_rows(candidates, dedup.duplicate_hints(candidates)), "members": merged.members}
    if report_root:
        reports.write_tables(tables, f"{report_root}/v={version}")
    # history moves last: only a written incremental report may mark anything as delivered
    allowed = delivery.delivery_allowed(status, mode, not due.isEmpty(), bool(report_root))
    if allowed:
        state.stage_changes(version, "history", delivery.delivered_rows(history, plan, now, f"report-{version}"))
    state.commit(version)
    return RunResult(outcomes, report, tables)
