"""State by changes, items whose detail lands late, and re-extraction over the stored state."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noticemill.operators import reextraction
from noticemill.plans import reextract, run
from noticemill.sources import schemas
from noticemill.sources.store import Table, VersionedStore
from test_run import D1, DETAILS, ITEMS, TASKS, TITLE, detail, item

KEYED = schemas._struct(k=schemas.S, v=schemas.L, is_gone=schemas.B)


def test_latest_row_of_each_key_and_compaction(spark, tmp_path):
    state = VersionedStore(spark, str(tmp_path), {"t": Table(KEYED, "keyed", ("k",)), "log": Table(schemas.NOTICE_REASON, "rows")},
                           buckets=4, compact_after=3)
    expected = {}
    for version in range(7):
        rows = [(f"k{i}", version, (i + version) % 5 == 0) for i in range(version, version + 4)]
        state.stage_changes(version, "t", spark.createDataFrame(rows, KEYED))
        state.stage_changes(version, "log", spark.createDataFrame([(str(version), "r")], schemas.NOTICE_REASON))
        assert {r.k: r.v for r in state.read("t").collect()} == expected  # nothing is seen before the commit
        state.commit(version)
        expected |= {k: v for k, v, _ in rows}
        expected = {k: v for k, v in expected.items() if not any(k == x and gone for x, _, gone in rows)}
        assert {r.k: r.v for r in state.read("t").collect()} == expected
        assert len(state.folders("t")) <= 4 and state.read("log").count() == version + 1
    one = min(expected)
    some = spark.createDataFrame([(one,), ("none",)], "k string")
    assert [tuple(r) for r in state.read("t", ["v", "k"], some).collect()] == [(expected[one], one)]
    state.drop_before(1)
    assert state.committed() == [6] and {r.k: r.v for r in state.read("t").collect()} == expected
    kept = {f"{p.parent.name}/{p.name}" for p in tmp_path.glob("*/state_version=*")}
    assert {f for name in ("t", "log") for f in state.folders(name)} <= kept


def test_known_keys_read_only_their_buckets(spark, tmp_path):
    state = VersionedStore(spark, str(tmp_path), {"t": Table(KEYED, "keyed", ("k",))}, buckets=8)
    state.stage_changes(0, "t", spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"), F.lit(False).alias("is_gone")))
    state.commit(0)
    state.stage_changes(1, "t", spark.createDataFrame([("k7", -7, False)], KEYED))
    state.commit(1)
    found = state.read("t", among=spark.createDataFrame([("k7",)], "k string"))
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "state_bucket" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert [(r.k, r.v) for r in found.collect()] == [("k7", -7)]


def frames(spark, items, details):
    return (spark.createDataFrame(items, schemas.LIST_ITEM), spark.createDataFrame(details, schemas.DETAIL),
            spark.createDataFrame(TASKS, schemas.TASK))


def test_a_detail_that_lands_later_is_delivered_once(spark, tmp_path):
    state = run.open_state(spark, f"{tmp_path}/state")
    late, other = ITEMS[0], item(9, "ccgp", "安徽省服务器采购公告三期", "http://e/c", "c")
    body = detail(TITLE, "http://e/a1", "采购人：甲单位 服务器采购")
    again = item(30, *late[1:5])  # listed once more while it waits
    batches = [([late], []), ([again], []), ([other], [body]), ([], [body]), ([], [body])]
    delivered, waiting = [], []
    for version, (items, details) in enumerate(batches):
        done = run.run_batch(state, version, *frames(spark, items, details), f"day-{version}", f"{tmp_path}/reports", extract=False)
        delivered.append(done.report.count())
        waiting.append(state.read("pending").count())
    assert delivered == [0, 0, 1, 0, 0] and waiting == [1, 1, 1, 1, 1]
    assert [r.source_url for r in state.read("pending").collect()] == ["http://e/c"]
    assert state.read("history").first().first_delivered_at == "day-2"


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    state = run.open_state(spark, f"{tmp_path}/state")
    for version in range(3):
        rows = [item(i, "ccgp", f"安徽省服务器采购公告第{version}{i}号", f"http://e/{version}-{i}", f"i{version}-{i}") for i in range(1, 4 - version)]
        bodies = [detail(r[2], r[3], f"采购人：单位{version}{r[0]} 服务器采购") for r in rows]
        run.run_batch(state, version, *frames(spark, rows, bodies), f"day-{version}", f"{tmp_path}/reports", extract=False)
        written = {t: spark.read.parquet(f"{tmp_path}/state/{t}/state_version={version}").count() for t in ("notices", "history", "sources")}
        assert written == dict.fromkeys(written, 3 - version)
    assert state.read("notices").count() == state.read("history").count() == 6


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("filled")
    state = run.open_state(spark, f"{root}/state")
    rows = [ITEMS[0], item(6, "cebpub", "合肥市医院影像服务器租赁比选公告", "http://c/6", "u6"),
            item(7, "ccgp", "芜湖港数据中心服务器维保询价", "http://e/7", "i7")]
    bodies = [DETAILS[0], detail(rows[1][2], "http://c/6", "采购人：乙单位\n项目编号：ABC20260009 服务器采购"),
              detail(rows[2][2], "http://e/7", "服务器采购", status="failed")]
    run.run_batch(state, 0, *frames(spark, rows, bodies), "day-0", f"{root}/reports")
    return state


def values(state, name):
    return {r.notice_id: (r.value, r.method, r.evidence_id) for r in state.read("fields").where(F.col("field_name") == name).collect()}


def test_the_run_extracts_and_corrections_win(spark, filled):
    notices = {r.source_url: r for r in filled.read("notices").collect()}
    assert {r.extraction_version for r in notices.values()} == {"v2"}
    first, second, failed = (notices[u].notice_id for u in ("http://e/a1", "http://c/6", "http://e/7"))
    assert values(filled, "purchaser")[first][0].startswith("甲单位") and values(filled, "purchaser")[second][0] == "乙单位"
    requests = spark.createDataFrame([
        (first, "budget", "9元", "核对", datetime(2026, 1, 1), 1), (first, "purchaser", "丙单位", "核对", datetime(2026, 1, 2), 2),
        (second, "colour", "x", "核对", datetime(2026, 1, 3), 3)],
        "notice_id string, field_name string, corrected_value string, reason string, corrected_at timestamp, correction_id long")
    rejected = reextract.correct_stored(filled, 1, requests)
    assert [r.field_name for r in rejected.collect()] == ["colour"]
    assert values(filled, "purchaser")[first] == ("丙单位", "manual_correction", "M-purchaser-2")
    assert {(r.field_name, r.previous_value) for r in filled.read("corrections").collect()} == {
        ("budget", None), ("purchaser", "甲单位 服务器采购")}

    ids = spark.createDataFrame([(first,), (failed,), ("nobody",)], "notice_id string")
    done = reextract.reextract_stored(filled, 2, ids)
    assert {(r.notice_id, r.error) for r in done.refused.collect()} == {(failed, reextraction.NO_TEXT), ("nobody", "公告不存在")}
    assert {r.notice_id for r in done.notices.collect()} == {first}
    assert values(filled, "purchaser")[first][0] == "丙单位" and values(filled, "purchaser")[second][0] == "乙单位"
    assert reextract.reextract_stored(filled, 2, ids) is None


def test_backfill_extracts_old_rows_only(spark, filled):
    old = filled.read("notices").where("source_url <> 'http://e/a1'").withColumns({
        "extraction_version": F.lit("v1"), "detail_url": F.lit(None).cast("string")})
    filled.stage_changes(3, "notices", old)
    filled.commit(3)
    done = reextract.backfill_stored(filled, 4)
    rows = {r.source_url: r for r in filled.read("notices").collect()}
    assert rows["http://c/6"].extraction_version == "v2" and "uuid=u6" in rows["http://c/6"].detail_url
    assert (rows["http://e/7"].extraction_version, rows["http://e/7"].detail_status) == ("needs_recrawl", "metadata_only")
    assert done.fields.select("notice_id").distinct().count() == 1 and done.refused.count() == 1
    assert reextract.backfill_stored(filled, 5).fields.count() == 0  # what waits for a crawl is marked again, nothing is extracted
