"""The whole run on a small fixture: first delivery, skip, update, crash, snapshot, stream."""

import tempfile
from datetime import date
from functools import partial

import pytest
from pyspark.sql import functions as F

from noticemill.plans import run
from noticemill.sources import schemas
from noticemill.sources.store import VersionedStore
from noticemill.streaming.increment import start_increment

D1 = date(2026, 6, 1)
run_batch = partial(run.run_batch, extract=False)  # what is extracted is tested in test_state.py
TITLE = "安徽省服务器采购公开招标公告"


def item(seq, source, title, url, ident, region="安徽省"):
    return (seq, source, title, url, ident, D1, None, region)


ITEMS = [item(1, "ccgp", TITLE, "http://e/a1", "a1"), item(2, "ccgp", "培训班招生广告", "http://e/n1", "n1"),
         item(3, "mirror", TITLE, "http://m/a1", "m1"), item(4, "ccgp", "上海市服务器采购公告", "http://e/b", "b", "上海市"),
         item(5, "ccgp", "安徽省服务器采购公告二期", "http://e/lost", "l1")]


def detail(title, url, body, status="full"):
    return ("x", url, title, D1, "安徽省", None, body, ["http://f/a.pdf"], status, "html")


DETAILS = [detail(TITLE, "http://e/a1", "采购人：甲单位 服务器采购"), detail(TITLE, "http://m/a1", "采购人：甲单位 服务器采购 补充说明")]
TASKS = [("t1", ["服务器"], ["安徽省"], date(2026, 5, 1), date(2026, 7, 17), "active"),
         ("t2", ["桌椅"], ["安徽省"], None, None, "active"), ("t3", ["服务器"], ["安徽省"], None, None, "deleted")]


def frames(spark, details=DETAILS):
    return (spark.createDataFrame(ITEMS, schemas.LIST_ITEM), spark.createDataFrame(details, schemas.DETAIL),
            spark.createDataFrame(TASKS, schemas.TASK))


def changes(result):
    return sorted((r.task_id, r.change_label, r.source_name) for r in result.report.collect())


def test_deliver_skip_update(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    state = run.open_state(spark, root + "/state")
    first = run_batch(state, 0, *frames(spark), "2026-06-02", root + "/reports")
    assert changes(first) == [("t1", "新增", "ccgp")]
    got = {r.outcome: r.n for r in first.outcomes.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert got == {"primary": 1, "merged": 1, "detail_failed": 1}
    assert sorted((r.source_url, r.reason) for r in state.read("sources").collect()) == [
        ("http://e/a1", None), ("http://m/a1", "标准化标题+区域+日期")]
    assert state.read("reasons").count() == 1 and state.read("history").count() == 1
    funnel = {r.task_id: r for r in first.tables["funnel"].collect()}
    assert (funnel["t1"].raw_count, funnel["t1"].list_filtered, funnel["t1"].candidates) == (5, 2, 2)
    assert funnel["t2"].list_filtered == 5 and "t3" not in funnel

    again = run_batch(state, 1, *frames(spark), "2026-06-03", root + "/reports")
    assert changes(again) == [] and state.read("notices").count() == 1
    changed = [detail(TITLE, "http://e/a1", "采购人：甲单位 服务器采购 变更后的全文内容"), DETAILS[1]]
    third = run_batch(state, 2, *frames(spark, changed), "2026-06-04", root + "/reports")
    assert changes(third) == [("t1", "内容发生变化", "ccgp")]
    row = state.read("history").first()
    assert row.first_delivered_at == "2026-06-02" and row.last_delivered_at == "2026-06-04"
    assert run_batch(state, 2, *frames(spark), "2026-06-05") is None


def test_crash_before_commit_leaves_nothing(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="spark-")
    state = run.open_state(spark, root + "/state")

    def broken(self, version):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(VersionedStore, "commit", broken)
        with pytest.raises(OSError):
            run_batch(state, 0, *frames(spark), "2026-06-02", root + "/reports")
    assert state.read("history").count() == 0
    assert changes(run_batch(state, 0, *frames(spark), "2026-06-02", root + "/reports")) == [("t1", "新增", "ccgp")]


def test_snapshot_keeps_every_record_and_the_history(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    state = run.open_state(spark, root + "/state")
    snap = run_batch(state, 0, *frames(spark), "2026-06-02", root + "/reports", mode="full_snapshot")
    rows = snap.tables["items"].collect()
    assert len(rows) == 2 and {r.dedupe_status for r in rows} == {"保留（同批疑似重复）"}
    assert state.read("history").count() == 0 and state.read("notices").count() == 1


def test_stream_equals_batches(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    items, details, tasks = frames(spark)
    details.write.parquet(root + "/details")

    def go():
        start_increment(spark, root + "/items", root + "/details", tasks, root + "/state", root + "/reports",
                        root + "/checkpoint", lambda b: f"day-{b}").awaitTermination()

    items.where("seq = 1").write.mode("append").parquet(root + "/items")
    go()
    state = run.open_state(spark, root + "/state")
    assert state.read("history").count() == 1
    items.where("seq > 1").write.mode("append").parquet(root + "/items")
    go()
    go()  # nothing new: no further batch
    rows = state.read("history").collect()
    assert sorted(r.first_delivered_at for r in rows) == ["day-0", "day-1"]
    assert state.read("sources").select("source_name").distinct().count() == 2


def test_capped_items_wait_for_the_next_version(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    state = run.open_state(spark, root + "/state")
    rows = [item(i, "ccgp", f"安徽省服务器采购公告第{i}号", f"http://e/{i}", f"i{i}") for i in range(1, 6)]
    bodies = [detail(r[2], r[3], f"采购人：单位{r[0]} 服务器采购 编号{r[0]}") for r in rows]
    empty, tasks = spark.createDataFrame([], schemas.LIST_ITEM), spark.createDataFrame(TASKS, schemas.TASK)
    landed, details = spark.createDataFrame(rows, schemas.LIST_ITEM), spark.createDataFrame(bodies, schemas.DETAIL)
    for version, batch in enumerate((landed, empty)):
        result = run_batch(state, version, batch, details, tasks, f"day-{version}", root + "/reports", cap=3)
        assert result.report.count() == (3, 2)[version]
    assert state.read("pending").count() == 0 and state.read("history").count() == 5


def test_siblings_of_one_batch_are_linked_both_ways(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    state = run.open_state(spark, root + "/state")
    rows = [item(1, "ccgp", "安徽省服务器采购招标公告", "http://e/1", "i1"), item(2, "ccgp", "安徽省服务器采购中标公告", "http://e/2", "i2")]
    bodies = [detail(r[2], r[3], f"项目编号：ABC20260001 服务器采购 {r[2]}") for r in rows]
    run_batch(state, 0, spark.createDataFrame(rows, schemas.LIST_ITEM), spark.createDataFrame(bodies, schemas.DETAIL),
                  spark.createDataFrame(TASKS, schemas.TASK), "day-0", root + "/reports")
    links = {(r.notice_id, r.announcement_id) for r in state.read("lifecycle").collect()}
    ids = {r.notice_id for r in state.read("notices").collect()}
    assert len(ids) == 2 and links == {(a, b) for a in ids for b in ids if a != b}


def test_a_failed_reading_delivers_nothing(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    state = run.open_state(spark, root + "/state")
    run_batch(state, 0, *frames(spark), "day-0", root + "/reports", status="failed")
    assert state.read("history").count() == 0 and state.read("notices").count() == 1


def test_oversized_groups_keep_sources_and_attachments(spark):
    def outcome(limit):
        root = tempfile.mkdtemp(prefix="spark-")
        state = run.open_state(spark, root + "/state")
        rows = [item(i, f"s{i}", TITLE, f"http://e/{i}", f"i{i}") for i in range(1, 5)]
        bodies = [(*detail(TITLE, r[3], "采购人：甲单位 服务器采购")[:7], [f"http://f/{r[0]}.pdf"], "full", "html") for r in rows]
        run_batch(state, 0, spark.createDataFrame(rows, schemas.LIST_ITEM), spark.createDataFrame(bodies, schemas.DETAIL),
                      spark.createDataFrame(TASKS, schemas.TASK), "day-0", root + "/reports", fold_limit=limit)
        return ({r.source_url for r in state.read("sources").collect()}, {r.link for r in state.read("attachments").collect()},
                state.read("notices").count())

    assert outcome(2) == outcome(2000) == ({f"http://e/{i}" for i in range(1, 5)}, {f"http://f/{i}.pdf" for i in range(1, 5)}, 1)
