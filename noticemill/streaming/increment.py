"""Repeated increments as a file stream: every trigger is one run over what landed since."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from noticemill.plans.run import open_state, run_batch
from noticemill.sources import schemas


def landed_items(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schemas.LIST_ITEM).option("maxFilesPerTrigger", max_files).parquet(folder))


def start_increment(spark: SparkSession, items_folder: str, details_folder: str, tasks: DataFrame, state_root: str,
                    report_root: str, checkpoint: str, now, cap: int | None = None, max_files: int = 1000) -> StreamingQuery:
    """One scheduled run: process everything that is waiting, then stop.

    The batch id is the version of the state. A batch that was committed is skipped
    when the stream replays it; one that died before its commit is run again and
    overwrites its own uncommitted files, so nothing is delivered twice or lost.
    ``now`` is a text or a function giving the delivery time of a batch.
    """
    state = open_state(spark, state_root)

    def handle(batch: DataFrame, batch_id: int) -> None:
        if state.is_committed(batch_id):
            return
        details = spark.read.schema(schemas.DETAIL).parquet(details_folder)
        when = now(batch_id) if callable(now) else now
        run_batch(state, batch_id, batch, details, tasks, when, report_root, cap=cap)

    return (landed_items(spark, items_folder, max_files).writeStream.foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
