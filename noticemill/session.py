"""Spark session helpers: settings, checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIME_ZONE = "Asia/Shanghai"

#: Rows up to which a side is hinted for broadcast (checked with one bounded action).
BROADCAST_ROW_LIMIT = 200_000
#: Bytes of these rows, written as JSON, that it may have.
BROADCAST_BYTE_LIMIT = 64 << 20


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None,
                  app_name: str = "noticemill", **extra: str) -> SparkSession:
    """A session with the settings the jobs are written for (AQE, Arrow, Shanghai time)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.session.timeZone", TIME_ZONE)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; only an unset local session gets its own."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before iterative jobs run")
    folder = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT, max_bytes: int = BROADCAST_BYTE_LIMIT) -> bool:
    """True if the frame has at most ``limit`` rows of ``max_bytes`` in all; reads at most ``limit + 1`` rows."""
    size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    row = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return row.n <= limit and row.bytes <= max_bytes


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT, max_bytes: int = BROADCAST_BYTE_LIMIT) -> DataFrame:
    """Hint a broadcast only after its rows and bytes were checked; otherwise leave the join to AQE."""
    return F.broadcast(df) if is_small(df, limit, max_bytes) else df
