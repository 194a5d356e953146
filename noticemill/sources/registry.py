"""Source registry and the isolated union of many sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticemill.functions.text import list_key
from noticemill.sources import schemas


@dataclass(frozen=True)
class Source:
    """A source: how to read it and what it needs."""

    name: str
    read: Callable[[SparkSession], DataFrame]
    display_name: str = ""
    requires_login: bool = False
    enabled: bool = True
    official: bool = True
    #: None when ready, else why it is skipped (for example a lost login)
    not_ready: str | None = None
    #: column of the list key; the title is used where it is empty
    key: str = "source_url"


class SourceSkipped(Exception):
    """Raised by a reader that cannot run now; the other sources go on."""


def landed(path: str, fmt: str = "parquet") -> Callable[[SparkSession], DataFrame]:
    """Reader of landed list items in the fixed schema."""
    return lambda spark: spark.read.schema(schemas.LIST_ITEM).format(fmt).load(path)


def read_sources(spark: SparkSession, sources: list[Source]) -> tuple[DataFrame | None, DataFrame]:
    """(items of all readable sources, one status row per enabled source).

    Every reader is resolved on its own, so a missing path or a bad schema gives a
    status row and does not stop the others.
    """
    frames: list[DataFrame] = []
    rows: list[tuple[str, str, str]] = []
    for source in sources:
        if not source.enabled:
            continue
        try:
            if source.not_ready:
                raise SourceSkipped(source.not_ready)
            items = source.read(spark).withColumn("source_name", F.lit(source.name))
            items.schema  # resolves files and columns now
            frames.append(first_per_key(items, source.key))
            rows.append((source.name, "success", "检索完成"))
        except SourceSkipped as exc:
            rows.append((source.name, "skipped", str(exc)))
        except Exception as exc:  # noqa: BLE001 - one source must not stop the others
            rows.append((source.name, "failed", str(exc).splitlines()[0][:500]))
    items = None
    for frame in frames:
        items = frame if items is None else items.unionByName(frame, allowMissingColumns=True)
    return items, spark.createDataFrame(rows, "source_name string, status string, message string")


def first_per_key(items: DataFrame, key: str) -> DataFrame:
    """First item per source and list key in list order."""
    w = Window.partitionBy("source_name", "_key").orderBy("seq")
    return (items.withColumn("_key", list_key(F.col(key), F.col("title")))
            .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_key"))


def capabilities(spark: SparkSession, sources: list[Source]) -> DataFrame:
    return spark.createDataFrame(
        [(s.name, s.display_name or s.name, s.requires_login, s.enabled, s.official) for s in sources],
        "source_name string, display_name string, requires_login boolean, enabled boolean, official boolean")
