"""Reading the given tables and narrowing them to the columns an operator works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of ``documents``; stages of the pipeline return exactly these, in this order.
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
