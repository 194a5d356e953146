import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path[:0] = [str(Path(__file__).resolve().parents[n]) for n in (2, 1, 0)]

from llm_cases import CLASHING, SF, TRICKY


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in CLASHING])
    rows = [(i, t, "en" if k % 3 else None, None if k % 4 else "s", len(t) if t else None, *([None] * len(CLASHING)))
            for k, (i, t) in enumerate(TRICKY)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(tricky):
    return tricky.limit(0)


@pytest.fixture(scope="session")
def documents():
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/documents.parquet").to_pylist()
