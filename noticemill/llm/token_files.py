"""Token ids of whole documents in ORC files, ordered by document id.

Documents are dealt into ranges of ids and sorted, so each file covers a range of its own; one row holds the ids of one
document. ORC writes the ids as run-length encoded integers (bit-packed to the width of a run), cuts a file into stripes
that tasks read in parallel, and keeps minima, maxima and Bloom filters of the document ids for each ``STRIDE`` rows: a
lookup of some ids reads only the row groups that can hold them, and a range of ids only the files and stripes that
overlap it.

``start`` (the ids of all documents before one) is not stored as such: a file knows the ids before a row inside itself, and
the sums of the files, one number each, are added when the files are read. No task sees more than its range.

Defined cases: a null or empty text has the end id only; rows that repeat an id follow each other in the order of a hash of
their texts, and a third of all rows may have one id (the range is then split inside it); rows without an id come first; an
empty table gives files without rows; other columns are ignored. The files must not be written twice to one place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticemill.llm.byte_bpe import encoder, vocabulary_path
from noticemill.llm.tables import partitions, table
from noticemill.session import ensure_checkpoint_dir

END_ID = 2
#: Rows of one entry of the row index, and of one Bloom filter.
STRIDE = 1000
STRIPE_BYTES = 64 << 20
#: Ids that a task holds before it hands a batch on.
BATCH_IDS = 1_000_000


def encoded(ordered: DataFrame, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """doc_id, shard, ahead, ids: the ids of each row, the task it came from and the ids before it in that task."""
    path = vocabulary or vocabulary_path()
    kind = ordered.schema["doc_id"].dataType.simpleString()

    def work(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, end, shard, ahead = encoder(path), end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        names = ["doc_id", "shard", "ahead", "ids"]
        for batch in batches:
            first, data, starts, ends, held = 0, [], [], [0], 0
            texts = batch.column(1)
            for row in range(len(texts)):
                ids = encode(texts[row].as_py() or "") + end
                data.append(ids)
                starts.append(ahead)
                ahead += len(ids) // 4
                held += len(ids) // 4
                ends.append(held)
                if held >= BATCH_IDS or row + 1 == len(texts):
                    values = pa.array(np.frombuffer(b"".join(data), dtype="<i4"))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(data)), pa.array([shard] * len(data), pa.int32()),
                         pa.array(starts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names)
                    first, data, starts, ends, held = row + 1, [], [], [0], 0

    return ordered.mapInArrow(work, f"doc_id {kind}, shard int, ahead bigint, ids array<int>")


def write_tokens(docs: DataFrame, path: str, end_id: int = END_ID, vocabulary: str | None = None,
                 stripe_bytes: int = STRIPE_BYTES, stride: int = STRIDE) -> None:
    """Write the token files of ``docs`` to the new folder ``path``."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h"),
                       F.monotonically_increasing_id().alias("at"))
    # ``at`` lets copies of one row that fill a range go to several; among themselves their order makes no difference.
    order = ["doc_id", "h", "at"]
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")
    (encoded(ordered, end_id, vocabulary).write.format("orc")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", str(stride))
     .option("orc.stripe.size", str(stripe_bytes)).save(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list | None = None, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, ids of all documents, or of those named: a condition that ORC answers from its indexes."""
    stored = spark.read.schema(f"doc_id {id_type}, shard int, ahead bigint, ids array<int>").orc(path)
    sums = stored.groupBy("shard").agg(F.sum(F.size("ids").cast("bigint")).alias("n")).orderBy("shard").collect()
    before, bases = 0, []
    for row in sums:
        bases.append((row.shard, before))
        before += row.n
    # one row for each file
    base = F.broadcast(spark.createDataFrame(bases, "shard int, base bigint"))
    wanted = stored if doc_ids is None else stored.where(F.col("doc_id").isin(doc_ids))
    return wanted.join(base, "shard").select("doc_id", (F.col("base") + F.col("ahead")).alias("start"), "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of documents read back."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def work(batches):
        from zlib import crc32

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_numpy()
            ids = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")
            crc = [crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(work, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


# --- query ---------------------------------------------------------------------------------------------------------

def op13_token_files(spark, sf_dir):
    """Writes the token files of ``documents`` into the shared folder and reads them back."""
    path = f"{ensure_checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return digests(read_tokens(spark, path))


ENTRIES = {"op13_token_files": (op13_token_files, None)}
