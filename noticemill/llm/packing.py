"""Packing documents into token sequences by minimum bin slack.

A document's ids (with an end id) are cut into full windows and one remainder, so the lengths of all pieces are known
after one pass. Their histogram has at most ``capacity`` entries whatever the corpus holds, and is all that the driver
sees. From it the plan is made pattern by pattern: the longest remaining length opens a window, a subset-sum over a bitset
(one bit for each reachable fill, copies of a length in binary parts) finds the multiset of remaining lengths that comes
closest to the capacity, backtracking gives its counts, and the pattern is repeated for as many windows as its scarcest
length allows. Pieces then take their places by rank within their length. Ranks come from buckets of nearly equal size, so
a length that very many pieces share is spread over many tasks.

Defined cases: a null or empty text has the end id only; rows that repeat an id are packed one by one; an empty table
gives no piece; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticemill.llm.byte_bpe import encoder, vocabulary_path
from noticemill.llm.tables import partitions, table
from noticemill.session import cut_lineage

CAPACITY = 2048
END_ID = 1


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None,
           with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ``ids``, if asked for) of every piece."""
    path = vocabulary or vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def work(batches):
        from zlib import crc32

        import numpy as np
        import pyarrow as pa

        encode, end = encoder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            at, start, length, crc, total, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                data = encode(text or "") + end
                n = len(data) // 4
                for a in range(0, n, capacity):
                    part = data[4 * a:4 * (a + capacity)]
                    at.append(row)
                    start.append(a)
                    length.append(len(part) // 4)
                    crc.append(crc32(part))
                    total.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names)

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        work, schema + (", ids array<int>" if with_ids else ""))


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the counted lengths whose sum comes closest to ``room`` without exceeding it."""
    reach, limit, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        copies, part = min(counts[length], room // length), 1
        while copies:
            part = min(part, copies)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & limit
            copies -= part
            part *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + part
            total -= length * part
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(multiset of lengths, number of windows filled with it), using up the histogram."""
    left, out = {x: n for x, n in histogram.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fill(left, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        windows = min(left[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            left[x] -= n * windows
            if not left[x]:
                del left[x]
        out.append((chosen, windows))
    return out


def _places(patterns: list[tuple[dict[int, int], int]]):
    """For each length and rank from which a pattern is used: copies in a window, first sequence, first offset."""
    import numpy as np

    used: dict[int, int] = {}
    rows, sequence = [], 0
    for chosen, windows in patterns:
        offset = 0
        for x in sorted(chosen, reverse=True):
            rows.append((x << 48 | used.get(x, 0), chosen[x], sequence, offset))
            used[x] = used.get(x, 0) + chosen[x] * windows
            offset += x * chosen[x]
        sequence += windows
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def ranked(rows: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds ``rank``, 0, 1, ... within each length, without gathering a length in one task."""
    share = max(1, sum(histogram.values()) // (4 * partitions(rows.sparkSession)))
    buckets = F.create_map(*[F.lit(v) for x, n in sorted(histogram.items()) if n > share
                             for v in (x, -(-n // share))]) if max(histogram.values(), default=0) > share else None
    parts = F.coalesce(buckets[F.col("length")], F.lit(1)) if buckets is not None else F.lit(1)
    salted = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), parts.cast("bigint")))
    sizes = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    local = salted.withColumn("local", F.row_number().over(own) - 1)
    # at most one row for each length and 4 buckets for each shuffle partition
    return local.join(F.broadcast(firsts), ["length", "bucket"]).withColumn(
        "rank", F.col("first") + F.col("local")).drop("bucket", "local", "first")


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; ``rows`` should be stored, as it is read twice."""
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table_ = rows.sparkSession.sparkContext.broadcast(_places(plan(histogram, capacity)))
    order = ranked(rows, histogram)
    names = [c for c in order.columns if c != "rank"]

    def work(batches):
        import numpy as np
        import pyarrow as pa

        places = table_.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            found = places[np.searchsorted(places[:, 0], length << 48 | rank, side="right") - 1]
            window, slot = np.divmod(rank - (found[:, 0] & ((1 << 48) - 1)), found[:, 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(found[:, 2] + window), pa.array(found[:, 3] + slot * length)],
                [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{c} {order.schema[c].dataType.simpleString()}" for c in names)
    return order.mapInArrow(work, f"{kinds}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document."""
    stored = cut_lineage(pieces(docs, capacity, end_id, vocabulary))
    return place(stored, capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(docs: DataFrame, placed: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
              vocabulary: str | None = None) -> DataFrame:
    """(sequence_id, ids) of packed documents; a sequence holds at most ``capacity`` ids, so its group is bounded."""
    ids = pieces(docs, capacity, end_id, vocabulary, with_ids=True).dropDuplicates(["doc_id", "start", "ids_crc32"])
    joined = placed.join(ids.select("doc_id", "start", "ids_crc32", "ids"), ["doc_id", "start", "ids_crc32"])
    return joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select(
        "sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


# --- query ---------------------------------------------------------------------------------------------------------

def op4_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


ENTRIES = {"op4_packing": (op4_packing, None)}
