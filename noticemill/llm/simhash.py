"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is mapped to its number of set bits in each of 32 segments of two bits. The Manhattan distance of two such
vectors never exceeds the Hamming distance, so it is a safe filter. The vectors lie on a grid: eight groups of segments;
two vectors within Manhattan distance 4 agree in at least four groups, hence meet in a cell made of four of them.
Within a cell the Manhattan bound is tested first, then the exact Hamming distance; each pair counts only in the first
cell that it shares. Only distinct fingerprints are joined, so copies cost nothing. A cell of over ``hot_cell`` distinct
fingerprints is never joined with itself: its members are linked through midpoints instead (two fingerprints within
distance 4 have a common neighbour within distance 2 of both, and any two with such a neighbour are within 4), which
takes a fixed number of rows for each member.

The counts are held as a thermometer code (00, 10, 11 for 0, 1, 2), so the Manhattan distance is one XOR and a bit count.

Defined cases: null and empty texts have no words and the fingerprint zero, linked like any other; ties do not matter;
rows that repeat a doc_id are linked row by row, each by its own text;
a null doc_id never becomes a component id unless nothing else is there; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill.operators.components import connected_components
from noticemill.session import cut_lineage

SHINGLE, SEED, MAX_BITS = 4, 42, 4
GROUPS, SHARED = 8, 4
#: Distinct fingerprints in a cell up to which its members are compared with each other.
HOT_CELL = 4096
#: Shingle hashes summed at a time.
BLOCK = 1 << 15


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None) -> int:
    """Unsigned fingerprint of one text given as UTF-8."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[:n].tolist(), ends[len(words) - n:].tolist())
    counts = np.zeros(64, dtype=np.int64)
    hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in spans]
    for at in range(0, n, BLOCK):
        part = np.array(hashes[at:at + BLOCK], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, t, fp) of every row; fp as a signed long, t a hash that tells the texts of one doc_id apart."""
    def work(batches):
        import pyarrow as pa

        for batch in batches:
            fps = [_signed(fingerprint(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "t", "fp"])

    narrow = docs.select("doc_id", _text_hash().alias("t"), F.col("text").cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t bigint, fp bigint")


def _text_hash() -> F.Column:
    return F.xxhash64(F.col("text").cast("string"))


def _groups() -> list[int]:
    """Signed bit masks of the groups of segments over the thermometer code."""
    cuts = [32 * g // GROUPS for g in range(GROUPS + 1)]
    return [_signed(sum(3 << 2 * s for s in range(a, b))) for a, b in zip(cuts, cuts[1:])]


def _embedding(fp) -> F.Column:
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def links(classes: DataFrame, hot_cell: int = HOT_CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``; their components are those of all links within 4 bits.

    Outside hot cells every linked pair comes once, with a < b.
    """
    masks = _groups()
    combos = [_signed(sum(m & (2 ** 64 - 1) for m in c)) for c in combinations(masks, SHARED)]
    coded = classes.select("fp", _embedding(F.col("fp")).alias("code"))
    keys = F.array(*[F.xxhash64(F.lit(m), F.col("code").bitwiseAND(F.lit(m))) for m in combos])
    cells = coded.select("fp", F.explode(keys).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut_lineage(cells.join(sizes, "cell"))

    small = shared.where(F.col("n") <= hot_cell).withColumn("code", _embedding(F.col("fp")))
    left = small.select("cell", F.col("fp").alias("a"), F.col("code").alias("ca"))
    right = small.select("cell", F.col("fp").alias("b"), F.col("code").alias("cb"))
    apart = F.col("ca").bitwiseXOR(F.col("cb"))
    agreeing, first_shared = F.lit(0), F.lit(0).cast("bigint")
    for m in masks:
        same = apart.bitwiseAND(F.lit(m)) == 0
        first_shared = first_shared.bitwiseOR(F.when(same & (agreeing < SHARED), F.lit(m)).otherwise(F.lit(0)))
        agreeing = agreeing + F.when(same, 1).otherwise(0)
    first_cell = F.xxhash64(first_shared, F.col("ca").bitwiseAND(first_shared)) == F.col("cell")
    close = (F.bit_count(apart) <= MAX_BITS) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    near = left.join(right, "cell").where((F.col("a") < F.col("b")) & close & first_cell).select("a", "b")

    hot = shared.where(F.col("n") > hot_cell).select("fp").distinct()
    flips = """concat(array(0L), flatten(transform(sequence(0, 63), i -> transform(sequence(i + 1, 64), j ->
      shiftleft(1L, i) ^ if(j = 64, 0L, shiftleft(1L, j))))))"""
    around = hot.select("fp", F.explode(F.expr(flips)).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    centre = around.groupBy("mid").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    through = around.join(centre, "mid").where(F.col("fp") != F.col("low")).select(
        F.col("low").alias("a"), F.col("fp").alias("b")).distinct()
    if not hot.take(1):
        return near
    return near.unionByName(through)


def _labelled(docs: DataFrame, hot_cell: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of every row, and (fp, component, n) of every fingerprint with the rows that have it."""
    rows = cut_lineage(fingerprints(docs))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")))
    found = connected_components(links(classes, hot_cell)).withColumnRenamed("node", "fp")
    return rows, classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def components(docs: DataFrame, hot_cell: int = HOT_CELL) -> DataFrame:
    """(doc_id, fp, component_id, n_members) of every row."""
    rows, labelled = _labelled(docs, hot_cell)
    heads = labelled.groupBy("component").agg(F.min("first_doc").alias("component_id"), F.sum("n").alias("n_members"))
    return rows.join(labelled.join(heads, "component").select("fp", "component_id", "n_members"), "fp").select(
        "doc_id", "fp", "component_id", "n_members")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of each group: of the smallest doc_id the one with the smallest text hash, and one of equal such rows.

    Rows without an id stay, as nothing can name them; rows that repeat an id are told apart by their texts.
    """
    rows, labelled = _labelled(docs.where("doc_id IS NOT NULL"), HOT_CELL)
    heads = rows.join(labelled.select("fp", "component"), "fp").groupBy("component").agg(F.min(F.struct("doc_id", "t")).alias("head"))
    same = rows.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("__n"))
    kept = cut_lineage(heads.select("head.*").join(same, ["doc_id", "t"]).withColumnsRenamed({"doc_id": "__id", "t": "__t"}))
    found = docs.withColumn("__h", _text_hash()).join(kept, (F.col("doc_id") == F.col("__id")) & (F.col("__h") == F.col("__t")))
    again = found.where("__n > 1").dropDuplicates(["__id", "__t"])  # equal rows only; any of them will do
    return found.where("__n = 1").unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(
        docs.where("doc_id IS NULL"))


# --- query ---------------------------------------------------------------------------------------------------------

def op9_simhash(spark, sf_dir):
    from noticemill.llm.tables import table

    return components(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_members")


ENTRIES = {"op9_simhash": (op9_simhash, None)}
