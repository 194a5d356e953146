"""Alignment of two tokenizers over the same bytes, with the document frequencies of linked id pairs.

Where tokens of A and of B both end, the bytes of a text are cut into groups. An A and a B token are linked if their byte
ranges overlap: between two neighbouring ends (of either side) lies exactly one link, so all links of a batch of texts come
from one sorted merge of the ends.

Most groups hold one token of each side, hence of the same bytes. For them the pair follows from the A id alone by an array
from A ids to the B id of the same bytes (``identity``): their document counts are vectors as long as A's vocabulary, one
for each task, added up. Only the other pairs go through a shuffle, each once for a batch of documents. The counts come back
in two ways. Pairs linked in many documents (``share`` of all pair occurrences) are at most ``HEAVY`` by arithmetic, and so
are the vectors bounded by the vocabulary; both are broadcast. The rest is joined by pair, where no pair is hot any more.

The texts are encoded once; what is stored is one row for each document with its distinct pairs.

Defined cases: null and empty texts, and texts whose tokens do not spell a blank and the text (one with U+2581 in B), have
no tokens: zeros and an empty digest; rows that repeat an id are documents of their own; an empty table gives no row;
other columns are ignored. A text's links are held in memory at once, so memory follows the longest text.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticemill.llm.byte_bpe import VOCABULARY, encoder, vocabulary_path
from noticemill.llm.tables import table
from noticemill.session import cut_lineage, ensure_checkpoint_dir

PIECES = "piece_bpe_32k.model"
#: Pairs that are broadcast: those in at least one HEAVY-th of all pair occurrences, so no more than this number.
HEAVY = 100_000
#: Characters of the texts that are aligned at once.
BATCH_CHARS = 1_000_000


class Pieces:
    """A sentencepiece model; an id's bytes are those of its piece, with a blank for U+2581."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [None if model.is_control(i) or model.is_unknown(i)
                      else bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
                      else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.vocab_size())]
        self.encode = lambda texts: model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One for each worker process and file."""
    return Pieces(path)


def identity(a_bytes: list, b_bytes: list):
    """For each A id the largest B id of the same bytes (byte pieces have the smallest ids), or -1."""
    import numpy as np

    of = {x: i for i, x in enumerate(b_bytes) if x is not None}
    return np.array([of.get(x, -1) if x is not None else -1 for x in a_bytes], dtype=np.int64)


class Aligner:
    """Both tokenizers and the tables between them, one for each worker process."""

    def __init__(self, a_path: str, b_path: str):
        import numpy as np

        self.a, self.b = encoder(a_path), pieces(b_path)
        self.identity = identity(self.a.bytes, self.b.bytes)
        self.a_length = np.array([len(x or b"") for x in self.a.bytes], dtype=np.int64)
        self.b_length = np.array([len(x or b"") for x in self.b.bytes], dtype=np.int64)
        n_a, n_b = len(self.a.bytes), len(self.b.bytes)
        #: Id and sign of A inside and at the end of a group, then of B.
        self.signs = np.array([f"{i}{s}".encode() for s, n in ((",", n_a), ("|", n_a), (",", n_b), (";", n_b)) for i in range(n)])

    def tokens(self, texts: list[str]):
        """For each text its A and B ids, empty where they do not spell it."""
        import numpy as np

        nothing, out = np.array([], dtype=np.int64), []
        for text, b in zip(texts, self.b.encode(texts)):
            a, whole = np.frombuffer(self.a.plain(" " + text), dtype="<u4").astype(np.int64), (" " + text).encode()
            spelled = [[side.bytes[i] for i in ids] for side, ids in ((self.a, a.tolist()), (self.b, b))]
            fits = text and all(None not in s and b"".join(s) == whole for s in spelled)
            out.append((a, np.array(b, dtype=np.int64)) if fits else (nothing, nothing))
        return out

    def align(self, texts: list[str]):
        """Of each text: tokens of A and B, groups, digest, and its distinct pairs with the number of their links.

        Pairs of the identity map are returned as A ids, the others as (A id << 32) + B id.
        """
        import hashlib

        import numpy as np

        found = self.tokens(texts)
        count_a, count_b = (np.array([len(t[k]) for t in found], dtype=np.int64) for k in (0, 1))
        a, b = (np.concatenate([t[k] for t in found]) for k in (0, 1))
        # One line of bytes over all texts; every text ends where both sides end.
        end_a, end_b = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        ends = np.union1d(end_a, end_b)
        of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)

        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, side="left")
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
        signs, n_a, n_b = np.empty(len(a) + len(b), dtype=np.int64), len(self.a.bytes), len(self.b.bytes)
        signs[place_a] = a + n_a * last_a
        signs[place_b] = b + 2 * n_a + n_b * last_b

        doc_a = np.repeat(np.arange(len(texts)), count_a)
        left, right, doc = a[of_a], b[of_b], doc_a[of_a]
        odd = self.identity[left] != right
        first_a, first, groups = np.cumsum(count_a) - count_a, np.cumsum(count_a + count_b) - count_a - count_b, np.zeros(
            len(texts), dtype=np.int64)
        np.add.at(groups, doc_a, last_a)
        packed = [_runs(doc[~odd], left[~odd], len(texts)), _runs(doc[odd], left[odd] << 32 | right[odd], len(texts))]
        for i in range(len(texts)):
            written = self.signs[signs[first[i]:first[i] + count_a[i] + count_b[i]]].tobytes().replace(b"\0", b"")
            digest = hashlib.sha256(written[:-1]).hexdigest() if written else ""
            yield int(count_a[i]), int(count_b[i]), int(groups[i]), digest, *(part for p in packed for part in p[i])


def _runs(doc, keys, n: int) -> list:
    """For each document its distinct keys and how often each occurs."""
    import numpy as np

    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    heads = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])][:len(keys)])
    times = np.diff(np.r_[heads, len(keys)])
    cuts = np.searchsorted(doc[heads], np.arange(n + 1))
    return [(keys[heads[x:y]], times[x:y].astype(np.int32)) for x, y in zip(cuts[:-1], cuts[1:])]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, groups_sha256, and the document's distinct pairs with the number of their links:
    ``same``/``same_n`` (A ids of the identity map) and ``odd``/``odd_n`` (A id << 32 | B id)."""
    paths = (a_path or vocabulary_path(VOCABULARY), b_path or vocabulary_path(PIECES))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "same", "same_n", "odd", "odd_n"]
    kinds = ("bigint", kind, "bigint", "bigint", "bigint", "string", "array<int>", "array<int>", "array<bigint>", "array<int>")

    def work(batches):
        import numpy as np
        import pyarrow as pa

        align = aligner(*paths).align

        def lists(parts, arrow):
            ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), arrow))

        def rows(batch, first, texts):
            done = list(zip(*align(texts)))
            same, same_n, odd, odd_n = done[4:]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)),
                 *(pa.array(x, pa.int64()) for x in done[:3]), pa.array(done[3], pa.string()),
                 lists([x.astype(np.int32) for x in same], pa.int32()), lists(same_n, pa.int32()),
                 lists(odd, pa.int64()), lists(odd_n, pa.int32())], names)

        for batch in batches:
            first, texts, held, column = 0, [], 0, batch.column(2)
            for i in range(len(column)):
                texts.append(column[i].as_py() or "")
                held += len(texts[-1])
                if held >= BATCH_CHARS or i + 1 == len(column):
                    yield rows(batch, first, texts)
                    first, texts, held = i + 1, [], 0

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        work, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def counts(stored: DataFrame, vocabulary: int) -> DataFrame:
    """(key, n): in how many documents a pair is linked; the key is (A id << 32) + B id, or -1 - A id for the identity map."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        vector = np.zeros(vocabulary, dtype=np.int64)

        def rows(keys, n):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

        for batch in batches:
            vector += np.bincount(batch.column(0).values.to_numpy(), minlength=vocabulary)
            keys, n = np.unique(batch.column(1).values.to_numpy(), return_counts=True)
            yield rows(keys, n)
        used = np.flatnonzero(vector)
        yield rows(-1 - used, vector[used])

    found = stored.select("same", "odd").mapInArrow(work, "key bigint, n bigint")
    return found.groupBy("key").agg(F.sum("n").alias("n"))


def _a_id() -> F.Column:
    return F.when(F.col("key") < 0, -1 - F.col("key")).otherwise(F.shiftright("key", 32))


def scored(stored: DataFrame, pairs: DataFrame, vocabulary: int) -> DataFrame:
    """Adds n_links, n_best and count_sum to the stored documents."""
    import numpy as np

    # one row for each id of the vocabulary
    top = pairs.groupBy(_a_id().alias("a")).agg(F.max("n").alias("best"), F.max(F.when(F.col("key") < 0, F.col("n"))).alias("same"))
    best, same = np.zeros(vocabulary, dtype=np.int64), np.zeros(vocabulary, dtype=np.int64)
    for row in top.collect():
        best[row.a], same[row.a] = row.best, row.same or 0
    odd = pairs.where("key >= 0")
    total = odd.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    share = -(-max(total, 1) // HEAVY)
    heavy = sorted((r.key, r.n) for r in odd.where(F.col("n") >= share).collect())  # at most HEAVY rows
    sent = stored.sparkSession.sparkContext.broadcast(
        (best, same, np.array([k for k, _ in heavy], dtype=np.int64), np.array([n for _, n in heavy], dtype=np.int64)))
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    names = [*kept, "n_best", "count_sum", "rest", "rest_n"]

    def work(batches):
        import pyarrow as pa

        best, same, keys, n = sent.value

        def sums(lists, values):
            at = lists.offsets.to_numpy()
            ahead = np.r_[0, np.cumsum(values)]
            return ahead[at[1:] - at[0]] - ahead[at[:-1] - at[0]]

        for batch in batches:
            a, a_n, pair, pair_n = (batch.column(c) for c in ("same", "same_n", "odd", "odd_n"))
            ids, times = a.flatten().to_numpy(), a_n.flatten().to_numpy().astype(np.int64)
            n_best, count_sum = sums(a, times * (same[ids] == best[ids])), sums(a, times * same[ids])
            links, times = pair.flatten().to_numpy(), pair_n.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(keys, links), max(len(keys) - 1, 0))
            known = keys[at] == links if len(keys) else np.zeros(len(links), dtype=bool)
            count = np.where(known, n[at], 0) if len(keys) else np.zeros(len(links), dtype=np.int64)
            n_best += sums(pair, times * (known & (count == best[links >> 32])))
            count_sum += sums(pair, times * count)
            ends = pa.array(np.r_[0, np.cumsum(sums(pair, ~known))].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(links[~known], pa.int64())),
                 pa.ListArray.from_arrays(ends, pa.array(times[~known], pa.int64()))], names)

    kinds = {c: stored.schema[c].dataType.simpleString() for c in kept} | {
        "n_best": "bigint", "count_sum": "bigint", "rest": "array<bigint>", "rest_n": "array<bigint>"}
    found = stored.mapInArrow(work, ", ".join(f"{n} {k}" for n, k in kinds.items()))
    rare = odd.where(F.col("n") < share)
    leading = F.broadcast(top.select("a", "best"))
    light = rare.withColumn("a", F.shiftright("key", 32)).join(leading, "a").select("key", "n", (F.col("n") == F.col("best")).alias("wins"))
    each = found.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("p")).select(
        "row", F.col("p.rest").alias("key"), F.col("p.rest_n").alias("times"))
    more = each.join(light, "key").groupBy("row").agg(
        F.sum(F.when(F.col("wins"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    return found.join(more, "row", "left").select(
        *kept, (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"),
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))


def store(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The aligned documents, written once as a table in the shared folder."""
    spark: SparkSession = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"
    found = aligned(docs, a_path, b_path)
    found.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def pair_table(pairs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(a, b, n) of a table of counts, with the B ids of the identity map written out."""
    ids = aligner(a_path or vocabulary_path(VOCABULARY), b_path or vocabulary_path(PIECES)).identity.tolist()
    named = F.broadcast(pairs.sparkSession.createDataFrame(list(enumerate(ids)), "a bigint, same_b bigint"))  # the vocabulary
    return pairs.withColumn("a", _a_id()).join(named, "a").select(
        "a", F.when(F.col("key") < 0, F.col("same_b")).otherwise(F.col("key").bitwiseAND((1 << 32) - 1)).alias("b"), "n")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    vocabulary = len(encoder(a_path or vocabulary_path(VOCABULARY)).bytes)
    stored = store(docs, a_path, b_path)
    pairs = cut_lineage(counts(stored, vocabulary))
    return scored(stored, pairs, vocabulary).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


# --- query ---------------------------------------------------------------------------------------------------------

def op12_token_alignment(spark, sf_dir):
    return align(table(spark, sf_dir, "documents"))


ENTRIES = {"op12_token_alignment": (op12_token_alignment, None)}
