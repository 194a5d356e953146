"""Language identification with a language-bitmask n-gram filter.

The filter is a bit-sliced Bloom filter: each of its positions holds a mask with one bit for each language, and the AND
over an n-gram's positions gives all languages that contain it in one lookup. A text's n-grams are counted per language by
these bits; from each count the hits that the filter gives by chance (its false-positive rate for that language, known
from the bits that are set) are taken off, and the language with the largest corrected share wins.

Learning reads labelled rows only: at most about ``sample`` texts of each language (those with the smallest hashes of
their text, by a threshold set from the number of such texts), which bounds the size of what is learned. An n-gram belongs
to a language if it occurs in ``min_texts`` sampled texts of it and at least ``min_ratio`` as often, by share, as in the
language where it is most frequent, so a wrong label or a borrowed word teaches little. At most ``max_grams`` n-grams of a
language, the most frequent ones, enter the filter.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing was learned;
equal shares go to the language that sorts first; rows are judged one by one whatever their ids; an empty table gives an
empty one; columns other than doc_id and text never enter a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticemill.llm.tables import table

UNKNOWN = "und"
GRAM = 4
SAMPLE, MAX_GRAMS, MIN_TEXTS, MIN_RATIO = 4000, 60_000, 3, 0.2
#: Positions of the filter for each n-gram in it, and positions looked up for one n-gram.
BITS_PER_GRAM, HASHES = 12, 3
#: Characters of a text looked at together.
BLOCK = 1 << 18


def grams(text: str):
    """64-bit codes of the n-grams of a text: letters in lower case, everything else one blank between words."""
    import numpy as np

    line = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else text.lower().translate(_ASCII)
    line = f" {' '.join(line.split())} "
    points = np.frombuffer(line.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, dtype=np.uint64)
    points = np.concatenate((points, np.full(max(0, GRAM - len(points)), 32, dtype=np.uint64)))
    code = np.zeros(len(points) - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        code = code * np.uint64(0x9E3779B97F4A7C15) + points[k:len(points) - GRAM + 1 + k]
    return mix(code)


_ASCII = {i: i if chr(i).isalpha() else " " for i in range(128)}


def mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Filter:
    """Languages in sorted order and one mask for each position."""

    languages: list[str]
    masks: object

    @classmethod
    def of(cls, languages: list[str], codes, masks) -> Filter:
        """A filter of n-gram codes (uint64) with the language masks (uint64) of each."""
        import numpy as np

        size = 1 << max(10, int(len(codes) * BITS_PER_GRAM).bit_length())
        slots = np.zeros(size, dtype=np.uint64)
        for at in cls.positions(codes, size):
            np.bitwise_or.at(slots, at, masks)
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        return cls(languages, slots.astype(kind))

    @staticmethod
    def positions(codes, size: int):
        import numpy as np

        step = (codes >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield ((codes + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)

    def false_positive_rates(self):
        import numpy as np

        return np.array([float(((self.masks >> self.masks.dtype.type(b)) & self.masks.dtype.type(1)).mean()) ** HASHES
                         for b in range(len(self.languages))])

    def counts(self, codes):
        """Number of n-grams that each language contains."""
        import numpy as np

        found = None
        for at in self.positions(codes, len(self.masks)):
            found = self.masks[at] if found is None else found & self.masks[at]
        n = len(self.languages)
        if n <= 8:
            by_mask = np.bincount(found, minlength=256)
            bits = (np.arange(256)[:, None] >> np.arange(n)) & 1
            return by_mask @ bits
        return np.array([int(((found >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(n)])

    def decide(self, text: str | None, rates) -> tuple[str, float]:
        import numpy as np

        if not text or not self.languages:
            return UNKNOWN, 0.0
        total, hits = 0, np.zeros(len(self.languages))
        for at in range(0, len(text), BLOCK):
            codes = grams(text[at:at + BLOCK])
            total += len(codes)
            if len(codes):
                hits += self.counts(codes)
        if not total:
            return UNKNOWN, 0.0
        share = np.clip((hits - total * rates) / (total * np.maximum(1 - rates, 1e-9)), 0, 1)
        best = int(share.argmax())
        return self.languages[best], float(share[best])


def sampled(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, text) of about ``sample`` texts of each language at most."""
    narrow = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in labelled.where("lang IS NOT NULL").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n")).limit(65).collect()}
    if len(sizes) > 64:
        raise ValueError("a mask holds 64 languages; learn several filters for more")
    if not sizes:
        return narrow.limit(0)
    limit = F.create_map(*[x for lang, n in sizes.items() for x in (
        F.lit(lang), F.lit(2 ** 63 - 1 if n <= sample else int((sample / n - 0.5) * 2 ** 64)))])
    return narrow.where(F.xxhash64("text") <= limit[F.col("lang")])


def learn(labelled: DataFrame, sample: int = SAMPLE, max_grams: int = MAX_GRAMS, min_texts: int = MIN_TEXTS,
          min_ratio: float = MIN_RATIO) -> Filter:
    """The filter of the labelled rows (``lang``, ``text``). The driver gets at most ``max_grams`` n-grams a language."""
    import numpy as np

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            seen: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = [np.unique(grams(text[a:a + BLOCK])) for a in range(0, len(text), BLOCK)]
                seen.setdefault(lang, []).extend(codes)
            for lang, parts in seen.items():
                codes, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(
                    np.asarray(codes, dtype=np.uint64).view(np.int64)), pa.array(np.asarray(counts, dtype=np.int64))],
                    ["lang", "code", "n"])

    texts = sampled(labelled, sample)
    counted = texts.mapInArrow(work, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
    shares = counted.where(F.col("n") >= min_texts).join(F.broadcast(sizes), "lang").withColumn("share", F.col("n") / F.col("texts"))
    peak = F.max("share").over(Window.partitionBy("code"))
    own = shares.withColumn("peak", peak).where(F.col("share") >= min_ratio * F.col("peak"))
    ranks = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = own.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= max_grams).select("lang", "code").toPandas()
    languages = sorted(top["lang"].unique())
    bits = np.uint64(1) << top["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.uint64)
    codes, where = np.unique(top["code"].to_numpy(dtype=np.int64).view(np.uint64), return_inverse=True)
    masks = np.zeros(len(codes), dtype=np.uint64)
    np.bitwise_or.at(masks, where, bits)
    return Filter.of(languages, codes, masks)


def predict(docs: DataFrame, model: Filter, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``lang_pred`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BITS_PER_GRAM bytes a learned n-gram

    def work(batches):
        import pyarrow as pa

        own = shared.value
        rates = own.false_positive_rates()
        for batch in batches:
            found = [own.decide(t, rates) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array([x for x, _ in found], pa.string()),
                 pa.array([s for _, s in found], pa.float64())], [*keep, "lang_pred", "score"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(
        work, f"{kinds}, lang_pred string, score double")


# --- query ---------------------------------------------------------------------------------------------------------

def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    model = learn(docs.where("NOT held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model, ("doc_id", "held_out"))


ENTRIES = {"op7_language_id": (op7_language_id, None)}
