"""Operators on token ids and phrases: cross-tokenizer alignment, token files, collocations."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticemill.llm import byte_bpe, collocations, token_alignment, token_files
from llm_cases import SF
from oracle_check import compare, duck


# --- alignment

@pytest.fixture(scope="module")
def two_tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(byte_bpe.vocabulary_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=byte_bpe.vocabulary_path(token_alignment.PIECES))


def align_one(a, b, text):
    """A and B tokens as (id, first byte, end byte), or nothing."""
    if not text:
        return [], []
    letters, whole = byte_bpe._byte_letters(), (" " + text).encode()
    ids = a.encode(" " + text, add_special_tokens=False).ids
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
             for i in b.encode(text)]
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return [], []
    sides = []
    for tokens in (left, right):
        at, out = 0, []
        for i, x in tokens:
            out.append((i, at, at + len(x)))
            at += len(x)
        sides.append(out)
    return sides


def expected_alignment(docs, a, b):
    sides = [align_one(a, b, text) for _, text in docs]
    links = [[(x[0], y[0]) for x in left for y in right if x[1] < y[2] and y[1] < x[2]] if len(left) < 400 else None
             for left, right in sides]
    links = [found if found is not None else sweep(*side) for found, side in zip(links, sides)]
    count = Counter(pair for found in links for pair in set(found))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, _), (left, right), found in zip(docs, sides, links):
        both, groups, x, y = {t[2] for t in left} & {t[2] for t in right}, [], [], []
        for end in sorted(both):
            groups.append((",".join(str(t[0]) for t in left if end >= t[2] > (x[-1] if x else 0)) if len(left) < 400 else None, end))
            x.append(end)
        if len(left) >= 400:
            texts = written(left, right, both)
        else:
            starts = [0, *x]
            texts = [f"{g}|{','.join(str(t[0]) for t in right if s < t[2] <= e)}" for (g, e), s in zip(groups, starts)]
        sha = hashlib.sha256(";".join(texts).encode()).hexdigest() if texts else ""
        out.append((doc_id, len(left), len(right), len(both), len(found), sum(count[p] == best[p[0]] for p in found),
                    sum(count[p] for p in found), sha))
    return out


def sweep(left, right):
    found, at = [], 0
    for i, start, end in left:
        while right[at][2] <= start:
            at += 1
        k = at
        while k < len(right) and right[k][1] < end:
            found.append((i, right[k][0]))
            k += 1
    return found


def written(left, right, both):
    sides = []
    for tokens in (left, right):
        parts, part = [], []
        for i, _, end in tokens:
            part.append(str(i))
            if end in both:
                parts.append(",".join(part))
                part = []
        sides.append(parts)
    return [f"{x}|{y}" for x, y in zip(*sides)]


def alignment_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_alignment_equals_brute_force(spark, documents, two_tokenizers):
    docs = [(d["doc_id"], d["text"]) for d in documents]
    got = alignment_rows(token_alignment.op12_token_alignment(spark, SF))
    assert got == sorted(expected_alignment(docs, *two_tokenizers), key=repr)


@pytest.mark.parametrize("heavy", [1, 100_000])
def test_alignment_of_odd_texts(spark, tricky, two_tokenizers, monkeypatch, heavy):
    """Special strings, U+2581, blanks, repeated and overlapping letters; with and without broadcast pairs."""
    monkeypatch.setattr(token_alignment, "HEAVY", heavy)
    odd = ["! ! !", "!!!!", "<|endoftext|> <s>", "a▁b", " a  b ", "\n\n", "\t", "\x00", "aaaaaaaaaaaaaaa" * 3, "😀é́日本語", " ", "!é!é"]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd * 2)], "doc_id long, text string")
    frame = tricky.select("doc_id", "text", "n", "rest", "key", "lines").unionByName(extra, allowMissingColumns=True)
    docs = [(r.doc_id, r.text) for r in frame.collect()]
    assert alignment_rows(token_alignment.align(frame)) == sorted(expected_alignment(docs, *two_tokenizers), key=repr)


def test_pair_table_and_no_documents(spark, no_docs, two_tokenizers):
    assert token_alignment.align(no_docs).count() == 0
    docs = [(1, "plain words, again"), (2, "plain naïve words"), (2, "plain")]
    stored = token_alignment.store(spark.createDataFrame(docs, "doc_id long, text string"))
    table = token_alignment.pair_table(token_alignment.counts(stored, 50_257))
    sides = [align_one(*two_tokenizers, t) for _, t in docs]
    want = Counter(p for left, right in sides for p in {(x[0], y[0]) for x in left for y in right if x[1] < y[2] and y[1] < x[2]})
    assert {(r.a, r.b): r.n for r in table.collect()} == want


# --- token files

def expected_files(docs, tokenizer):
    out, start = [], 0
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe.vocabulary_path())


def test_token_files_equal_the_library(spark, documents, library):
    docs = sorted((d["doc_id"], d["text"]) for d in documents)
    rows = token_files.op13_token_files(spark, SF).collect()
    assert sorted(tuple(r) for r in rows) == expected_files(docs, library)


def test_token_files_of_odd_rows(spark, tricky, no_docs, library, tmp_path):
    """Repeated and missing ids: the ranges of the rows follow each other without gap, whatever their order."""
    token_files.write_tokens(tricky, f"{tmp_path}/odd")
    rows = sorted(token_files.digests(token_files.read_tokens(spark, f"{tmp_path}/odd")).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    want = Counter(r[:1] + r[2:] for r in expected_files([(r.doc_id, r.text) for r in tricky.collect()], library))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    token_files.write_tokens(no_docs, f"{tmp_path}/none")
    assert token_files.read_tokens(spark, f"{tmp_path}/none").count() == 0


def test_a_range_of_one_id_is_split(spark, tmp_path):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(7).alias("doc_id"), F.lit("same text").alias("text"))
    token_files.write_tokens(docs, f"{tmp_path}/hot")
    stored = spark.read.orc(f"{tmp_path}/hot")
    assert stored.where("doc_id = 7").select("shard").distinct().count() > 1
    rows = token_files.read_tokens(spark, f"{tmp_path}/hot").orderBy("start").collect()
    assert [r.start for r in rows] == [3 * i for i in range(4000)] and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_lookup_reads_few_row_groups(spark, tmp_path):
    """Only even ids are stored: minima and maxima cannot exclude an odd one, Bloom filters do; stripes are read apart."""
    docs = spark.range(0, 400_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    token_files.write_tokens(docs.coalesce(1), f"{tmp_path}/files", stripe_bytes=1 << 16)

    def scanned(ids):
        frame = token_files.read_tokens(spark, f"{tmp_path}/files", ids)
        rows = frame.collect()
        plan, found = frame._jdf.queryExecution().executedPlan(), []

        def walk(node):
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                return walk(node.executedPlan())
            if hasattr(node, "plan") and "QueryStage" in node.nodeName():
                return walk(node.plan())
            if node.nodeName().startswith("Scan orc"):
                found.append(node.metrics().apply("numOutputRows").value())
            for k in range(node.children().size()):
                walk(node.children().apply(k))

        walk(plan)
        return rows, sum(found)

    rows, read = scanned([123_456])
    assert [r.doc_id for r in rows] == [123_456] and 1 <= read <= 20_000
    rows, missed = scanned([123_457])
    assert not rows and missed < read or missed == 0
    from pyarrow import orc

    assert max(orc.ORCFile(f).nstripes for f in map(str, (tmp_path / "files").glob("*.orc"))) > 1


# --- collocations

def brute_collocations(docs, support, top):
    """The definition, phrase by phrase."""
    import re

    n, f = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    f = Counter({k: v for k, v in f.items() if v >= support})
    longer = defaultdict(int)
    for (lang, w), v in f.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[lang, w[i:i + m]] = max(longer[lang, w[i:i + m]], v)
    rows = defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) > 1 and not 100 * longer[lang, w] >= 80 * a:
            cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in rows.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize("shards, bits, hot", [(1, (1 << 20, 1 << 28), 20_000), (3, (1 << 15, 1 << 15), 5), (50, (1 << 18, 1 << 20), 1)])
def test_collocations_equal_brute_force(spark, documents, tricky, monkeypatch, shards, bits, hot):
    """Over one and many shards, with a nearly full bit array, and in batches of a few texts."""
    monkeypatch.setattr(collocations, "BITS", bits)
    monkeypatch.setattr(collocations, "HOT", hot)
    monkeypatch.setattr(collocations, "BATCH_CHARS", 50_000)
    odd = [("ÀB àb ÀB\x1cz z\x00z  z\tz\x0bz. .. z z\u2028z\xa0z" * 4, "en"), ("Z Z z Z, z z? Z", None), ("z z z z", "und"), (".", "xx"),
           ("a b c d e. " * 9 + "a b c d. " * 3, "de")]
    docs = [(d["text"], d["lang"]) for d in documents] + odd + [(r.text, r.lang) for r in tricky.collect()]
    frame = spark.createDataFrame(docs, "text string, lang string").repartition(4).withColumns({c: F.lit("x") for c in ("h", "f", "m", "n", "phrase")})
    for support, top in ((4, 10_000), (30, 20)):
        got = sorted(tuple(r) for r in collocations.collocations(frame, support, shards, top).collect())
        assert got == brute_collocations(docs, support, top)


def test_collocations_shuffle_short_hashes_and_few_phrases(spark, documents):
    frame = spark.createDataFrame([(d["lang"], d["text"]) for d in documents], "lang string, text string").repartition(4)
    found = collocations.mined(collocations.coded(frame), 8)
    assert found.where(f"h < 0 OR h >= {1 << 40}").count() == 0
    # A phrase is counted only if its parts may be frequent too.
    frame = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    codes = collocations._word_codes(pa.array(["a", "b", "c"]))
    hashes = [int(h[i]) & 0x7FFFFFFFFFFFFFFF for h, whole in collocations._phrase_hashes(codes, "en") for i in range(len(h))]

    def phrases(some):
        return {r.phrase for r in collocations.counted(frame, spark.createDataFrame([(h,) for h in some], "h long")).collect()}

    assert phrases(hashes) == {"a", "b", "c", "a b", "b c", "a b c"}
    assert phrases(hashes[:3] + hashes[4:]) == {"a", "b", "c", "b c"}


def test_collocations_of_no_documents_and_sql(spark, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    for name, (fn, sql) in collocations.ENTRIES.items():
        ok, text = compare(spark, SF, name, fn, sql, duck(SF))
        assert ok, text
