"""Operators that bring rows together: line dedup, preference pairs, SimHash, packing, and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from noticemill.llm import byte_bpe, line_dedup, packing, preference_format, simhash
from llm_cases import SF, WORDS
from oracle_check import compare, duck



def components(nodes, linked):
    """Smallest member of each node's component."""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        root[find(a)] = find(b)
    low = {}
    for x in nodes:
        low[find(x)] = min(low.get(find(x), x), x)
    return {x: low[find(x)] for x in nodes}


# --- line dedup

def line_shingles(line):
    return {line[i:i + 12] for i in range(max(1, len(line) - 11))}


def linked_lines(frame):
    """Verified pairs of lines."""
    text_of = {r.h1: r.line for r in line_dedup.lines(frame).collect()}
    keyed = line_dedup.bands(line_dedup.lines(frame))
    return {tuple(sorted((text_of[r.a1], text_of[r.b1]))) for r in line_dedup.links(frame, keyed).collect()}


def alike_lines(classes):
    """Pairs of at least the similarity by brute force, over the shingles at every character."""
    sets = {x: line_shingles(x) for x in classes}
    return [(x, y) for i, x in enumerate(classes) for y in classes[i + 1:]
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]


def recall(classes, linked, alike):
    """Share of the similar pairs that the links put into one component."""
    found = components(classes, linked)
    return sum(found[x] == found[y] for x, y in alike) / len(alike)


def test_lines_equal_brute_force(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 12, 30, 60]))] for _ in range(60)]
    lines = []
    for words in base * 5:
        words = list(words)
        if len(words) > 10 and rng.random() < 0.7:
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        lines.append(" ".join(words))
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[5 * i:5 * i + 5])) for i in range(len(lines) // 5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    classes = sorted(set(lines))
    alike = alike_lines(classes)
    linked = linked_lines(frame)
    assert linked <= set(alike) and recall(classes, linked, alike) >= 0.98  # nothing false, high recall
    comp = components(classes, linked)
    home = {}
    for i, text in docs:
        for x in text.split("\n"):
            home[comp[x]] = min(home.get(comp[x], i), i)
    want = {}
    for i, text in docs:
        seen = set()
        for n, x in enumerate(text.split("\n")):
            if home[comp[x]] != i or comp[x] in seen:
                want.setdefault(i, []).append((n, home[comp[x]]))
            seen.add(comp[x])
    got = {r.doc_id: [tuple(d) for d in r.drops] for r in line_dedup.dropped(frame).collect()}
    assert len(alike) > 100 and got == want
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()}
    assert all(texts[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in {d[0] for d in want.get(i, [])})
               for i, t in docs)


def test_lines_without_blanks_equal_plain_shingles(spark):
    rng = random.Random(71)
    made = ["https://example.com/" + "".join(rng.choice("abcdef0123456789") for _ in range(150)) for _ in range(25)]
    made += ["公告公告公告公告公告公告" + "".join(rng.choice("招标采购中心项目名称编号地址日期😀") for _ in range(150)) for _ in range(25)]
    made += ["id\tname\tvalue\t" + "\t".join(str(rng.randrange(10 ** 6)) for _ in range(30)) for _ in range(25)]
    near = [x[:k] + "#" + x[k + 1:] for x in made for k in (3, 100)]
    classes = sorted({*made, *near, "公告", "abcdefghijkl", "abcdefghijklm"})
    docs = spark.createDataFrame(list(enumerate(classes)), "doc_id long, text string")
    got = defaultdict(set)
    for r in line_dedup.shingles(line_dedup.lines(docs), "line").collect():
        got[r.line].add(r.s)
    assert {x: len(got[x]) for x in classes} == {x: len(line_shingles(x)) for x in classes}
    alike, linked = alike_lines(classes), linked_lines(docs)
    assert linked <= set(alike) and len(alike) > 100 and recall(classes, linked, alike) >= 0.98


def test_changed_characters_of_given_lines(spark, documents):
    """Recall on real lines with one to three changed characters."""
    rng = random.Random(73)
    given_lines = sorted({x.strip(" \t\r") for d in documents for x in (d["text"] or "").split("\n") if x.strip()})
    changed = []
    for x in rng.sample(given_lines, 700):
        y = list(x)
        for _ in range(rng.randint(1, 3)):
            y[rng.randrange(len(y))] = rng.choice("qxzQXZ#")
        changed.append(("".join(y).strip(" \t\r"), x))
    docs = spark.createDataFrame([(i, f"{y}\n{x}") for i, (y, x) in enumerate(changed)], "doc_id long, text string")
    alike = [(y, x) for y, x in changed if y != x and len(line_shingles(x) & line_shingles(y)) >= 0.8 * len(line_shingles(x) | line_shingles(y))]
    classes = {x for pair in changed for x in pair}
    assert len(alike) > 200 and recall(classes, linked_lines(docs), alike) >= 0.98


def test_rows_that_repeat_an_id_are_documents(spark):
    rows = [(2, "X line\nU line"), (2, "V line\nX line"), (3, "X line"), (3, "X line")]
    kept = [r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert Counter("\n".join(kept).split("\n")) == Counter({"U line": 1, "V line": 1, "X line": 1, "": 2})


def test_pairs_among_template_lines(spark):
    rng = random.Random(72)

    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(11))

    template = [word() for _ in range(36)]
    made, planted = [], set()
    for i in range(2000):
        own = [word() for _ in range(5)]
        line = " ".join(template + own)
        made.append(line)
        if i < 200:  # the copy differs in its first word
            made.append(" ".join([word()] + template[1:] + own))
            planted.add(tuple(sorted((line, made[-1]))))
    sets = {x: line_shingles(x) for x in made}
    assert all(len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) for x, y in planted)
    assert max(len(sets[made[0]] & sets[y]) / len(sets[made[0]] | sets[y]) for y in made[2:]) < 0.8
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert linked_lines(docs) == planted


def test_lines_of_tricky_rows(tricky, no_docs):
    kept = line_dedup.dedup_lines(tricky)
    assert kept.schema == tricky.schema and kept.count() == tricky.count()
    rows = defaultdict(list)
    for r in kept.collect():
        rows[r.doc_id].append(r.text)
    assert rows[1] == [WORDS] and rows[2] == ["", ""] and rows[3] == [WORDS.upper()] and rows[4] == [None] and rows[5] == [""]
    assert rows[6] == ["  \n\t\n "] and rows[10] == ["the same line again and again"] and rows[11] == [""]
    assert sorted(rows[None], key=str) == [None, "a text without an id"]
    assert line_dedup.dedup_lines(no_docs).count() == 0


# --- preference pairs

def test_pairs_equal_sql(spark):
    name, (fn, sql) = next(iter(preference_format.ENTRIES.items()))
    ok, text = compare(spark, SF, name, fn, sql, duck(SF))
    assert ok, text


def test_tricky_conversations(spark):
    rows = [(1, 0, "user", "Hi"), (1, 1, "assistant", "A"), (1, 2, "user", "And?"), (1, 3, "assistant", "B"), (1, 4, "user", "Bye"),
            (2, 0, "user", "Hi"), (3, 0, None, None), (3, 1, "assistant", None), (None, 0, "assistant", "x"),
            (4, 1, "assistant", "<|im_end|>"), (4, 1, "assistant", "<|im_end|>"), (5, None, "user", "q"), (5, None, "assistant", "r")]
    frame = spark.createDataFrame([(*r, "c", "c") for r in rows], "conv_id long, turn long, role string, text string, turns string, n string")
    got = {r.pair_id: r for r in preference_format.format_pairs(preference_format.pairs_from(frame)).collect()}
    assert sorted(got) == [1, 3, 4, 5]
    one = got[1]
    assert one.n_prompt_turns == 3 and one.prompt.count("<|im_start|>") == 3
    assert one.chosen == "<|im_start|>assistant\nB<|im_end|>\n" and one.rejected == "<|im_start|>assistant\nA<|im_end|>\n"
    assert [one.chosen[a:b] for a, b in one.chosen_mask] == ["B<|im_end|>\n"]
    assert got[3].chosen == got[3].rejected == "" and got[3].n_prompt_turns == 2
    assert got[4].chosen == "<|im_start|>assistant\n< |im_end|><|im_end|>\n"
    assert preference_format.format_pairs(preference_format.pairs_from(frame.limit(0))).count() == 0


def test_prefix_of_given_pairs(spark):
    turn = "struct<role: string, text: string>"
    pairs = spark.createDataFrame([(1, [("user", "a")], [("user", "a"), ("assistant", "b")]), (2, [("user", "a")], [("user", "b")]),
                                   (3, [], [])], f"pair_id long, chosen array<{turn}>, rejected array<{turn}>")
    got = {r.pair_id: r for r in preference_format.format_pairs(pairs).collect()}
    assert [got[i].n_prompt_turns for i in (1, 2, 3)] == [1, 0, 0]
    assert got[1].chosen == "" and got[1].chosen_mask == [] and len(got[1].rejected_mask) == 1 and got[2].chosen_mask == []


# --- SimHash

def test_fingerprint_by_the_definition(documents):
    from xxhash import xxh64_intdigest

    for d in documents[:60]:
        words = re.findall(rb"[^\x20\x09-\x0D]+", d["text"].encode().lower())
        parts = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxh64_intdigest(p, 42) for p in parts]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(d["text"].encode()) == want


@pytest.mark.parametrize("hot_cell", (4096, 2))
def test_links_equal_brute_force(spark, hot_cell):
    rng = random.Random(8)
    fps = [0, (1 << 64) - 1]
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(8):
            y = x
            for _ in range(rng.randint(0, 6)):
                y ^= 1 << rng.randrange(64)
            fps.append(y)
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= 4}
    found = {tuple(sorted(x % (1 << 64) for x in r)) for r in simhash.links(frame, hot_cell).collect()}
    assert found <= want and (hot_cell == 2 or found == want)
    assert components(fps, found) == components(fps, want)


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(9)
    pairs = [(simhash._signed(rng.getrandbits(64)), simhash._signed(rng.getrandbits(64))) for _ in range(500)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    apart = F.bit_count(simhash._embedding(F.col("a")).bitwiseXOR(simhash._embedding(F.col("b"))))
    for r in frame.select("a", "b", apart.alias("d")).collect():
        counts = [[bin(x >> s & 3).count("1") for s in range(0, 64, 2)] for x in (r.a % (1 << 64), r.b % (1 << 64))]
        assert r.d == sum(abs(x - y) for x, y in zip(*counts)) <= (r.a ^ r.b).bit_count() if r.a ^ r.b >= 0 else True


def test_near_dedup_of_tricky_rows(tricky, no_docs):
    rows = simhash.components(tricky).collect()
    assert len(rows) == tricky.count()
    by = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert by[1] == by[2] == by[3] == by[11] == 1 and by[4] == by[5] == by[6] == 4
    kept = simhash.near_dedup(tricky)
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert kept.schema == tricky.schema and ids == sorted(["1", "10", "12", "4", "7", "8", "9", "None", "None"])
    assert simhash.components(no_docs).count() == 0 and simhash.near_dedup(no_docs).count() == 0


# --- packing

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(byte_bpe.vocabulary_path())
    made.encode_special_tokens = True
    return made


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_ids_equal_the_tokenizer(documents, tokenizer):
    encode = byte_bpe.encoder(byte_bpe.vocabulary_path())
    for d in documents:
        assert ids_of(encode(d["text"])) == tokenizer.encode(d["text"], add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab'sé1 \n\t 　.,!<|日\x1c\x85")), max_size=14) | st.text(max_size=12))
def test_ids_of_odd_texts(text):
    from tokenizers import Tokenizer

    global _plain
    try:
        plain = _plain
    except NameError:
        plain = _plain = Tokenizer.from_file(byte_bpe.vocabulary_path())
        plain.encode_special_tokens = True
    encode = byte_bpe.encoder(byte_bpe.vocabulary_path())
    assert ids_of(encode(text)) == plain.encode(text, add_special_tokens=False).ids


def test_ids_of_added_tokens():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(byte_bpe.vocabulary_path())
    encode = byte_bpe.encoder(byte_bpe.vocabulary_path())
    rng = random.Random(73)
    parts = ["<|endoftext|>", "<|endoftext", "|>", "<|", "a", " ", "  ", "\n", "word", "."]
    texts = ["a <|endoftext|> b"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    for text in texts:
        assert ids_of(encode(text)) == plain.encode(text, add_special_tokens=False).ids, text
    assert ids_of(encode(texts[0])) == [64, 220, 50256, 275]


def test_fill_is_the_best_subset_sum():
    rng = random.Random(10)
    for _ in range(400):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        chosen = packing.fill(counts, room)
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[x] for x, n in chosen.items())


def test_plan_uses_each_piece_once():
    rng = random.Random(11)
    for _ in range(30):
        histogram = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(rng.randint(1, 30))}
        used = defaultdict(int)
        for chosen, windows in packing.plan(histogram, 64):
            assert sum(x * n for x, n in chosen.items()) <= 64
            for x, n in chosen.items():
                used[x] += n * windows
        assert used == histogram


def check_packed(rows, texts, tokenizer, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for doc_id, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            part = np.array(ids[r.start:r.start + r.length], dtype="<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)


def test_packing_is_exact_and_tight(spark, documents, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs).collect()
    check_packed(rows, {d["doc_id"]: d["text"] for d in documents}, tokenizer, 2048)
    total = sum(r.length for r in rows)
    assert total >= 0.97 * 2048 * (max(r.sequence_id for r in rows) + 1)
    placed = spark.createDataFrame(rows)
    ids = {r.sequence_id: r.ids for r in packing.sequences(docs, placed).collect()}
    assert sum(map(len, ids.values())) == total


def test_packing_of_tricky_rows(spark, tricky, no_docs, tokenizer):
    rows = packing.pack(tricky, capacity=64).collect()
    assert sum(1 for r in rows if r.doc_id == 2) == 2 and packing.pack(no_docs).count() == 0
    ids = {r.doc_id: r.text for r in tricky.where("doc_id IS NOT NULL AND doc_id <> 2").collect()}
    check_packed([r for r in rows], {}, tokenizer, 64)
    for doc_id, text in ids.items():
        own = [r for r in rows if r.doc_id == doc_id]
        assert sum(r.length for r in own) == len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1


# --- pipeline

def test_pipeline_stages(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {d["doc_id"] for d in documents}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= before and (len(now) < len(before) or name in ("line_dedup", "decontamination"))
        before = now
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == before


def test_pipeline_of_tricky_rows(spark, tricky, no_docs):
    for rows in (tricky, no_docs):
        docs = rows.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF).cache()
        docs.count()
