"""Operators that read rows one by one: quality rules, decontamination, secrets, languages, URLs, pages."""

import hashlib
import html
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noticemill.llm import decontamination, html_extraction, language_id, quality_rules, secret_automaton, secret_scan, url_filters
from llm_cases import SF
from oracle_check import compare, duck



@pytest.mark.parametrize("module", (quality_rules, decontamination, url_filters))
def test_equals_sql(spark, module):
    for name, (fn, sql) in module.ENTRIES.items():
        ok, text = compare(spark, SF, name, fn, sql, duck(SF))
        assert ok, text


# --- quality rules

def test_ledger_of_tricky_rows(tricky, no_docs):
    rows = quality_rules.ledger(tricky).collect()
    assert len(rows) == tricky.count() and quality_rules.ledger(no_docs).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[4][0].n_words == by[5][0].n_words == by[6][0].n_words == 0 and by[4][0].fail_bits & quality_rules.bit("few_words")
    assert by[8][0].n_repeat_words == 30_000 and by[7][0].word_chars == 200_000 and len(by[2]) == 2
    assert by[10][0].n_dup_lines == 49 and by[11][0].n_repeat_words == 32 and by[12][0].fail_bits & quality_rules.bit("symbols")


def test_windows_that_overlap_count_words_once(spark):
    rows = spark.createDataFrame([(1, "a b " * 6), (2, "a b c d e f g h i"), (3, "a b c d e f g h x a b c d e f g h")], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.measure(rows).collect()}
    assert got == {1: 12, 2: 0, 3: 16}


def test_policies_and_ablations(tricky):
    rows = quality_rules.ledger(tricky).cache()
    kept = {p: quality_rules.apply_policy(rows, p).where("kept").count() for p in quality_rules.POLICIES}
    assert kept["v1"] <= kept["base"]
    table = {r.rule: r for r in quality_rules.ablations(rows, "v1").collect()}
    bits = [r.fail_bits for r in rows.collect()]
    for rule in quality_rules.RULES:
        b = quality_rules.bit(rule)
        assert table[rule].failed == sum(bool(x & b) for x in bits) and table[rule].failed_alone == sum(x == b for x in bits)


def test_keep_good_returns_rows_as_they_came(tricky):
    kept = quality_rules.keep_good(tricky)
    assert kept.columns == tricky.columns and kept.schema == tricky.schema
    assert {r.doc_id for r in kept.collect()} >= set() and kept.where("doc_id = 12").count() == 0


# --- decontamination

def brute_hits(items, text, window):
    hit, found = set(), set()
    for item_id, item in items:
        n = min(window, len(item))
        windows = {tuple(item[j:j + n]) for j in range(len(item) - n + 1)}
        for p in range(len(text) - n + 1):
            if tuple(text[p:p + n]) in windows:
                hit |= set(range(p, p + n))
                found.add(item_id)
    return hit, found


def test_automaton_equals_brute_force():
    rng = random.Random(4)
    for _ in range(3000):
        letters = [bytes([97 + i]) for i in range(rng.choice([2, 3]))]
        window = rng.choice([2, 3, 4])
        items = [(str(i), [rng.choice(letters) for _ in range(rng.randint(1, 7))]) for i in range(rng.randint(1, 4))]
        text = [rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 25))]
        spans, found = decontamination.build(items, window).hits(text)
        assert ({x for a, b in spans for x in range(a, b)}, found) == brute_hits(items, text, window)


def test_blocks_of_items_give_the_same(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    one = decontamination.decontaminate(docs, items).select("doc_id", "n_hit", "items_sha256")
    many = decontamination.decontaminate(docs, items, block_words=400).select("doc_id", "n_hit", "items_sha256")
    assert sorted(one.collect()) == sorted(many.collect())


def test_decontamination_of_tricky_rows(spark, tricky, no_docs):
    items = spark.createDataFrame([(1, "Three, four; FIVE six"), (1, "nine ten"), (None, "one"), (2, None), (3, "..."), (4, "b")],
                                  "item_id long, text string")
    rows = decontamination.decontaminate(tricky, items).collect()
    assert len(rows) == tricky.count() and decontamination.decontaminate(no_docs, items).count() == 0
    one = next(r for r in rows if r.doc_id == 1)
    assert (one.n_words, one.n_hit, one["items"]) == (16, 6, ["1"])
    assert next(r for r in rows if r.doc_id == 4).items_sha256 == hashlib.sha256(b"").hexdigest()
    clean = decontamination.clean(tricky, items)
    assert clean.columns == tricky.columns and clean.count() == tricky.count()
    text = clean.where("doc_id = 1").first().text
    assert "four five" not in text and "nine" not in text and "seven" in text
    assert decontamination.clean(tricky, items, max_coverage=0.1).where("doc_id = 1").count() == 0
    nothing = decontamination.decontaminate(tricky, items.limit(0))
    assert nothing.where("contaminated").count() == 0 and nothing.count() == tricky.count()


def test_clean_is_the_same_for_any_blocks(spark):
    def ws(a, b):
        return [f"w{i}" for i in range(a, b)]

    items = spark.createDataFrame([(1, " ".join(ws(0, 20))), (2, " ".join(ws(12, 32))), (3, " ".join(ws(100, 120))),
                                   (4, " ".join(ws(200, 220)))], "item_id long, text string")
    docs = [(1, ws(100, 120) + ws(900, 926) + ws(200, 220)),  # 40 of 66 words
            (2, ws(900, 940) + ws(0, 32) + ws(940, 980)),  # spans that overlap
            (3, ws(900, 940) + ws(200, 208) + ws(0, 20) + ws(208, 220) + ws(940, 980)),  # a cut joins an item of another block
            (4, ws(900, 950)), (5, [])]
    rows = spark.createDataFrame([(i, " ".join(t), len(" ".join(t))) for i, t in docs] + [(6, None, None)],
                                 "doc_id long, text string, n_chars long")
    one = sorted(map(str, decontamination.clean(rows, items).collect()))
    assert one == sorted(map(str, decontamination.clean(rows, items, block_words=20).collect()))
    assert sorted(r.doc_id for r in decontamination.clean(rows, items, block_words=20).collect()) == [2, 3, 4, 5, 6]


# --- secrets

BASE = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
         lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def brute_secrets(text):
    return [(k, a, b) for a, _, k, b in sorted((m.start(), i, k, m.end()) for i, (k, r, ok) in enumerate(BASE)
                                               for m in r.finditer(text) if ok(m))]


def test_secrets_equal_regexes(documents):
    rng = random.Random(5)
    parts = ["token", "secret", "Password", "api_key", "APIKEY", "AKIA", "A", "0", "f", " ", "  ", "=", ":", "'", '"', "é", "_",
             "ABCDEF0123456789", "0123456789abcdef", "日", ".", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 18))) for _ in range(4000)] + [d["text"] for d in documents]
    for text in texts:
        got = [x for x in secret_scan.find((text or "").encode()) if x[0] in secret_scan.BASE]
        assert got == brute_secrets(text or ""), text


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["a*b", "(ab|a)c?", "[ab]{2,3}c", "a+b?a{1,2}", "(a|bc)*d", "[^a]b"]), st.text("abcd", max_size=10))
def test_automaton_finds_each_start(pattern, text):
    data = text.encode()
    scanner = secret_automaton.Scanner([pattern])
    want = [i for i in range(len(data)) if (m := re.compile(pattern.encode()).match(data, i)) and m.end() > i]
    starts = {at for at, _ in scanner.starts(data)}
    assert starts >= set(want)


def test_secrets_of_tricky_rows(tricky, no_docs):
    rows = {r.doc_id: r.found for r in secret_scan.scan(tricky).collect()}
    assert rows[4] == rows[5] == [] and secret_scan.scan(no_docs).count() == 0
    assert [(x.kind, x.start, x.end) for x in rows[9]] == [("assign", 14, 35)]


# --- languages

def test_held_out_accuracy(spark):
    rows = language_id.op7_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out AND lang IS NOT NULL")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count() > 0
    assert rows.where("score < 0 OR score > 1").count() == 0


def test_filter_has_no_false_negatives():
    import numpy as np

    codes = language_id.mix(np.arange(5000, dtype=np.uint64))
    masks = np.where(np.arange(5000) % 2 == 0, 1, 2).astype(np.uint64)
    made = language_id.Filter.of(["a", "b"], codes, masks)
    assert made.counts(codes[::2])[0] == 2500 and made.counts(codes[1::2])[1] == 2500
    strange = language_id.mix(np.arange(10 ** 6, 10 ** 6 + 20000, dtype=np.uint64))
    assert abs(made.counts(strange)[0] / 20000 - made.false_positive_rates()[0]) < 0.01


def test_languages_of_tricky_rows(spark, tricky, no_docs):
    model = language_id.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = {r.doc_id: r.lang_pred for r in language_id.predict(tricky, model).collect()}
    assert rows[4] == rows[5] == rows[6] == rows[12] == "und" and rows[9] != "und"
    assert language_id.predict(no_docs, model).count() == 0
    empty = language_id.learn(no_docs)
    assert {r.lang_pred for r in language_id.predict(tricky, empty).collect()} == {"und"}


# --- URLs

def test_urls_equal_brute_force(spark):
    rng = random.Random(6)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "xexample.com", "net", "b.net", "org", "", "EXAMPLE.com"]
    paths = ["", "/", "/en", "/en/", "/en/1?x=/es/", "/es/2#y", "/fr/", "?q", "#h"]
    urls = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(400)]
    urls += [(None, None), (401, ""), (402, "mailto:x"), (403, "http://net/es/"), (403, "http://net/es/")]
    pages = spark.createDataFrame([(*u, "clash", "clash") for u in urls], "page_id long, url string, key string, block string")
    rules = [*url_filters.RULES, ("example.com", "/", "block"), ("b.net", "/en/1", "allow")]

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.lower()
        fit = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow" if host else "block")

    for blocks in (1, 7):
        got = url_filters.judge(pages, url_filters.rule_rows(spark, rules), blocks).collect()
        assert sorted((str(r.page_id), *map(str, r[1:])) for r in got) == sorted((str(i), *map(str, brute(u))) for i, u in urls)
    assert url_filters.judge(pages.limit(0), url_filters.rule_rows(spark)).count() == 0
    assert url_filters.judge(pages, url_filters.rule_rows(spark).limit(0)).where("rule IS NOT NULL").count() == 0


# --- pages

def test_articles_of_given_pages():
    import pyarrow.parquet as pq

    for page in pq.read_table(f"{SF}/pages.parquet", columns=["html"])["html"].to_pylist():
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [re.sub(r"[ \t\n\r\f\v]+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
        assert html_extraction.main_text(page) == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>One.<p>Two.", "One.\nTwo."),
    ("<nav><a href=x>Menu</a></nav><main><h2>T</h2><p>A&nbsp;b &#233;\n c.</p></main><footer>F</footer>", "T\nA b é c."),
    ("<article><p>Text.</p><form><input><button>Go</button></form><div class='comments'><p>First!</p></div></article>", "Text."),
    ("<article><p>a<br>b</p><script>if (1 < 2) x('</p>')</script><style>p{}</style></article>", "a b"),
    ("<body><div class='cookie-notice'>We use cookies.</div><div><p>Long enough text, with marks. And more, here.</p>"
     "<p>Second one, too.</p></div><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></body>",
     "Long enough text, with marks. And more, here.\nSecond one, too."),
    ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one\ntwo\nx\ny"),
])
def test_pages(page, text):
    assert html_extraction.main_text(page) == text


@pytest.mark.parametrize("tag", ("<article>", "<article class='teaser'>", "<article class='comment-body'>", "<article class='related'>"))
def test_text_beside_an_article(tag):
    body = [f"This is paragraph {i} of the main text, which is long, has marks; and goes on for a while." for i in range(8)]
    page = "<div class=post>" + "".join(f"<p>{b}</p>" for b in body) + f"</div>{tag}<p>Read more here.</p></article>"
    got = html_extraction.main_text(page).split("\n")
    assert got[:8] == body and ("comment" not in tag and "related" not in tag or len(got) == 8)


def test_links_inside_main():
    body = "".join(f"<p>Paragraph {i} of the text, which is long, has marks; and goes on for a while.</p>" for i in range(5))
    page = f"<main><ul><li><a href=1>Home</a><li><a href=2>All the latest news</a></ul><div>{body}</div></main>"
    assert html_extraction.main_text(page) == "\n".join(re.findall("<p>(.*?)</p>", body))


def test_heading_before_dense_text():
    page = "<article><h1>A heading of text.</h1><p>" + "LOUD!! WORDS!! " * 90 + "</p><p>And some more words.</p></article>"
    assert html_extraction.main_text(page).startswith("A heading of text.\nLOUD")


def test_names_of_an_article():
    assert html_extraction.main_text("<article class='post has-comments category-notice'><p>Text.</p></article>") == "Text."


def test_page_rows(spark):
    rows = [(1, "u", None, "c"), (None, None, "<p>x</p>", "c"), (1, "u", "<p>" + "long. " * 100_000, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extraction.extract(pages).collect()
    assert sorted(len(r.text) for r in got) == [0, 1, 599_999]
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_marked_sections_and_modifier_classes():
    from noticemill.llm.html_extraction import main_text

    body = "".join(f"<p>Paragraph {i}, which says a few words about salt and sugar.</p>" for i in range(6))
    for lead in ("<![foo[bar]]>", "<![ ]>", "<![endif]>", "<![CDATA[x]]>", "<![", "<!x>"):
        for page in (f"{lead}<div>{body}</div>", f"<div>{body}{lead}</div>", lead):
            main_text(page)  # never raises
    assert main_text(f"<![foo[bar]]><div>{body}</div>").count("Paragraph") == 6
    for name in ("content has-sidebar", "no-header", "is-social"):
        assert main_text(f"<div class='{name}'>{body}</div>").count("Paragraph") == 6
    assert main_text(f"<div class='site-footer'>{body}</div>") == ""
