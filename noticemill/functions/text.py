"""Text column functions: normalisation, codes, hashes, regions, summaries.

All of them are built-in column expressions; the exceptions run as Arrow-batched UDFs:
Unicode NFKC over titles, which Spark lacks, and the trigram similarity of whole texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticemill import constants as C

_SPACE = r"\s"
_JAVA_META = set("\\^$.|?*+()[]{}")


def rx(pattern: str) -> str:
    """Give a pattern Unicode classes and ``\\n`` as the only line end, in Java."""
    return "(?Ud)" + pattern


def quote(word: str) -> str:
    return "".join("\\" + ch if ch in _JAVA_META else ch for ch in word)


def any_of(words: Sequence[str]) -> str:
    return "|".join(quote(w) for w in words)


def longest_first(words: Sequence[str]) -> list[str]:
    return sorted(words, key=len, reverse=True)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once; a plain column is evaluated again at each of its mentions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def nonblank(c: Column) -> Column:
    """Like ``blank_to_null``, for costly texts: ``nullif`` behind a condition evaluates its text twice."""
    return F.get(F.filter(F.array(c), lambda v: v != ""), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rx(r"^\s+|\s+\z"), "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, rx(r"\s+"), " ")


def compact(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, rx(r"\s+"), "")


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL when the pattern or group is absent."""
    return nonblank(F.regexp_extract(c, rx(pattern), group))


def groups(c: Column, pattern: str, count: int) -> Column:
    """Array of the first groups of the first match; one empty text where nothing matches. They must hold no comma."""
    order = ",".join(f"${i}" for i in range(1, count + 1))
    return F.split(F.regexp_replace(F.regexp_extract(c, rx(pattern), 0), rx(pattern), order), ",")


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(c, F.lit(rx(pattern))), F.lit(False))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    return matches(c, any_of(words))


def lines_of(c: Column) -> Column:
    """Lines as Python's ``splitlines`` gives them (the empty tail is dropped)."""
    ends = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
    parts = F.split(c, ends)
    return F.when(text_or_empty(c) == "", F.array().cast("array<string>")).otherwise(
        F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    )


def clean_capture(c: Column, limit: int = 200) -> Column:
    """Squeeze, trim outer punctuation, cut; the empty text stays empty."""
    return F.substring(F.btrim(squeeze(strip(text_or_empty(c))), F.lit("：:；;，,。 ")), 1, limit)


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    return _nfkc(c)


# --- titles and codes ------------------------------------------------------------------

def normalize_folded_title(c: Column, suffixes: Sequence[str] = C.TITLE_SUFFIXES) -> Column:
    """The native part of title normalisation, for text that is already NFKC."""
    t = F.lower(strip(text_or_empty(c)))
    for pattern in (C.TITLE_BRACKETS.replace("[\\[", "[\\[", 1), C.TITLE_PUNCTUATION, r"\s+"):
        t = F.regexp_replace(t, rx(pattern), "")
    # one suffix at most; a longer listed suffix always starts further left
    return F.regexp_replace(t, rx("(?:" + any_of(suffixes) + r")\z"), "")


def normalize_title(c: Column) -> Column:
    return normalize_folded_title(nfkc(c))


def bid_code(text: Column) -> Column:
    """Labelled code, else a bare one; the word-boundary scan runs only where a code can stand."""
    labelled = F.when(F.contains(text, F.lit("编号")), extract(text, C.CODE_LABELLED))
    bare = F.when(F.rlike(text, F.lit(rx(r"[A-Z]\d{4}"))), extract(text, C.CODE_BARE))
    return F.upper(F.coalesce(labelled, bare))


def identity_text(c: Column) -> Column:
    """Letters, digits and CJK only, lower case."""
    return F.lower(F.regexp_replace(text_or_empty(c), r"[^0-9A-Za-z\x{4e00}-\x{9fff}]+", ""))


def word_text(c: Column) -> Column:
    """Word characters only (the probe used for payload titles)."""
    return F.regexp_replace(text_or_empty(c), rx(r"\W+"), "")


def lifecycle_type(kind: Column, title: Column) -> Column:
    explicit = strip(text_or_empty(kind))
    probe = F.concat(explicit, F.lit(" "), text_or_empty(title))
    out = None
    for name, markers in C.LIFECYCLE_MARKERS:
        cond = contains_any(probe, markers)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(F.coalesce(blank_to_null(explicit), F.lit(C.UNKNOWN_TYPE)))


def short_title(title: Column, limit: int = 28) -> Column:
    def cut(packed: Column) -> Column:
        return let(F.regexp_replace(packed, rx(C.SHORT_TITLE_SUFFIX), ""), lambda c: (
            F.when(c == "", F.substring(title, 1, limit)).when(F.length(c) <= limit, c)
            .otherwise(F.concat(F.substring(c, 1, limit - 1), F.lit("…")))))

    return let(compact(text_or_empty(title)), lambda packed: F.when(packed == "", C.MISSING).otherwise(cut(packed)))


# --- n-grams and similarity ---------------------------------------------------------

def char_ngrams(c: Column, n: int) -> Column:
    """Distinct n-grams; a shorter text is its own single gram."""
    t = strip(text_or_empty(c))
    # one pass over the text; a substring for each place would start from the beginning each time
    grams = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return (F.when(t == "", F.array().cast("array<string>")).when(F.length(t) < n, F.array(t))
            .otherwise(F.array_distinct(grams)))


def _gram_numbers(text: str, n: int) -> np.ndarray:
    """Distinct n-grams, n up to 3, as sorted numbers: three code points take 63 bits, so equal numbers are equal grams. A shorter
    text is its own single gram, below zero."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    if len(points) < n:
        return np.array([-1 - sum((int(p) + 1) << (21 * i) for i, p in enumerate(points))][:len(points)], dtype=np.int64)
    grams = points[:len(points) - n + 1].copy()
    for i in range(1, n):
        grams = (grams << 21) | points[i:len(points) - n + 1 + i]
    return np.unique(grams)


def _number_jaccard(n: int):
    @F.pandas_udf(T.DoubleType())
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            g, h = _gram_numbers(x, n), _gram_numbers(y, n)
            both = len(np.intersect1d(g, h, assume_unique=True))
            out.append(both / (len(g) + len(h) - both) if len(g) + len(h) else 1.0)
        return pd.Series(out, dtype="float64")

    return similarity


def gram_jaccard(a: Column, b: Column, n: int) -> Column:
    """``jaccard`` of the ``char_ngrams`` of two whole texts, n up to 3: null as empty, without the white space around them."""
    return _number_jaccard(n)(strip(text_or_empty(a)), strip(text_or_empty(b)))


def bigram_jaccard(a: Column, b: Column) -> Column:
    return gram_jaccard(a, b, 2)


def trigram_jaccard(a: Column, b: Column) -> Column:
    return gram_jaccard(a, b, 3)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(both / (F.size(a) + F.size(b) - both))
    )


def title_similarity(na: Column, nb: Column, grams_a: Column | None = None,
                     grams_b: Column | None = None) -> Column:
    """Similarity of two normalised titles: equal, contained, else bigram Jaccard."""
    shorter = F.least(F.length(na), F.length(nb))
    ga = grams_a if grams_a is not None else char_ngrams(na, 2)
    gb = grams_b if grams_b is not None else char_ngrams(nb, 2)
    return (
        F.when((na == "") | (nb == ""), F.lit(0.0))
        .when(na == nb, F.lit(1.0))
        .when((F.contains(nb, na) | F.contains(na, nb)) & (shorter >= C.CONTAINED_MIN_CHARS),
              F.lit(C.CONTAINED_SIMILARITY))
        .otherwise(jaccard(ga, gb))
    )


def content_similarity(a: Column, b: Column, chars: int | None = None) -> Column:
    """Trigram Jaccard of two bodies, of their first ``chars`` characters if given; zero if one is empty."""
    ca, cb = (text_or_empty(x) if chars is None else F.substring(text_or_empty(x), 1, chars) for x in (a, b))
    return F.when((ca == "") | (cb == ""), F.lit(0.0)).otherwise(
        jaccard(char_ngrams(ca, 3), char_ngrams(cb, 3))
    )


def attachment_names(links: Column) -> Column:
    safe = F.coalesce(links, F.array().cast("array<string>"))
    names = F.transform(safe, lambda u: F.lower(F.element_at(
        F.split(F.element_at(F.split(F.regexp_replace(u, r"/+\z", ""), "/"), -1), r"\?"), 1)))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


# --- hashes and keys -------------------------------------------------------------------

def content_hash(title: Column, content: Column, url: Column, prefix: int | None = None) -> Column:
    """Over the whole content; ``prefix`` = 2000 hashes only so many characters of it, and misses later changes."""
    body = text_or_empty(content)
    return F.sha2(F.concat_ws("|", text_or_empty(title), body if prefix is None else F.substring(body, 1, prefix),
                              text_or_empty(url)), 256)


def source_key(source: Column, item_id: Column, url: Column, title: Column) -> Column:
    fallback = F.md5(F.coalesce(blank_to_null(url), title))
    return F.concat(source, F.lit(":"), F.coalesce(blank_to_null(item_id), fallback))


def list_key(first: Column, title: Column) -> Column:
    return F.coalesce(blank_to_null(first), title)


def detail_url(item_id: Column) -> Column:
    """Detail page of a list identifier."""
    value = strip(text_or_empty(item_id))
    return F.when(value == "", C.DETAIL_URL_ROOT).otherwise(
        F.concat(F.lit(C.DETAIL_URL_BASE + "?uuid="), value,
                 F.lit("&inpvalue=&dataSource=0&tenderAgency=")))


# --- regions ---------------------------------------------------------------------------

def region_alias_pairs() -> list[tuple[str, str]]:
    """(alias, canonical), longest alias first, otherwise in listed order."""
    pairs = [(alias, name) for name, aliases in C.REGION_ALIASES.items() for alias in aliases]
    return sorted(pairs, key=lambda p: len(p[0]), reverse=True)


def _alias_array() -> Column:
    rows = [F.struct(F.lit(a).alias("alias"), F.lit(n).alias("name")) for a, n in region_alias_pairs()]
    return F.array(*rows)


def region_tags(text: Column) -> Column:
    """Canonical regions in order of discovery; each alias consumes one occurrence."""
    start = F.struct(text_or_empty(text).alias("rest"),
                     F.array().cast("array<string>").alias("found"))

    def step(acc: Column, entry: Column) -> Column:
        pos = F.locate_col(entry["alias"], acc["rest"]) if hasattr(F, "locate_col") else F.instr(
            acc["rest"], entry["alias"])
        rest = F.concat(F.substring(acc["rest"], F.lit(1), pos - 1), F.lit(" "),
                        F.substring(acc["rest"], pos + F.length(entry["alias"]), F.length(acc["rest"])))
        found = F.when(F.array_contains(acc["found"], entry["name"]), acc["found"]).otherwise(
            F.array_append(acc["found"], entry["name"]))
        return F.when(pos > 0, F.struct(rest.alias("rest"), found.alias("found"))).otherwise(acc)

    return F.aggregate(_alias_array(), start, step, lambda acc: acc["found"])


def strip_regions(text: Column) -> Column:
    """Every listed region word becomes a blank, longest words first."""
    return F.aggregate(_alias_array(), text_or_empty(text),
                       lambda acc, entry: F.replace(acc, entry["alias"], F.lit(" ")))


def short_region(name: Column, suffixes: Sequence[str] = C.REGION_SUFFIXES) -> Column:
    out = name
    for word in suffixes:
        out = F.replace(out, F.lit(word), F.lit(""))
    return out


def regions_compatible(a: Column, b: Column) -> Column:
    """Missing passes; else one contains the other once 省/市 are dropped."""
    sa, sb = short_region(a, ("省", "市")), short_region(b, ("省", "市"))
    hit = F.contains(b, sa) | F.contains(a, sb) | F.contains(sb, sa) | F.contains(sa, sb)
    return (text_or_empty(a) == "") | (text_or_empty(b) == "") | F.coalesce(hit, F.lit(False))


# --- summaries and labels ------------------------------------------------------------

def simple_summary(title: Column, content: Column, limit: int = 600) -> Column:
    """Up to eight telling lines, else the head of the text, under the title."""
    body = text_or_empty(content)
    kept = F.slice(F.filter(F.transform(lines_of(body), strip),
                            lambda ln: F.rlike(ln, F.lit(any_of(C.SUMMARY_TERMS)))), 1, 8)
    head = F.when(text_or_empty(title) != "", F.concat(F.lit("标题："), title))
    start = F.coalesce(blank_to_null(F.substring(squeeze(body), 1, limit)), F.lit(C.MISSING))
    text = F.concat_ws("\n", head, F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(start))
    return F.when(F.length(text) > limit,
                  F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def label_of(c: Column, labels: dict[str, str], default: Column) -> Column:
    out = None
    for key, label in labels.items():
        out = F.when(c == key, label) if out is None else out.when(c == key, label)
    return out.otherwise(default)


def source_display(c: Column) -> Column:
    return label_of(c, C.SOURCE_DISPLAY_NAMES, F.coalesce(blank_to_null(c), F.lit(C.MISSING)))


def metadata_text(title: Column, region: Column, platform: Column, code: Column, industry: Column,
                  received: Column, ends: Column) -> Column:
    """Labelled lines that stand in for a detail text that is not available."""
    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label + "："), F.coalesce(blank_to_null(value), F.lit(C.MISSING)))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("项目名称："), title),
        line("区域", region), line("交易平台", platform), line("项目编号", code),
        line("行业", industry), line("公告发布时间", received), line("公告结束时间", ends),
        F.lit("说明：本条仅使用公开检索接口元数据；完整正文以官方公告详情为准。"),
    )
