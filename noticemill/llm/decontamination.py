"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The items' words go into one automaton over words; a document is streamed through it once, with the length of the longest
suffix that occurs in an item. Where that length reaches the window (or the whole of a shorter item) the words are hit.
The automaton is plain transition tables, at most two states for a word of the items. Items are taken in blocks of at most
``block_words`` words; each block makes one automaton, and the documents pass one after the other through all of them, so
the memory of a task is bounded for any number of items while the result stays that of all items together.

``clean`` removes the hit spans from the texts and drops documents of which more than ``max_coverage`` is hit.

Defined cases: a null or empty text has no words and is clean; an item without words has no window; items that repeat (or
share an id) count once for each id; a null item_id is ignored in ``items``; an empty table of items hits nothing;
documents are judged row by row, whatever their ids; other columns are passed through by ``clean`` and ignored by ``scan``.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill.session import cut_lineage

WINDOW = 10
#: Words of items in one automaton.
BLOCK_WORDS = 500_000
#: Share of a document's words above which ``clean`` drops it instead of cutting the spans.
MAX_COVERAGE = 0.5

#: A-Z to lower case, other ASCII that is no digit or letter to a blank; bytes of other letters stay.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


@dataclass
class Automaton:
    """Transitions, suffix links and longest lengths of the states; 0 is the root."""

    window: int = WINDOW
    next: list[dict] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: State -> ids of the items of which the state's window (or whole short item) is a part.
    items: dict[int, set] = field(default_factory=dict)
    #: State -> length of the window or short item found there.
    found: dict[int, int] = field(default_factory=dict)
    #: State -> shortest match that reports anything.
    least: list[int] = field(default_factory=list)

    def _state(self, length: int, link: int, nxt: dict) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """A copy of ``q`` for the suffixes no longer than those of ``p`` plus the word."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:  # the prefix is known from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def add(self, item: list[bytes]) -> None:
        last = 0
        for word in item:
            last = self._extend(last, word)

    def mark(self, item_id: str, item: list[bytes]) -> None:
        """After all items were added: note the item's windows."""
        width = min(self.window, len(item))
        state = size = 0
        for i, word in enumerate(item):
            state, size = self.next[state][word], size + 1
            while self.length[self.link[state]] >= width and state:
                state = self.link[state]
                size = min(size, self.length[state])
            if i + 1 >= width > 0:
                self.items.setdefault(state, set()).add(item_id)
                self.found[state] = width

    def finish(self) -> Automaton:
        none = 1 << 60
        self.least = [none] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = self.found.get(state, none)
            self.least[state] = min(own, self.least[self.link[state]])
        return self

    def hits(self, text: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged spans [start, end) of hit words, and the ids of the items found."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        spans: list[list[int]] = []
        ids: set = set()
        state = size = 0
        for i, word in enumerate(text):
            to = nxt[state].get(word)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = nxt[state].get(word)
                if to is None:
                    size = 0
                    continue
                size = length[state] + 1
            else:
                size += 1
            state = to
            if size >= least[state]:
                at, widest = state, 0
                while at > 0:
                    if at in self.found and self.found[at] <= size:
                        widest = max(widest, self.found[at])
                        ids |= self.items[at]
                    at = link[at]
                start = i + 1 - widest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return spans, ids


def build(items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> Automaton:
    auto = Automaton(window)
    for _, item in items:
        auto.add(item)
    for item_id, item in items:
        auto.mark(item_id, item)
    return auto.finish()


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS):
    """One automaton for each block of items, built as the items stream by; the driver never holds more than a block."""
    block, size = [], 0
    narrow = benchmark.where("item_id IS NOT NULL").select(
        F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").cast("binary").alias("t"))
    for row in narrow.toLocalIterator():
        item = words(bytes(row.t) if row.t is not None else None)
        if item:
            block.append((row.i, item))
            size += len(item)
        if size >= block_words:
            yield build(block, window)
            block, size = [], 0
    if block:
        yield build(block, window)


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_FOUND = "n_words bigint, spans array<array<int>>, items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id``, ``text``, ``n_words``, ``spans`` of hit words and sorted ``items`` of every row."""
    return _scan(docs, [docs.sparkSession.sparkContext.broadcast(a) for a in automata(benchmark, window, block_words)])


def _scan(docs: DataFrame, shared: list) -> DataFrame:
    """As ``scan``, through the given broadcast automata; spans are merged over all of them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"),
                      F.lit(None).cast("bigint").alias("n_words"), F.lit(None).cast("array<array<int>>").alias("spans"),
                      F.lit(None).cast("array<string>").alias("items"))

    def through(auto):
        def work(batches):
            import pyarrow as pa

            for batch in batches:
                n_words, spans, items = [], [], []
                for text, had, names in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4))):
                    ws = words(text)
                    new, ids = auto.value.hits(ws) if auto else ([], set())
                    n_words.append(len(ws))
                    spans.append(_merge([*new, *had]) if had else new)
                    items.append(sorted(ids | set(names or ())))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()),
                                                  pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                                                  pa.array(items, pa.list_(pa.string()))],
                                                 ["doc_id", "text", "n_words", "spans", "items"])
        return work

    for auto in shared or [None]:
        out = out.mapInArrow(through(auto), f"doc_id {kind}, text binary, {_FOUND}")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items, n_items, items_sha256 and contaminated of every row."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s[1] - s[0])
    return scan(docs, benchmark, window, block_words).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def cut(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def _rounds(carried: DataFrame, autos: list, kind: str, max_coverage: float) -> DataFrame:
    """(rest, text) after cutting the spans of all automata at once, again and again until nothing is hit."""
    state = "hit bigint, total bigint, again boolean"

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            row = batch.column(0)
            given = zip(*(row.field(i).to_pylist() for i in (1, 2)),
                        *(batch.column(i).to_pylist() for i in (1, 2, 3)))
            texts, hits, totals, again, keep = [], [], [], [], []
            for hit, total, text, n_words, spans in given:
                total = n_words if total is None else total
                hit += sum(b - a for a, b in spans)
                keep.append(not spans or hit <= max_coverage * total)
                texts.append(cut(text, spans) if spans and keep[-1] else text)
                hits.append(hit)
                totals.append(total)
                again.append(bool(spans))
            yield pa.RecordBatch.from_arrays(
                [row.field(0), pa.array(hits, pa.int64()), pa.array(totals, pa.int64()),
                 pa.array(again, pa.bool_()), pa.array(texts, pa.binary())],
                ["rest", "hit", "total", "again", "text"]).filter(pa.array(keep, pa.bool_()))

    todo = carried.select("rest", F.lit(0).cast("bigint").alias("hit"),
                          F.lit(None).cast("bigint").alias("total"), F.lit(True).alias("again"), "text")
    done = None
    while True:
        keyed = todo.select(F.struct("rest", "hit", "total").alias("doc_id"), "text")
        cleaned = cut_lineage(_scan(keyed, autos).mapInArrow(work, f"rest {kind}, {state}, text binary"))
        still = cleaned.where("NOT again").select("rest", "text")
        done = still if done is None else done.unionByName(still)
        todo = cleaned.where("again")
        if not todo.take(1):
            return done


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without hit spans, those of a larger coverage dropped; columns as they came, ``n_chars`` renewed.

    What remains is scanned again until nothing is hit, as the words around a cut become neighbours.
    """
    autos = [docs.sparkSession.sparkContext.broadcast(a) for a in automata(benchmark, window, block_words)]
    if not autos:
        return docs
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"),
                          F.col("text").cast("string").cast("binary").alias("text"))
    kind = carried.schema["rest"].dataType.simpleString()

    def through(auto):
        def one(text):
            hit, total = 0, None
            while True:
                ws = words(text)
                total = len(ws) if total is None else total
                spans, _ = auto.value.hits(ws)
                if not spans:
                    return text
                hit += sum(b - a for a, b in spans)
                if hit > max_coverage * total:
                    return None
                text = cut(text, spans)

        def work(batches):
            import pyarrow as pa

            for batch in batches:
                texts = [(t, one(t) if t else t) for t in batch.column(1).to_pylist()]
                keep = pa.array([not (was and now is None) for was, now in texts], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([now for _, now in texts], pa.binary())],
                                                 ["rest", "text"]).filter(keep)
        return work

    if len(autos) == 1:
        out = carried.mapInArrow(through(autos[0]), f"rest {kind}, text binary")
    else:
        out = _rounds(carried, autos, kind, max_coverage)
    whole = out.select("rest", F.col("text").cast("string").alias("text"))
    columns = [F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    result = whole.select(*columns)
    if "n_chars" in docs.columns:
        result = result.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return result


# --- query ---------------------------------------------------------------------------------------------------------

def op3_decontamination(spark, sf_dir):
    from noticemill.llm.tables import table

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP3_SQL = rf"""WITH b AS (SELECT cast(item_id AS varchar) AS item_id,
  regexp_extract_all(regexp_replace(text, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS raw FROM benchmark),
i AS (SELECT item_id, list_transform(raw, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
  FROM b WHERE item_id IS NOT NULL AND len(raw) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[k:k+least({WINDOW}, len(w))-1], ' ') AS x, least({WINDOW}, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - {WINDOW - 2}))) AS k FROM i)),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''),
  '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+'),
  lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
p AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS k FROM d),
hit AS (SELECT rid, k, n, item_id FROM (SELECT rid, k, l.n AS n, array_to_string(w[k:k+l.n-1], ' ') AS x
  FROM p, (SELECT DISTINCT n FROM win) l WHERE k + l.n - 1 <= len(w)) JOIN win USING (x, n)),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS pos FROM hit) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit,
  cast(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (rid) LEFT JOIN s USING (rid)"""

ENTRIES = {"op3_decontamination": (op3_decontamination, OP3_SQL)}
