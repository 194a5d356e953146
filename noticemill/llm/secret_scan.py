"""Secret scans: all rules in one pass over the bytes of a text.

The rules are compiled into one automaton (``secret_automaton``); it reports where a match of which rule starts, and a short
forward run from there finds its end. Matches are leftmost, longest and not overlapping within a kind, then those that
fail a rule's check are dropped. Positions are code points.

Defined cases: a null text is empty; kinds may overlap each other; ties at a start are listed in the order of the rules;
rows are judged one by one whatever their ids; an empty table gives an empty one; other columns are ignored. Bytes that
are no valid UTF-8 can't occur in a string column.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill.llm.secret_automaton import Scanner
from noticemill.llm.tables import table


def _any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Characters of an assigned value.
_VALUE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"


def _assigned(match: bytes) -> bool:
    """Whether the value has six characters or more: what follows the first separator, its blanks and its quote."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    return len(match[at + 1:].lstrip(b" ").lstrip(b"\"'")) >= 6


#: kind, pattern, check of a match. The first three are the base kinds, in their order.
RULES = (
    ("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", _assigned),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m) >= 20),
    ("hex", r"[0-9a-f]{24,}", None),  # a run of 24 or more is the same as a run checked for its length
    ("pem", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----", None),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", lambda m: len(m) >= 40),
    ("prefixed", r"(gh[opsu]_|glpat-|sk_live_|xox[abprs]-|AIza)[A-Za-z0-9_-]+", lambda m: len(m) >= 24),
    ("credentials", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._~!$*+-]+@", None),
)
BASE = ("assign", "access", "hex")
KINDS = tuple(kind for kind, _, _ in RULES)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    """One for each worker process."""
    return Scanner([pattern for _, pattern, _ in RULES])


def find(text: bytes | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of the kinds."""
    data = text or b""
    out = []
    for rule, a, b in scanner().matches(data):
        check = RULES[rule][2]
        if check is None or check(data[a:b]):
            out.append((a, rule, b))
    if not out:
        return []
    out.sort()
    places, at, chars = {}, 0, 0
    for p in sorted({p for a, _, b in out for p in (a, b)}):
        chars += len(data[at:p].decode("utf-8", "replace"))
        places[p], at = chars, p
    return [(KINDS[rule], places[a], places[b]) for a, rule, b in out]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, found): every row with its spans as ``array<struct<kind, start, end>>``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], ["doc_id", "found"])

    narrow = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(work, f"doc_id {kind}, found array<struct<kind string, start bigint, end bigint>>")


# --- query ---------------------------------------------------------------------------------------------------------

def op6_secret_scan(spark, sf_dir):
    joined = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    base = "filter(found, x -> x.kind IN ('assign', 'access', 'hex'))"
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) AS bigint) AS n_{k}") for k in BASE]
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *counts, F.expr(f"sha2({joined.format(base)}, 256) AS base_sha256"),
        F.expr(f"{joined.format('found')} AS spans"))


ENTRIES = {"op6_secret_scan": (op6_secret_scan, None)}
