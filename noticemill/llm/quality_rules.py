"""Rule bitmask ledger: every quality rule is evaluated once per text, in DataFrame functions only.

``ledger`` stores the measurements and one bit per failed rule. A policy is a set of rules with a version name;
``apply_policy`` decides by one bitwise AND, so a new policy never reads a text again, and ``ablations`` tells from the
stored bits what each rule alone removes.

Defined cases: a null or empty text has no words and fails ``few_words``; rows with equal or null ids are judged one by
one; an empty table gives an empty ledger; other columns are ignored, and the returned columns are always the ones
listed in ``LEDGER``. Repeated windows are compared by a 64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space that ends a word.
SPACE = r"\x20\x09-\x0D"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Rule name -> condition on the measurements that makes a text fail. The position of a rule is its bit.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "repeated_lines": "100 * n_dup_lines > 60 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 40 * n_words)",
    "capitals": "10 * n_capitals > 6 * word_chars",
}
#: Policy version -> rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
LEDGER = ("doc_id", *MEASURES, "fail_bits")


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def policy_mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def _repeat_words(windows: str, width: int = WINDOW) -> str:
    """Words covered by windows that occur twice or more; ``windows`` holds one hash per start position.

    Most texts repeat nothing, which one hash set shows; only the others sort (hash, position).
    """
    hit = "transform(filter(s, (x, k) -> get(s, k - 1).h <=> x.h OR get(s, k + 1).h <=> x.h), x -> x.i)"
    gaps = f"zip_with(slice(p, 2, size(p)), p, (b, a) -> least({width}, coalesce(b - a, {width})))"
    return f"""CASE WHEN size(array_distinct({windows})) = size({windows}) THEN 0L ELSE
      transform(array(sort_array(transform({windows}, (h, i) -> struct(h AS h, i AS i)))), s ->
        transform(array(sort_array({hit})), p -> aggregate({gaps}, 0L, (t, v) -> t + v))[0])[0] END"""


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each text."""
    words = docs.select(
        "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "doc_id", "text",
        F.expr(rf"""CASE WHEN text RLIKE '[^{SPACE}]' THEN
          split(regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', ''), '[{SPACE}]+')
          ELSE cast(array() AS array<string>) END""".replace("\\", "\\\\")).alias("w"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"))
    hashed = words.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(w, x -> xxhash64(x))").alias("h"))
    windows = hashed
    for step in (1, 2, 4):  # hashes of 2, 4 and then 8 neighbouring words
        windows = windows.withColumn("h", F.expr(f"zip_with(h, slice(h, {step} + 1, size(h)), (a, b) -> xxhash64(a, b))"))
    windows = windows.withColumn("h", F.expr(f"slice(h, 1, cast(greatest(0, n_words - {WINDOW - 1}) AS int))"))
    return windows.withColumn("n_repeat_words", F.expr(_repeat_words("h"))).select("doc_id", *MEASURES)


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``fail_bits`` of every row of ``docs``."""
    bits = " | ".join(f"if({condition}, {bit(rule)}L, 0L)" for rule, condition in RULES.items())
    return measure(docs).withColumn("fail_bits", F.expr(bits)).select(*LEDGER)


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """(policy, rule, failed, failed_alone): texts that fail a rule, and those only this rule of the policy removes.

    The ledger is first counted per bit pattern, so the rest handles at most 2 ** rules rows.
    """
    mask = policy_mask(policy)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("b")) for r in POLICIES[policy]])
    return patterns.select("bits", "n", F.inline(rules)).groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("b")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("b"), F.col("n")).otherwise(0)).alias("failed_alone"),
    ).withColumn("policy", F.lit(policy)).select("policy", "rule", "failed", "failed_alone")


def keep_good(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns as they came.

    Judged row by row beside the data, without a join, so rows with equal or null ids can't be mixed up.
    """
    carried = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    judged = apply_policy(ledger(carried.select(F.col("__row").alias("doc_id"), F.col("text"))), policy)
    # A filter is not pushed below an outer generator; pushed into the stages it would evaluate them once per mention.
    return judged.select("doc_id", F.explode_outer(F.array("kept")).alias("kept")).where("kept").select("doc_id.*")


# --- query ---------------------------------------------------------------------------------------------------------

def op5_quality_rules(spark, sf_dir):
    from noticemill.llm.tables import table

    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    failed = F.col("fail_bits").bitwiseAND(F.lit(policy_mask("base"))) != 0
    return rows.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_capitals", "fail_bits")


MEASURE_SQL = rf"""d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM {{docs}}),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS x
  FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
m AS (SELECT w.rid, w.doc_id, cast(len(w) AS bigint) AS n_words, cast(length(array_to_string(w, '')) AS bigint) AS word_chars,
  cast(length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS bigint) AS n_symbols,
  cast(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS bigint) AS n_capitals,
  cast(len(lines) AS bigint) AS n_lines, cast(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines,
  cast(coalesce(n_repeat_words, 0) AS bigint) AS n_repeat_words FROM w LEFT JOIN cov ON w.rid = cov.rid),
b AS (SELECT *, cast({' + '.join(f'CASE WHEN {c} THEN {bit(r)} ELSE 0 END' for r, c in RULES.items())} AS bigint) AS fail_bits FROM m)"""

OP5_SQL = f"""WITH {MEASURE_SQL.format(docs='documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {policy_mask('base')}) <> 0 AS base_failed, (fail_bits & {policy_mask('v1')}) = 0 AS kept,
  n_lines, n_capitals, fail_bits FROM b"""

ENTRIES = {"op5_quality_rules": (op5_quality_rules, OP5_SQL)}
