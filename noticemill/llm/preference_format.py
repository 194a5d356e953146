"""Preference formatting: one rendered prompt and two masked completions for each pair, in DataFrame functions only.

The prompt is the longest common prefix of turns (role and text) of the chosen and the rejected conversation; what follows
on either side is its completion. A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. The masks list the stretches
[start, end) of a completion, in code points, that carry loss: text and end mark of the assistant's turns.

``collect_turns`` makes one array of turns for each conversation; a conversation is one row of the result, so its turns
have to meet anyway. ``pairs_from`` derives pairs where only single conversations are given: chosen is the conversation up
to the assistant's last turn; in rejected that turn repeats the assistant's answer before it or, without one that differs,
echoes the last question (else it is empty).

Defined cases: turns are ordered by turn, role and text, and equal rows of a conversation count once; a null role is
``unknown``, a null text empty; rows without a conversation id form no conversation; a conversation without an
assistant's turn gives no pair; if both sides are equal, or one begins with the whole other, the completion that is left
without turns is empty; marks inside a text are broken up (``<|im_`` becomes ``< |im_``); an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill.llm.tables import table

TRAINED = "assistant"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def collect_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the ordered array of (turn, role, text) of each conversation."""
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct(
        F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.array_distinct(F.collect_list("t"))).alias("turns"))


def pairs_from(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) from single conversations, see above."""
    last = F.expr(f"size(turns) + 1 - array_position(reverse(transform(turns, x -> x.role = '{TRAINED}')), true)")
    cut = collect_turns(conversations).withColumn("last", last.cast("int")).where("last <= size(turns)").select(
        "conv_id", F.expr("slice(turns, 1, last)").alias("chosen"))
    before = cut.withColumn("before", F.expr("slice(chosen, 1, size(chosen) - 1)")).withColumn("final", F.element_at("chosen", -1))
    answer, question = [F.expr(f"nullif(try_element_at(filter(before, x -> x.role = '{r}'), -1).text, final.text)")
                        for r in (TRAINED, "user")]
    other = F.coalesce(answer, question, F.lit(""))
    negative = F.struct(F.col("final.turn").alias("turn"), F.col("final.role").alias("role"), other.alias("text"))
    return before.select(F.col("conv_id").alias("pair_id"), "chosen", F.concat("before", F.array(negative)).alias("rejected"))


def _head(x: str) -> str:
    return f"concat('{OPEN}', {x}.role, '\\n')"


def _body(x: str) -> str:
    return f"concat(replace({x}.text, '<|im_', '< |im_'), '{CLOSE.replace(chr(10), chr(92) + 'n')}')"


def _render(turns: str) -> F.Column:
    return F.expr(f"array_join(transform({turns}, x -> concat({_head('x')}, {_body('x')})), '')")


def _mask(turns: str) -> F.Column:
    """Stretches of the rendered turns that carry loss."""
    return F.expr(f"""aggregate({turns}, struct(0 AS at, cast(array() AS array<struct<start: int, end: int>>) AS spans),
      (s, x) -> struct(s.at + length({_head('x')}) + length({_body('x')}) AS at,
        if(x.role = '{TRAINED}', array_append(s.spans, struct(s.at + length({_head('x')}) AS start,
          s.at + length({_head('x')}) + length({_body('x')}) AS end)), s.spans) AS spans), s -> s.spans)""")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, and ``chosen`` and ``rejected`` with ``*_mask`` of every pair.

    ``pairs`` has pair_id and the arrays ``chosen`` and ``rejected`` of structs with role and text.
    """
    common = """transform(array(array_position(zip_with(slice(chosen, 1, least(size(chosen), size(rejected))),
      slice(rejected, 1, least(size(chosen), size(rejected))), (a, b) -> a.role <=> b.role AND a.text <=> b.text), false)),
      p -> if(p = 0, least(size(chosen), size(rejected)), cast(p AS int) - 1))[0]"""
    cut = pairs.withColumn("n", F.expr(common)).select(
        "pair_id", "n", F.expr("slice(chosen, 1, n)").alias("shared"),
        F.expr("slice(chosen, n + 1, size(chosen))").alias("c"), F.expr("slice(rejected, n + 1, size(rejected))").alias("r"))
    return cut.select("pair_id", F.col("n").cast("bigint").alias("n_prompt_turns"), _render("shared").alias("prompt"),
                      _render("c").alias("chosen"), _render("r").alias("rejected"),
                      _mask("c").alias("chosen_mask"), _mask("r").alias("rejected_mask"))


# --- query ---------------------------------------------------------------------------------------------------------

def op2_preference_format(spark, sf_dir):
    written = "array_join(transform({0}, x -> concat(x.start, '-', x.end)), ',') AS {0}"
    return format_pairs(pairs_from(table(spark, sf_dir, "conversations"))).select(
        F.col("pair_id").alias("conv_id"), "n_prompt_turns", "prompt", "chosen", "rejected",
        F.expr(written.format("chosen_mask")), F.expr(written.format("rejected_mask")))


OP2_SQL = f"""WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
l AS (SELECT conv_id, max(i) AS last FROM o WHERE role = '{TRAINED}' GROUP BY conv_id),
f AS (SELECT l.conv_id, last, o.text AS final FROM l JOIN o ON o.conv_id = l.conv_id AND i = last),
a AS (SELECT f.conv_id, last, final, max_by(o.text, i) FILTER (role = '{TRAINED}') AS answer, max_by(o.text, i) FILTER (role = 'user') AS ask
  FROM f LEFT JOIN o ON o.conv_id = f.conv_id AND i < last GROUP BY ALL),
p AS (SELECT conv_id, last, coalesce(nullif(answer, final), nullif(ask, final), '') AS negative FROM a),
s AS (SELECT o.conv_id, i, role, text AS c, CASE WHEN i = last THEN negative ELSE text END AS r FROM o JOIN p USING (conv_id) WHERE i <= last),
n AS (SELECT conv_id, coalesce(min(i) FILTER (c <> r), max(i) + 1) - 1 AS n FROM s GROUP BY conv_id),
x AS (SELECT s.conv_id, i, n, role, '{OPEN}' || role || chr(10) AS head, replace(c, '<|im_', '< |im_') || '<|im_end|>' || chr(10) AS cb,
  replace(r, '<|im_', '< |im_') || '<|im_end|>' || chr(10) AS rb FROM s JOIN n USING (conv_id)),
y AS (SELECT *, sum(CASE WHEN i > n THEN length(head) + length(cb) ELSE 0 END) OVER w AS ce,
  sum(CASE WHEN i > n THEN length(head) + length(rb) ELSE 0 END) OVER w AS re FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY i))
SELECT conv_id, cast(max(n) AS bigint) AS n_prompt_turns, coalesce(string_agg(head || cb, '' ORDER BY i) FILTER (i <= n), '') AS prompt,
  coalesce(string_agg(head || cb, '' ORDER BY i) FILTER (i > n), '') AS chosen,
  coalesce(string_agg(head || rb, '' ORDER BY i) FILTER (i > n), '') AS rejected,
  coalesce(string_agg((ce - length(cb)) || '-' || ce, ',' ORDER BY i) FILTER (i > n AND role = '{TRAINED}'), '') AS chosen_mask,
  coalesce(string_agg((re - length(rb)) || '-' || re, ',' ORDER BY i) FILTER (i > n AND role = '{TRAINED}'), '') AS rejected_mask
FROM y GROUP BY conv_id"""

ENTRIES = {"op2_preference_format": (op2_preference_format, OP2_SQL)}
