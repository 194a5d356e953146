"""URL filters as a sort-merge range join on reversed hosts.

A host's canonical key is its labels in reverse, each closed by a unit separator, so a rule's host and all its subdomains
are one interval of keys and the intervals of any two rules are nested or apart. Rules and URLs are dealt into blocks of
the sorted keys; a rule goes to each block that its interval touches. One sweep over a sorted block keeps a stack of the
rules whose interval holds the current key; of these, the longest whose path starts the URL's path decides.

Block borders come from a sample of (key, hash) pairs, so a host that very many URLs share spreads over several blocks.
The sample only balances the work: any borders give the same result.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no rule; a rule with a null or empty
host is refused; of rules with equal host and path the one that blocks wins; rows that repeat an id are judged one by one;
other columns are ignored. Without a rule the verdict is ``allow`` if there is a host, else ``block``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill.llm.tables import partitions, table

END = "\x1f"
#: Sampled keys for each block border.
SAMPLE_PER_BLOCK = 20

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path) of a URL."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"\A[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def host_key(host: F.Column) -> F.Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), END), F.lit(END)))


def rule_rows(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, action string")


def sweep(rows):
    """Sorted (key, is_url, ..) rows of one block: yields each URL row with the rule that decides, or None.

    Rules of a key come before its URLs. A rule row is (key, host, path, action).
    """
    stack: list[list] = []
    for key, rule, payload in rows:
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if rule is not None:
            stack.append([key, *rule])
            continue
        _, path = payload
        best = None
        for _, host, prefix, action in stack:
            if path.startswith(prefix):
                rank = (len(host) + len(prefix), len(host), action == "block")
                if best is None or rank > best[0]:
                    best = (rank, host + prefix, action)
        yield payload, best


def judge(pages: DataFrame, rules: DataFrame, blocks: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``."""
    spark = pages.sparkSession
    blocks = blocks or partitions(spark)
    host, path = split_url(F.col("url").cast("string"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host"))).withColumn(
        "salt", F.xxhash64("page_id", "path"))
    wide = rules.where("host IS NOT NULL AND host <> ''").select(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    keyed = wide.withColumn("key", host_key(F.col("host")))

    total = urls.count()
    want = blocks * SAMPLE_PER_BLOCK
    share = min(1.0, 1.2 * want / max(total, 1))
    drawn = sorted((r["key"], r["salt"]) for r in urls.where(F.xxhash64("salt", F.lit(7)) < F.lit(
        int((share - 0.5) * 2 ** 64) if share < 1 else 2 ** 63 - 1)).select("key", "salt").limit(3 * want).collect())
    borders = [drawn[len(drawn) * i // blocks] for i in range(1, blocks)] if drawn else []
    shared = spark.sparkContext.broadcast(borders)  # blocks - 1 pairs

    def url_block(keys, salts):
        import pandas as pd

        cuts = shared.value
        return pd.Series([bisect_right(cuts, pair) for pair in zip(keys, salts)], dtype="int32")

    def rule_blocks(keys):
        import pandas as pd

        cuts = shared.value
        first = [bisect_left(cuts, (k, -2 ** 63)) for k in keys]
        last = [bisect_right(cuts, (k + "\U0010ffff", 2 ** 63)) for k in keys]
        return pd.Series([list(range(a, b + 1)) for a, b in zip(first, last)])

    of_url = _typed(url_block, "int", 2)
    of_rule = _typed(rule_blocks, "array<int>", 1)
    none = F.lit(None).cast("string")
    kind = pages.schema["page_id"].dataType.simpleString()
    left = urls.select(of_url("key", "salt").alias("block"), "key", F.lit(1).alias("is_url"), "page_id", "host", "path",
                       none.alias("action"))
    right = keyed.select(F.explode(of_rule("key")).alias("block"), "key", F.lit(0).alias("is_url"),
                         F.lit(None).cast(kind).alias("page_id"), "host", "path", "action")
    dealt = left.unionByName(right).repartition(blocks, "block").sortWithinPartitions("block", "key", "is_url")

    def work(batches):
        import pyarrow as pa

        def rows():
            at = None
            for batch in batches:
                for block, key, is_url, page, host_, path_, action in zip(*(c.to_pylist() for c in batch.columns)):
                    if block != at:  # a new block starts with an empty stack
                        at = block
                        yield "\x00", ("", "\x00", "allow"), None
                    yield (key, None, ((page, host_), path_)) if is_url else (key, (host_, path_, action), None)

        out = []
        for ((page, host_), path_), best in sweep(rows()):
            rule, verdict = (best[1], best[2]) if best else (None, "allow" if host_ else "block")
            out.append((page, host_, path_, rule, verdict))
            if len(out) >= 10_000:
                yield _batch(out, page_type)
                out = []
        if out:
            yield _batch(out, page_type)

    from pyspark.sql.pandas.types import to_arrow_type

    page_type = to_arrow_type(pages.schema["page_id"].dataType)
    return dealt.mapInArrow(work, f"page_id {kind}, host string, path string, rule string, verdict string")


def _typed(function, returns: str, n: int):
    """A scalar pandas UDF; the annotations are set here, as the module's are text."""
    import pandas as pd

    names = function.__code__.co_varnames[:n]
    function.__annotations__ = {x: pd.Series for x in names} | {"return": pd.Series}
    return F.pandas_udf(function, returns)


def _batch(rows, page_type):
    import pyarrow as pa

    kinds = (page_type, pa.string(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      ["page_id", "host", "path", "rule", "verdict"])


# --- query ---------------------------------------------------------------------------------------------------------

def op8_url_filters(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), rule_rows(spark))


_RULE_VALUES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
OP8_SQL = rf"""WITH u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
  THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT rid, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT rid, page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rh, rp, action) AS (VALUES {_RULE_VALUES}),
best AS (SELECT rid, max_by(rh || rp, length(rh || rp)) AS rule, max_by(action, length(rh || rp)) AS action FROM p, r
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (rid)"""

ENTRIES = {"op8_url_filters": (op8_url_filters, OP8_SQL)}
