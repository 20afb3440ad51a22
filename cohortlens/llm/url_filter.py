r"""URL filter: allow/block rules, then a blocked Bloom filter over listed URLs.

Verdicts come from two sources.  (1) A small, fixed table of (host, path) rules,
compiled into one CASE expression; a rule fits its host and all subdomains when
the url's path starts with the rule's path, and the longest rule wins.  (2) For
urls that no rule fits, a list of blocked canonical URLs of any length.

The list check never sends every url through a join.  The list is hashed into a
*blocked Bloom filter*: each entry owns one 512-bit block (eight longs) and sets
one bit in each long, so a probe touches one row of the filter.  The filter is a
DataFrame with one row per non-empty block; up to ``broadcast_blocks`` blocks (72
bytes each) go to all tasks, a larger filter meets the undecided urls by block
number.  The distinct canonical forms of the urls whose eight bits are all set, the
possible hits, go into an exact hash join with the list, which removes the false
positives.  The answer, one row per possible hit, is stored and joined back to the
undecided pages only: to all tasks if its counted rows are few, else by canonical form.
Pages that a rule or a missing host decides take part in no join.

Everything is DataFrame expressions (no Python on the executors).  The number of
blocks follows the counted size of the list (``bits_per_item``).

Defined cases: a null url or one without ``://`` has empty host and path, no
canonical form and the verdict allow.  An empty list blocks nothing.  Repeated
rows get equal verdicts.  Extra columns of the input are carried; the columns
``host, path, rule, verdict`` are replaced if the input has them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, key_list

#: (verdict, host, path); fixed values.
BASE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
LANES = 8


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lowered."""
    at = F.locate("://", url)
    tail = F.substr(url, at + F.lit(3))
    return F.coalesce(F.when(at > 0, ascii_lower(F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1))), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    tail = F.substr(url, at + F.lit(3))
    return F.coalesce(F.when(at > 0, F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)), F.lit(""))


def canonical_url(host: Column, path: Column) -> Column:
    """Host without www./m./blog. and without a default port, path without a trailing
    ``/``, ``index.html`` or ``.html``; scheme, query and fragment go.  Null without host."""
    h = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m|blog)\.", "")
    p = F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html?$", ""), r"/+$", "")
    return F.when(host != "", F.concat(h, p))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], column: str) -> Column:
    """The longest fitting rule's text or verdict, or null; ``rules`` is a short fixed table."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    out = None
    for verdict, rule_host, rule_path in ordered:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.lit(rule_host + rule_path if column == "rule" else verdict)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def _bits(h: Column) -> list[Column]:
    """One bit for each lane, from disjoint 6-bit slices of a second hash."""
    g = F.xxhash64(h, F.lit(7))
    return [F.call_function("shiftleft", F.lit(1).cast("long"),
                            F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
            for i in range(LANES)]


def build_filter(listed: DataFrame, url_col: str, n_blocks: int) -> DataFrame:
    """Blocks of the filter: (__slot, __lane0..7), one row per non-empty block."""
    h = F.xxhash64(F.col(url_col))
    rows = listed.filter(F.col(url_col).isNotNull()).select(
        F.pmod(h, F.lit(n_blocks)).alias("__slot"), *[b.alias(f"__lane{i}") for i, b in enumerate(_bits(h))])
    return rows.groupBy("__slot").agg(*[F.bit_or(f"__lane{i}").alias(f"__lane{i}") for i in range(LANES)])


def filter_urls(pages: DataFrame, listed: DataFrame, url_col: str = "url", listed_col: str = "canonical",
                rules: Sequence[tuple[str, str, str]] = BASE_RULES, bits_per_item: int = 16,
                broadcast_blocks: int = 200_000) -> DataFrame:
    """``pages`` with host, path, canonical, rule, verdict, possible_hit and listed."""
    out = ("host", "path", "canonical", "rule", "verdict", "possible_hit", "listed")
    pages = pages.drop(*[c for c in pages.columns if c.lower() in out])
    listed = listed.select(F.col(listed_col).alias("__listed")).filter(F.col("__listed").isNotNull())
    n_listed = listed.count()
    n_blocks = max(1, -(-n_listed * bits_per_item // (64 * LANES)))
    blocks = build_filter(listed, "__listed", n_blocks)
    if n_blocks <= broadcast_blocks:
        blocks = F.broadcast(blocks)

    url = F.col(url_col).cast("string")
    host, path = url_host(url), url_path(url)
    df = pages.withColumn("host", host).withColumn("path", path)
    df = df.withColumn("canonical", canonical_url(F.col("host"), F.col("path")))
    df = df.withColumn("rule", match_rule(F.col("host"), F.col("path"), rules, "rule"))
    is_open = F.col("rule").isNull() & F.col("canonical").isNotNull()

    # The filter passes possible hits; only their distinct forms meet the list.
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.xxhash64("canonical"))):
        hit = hit & (F.col(f"__lane{i}").bitwiseAND(b) != 0)
    possible = (df.filter(is_open).select("canonical", F.pmod(F.xxhash64("canonical"), F.lit(n_blocks)).alias("__block"))
                .join(blocks, F.col("__block") == F.col("__slot")).filter(hit).select("canonical").distinct())
    names = listed.distinct().withColumn("__in", F.lit(True))
    checked = key_list(possible.join(names, F.col("canonical") == F.col("__listed"), "left").select(
        F.col("canonical").alias("__hit"), F.coalesce("__in", F.lit(False)).alias("__listed")), "url-hits")

    # Pages that a rule or a missing host decides are not joined, so no null key is dealt out.
    key, flag = fresh(df, "hit"), fresh(df, "listed")
    checked = checked.withColumnsRenamed({"__hit": key, "__listed": flag})
    asked = df.filter(is_open).join(checked, F.col("canonical") == F.col(key), "left").withColumns({
        "possible_hit": F.col(key).isNotNull(), "listed": F.coalesce(F.col(flag), F.lit(False))}).drop(key, flag)
    decided = df.filter(~is_open).withColumns({"possible_hit": F.lit(False), "listed": F.lit(False)})
    by_rule = match_rule(F.col("host"), F.col("path"), rules, "verdict")
    return asked.unionByName(decided).withColumn(
        "verdict", F.when(F.col("rule").isNotNull(), by_rule)
        .when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
