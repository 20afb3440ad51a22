"""Data profiling (Q1-Q6): structure, sentinels, cardinality, numerics,
class balance, single-column drill-down.

Each profile is one or two aggregate passes; wide per-column statistics are
computed in one ``agg`` and reshaped into rows with ``inline``, so a
50-column profile does not run 50 jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from .clean import sentinel_counts  # noqa: F401  (Q2 lives with the cleaning rules)
from .clean import value_frequencies
from .segments import present
from .quantiles import exact_quantiles


def _rows(one: DataFrame, specs: list[tuple[str, dict]]) -> DataFrame:
    """Reshape a one-row frame into rows: specs = [(row label, {field: column})]."""
    structs = [F.struct(F.lit(label).alias("column"), *[c.alias(k) for k, c in fields.items()])
               for label, fields in specs]
    return one.select(F.inline(F.array(*structs)))


def profile_structure(df: DataFrame, exact_distinct: bool = True) -> DataFrame:
    """Q1: (column, dtype, non_null, null_count, null_pct, unique, sample_value).

    Counts and samples come from one aggregate, reshaped into one row per
    column; derived figures are computed once on the reshaped rows.  Exact
    distinct counts use one long-form (column, value) distinct pass instead of
    N COUNT(DISTINCT) expressions (which Spark would expand N-fold);
    ``exact_distinct=False`` switches to HyperLogLog++ in the same aggregate.
    The sample is the smallest non-null value, which is deterministic (row
    order is not).
    """
    fields = df.schema.fields
    # Wide per-column aggregates written as SQL expressions: one call into the
    # JVM instead of hundreds of small Column objects.
    aggs = ["count(1) AS _rows"]
    for i, f in enumerate(fields):
        q = _ident(f.name)
        aggs += [f"count({q}) AS n{i}", f"CAST(min({q}) AS STRING) AS s{i}"]
        if not exact_distinct:
            aggs.append(f"approx_count_distinct({q}) AS d{i}")
    one = df.selectExpr(*aggs)
    structs = []
    for i, f in enumerate(fields):
        uniq = f", d{i} AS unique" if not exact_distinct else ""
        structs.append(f"struct({_lit(f.name)} AS column, {_lit(f.dataType.simpleString())} AS dtype, "
                       f"n{i} AS non_null, _rows AS rows, s{i} AS sample{uniq})")
    out = one.selectExpr(f"inline(array({', '.join(structs)}))")
    if exact_distinct:
        long = df.unpivot([], [F.col(f.name).cast("string").alias(f.name) for f in fields], "column", "value")
        uniq = (long.filter(F.col("value").isNotNull()).distinct()
                .groupBy("column").agg(F.count(F.lit(1)).alias("unique")))
        out = out.join(uniq, "column", "left").withColumn("unique", F.coalesce("unique", F.lit(0)))
    nulls = F.col("rows") - F.col("non_null")
    return out.select("column", "dtype", "non_null", nulls.alias("null_count"),
                      X.rate_pct(nulls, "rows").alias("null_pct"),
                      F.col("unique").cast("long").alias("unique"),
                      F.coalesce("sample", F.lit("ALL NULL")).alias("sample_value")) \
        .transform(present, F.desc("null_pct"), "column")


def profile_cardinality(df: DataFrame, cols: Sequence[str], top_n: int = 10,
                        buckets: int = 64) -> DataFrame:
    """Q3: top-n values per column (NULL is a value), with count and % of rows.

    Two-level top-n: values are first ranked inside (column, hash bucket), so
    a high-cardinality column is spread over ``buckets`` tasks; only the n
    best of each bucket reach the final per-column ranking.  Ties on count
    are broken by value (NULL last) so the cut is deterministic.
    """
    cols = [c for c in cols if c in df.columns]
    long = df.unpivot([], [F.col(c).cast("string").alias(c) for c in cols], "column", "value")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    order = [F.desc("count"), F.col("value").asc_nulls_last()]
    bucket = F.pmod(F.hash("value"), F.lit(buckets))
    w1 = Window.partitionBy("column", "_b").orderBy(*order)
    stage1 = (counts.withColumn("_b", bucket).withColumn("_r", F.row_number().over(w1))
              .filter(F.col("_r") <= top_n))
    w2 = Window.partitionBy("column").orderBy(*order)
    top = stage1.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= top_n)
    rows = df.agg(F.count(F.lit(1))).scalar()
    return (top.select("column", "value", F.col("count").cast("long").alias("count"),
                       X.rate_pct("count", rows).alias("pct"))
            .orderBy("column", F.desc("count"), F.col("value").asc_nulls_last()))


def profile_numerics(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Q4: count, min, max, mean, median, std, Q1, Q3, skew, IQR, range.

    One aggregate pass, reshaped into one row per column.  Quantiles are exact
    (linear interpolation), by radix selection on value frequencies; std is the sample standard deviation; skew is
    bias-corrected (pandas ``skew``).  Mean/std/skew are rounded to
    ``digits`` decimals.
    """
    aggs = []
    for i, c in enumerate(cols):
        x = X.num(c)
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                 F.avg(x).alias(f"av{i}"), F.stddev_samp(x).alias(f"sd{i}"),
                 F.skewness(x).alias(f"sk{i}")]
    one = df.agg(*aggs)
    long = _rows(one, [(c, {"count": F.col(f"n{i}"), "min": F.col(f"mn{i}"), "max": F.col(f"mx{i}"),
                            "av": F.col(f"av{i}"), "sd": F.col(f"sd{i}"), "g1": F.col(f"sk{i}")}) for i, c in enumerate(cols)])
    quantiles = exact_quantiles(value_frequencies(df, cols), ["column"], "value", "n", [0.25, 0.5, 0.75]).drop("n")
    long = long.join(quantiles, "column", "left")
    q = F.col("_q")
    return long.select(
        "column", "count", "min", "max", F.round("av", digits).alias("mean"), q[1].alias("median"),
        F.round("sd", digits).alias("std"), q[0].alias("q1"), q[2].alias("q3"),
        F.round(X.skew_unbiased(F.col("g1"), F.col("count")), digits).alias("skew"),
        (q[2] - q[0]).alias("iqr"), (F.col("max") - F.col("min")).alias("range"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Q5: (class, count, percentage, imbalance_ratio); NULL classes dropped.

    The ratio is majority % / minority % of the rounded percentages, computed
    exactly from their hundredths.
    """
    counts = (df.filter(F.col(target).isNotNull()).groupBy(target)
              .agg(F.count(F.lit(1)).alias("count")))
    w = Window.partitionBy()
    pct = X.round_ratio(F.col("count") * 100, F.sum("count").over(w), 2)
    out = counts.withColumn("percentage", pct)
    h = F.round(F.col("percentage") * 100).cast("long")
    return (out.withColumn("imbalance_ratio", X.round_ratio(F.max(h).over(w), F.min(h).over(w), 1))
            .orderBy(F.desc("count")))


def column_drilldown(df: DataFrame, column: str, sentinel: str = "?", top_n: int = 5) -> DataFrame:
    """Q6: one column's type, rows, top values, equality and regex sentinel hits.

    Returns the top values as rows, each carrying the column-level figures.
    """
    c = F.col(column)
    stats = df.agg(F.struct(F.count(F.lit(1)).alias("total_rows"),
                            F.count_if(c == sentinel).alias("equality_hits"),
                            F.count_if(c.cast("string").rlike("^" + _regex_escape(sentinel) + "$"))
                            .alias("regex_hits"))).scalar()
    top = profile_cardinality(df, [column], top_n).select("value", "count")
    return top.select(F.lit(column).alias("column"),
                      F.lit(df.schema[column].dataType.simpleString()).alias("dtype"),
                      stats["total_rows"].alias("total_rows"), "value", "count",
                      stats["equality_hits"].alias("equality_hits"), stats["regex_hits"].alias("regex_hits"))


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _regex_escape(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in s)

