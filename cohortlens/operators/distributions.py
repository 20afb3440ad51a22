"""Distribution summaries behind the charts (G1-G5) and the correlation
matrix (A21).

Everything is computed from a value-frequency table (column, group, value,
n): the raw rows are aggregated once, partially on the map side, and the box
statistics, whiskers and histogram bins come from that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .quantiles import exact_quantiles


def correlation_matrix(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson correlation for every ordered pair, long form
    (col_a, col_b, r).  Pairwise-complete like pandas; one aggregate pass
    computes each unordered pair once."""
    cols = [c for c in cols if c in df.columns]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    one = df.agg(*[F.corr(X.num(cols[i]), X.num(cols[j])).alias(f"r{i}_{j}")
                   for i, j in pairs])
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                r = F.lit(1.0)
            else:
                lo, hi = min(i, j), max(i, j)
                r = F.round(F.col(f"r{lo}_{hi}"), digits)
            rows.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r.alias("r")))
    return one.select(F.inline(F.array(*rows)))


def group_frequencies(df: DataFrame, cols: Sequence[str], by: str) -> DataFrame:
    """(column, grp, value, n) for numeric ``cols`` split by ``by``; NULL values dropped."""
    long = df.select(F.col(by).cast("string").alias("grp"), *[X.num(c).alias(c) for c in cols]) \
        .unpivot(["grp"], list(cols), "column", "value")
    return (long.filter(F.col("value").isNotNull())
            .groupBy("column", "grp", "value").agg(F.count(F.lit(1)).alias("n")))


def box_stats(df: DataFrame, cols: Sequence[str], by: str, whisker: float = 1.5) -> DataFrame:
    """G1: per (column, group): n, q1, median, q3, iqr, whiskers (the most
    extreme data within ``whisker`` x IQR of the box) and the flier count."""
    freq = group_frequencies(df, cols, by)
    qs = exact_quantiles(freq, ["column", "grp"], "value", "n", [0.25, 0.5, 0.75])
    qs = qs.select("column", "grp", "n", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                   F.col("_q")[2].alias("q3"))
    qs = qs.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo = F.col("q1") - whisker * F.col("iqr")
    hi = F.col("q3") + whisker * F.col("iqr")
    box = qs.select(F.col("column").alias("_c"), F.col("grp").alias("_g"), "q1", "q3", "iqr")
    j = freq.join(box, (F.col("column") == F.col("_c")) & F.col("grp").eqNullSafe(F.col("_g")))
    w = j.groupBy("column", "grp").agg(
        F.min(F.when(F.col("value") >= lo, F.col("value"))).alias("whisker_low"),
        F.max(F.when(F.col("value") <= hi, F.col("value"))).alias("whisker_high"),
        F.sum(F.when((F.col("value") < lo) | (F.col("value") > hi), F.col("n")).otherwise(0))
        .cast("long").alias("fliers"))
    w = w.withColumnsRenamed({"column": "_c", "grp": "_g"})
    return (qs.join(w, (F.col("column") == F.col("_c")) & F.col("grp").eqNullSafe(F.col("_g")))
            .drop("_c", "_g").withColumnRenamed("grp", by))


def histogram(df: DataFrame, column: str, by: str, bins: int = 20) -> DataFrame:
    """Per group, ``bins`` equal-width bins over that group's own min..max
    (numpy/matplotlib rule: half-open bins, the last one closed; a constant
    group spans value +- 0.5).  Returns non-empty bins (grp, bin, lo, hi, count).
    """
    freq = group_frequencies(df, [column], by).drop("column")
    rng = freq.groupBy("grp").agg(F.min("value").alias("_mn"), F.max("value").alias("_mx"))
    first = F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn"))
    last = F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx"))
    rng = rng.select("grp", first.alias("_first"), last.alias("_last"))
    t = freq.join(rng, "grp")
    step = (F.col("_last") - F.col("_first")) / bins

    def edge(i):
        return F.when(i >= bins, F.col("_last")).otherwise(i * step + F.col("_first"))

    k = ((F.col("value") - F.col("_first")) * (F.lit(float(bins)) / (F.col("_last") - F.col("_first")))).cast("int")
    t = t.withColumn("_k", F.when(k >= bins, bins - 1).otherwise(k))
    t = t.withColumn("_k", F.when(F.col("value") < edge(F.col("_k")), F.col("_k") - 1).otherwise(F.col("_k")))
    t = t.withColumn("_k", F.when((F.col("value") >= edge(F.col("_k") + 1)) & (F.col("_k") != bins - 1),
                                  F.col("_k") + 1).otherwise(F.col("_k")))
    out = t.groupBy("grp", F.col("_k").alias("bin"), "_first", "_last").agg(
        F.sum("n").cast("long").alias("count"))
    step2 = (F.col("_last") - F.col("_first")) / bins
    return out.select(F.col("grp").alias(by), "bin",
                      (F.col("bin") * step2 + F.col("_first")).alias("bin_low"),
                      F.when(F.col("bin") + 1 >= bins, F.col("_last"))
                      .otherwise((F.col("bin") + 1) * step2 + F.col("_first")).alias("bin_high"),
                      "count")


def rate_by_value_vs_baseline(base: DataFrame, column: str, event: str) -> DataFrame:
    """30-day rate by each value of ``column`` next to the overall rate
    (the chart's baseline line), with the gap in points."""
    from .segments import Count, Rate, Sum, segment_rates, versus_baseline
    seg = segment_rates(base, [column], [Count("encounters"), Sum("readmitted_30day", event),
                                         Rate("readmission_rate_pct", event)])
    overall = segment_rates(base, [], [Rate("overall_rate_pct", event)])
    return versus_baseline(seg, overall, "readmission_rate_pct", "overall_rate_pct")


