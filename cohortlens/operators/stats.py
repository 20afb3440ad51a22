"""Association tests (H1-H8) computed from distributed aggregates.

Raw rows are only ever reduced to contingency tables and value-frequency
tables (partial aggregation on the map side); the statistics are column
arithmetic on those small frames.  Only the final p-values, which need the
normal / chi-square tail functions that Spark SQL lacks, are evaluated in a
vectorised pandas UDF on the one-row-per-test result.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import expr as X
from ..session import materialize
from .quantiles import exact_quantiles
from .slicing import ROWS_PER_SLICE, prefix_sum

try:  # ship the small tail-probability helpers with the UDFs, by value,
    from pyspark import cloudpickle  # so Python workers need no package import
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover
    pass


# ---------------------------------------------------------------------------
# Tail probabilities (small numeric helpers for the final result rows)
# ---------------------------------------------------------------------------

def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1:  # series for P(a, x)
        term = total = 1.0 / a
        ap = a
        for _ in range(10_000):
            ap += 1
            term *= x / ap
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return max(0.0, 1.0 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    # continued fraction for Q(a, x) (modified Lentz)
    tiny = 1e-300
    b = x + 1 - a
    c = 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-16:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, dof: int) -> float:
    if x is None or dof is None or dof <= 0 or (isinstance(x, float) and math.isnan(x)):
        return float("nan")
    if dof == 1:
        return math.erfc(math.sqrt(max(x, 0.0) / 2))
    return _gamma_q(dof / 2.0, x / 2.0)


def chi2_critical(dof: int, alpha: float = C.ALPHA) -> float:
    """Critical value by bisection on the survival function."""
    lo, hi = 0.0, 1000.0 + 10.0 * dof
    for _ in range(200):
        mid = (lo + hi) / 2
        if chi2_sf(mid, dof) > alpha:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


CHI2_CRITICAL = {1: C.CHI2_CRITICAL_DOF1, **{d: chi2_critical(d) for d in range(2, 31)}}


def _chi2_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(s), int(d)) if pd.notna(s) and pd.notna(d) else np.nan
                      for s, d in zip(stat, dof)])


def _normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([min(1.0, math.erfc(abs(float(v)) / math.sqrt(2))) if pd.notna(v) else np.nan
                      for v in z])


_UDFS: dict = {}


def _udf(fn):
    # pandas UDFs are created on first use: building one needs a live session.
    if fn not in _UDFS:
        _UDFS[fn] = F.pandas_udf(fn, "double")
    return _UDFS[fn]


def chi2_p_value(stat, dof) -> Column:
    """Chi-square upper-tail p-value (vectorised UDF; used on result rows only)."""
    return _udf(_chi2_p)(X.col(stat), X.col(dof))


def normal_two_sided_p(z) -> Column:
    """Two-sided normal p-value erfc(|z|/sqrt 2) (result rows only)."""
    return _udf(_normal_p)(X.col(z))


def _chi2_limit(dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_critical(int(d)) if pd.notna(d) and d > 0 else np.nan for d in dof])


def critical_value(dof: Column) -> Column:
    """Critical value at the 5 % level: fixed values up to 30 degrees of freedom, the
    survival function's inverse beyond (vectorised UDF on result rows)."""
    out = F.when(dof > max(CHI2_CRITICAL), _udf(_chi2_limit)(dof))
    for d, v in CHI2_CRITICAL.items():
        out = out.when(dof == d, F.lit(v))
    return out


# ---------------------------------------------------------------------------
# Chi-square test of independence
# ---------------------------------------------------------------------------

def contingency(df: DataFrame, row: Column | str, col: Column | str) -> DataFrame:
    """Observed cells (r, c, n) of a contingency table (A20); ``c`` is text.

    One partially aggregated count, with no limit on the categories of either side.
    Empty cells are left out; ``chi_square_from_table`` accounts for them from the
    margins, so no grid of categories is built.
    """
    return (df.select(X.col(row).alias("r"), X.col(col).cast("string").alias("c"))
            .groupBy("r", "c").agg(F.count(F.lit(1)).alias("n")))


def crosstab_wide(df: DataFrame, row: str, col: str, values: Sequence | None = None) -> DataFrame:
    """Wide ``pd.crosstab`` form: one row per ``row`` value, one column per ``col`` value."""
    g = df.groupBy(row)
    g = g.pivot(col, list(values)) if values is not None else g.pivot(col)
    return g.count().na.fill(0)


def chi_square_from_table(table: DataFrame, group_cols: Sequence[str] = (),
                          correction: bool = True) -> DataFrame:
    """Chi-square statistic per group of a long table (group..., r, c, n).

    With ``correction`` and one degree of freedom the Yates continuity
    correction is applied: each |O - E| shrinks by up to 0.5.
    Returns (group..., n, dof, chi2).  Cells may be missing: an empty cell adds
    its expected count E (Yates: (max(E - 0.5, 0))^2 / E), and the E of all cells add
    up to n, so without correction the empty ones add n - sum of the observed cells' E.
    """
    g = list(group_cols)
    wg = Window.partitionBy(*g) if g else Window.partitionBy()
    wr = Window.partitionBy(*g, "r")
    wc = Window.partitionBy(*g, "c")
    t = table.withColumns({"_N": F.sum("n").over(wg), "_R": F.sum("n").over(wr), "_C": F.sum("n").over(wc)})
    cats = table.groupBy(*g).agg(F.countDistinct("r").alias("_nr"), F.countDistinct("c").alias("_nc"))
    if g:
        t = t.join(cats, g)
    else:
        one = cats.select(F.struct("_nr", "_nc")).scalar()
        t = t.withColumns({"_nr": one["_nr"], "_nc": one["_nc"]})
    t = t.withColumn("_E", F.col("_R").cast("double") * F.col("_C") / F.col("_N")) \
        .withColumn("_dof", (F.col("_nr") - 1) * (F.col("_nc") - 1))
    dev = F.abs(F.col("n") - F.col("_E"))
    if correction:
        dev = F.when(F.col("_dof") == 1, F.greatest(dev - 0.5, F.lit(0.0))).otherwise(dev)
    t = t.withColumn("_term", dev * dev / F.col("_E"))
    out = t.groupBy(*g).agg(F.first("_N").alias("n"), F.first("_dof").cast("int").alias("dof"),
                            F.sum("_term").alias("_seen"), F.sum("_E").alias("_sumE"),
                            F.count(F.lit(1)).alias("_cells"), F.first(F.col("_nr") * F.col("_nc")).alias("_grid"),
                            F.min("_E").alias("_minE"))
    lost = F.when(F.col("_cells") < F.col("_grid"), F.greatest(F.col("n") - F.col("_sumE"), F.lit(0.0))).otherwise(0.0)
    if correction:
        # In a 2 x 2 grid without an empty row or column, two empty cells lie on a
        # diagonal and have the same expected count.
        empty = F.col("_grid") - F.col("_cells")
        yates = F.greatest(lost / empty - 0.5, F.lit(0.0))
        extra = F.when(lost <= 0, 0.0).when(F.col("dof") == 1, empty * yates * yates / (lost / empty)).otherwise(lost)
    else:
        extra = lost
    return out.withColumn("chi2", F.col("_seen") + extra).select(*g, "n", "dof", "chi2")


def chi_square_test(df: DataFrame, row: Column | str, col: Column | str,
                    correction: bool = True) -> DataFrame:
    """H1: one row (n, dof, chi2, p_value, significant)."""
    res = chi_square_from_table(contingency(df, row, col), (), correction)
    return res.withColumns({"p_value": chi2_p_value("chi2", "dof")}) \
        .withColumn("significant", F.col("p_value") < C.ALPHA)


# ---------------------------------------------------------------------------
# Mann-Whitney U (two-sided, tie and continuity corrected)
# ---------------------------------------------------------------------------

def rank_frequencies(df: DataFrame, value: Column | str, in_first: Column,
                     group: Column | None = None) -> DataFrame:
    """([g,] v, n1, n0) value-frequency table of two samples, NULLs dropped; ``g`` only
    with a ``group`` (a constant key would turn the joins by key into nested loops)."""
    v = X.col(value).cast("double").alias("v")
    keys = [group.alias("g")] if group is not None else []
    return (df.filter(X.col(value).isNotNull() & in_first.isNotNull())
            .groupBy(*keys, v)
            .agg(F.count_if(in_first).alias("n1"), F.count_if(~in_first).alias("n0")))


def mann_whitney_from_freq(freq: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """H2 from a ([g,] v, n1, n0) frequency table; one row per g, or one row without g.

    Mid-ranks come from the running count of smaller values:
    midrank(v) = below(v) + (n(v) + 1) / 2.  U1 is the statistic of the first
    sample; z uses max(U1, U2), the tie term and the continuity correction.
    """
    g = ["g"] if "g" in freq.columns else []
    freq = materialize(freq, "rank-frequencies")     # read by every step below
    f = freq.withColumn("n", F.col("n1") + F.col("n0"))
    f = prefix_sum(f, "v", "n", "below", group_cols=g, rows_per_slice=rows_per_slice)
    f = f.withColumn("midrank", F.col("below") + (F.col("n") + 1) / 2.0)
    # t^3 - t as DECIMAL: a tie of 2.1 million rows already exceeds LONG.
    t = F.col("n").cast("decimal(19,0)")
    tie = (t * t).cast("decimal(38,0)") * F.col("n").cast("decimal(19,0)") - t
    tie = tie.cast("decimal(38,0)")
    agg = f.groupBy(*g).agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"),
        F.sum(F.col("n1") * F.col("midrank")).alias("r1"),
        F.sum(tie).alias("tie_term"))
    # Both samples' medians by one selection: the side is one more group.
    sides = freq.unpivot([*g, "v"], ["n1", "n0"], "_side", "_n")
    medians = exact_quantiles(sides, [*g, "_side"], "v", "_n", [0.5])
    medians = medians.groupBy(*g).agg(*[F.max(F.when(F.col("_side") == side, F.col("_q")[0])).alias(f"median{side[1]}")
                                        for side in ("n1", "n0")])
    if g:
        agg = agg.join(medians.withColumnRenamed("g", "_qg"), F.col("g").eqNullSafe(F.col("_qg")), "left").drop("_qg")
    else:
        both = medians.select(F.struct("median1", "median0")).scalar()
        agg = agg.withColumns({"median1": both["median1"], "median0": both["median0"]})
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    nn = n1 + n0
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    out = agg.withColumn("u1", u1).withColumn("u2", n1 * n0 - F.col("u1"))
    sigma = F.sqrt(n1 * n0 / 12.0 * ((nn + 1) - F.col("tie_term") / (nn * (nn - 1))))
    z = (F.greatest("u1", "u2") - n1 * n0 / 2.0 - 0.5) / sigma
    return out.withColumn("z", z).drop("r1")


def mann_whitney_test(df: DataFrame, value: str, in_first: Column) -> DataFrame:
    """H2: one row (n1, n0, u1, u2, tie_term, median1, median0, z, p_value, significant)."""
    res = mann_whitney_from_freq(rank_frequencies(df, value, in_first))
    return res.withColumn("p_value", normal_two_sided_p("z")) \
        .withColumn("significant", F.col("p_value") < C.ALPHA)


# ---------------------------------------------------------------------------
# Battery, interpretation, effect sizes, multiple testing (H3-H8)
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class ChiSpec:
    test: str
    finding: str
    group: Callable[[], Column]  # grouping expression (two or more levels)
    label1: str              # level whose rate is reported first
    label2: str
    value1: object
    value2: object


@dataclass(frozen=True)
class RankSpec:
    test: str
    finding: str
    value: str
    reason: str


def _chi_long(base: DataFrame, specs: Sequence[ChiSpec], event: str) -> DataFrame:
    """All contingency tables of a 0/1 event in one pass: (test, r, c, n).

    Conditional counts give both event cells of every observed group (a
    zero where a cell is empty), so no category grid is needed.
    """
    stacked = base.select(F.col(event).alias("_e"), F.explode(F.array(*[
        F.struct(F.lit(s.test).alias("test"), s.group().cast("string").alias("r")) for s in specs
    ])).alias("_t")).select("_t.test", "_t.r", "_e")
    counts = stacked.groupBy("test", "r").agg(F.count_if(F.col("_e") == 1).alias("1"),
                                             F.count_if(F.col("_e") == 0).alias("0"))
    return counts.unpivot(["test", "r"], ["1", "0"], "c", "n") \
        .withColumn("c", F.col("c").cast("int"))


def chi_square_battery(base: DataFrame, specs: Sequence[ChiSpec], event: str,
                       digits: int = 6) -> DataFrame:
    """Chi-square tests of ``event`` against each spec's grouping, plus the
    two reported group rates, computed (never typed in)."""
    table = _chi_long(base, specs, event)
    stats = chi_square_from_table(table, ["test"])
    rates = table.groupBy("test", "r").agg(
        F.sum(F.when(F.col("c") == 1, F.col("n")).otherwise(0)).alias("e"), F.sum("n").alias("t"))
    rows = []
    for s in specs:
        rows.append(F.struct(F.lit(s.test).alias("test"), F.lit(s.finding).alias("finding"),
                             F.lit(s.label1).alias("group1"), F.lit(str(s.value1)).alias("v1"),
                             F.lit(s.label2).alias("group2"), F.lit(str(s.value2)).alias("v2")))
    meta = base.sparkSession.range(1).select(F.inline(F.array(*rows)))
    r1 = rates.select("test", F.col("r").alias("v1"), X.rate_pct("e", "t").alias("rate1"))
    r2 = rates.select("test", F.col("r").alias("v2"), X.rate_pct("e", "t").alias("rate2"))
    out = (meta.join(stats, "test").join(r1, ["test", "v1"], "left").join(r2, ["test", "v2"], "left")
           .withColumn("chi2", F.round("chi2", digits))
           .withColumn("significant", F.col("chi2") > critical_value(F.col("dof"))))
    return out.select("test", "finding", "n", "dof", "chi2", "significant",
                      "group1", "rate1", "group2", "rate2")


def rank_battery(base: DataFrame, specs: Sequence[RankSpec], in_first: Column,
                 digits: int = 6) -> DataFrame:
    """Mann-Whitney tests of several measures in one frequency pass."""
    stacked = base.select(in_first.alias("_first"), F.explode(F.array(*[
        F.struct(F.lit(s.test).alias("g"), F.col(s.value).cast("double").alias("v")) for s in specs
    ])).alias("_t")).select("_t.g", "_t.v", "_first")
    freq = (stacked.filter(F.col("v").isNotNull() & F.col("_first").isNotNull())
            .groupBy("g", "v").agg(F.count_if("_first").alias("n1"), F.count_if(~F.col("_first")).alias("n0")))
    res = mann_whitney_from_freq(freq)
    rows = [F.struct(F.lit(s.test).alias("g"), F.lit(s.finding).alias("finding"),
                     F.lit(s.reason).alias("reason")) for s in specs]
    meta = base.sparkSession.range(1).select(F.inline(F.array(*rows)))
    return (meta.join(res, "g").withColumnRenamed("g", "test")
            .withColumn("z", F.round("z", digits)).withColumn("tie_term", F.col("tie_term").cast("double"))
            .withColumn("significant", F.abs(F.col("z")) > C.Z_CRITICAL_TWO_SIDED)
            .select("test", "finding", "reason", "n1", "n0", "u1", "u2", "tie_term",
                    "median1", "median0", "z", "significant"))


def interpret_chi_square(res: DataFrame) -> DataFrame:
    """H3: wording of a chi-square result, with the small-gap note."""
    gap = F.abs(F.col("rate1") - F.col("rate2"))
    sig = F.col("p_value") < C.ALPHA
    sentence = F.format_string(
        "Chi-square: %s %.2f%%, %s %.2f%%, gap %.2f points; independence %s at the 5%% level.",
        F.col("group1"), F.col("rate1"), F.col("group2"), F.col("rate2"), gap,
        F.when(sig, "rejected").otherwise("not rejected"))
    note = F.when(sig & (gap < 0.5), F.format_string("Gap of %.2f points only: weigh its size, not the test alone.", gap))
    return res.withColumns({"gap_pts": F.round(gap, 2), "interpretation": sentence, "note": note})


def interpret_mann_whitney(res: DataFrame) -> DataFrame:
    """H4: wording of a Mann-Whitney result with both medians."""
    sig = F.col("p_value") < C.ALPHA
    sentence = F.format_string(
        "Mann-Whitney: %s, medians %.2f and %.2f; equal distributions %s at the 5%% level (rank test because %s).",
        F.lower(F.col("finding")), F.col("median1"), F.col("median0"),
        F.when(sig, "rejected").otherwise("not rejected"), F.col("reason"))
    return res.withColumn("interpretation", sentence)


def with_effect_sizes(battery: DataFrame) -> DataFrame:
    """H7: phi = sqrt(chi2 / n) for chi-square, rank-biserial 2*U1/(n1*n0) - 1
    for Mann-Whitney, and the strength rank within each method."""
    eff = F.when(F.col("method") == "Chi-square", F.sqrt(F.col("statistic") / F.col("n"))) \
        .otherwise(2 * F.col("statistic") / (F.col("n1") * F.col("n0")) - 1)
    w = Window.partitionBy("method").orderBy(F.desc(F.abs(F.col("effect_size"))), "test")
    return battery.withColumn("effect_size", eff).withColumn("strength_rank", F.rank().over(w))


def adjust_p_values(battery: DataFrame, p_col: str = "p_value") -> DataFrame:
    """H8: Bonferroni and Benjamini-Hochberg adjusted p-values over the
    battery (one row per test, so the unpartitioned windows are tiny)."""
    m = F.count(F.lit(1)).over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.col(p_col), "test"))
    out = battery.withColumns({"_m": m, "_i": rank})
    out = out.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col(p_col) * F.col("_m")))
    raw_bh = F.col(p_col) * F.col("_m") / F.col("_i")
    tail = Window.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    # BH >= p mathematically; the clamp removes a last-bit rounding of p*m/m.
    out = out.withColumn("p_bh", F.greatest(F.col(p_col), F.least(F.lit(1.0), F.min(raw_bh).over(tail))))
    return out.drop("_m", "_i")
