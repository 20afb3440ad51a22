"""The seven-test battery (H5/H6) over the base view.

Chi-square tests of the 30-day outcome against five groupings and
Mann-Whitney tests of two measures between readmitted and not-readmitted
encounters.  Every figure (rates, medians) is computed from the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import stats as S

EVENT = "led_to_30day_readmission"

CHI_SPECS = (
    S.ChiSpec("T1", "Repeat vs First-Time Patient", lambda: F.col("is_repeat_patient"),
              "Repeat patients", "First-time patients", 1, 0),
    S.ChiSpec("T2", "Polypharmacy vs 30-Day Readmission", lambda: F.col("polypharmacy_flag"),
              "Polypharmacy (10+ meds)", "Standard (<10 meds)", 1, 0),
    S.ChiSpec("T5", "Gender vs 30-Day Readmission", lambda: F.col("gender"), "Female", "Male", "Female", "Male"),
    S.ChiSpec("T6", "A1C Tested vs Not Tested", lambda: X.not_equal_null_true("A1Cresult", "None").cast("int"),
              "Not tested", "Tested", 0, 1),
    S.ChiSpec("T7", "Medication Change vs 30-Day Readmission", lambda: F.col("change"),
              "Changed (Ch)", "Unchanged (No)", "Ch", "No"),
)

RANK_SPECS = (
    S.RankSpec("T3", "Length of Stay", "time_in_hospital", "length of stay is right-skewed"),
    S.RankSpec("T4", "Total Prior Visits", "total_prior_visits", "prior visits are heavily skewed"),
)


def readmitted_first() -> F.Column:
    return F.col(EVENT) == 1


def chi_square_tests(base: DataFrame) -> DataFrame:
    return S.chi_square_battery(base, CHI_SPECS, EVENT)


def rank_tests(base: DataFrame) -> DataFrame:
    return S.rank_battery(base, RANK_SPECS, readmitted_first())


def battery(base: DataFrame) -> DataFrame:
    """H5/H6: one row per test with p-values, wording, effect size and
    multiple-testing adjustments (H3, H4, H7, H8)."""
    chi = S.interpret_chi_square(chi_square_tests(base).withColumn(
        "p_value", S.chi2_p_value("chi2", "dof")))
    chi = chi.select(
        "test", "finding", F.lit("Chi-square").alias("method"), F.col("chi2").alias("statistic"),
        "dof", "p_value", "n", F.lit(None).cast("long").alias("n1"), F.lit(None).cast("long").alias("n0"),
        "group1", F.col("rate1").alias("value1"), "group2", F.col("rate2").alias("value2"),
        "gap_pts", "interpretation", "note")
    rank = S.interpret_mann_whitney(rank_tests(base).withColumn("p_value", S.normal_two_sided_p("z")))
    rank = rank.select(
        "test", "finding", F.lit("Mann-Whitney U").alias("method"), F.col("u1").alias("statistic"),
        F.lit(None).cast("int").alias("dof"), "p_value", (F.col("n1") + F.col("n0")).alias("n"),
        "n1", "n0", F.lit("Readmitted").alias("group1"), F.col("median1").alias("value1"),
        F.lit("Not readmitted").alias("group2"), F.col("median0").alias("value2"),
        F.round(F.col("median1") - F.col("median0"), 2).alias("gap_pts"), "interpretation",
        F.lit(None).cast("string").alias("note"))
    out = chi.unionByName(rank).withColumn("significant", F.col("p_value") < 0.05)
    return S.adjust_p_values(S.with_effect_sizes(out)).orderBy("test")
