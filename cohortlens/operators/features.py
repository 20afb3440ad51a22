"""Row-level derived features (F1-F8): narrow projections, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X


def active_count(cols: Sequence[str], inactive: str = "No"):
    """Number of columns whose value is not ``inactive`` (NULL counts as active)."""
    return F.size(F.filter(F.array(*cols), lambda v: X.not_equal_null_true(v, inactive)))


def any_in(cols: Sequence[str], values: Sequence[str]):
    return X.flag(F.exists(F.array(*cols), lambda v: F.coalesce(v.isin(list(values)), F.lit(False))))


def engineer_features(df: DataFrame, medication_cols: Sequence[str], *,
                      age_col: str = "age",
                      visit_cols: Sequence[str] = ("number_outpatient", "number_emergency",
                                                   "number_inpatient"),
                      medications_col: str = "num_medications",
                      polypharmacy_threshold: int = 10) -> DataFrame:
    """Active medications, any dose change, age midpoint, prior
    visits and the polypharmacy flag."""
    meds = [c for c in medication_cols if c in df.columns]
    return df.withColumns({
        "num_active_medications": active_count(meds),
        "any_medication_change": any_in(meds, ("Up", "Down")),
        "age_midpoint": X.age_midpoint(age_col),
        "total_prior_visits": X.row_sum(list(visit_cols)),
        "polypharmacy_flag": X.flag(F.col(medications_col) >= polypharmacy_threshold),
    })


def add_test_flags(df: DataFrame, a1c_col: str = "A1Cresult", target: str = "readmitted",
                   event_value: str = "<30") -> DataFrame:
    """F7 ``a1c_tested`` (NULL counts as tested) and F8 ``readmit_30_binary``."""
    return df.withColumns({
        "a1c_tested": X.not_equal_null_true(a1c_col, "None").cast("int"),
        "readmit_30_binary": X.flag(F.col(target) == event_value),
    })


def feature_summary(df: DataFrame, cols: Sequence[str], digits: int | None = 6) -> DataFrame:
    """(feature, min, max, mean) in one aggregate pass; mean rounded to ``digits``."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max"),
                 (F.round(F.avg(c), digits) if digits is not None else F.avg(c)).alias(f"{c}__mean")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}__min").alias("min"),
                     F.col(f"{c}__max").alias("max"), F.col(f"{c}__mean").alias("mean"))
            for c in cols]
    return one.select(F.inline(F.array(*rows)))
