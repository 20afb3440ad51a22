"""The eight KPI views (K1-K8) and their verification (K9) over the base view.

Each function is ``base -> DataFrame``; the result is small (one row per
segment).  ``register_kpi_views`` exposes them as temp views for SQL users
(S10).  Sorting is kept for presentation; it runs on a handful of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import expr as X
from ..operators.segments import (Count, Distinct, Entities, Max, Mean, Median, Min, Rate, Sum,
                                  segment_rates, present)

EVENT = "led_to_30day_readmission"


def kpi_overall(base: DataFrame, sliced: bool = False) -> DataFrame:
    """K1: one row of headline metrics.

    Patients are counted by their first row; ``sliced``: the base has lost rows since it
    was sequenced (maybe first ones), so distinct patients are counted instead."""
    patients = Distinct if sliced else Entities
    return segment_rates(base, [], [
        Count("total_encounters"),
        Sum("readmitted_30day", EVENT),
        Sum("readmitted_any", "led_to_any_readmission"),
        Rate("rate_30day_pct", EVENT),
        Rate("rate_any_pct", "led_to_any_readmission"),
        patients("unique_patients", "patient_nbr"),
        Mean("avg_los_days", "time_in_hospital"),
        Mean("avg_medications", "num_medications"),
    ])


def kpi_by_diagnosis(base: DataFrame) -> DataFrame:
    """K2: ICD-9 chapter of the primary diagnosis."""
    return segment_rates(base, [("diagnosis_category", X.icd_chapter("diag_1"))], [
        Count("total_encounters"), Sum("readmitted_30day", EVENT),
        Rate("readmission_rate_pct", EVENT),
        Mean("avg_los_days", "time_in_hospital"), Mean("avg_medications", "num_medications"),
    ]).transform(present, F.desc("readmission_rate_pct"), "diagnosis_category")


def kpi_by_disposition(base: DataFrame, min_rows: int = C.KPI_MIN_DISPOSITION) -> DataFrame:
    """K3: discharge disposition code + label, HAVING COUNT(*) >= min_rows.

    Grouped by code first; the label is a CASE over the fixed code list
    applied to the aggregated rows.
    """
    out = segment_rates(base, ["discharge_disposition_id"], [
        Count("total_encounters"), Sum("readmitted_30day", EVENT),
        Rate("readmission_rate_pct", EVENT), Mean("avg_los_days", "time_in_hospital"),
    ], min_rows=min_rows)
    out = out.withColumn("disposition_label",
                         X.code_label("discharge_disposition_id", C.DISPOSITION_LABELS))
    return out.select("discharge_disposition_id", "disposition_label", "total_encounters",
                      "readmitted_30day", "readmission_rate_pct", "avg_los_days") \
                          .transform(present, F.desc("readmission_rate_pct"), "discharge_disposition_id")


def readmission_status() -> F.Column:
    return X.code_label("readmitted", C.READMISSION_STATUS_LABELS, C.READMISSION_STATUS_REST)


def kpi_los_by_readmission(base: DataFrame) -> DataFrame:
    """K4: utilisation by outcome, with the exact median length of stay."""
    return segment_rates(base, [("readmission_status", readmission_status())], [
        Count("encounters"),
        Mean("avg_los_days", "time_in_hospital"),
        Median("median_los_days", "time_in_hospital"),
        Min("min_los", "time_in_hospital"), Max("max_los", "time_in_hospital"),
        Mean("avg_medications", "num_medications"),
        Mean("avg_active_medications", "num_active_medications"),
        Mean("avg_diagnoses", "number_diagnoses"),
        Mean("avg_prior_visits", "total_prior_visits"),
    ]).transform(present, "readmission_status")


def prior_inpatient_band() -> F.Column:
    return X.exact_bands("number_inpatient", C.PRIOR_INPATIENT_BANDS, C.PRIOR_INPATIENT_REST)


def kpi_by_age(base: DataFrame) -> DataFrame:
    """K5: age band x prior-inpatient band.  Age midpoints are half-integral,
    so their mean is rounded exactly through a scale of 2."""
    return segment_rates(base, ["age", ("prior_inpatient_band", prior_inpatient_band())], [
        Count("encounters"), Sum("readmitted_30day", EVENT),
        Rate("readmission_rate_pct", EVENT),
        Mean("avg_age", "age_midpoint", digits=1, scale=2),
    ]).transform(present, "age", "prior_inpatient_band")


def kpi_by_specialty(base: DataFrame, min_rows: int = C.KPI_MIN_SPECIALTY) -> DataFrame:
    """K6: specialty (Unknown excluded), HAVING COUNT(*) >= min_rows."""
    return segment_rates(base.filter(F.col("medical_specialty") != C.UNKNOWN), ["medical_specialty"], [
        Count("total_encounters"), Sum("readmitted_30day", EVENT),
        Rate("readmission_rate_pct", EVENT),
        Mean("avg_los_days", "time_in_hospital"), Mean("avg_medications", "num_medications"),
        Mean("avg_active_medications", "num_active_medications"),
    ], min_rows=min_rows).transform(present, F.desc("readmission_rate_pct"), "medical_specialty")


def kpi_high_risk_segments(base: DataFrame, tiers=C.RISK_TIERS) -> DataFrame:
    """K7: three risk tiers, first matching rule wins."""
    return segment_rates(base, [("risk_tier", X.risk_tier(tiers))], [
        Count("total_encounters"), Distinct("unique_patients", "patient_nbr"),
        Sum("readmitted_30day", EVENT), Rate("readmission_rate_pct", EVENT),
        Mean("avg_los_days", "time_in_hospital"), Mean("avg_medications", "num_medications"),
        Mean("avg_active_medications", "num_active_medications"),
        Mean("avg_prior_inpatient", "number_inpatient"),
        Mean("avg_total_prior_visits", "total_prior_visits"),
        Sum("polypharmacy_count", "polypharmacy_flag"),
        Rate("polypharmacy_pct", "polypharmacy_flag"),
    ]).transform(present, "risk_tier")


def patient_type() -> F.Column:
    return F.when(F.col("is_repeat_patient") == 1, C.REPEAT_LABELS[0]).otherwise(C.REPEAT_LABELS[1])


def kpi_repeat_patients(base: DataFrame) -> DataFrame:
    """K8: repeat versus first-time patients."""
    return segment_rates(base, [("patient_type", patient_type())], [
        Count("total_encounters"), Entities("unique_patients", "patient_nbr"),
        Sum("readmitted_30day", EVENT), Rate("readmission_rate_pct", EVENT),
        Mean("avg_los_days", "time_in_hospital"), Mean("avg_prior_visits", "total_prior_visits"),
        Mean("avg_medications", "num_medications"),
    ]).transform(present, F.desc("readmission_rate_pct"), "patient_type")


KPI_VIEWS = {
    "vw_kpi_overall_readmission": kpi_overall,
    "vw_kpi_readmission_by_diagnosis": kpi_by_diagnosis,
    "vw_kpi_readmission_by_disposition": kpi_by_disposition,
    "vw_kpi_los_by_readmission": kpi_los_by_readmission,
    "vw_kpi_readmission_by_age": kpi_by_age,
    "vw_kpi_readmission_by_specialty": kpi_by_specialty,
    "vw_kpi_high_risk_segments": kpi_high_risk_segments,
    "vw_kpi_repeat_patient_readmission": kpi_repeat_patients,
}


KPI_VIEW_ORDER = tuple(KPI_VIEWS)


def register_kpi_views(base: DataFrame, base_name: str = "vw_encounter_base") -> dict[str, DataFrame]:
    """Register the base view and the KPI views as temp views."""
    base.createOrReplaceTempView(base_name)
    out = {}
    for name, fn in KPI_VIEWS.items():
        out[name] = fn(base)
        out[name].createOrReplaceTempView(name)
    return out


def kpi_view_row_counts(base: DataFrame) -> DataFrame:
    """K9: (view_name, rows) for every KPI view, as one UNION ALL."""
    parts = [fn(base).agg(F.count(F.lit(1)).alias("rows"))
             .select(F.lit(name).alias("view_name"), "rows")
             for name, fn in KPI_VIEWS.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
