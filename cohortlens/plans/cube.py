"""All segment families of the base view from a few joint aggregations.

The KPI and EDA reports mostly group the same base view by one or two keys
and report counts, event sums, rates and rounded means.  Instead of one scan
and one aggregation per report, ``encounter_cube`` aggregates every family at
once; each report then reads its family from that small table.  Reports that
need distinct counts or medians (K1, K4, K7, K8, D6) stay direct.

Every function here returns exactly what its direct counterpart in
``kpi.py`` / ``eda.py`` returns (checked by the tests).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import expr as X
from ..operators.segments import (Count, Family, Mean, Rate, Sum, adjacent_step, from_cube, present,
                                  segment_cube, share_of_total, versus_baseline)
from .eda import encounter_tier
from .kpi import EVENT, patient_type, prior_inpatient_band, readmission_status

FLAGS = (EVENT, "led_to_any_readmission", "polypharmacy_flag")
MEASURES = {"time_in_hospital": 1, "num_medications": 1, "num_active_medications": 1,
            "num_lab_procedures": 1, "number_diagnoses": 1, "total_prior_visits": 1,
            "number_inpatient": 1, "age_midpoint": 2}


def _col(name):
    return lambda: F.col(name)


FAMILIES = {
    "all": Family("all"),
    "readmitted": Family("readmitted", (("readmitted", _col("readmitted")),)),
    "age": Family("age", (("age", _col("age")),)),
    "gender": Family("gender", (("gender", _col("gender")),)),
    "race": Family("race", (("race", _col("race")),)),
    "insulin": Family("insulin", (("insulin", _col("insulin")),)),
    "A1Cresult": Family("A1Cresult", (("A1Cresult", _col("A1Cresult")),)),
    "num_active_medications": Family("num_active_medications",
                                     (("num_active_medications", _col("num_active_medications")),)),
    "medical_specialty": Family("medical_specialty", (("medical_specialty", _col("medical_specialty")),)),
    "admission_source_id": Family("admission_source_id", (("admission_source_id", _col("admission_source_id")),)),
    "admission_type_id": Family("admission_type_id", (("admission_type_id", _col("admission_type_id")),)),
    "discharge_disposition_id": Family("discharge_disposition_id",
                                       (("discharge_disposition_id", _col("discharge_disposition_id")),)),
    "readmission_status": Family("readmission_status", (("readmission_outcome", readmission_status),)),
    "los_band": Family("los_band", (("los_band", lambda: X.upper_bands(
        "time_in_hospital", C.LOS_BANDS, C.LOS_BAND_REST)),)),
    "diagnosis_category": Family("diagnosis_category", (("diagnosis_category", lambda: X.icd_chapter("diag_1")),)),
    "medication_burden": Family("medication_burden", (("medication_burden", lambda: F.when(
        F.col("polypharmacy_flag") == 1, C.POLYPHARMACY_LABELS[0]).otherwise(C.POLYPHARMACY_LABELS[1])),)),
    "encounter_tier": Family("encounter_tier", (("encounter_tier", encounter_tier),)),
    "patient_type": Family("patient_type", (("patient_type", patient_type),)),
    "change_x_med": Family("change_x_med", (("medication_change", _col("change")),
                                            ("on_diabetes_medication", _col("diabetesMed")))),
    "age_x_prior_inpatient": Family("age_x_prior_inpatient", (("age", _col("age")),
                                                              ("prior_inpatient_band", prior_inpatient_band))),
}
#: Families whose keys have few joint values (the product of their code lists) share an aggregation.
BUNDLES = {
    "visit": ("all", "readmitted", "age", "readmission_status", "encounter_tier", "patient_type", "age_x_prior_inpatient"),
    "treatment": ("gender", "race", "insulin", "A1Cresult", "medication_burden", "change_x_med"),
    "stay": ("los_band", "diagnosis_category", "admission_type_id", "num_active_medications"),
    "route": ("admission_source_id", "discharge_disposition_id"),
}
FAMILIES.update({name: replace(FAMILIES[name], bundle=bundle) for bundle, names in BUNDLES.items() for name in names})
INT_KEYED = {"num_active_medications"}


def encounter_cube(base: DataFrame) -> DataFrame:
    """Every family of the base view: one aggregation per bundle, then a small roll-up."""
    return segment_cube(base, FAMILIES.values(), FLAGS, MEASURES)


def _fam(cube, name, metrics, **kw):
    fam = FAMILIES[name]
    types = ["int" if name in INT_KEYED else "string"] * len(fam.keys)
    return from_cube(cube, fam, types, metrics, **kw)


def _rate3():
    return [Count("encounters"), Sum("readmitted_30day", EVENT), Rate("readmission_rate_pct", EVENT)]


def rate_by(cube, name, order_by_rate=True):
    out = _fam(cube, name, _rate3())
    key = FAMILIES[name].keys[0][0]
    return out.transform(present, F.desc("readmission_rate_pct"), key) if order_by_rate \
        else out.transform(present, key)


def kpi_by_diagnosis(cube):
    return _fam(cube, "diagnosis_category", [
        Count("total_encounters"), Sum("readmitted_30day", EVENT), Rate("readmission_rate_pct", EVENT),
        Mean("avg_los_days", "time_in_hospital"), Mean("avg_medications", "num_medications"),
    ]).transform(present, F.desc("readmission_rate_pct"), "diagnosis_category")


def kpi_by_disposition(cube, min_rows=C.KPI_MIN_DISPOSITION):
    out = _fam(cube, "discharge_disposition_id", [
        Count("total_encounters"), Sum("readmitted_30day", EVENT), Rate("readmission_rate_pct", EVENT),
        Mean("avg_los_days", "time_in_hospital")], min_rows=min_rows)
    out = out.withColumn("disposition_label", X.code_label("discharge_disposition_id", C.DISPOSITION_LABELS))
    return out.select("discharge_disposition_id", "disposition_label", "total_encounters",
                      "readmitted_30day", "readmission_rate_pct", "avg_los_days") \
        .transform(present, F.desc("readmission_rate_pct"), "discharge_disposition_id")


def kpi_by_age(cube):
    return _fam(cube, "age_x_prior_inpatient", [
        Count("encounters"), Sum("readmitted_30day", EVENT), Rate("readmission_rate_pct", EVENT),
        Mean("avg_age", "age_midpoint", digits=1, scale=2)]).transform(present, "age", "prior_inpatient_band")


def kpi_by_specialty(cube, min_rows=C.KPI_MIN_SPECIALTY):
    return _fam(cube, "medical_specialty", [
        Count("total_encounters"), Sum("readmitted_30day", EVENT), Rate("readmission_rate_pct", EVENT),
        Mean("avg_los_days", "time_in_hospital"), Mean("avg_medications", "num_medications"),
        Mean("avg_active_medications", "num_active_medications")],
        min_rows=min_rows, where=F.col("medical_specialty") != C.UNKNOWN) \
        .transform(present, F.desc("readmission_rate_pct"), "medical_specialty")


def target_distribution(cube):
    counts = _fam(cube, "readmitted", [Count("encounters")])
    return share_of_total(counts, "encounters").transform(present, F.desc("encounters"), "readmitted")


def rate_by_race(cube):
    return _fam(cube, "race", _rate3(), where=F.col("race") != C.UNKNOWN) \
        .transform(present, F.desc("readmission_rate_pct"), "race")


def utilisation_by_outcome(cube):
    return _fam(cube, "readmission_status", [
        Count("encounters"), Mean("avg_los_days", "time_in_hospital"), Mean("avg_medications", "num_medications"),
        Mean("avg_active_medications", "num_active_medications"),
        Mean("avg_lab_procedures", "num_lab_procedures"), Mean("avg_diagnoses", "number_diagnoses"),
        Mean("avg_prior_visits", "total_prior_visits"), Rate("polypharmacy_pct", "polypharmacy_flag"),
    ]).transform(present, "readmission_outcome")


def rate_by_los_band(cube):
    return _fam(cube, "los_band", _rate3()).transform(present, "los_band")


def rate_by_diagnosis(cube):
    return _fam(cube, "diagnosis_category", _rate3() + [Mean("avg_los_days", "time_in_hospital")]) \
        .transform(present, F.desc("readmission_rate_pct"), "diagnosis_category")


def top_specialties(cube, k=C.TOP_SPECIALTIES, min_rows=C.KPI_MIN_SPECIALTY):
    out = _fam(cube, "medical_specialty", _rate3() + [Mean("avg_los_days", "time_in_hospital")],
               min_rows=min_rows, where=F.col("medical_specialty") != C.UNKNOWN)
    return out.orderBy(F.desc("encounters"), "medical_specialty").limit(k)


def rate_by_admission_source(cube):
    out = _fam(cube, "admission_source_id", _rate3())
    out = out.withColumn("source_label", X.code_label("admission_source_id", C.ADMISSION_SOURCE_LABELS))
    return out.select("admission_source_id", "source_label", "encounters", "readmitted_30day",
                      "readmission_rate_pct").transform(present, F.desc("readmission_rate_pct"),
                                                        "admission_source_id")


def change_by_diabetes_med(cube):
    return _fam(cube, "change_x_med", _rate3()).transform(
        present, F.desc("readmission_rate_pct"), "medication_change", "on_diabetes_medication")


def rate_by_polypharmacy(cube):
    return _fam(cube, "medication_burden", _rate3()).transform(
        present, F.desc("readmission_rate_pct"), "medication_burden")


def rate_by_encounter_tier(cube):
    return _fam(cube, "encounter_tier", _rate3()).transform(
        present, F.desc("readmission_rate_pct"), "encounter_tier")


def repeat_vs_first(cube):
    return _fam(cube, "patient_type", _rate3() + [
        Mean("avg_los", "time_in_hospital"), Mean("avg_medications", "num_medications"),
        Mean("avg_prior_visits", "total_prior_visits")])


def age_volume_and_rate(cube):
    return _fam(cube, "age", [Count("encounters"), Rate("readmission_rate_pct", EVENT)]).transform(present, "age")


def overall_rate(cube):
    return _fam(cube, "all", [Rate("rate_30day_pct", EVENT)])


def segments_vs_baseline(cube, name):
    return versus_baseline(rate_by(cube, name), overall_rate(cube), "readmission_rate_pct", "rate_30day_pct")


def active_meds_vs_baseline(cube):
    seg = _fam(cube, "num_active_medications", _rate3())
    overall = _fam(cube, "all", [Rate("overall_rate_pct", EVENT)])
    return versus_baseline(seg, overall, "readmission_rate_pct", "overall_rate_pct")


def share_vs_events(cube):
    r = _fam(cube, "patient_type", [Count("encounters"), Sum("events", EVENT)])
    r = share_of_total(r, "encounters", "share_of_encounters_pct")
    r = share_of_total(r, "events", "share_of_events_pct")
    from ..operators.segments import hundredths
    return r.withColumn("disproportionality_index",
                        X.round_ratio(hundredths("share_of_events_pct"), hundredths("share_of_encounters_pct"), 2))


def tier_steps(cube):
    return adjacent_step(rate_by_encounter_tier(cube), "encounter_tier", "readmission_rate_pct")


def admission_type_labels(cube):
    """J1-J3 as a join: segment totals joined to the fixed code list (six
    rows, broadcast with a proven bound); unknown codes become ``Other``."""
    seg = _fam(cube, "admission_type_id", _rate3())
    dim = cube.sparkSession.createDataFrame(list(C.ADMISSION_TYPE_LABELS),
                                            "admission_type_id string, admission_type string")
    return (seg.join(F.broadcast(dim), "admission_type_id", "left")
            .withColumn("admission_type", F.coalesce("admission_type", F.lit("Other"))))


# query id -> cube function (same output as the direct query)
CUBE_QUERIES = {
    "k2_diagnosis": kpi_by_diagnosis,
    "k3_disposition": kpi_by_disposition,
    "k5_age_prior_inpatient": kpi_by_age,
    "k6_specialty": kpi_by_specialty,
    "e1_target_distribution": target_distribution,
    "e2_age": lambda c: rate_by(c, "age", order_by_rate=False),
    "e3_gender": lambda c: rate_by(c, "gender"),
    "e4_race": rate_by_race,
    "e5_utilisation_by_outcome": utilisation_by_outcome,
    "e6_los_band": rate_by_los_band,
    "e7_diagnosis": rate_by_diagnosis,
    "e8_top_specialties": top_specialties,
    "e9_admission_source": rate_by_admission_source,
    "e10_insulin": lambda c: rate_by(c, "insulin"),
    "e11_a1c": lambda c: rate_by(c, "A1Cresult"),
    "e12_change_x_diabetes_med": change_by_diabetes_med,
    "e13_polypharmacy": rate_by_polypharmacy,
    "e14_encounter_tier": rate_by_encounter_tier,
    "e15_repeat_vs_first": repeat_vs_first,
    "e16_active_medications": lambda c: rate_by(c, "num_active_medications", order_by_rate=False),
    "e17_age_volume_rate": age_volume_and_rate,
    "d1_gender_vs_baseline": lambda c: segments_vs_baseline(c, "gender"),
    "d4_share_vs_events": share_vs_events,
    "d5_tier_steps": tier_steps,
    "g5_active_meds_vs_baseline": active_meds_vs_baseline,
    "j3_admission_type_labels": admission_type_labels,
}


def kpi_view_row_counts(base: DataFrame, cube: DataFrame) -> DataFrame:
    """K9 with the cube-served views read from the segment totals."""
    from functools import reduce

    from . import kpi
    served = {"vw_kpi_readmission_by_diagnosis": kpi_by_diagnosis(cube),
              "vw_kpi_readmission_by_disposition": kpi_by_disposition(cube),
              # K4 has one row per outcome; its medians need not be computed to count them.
              "vw_kpi_los_by_readmission": _fam(cube, "readmission_status", [Count("encounters")]),
              "vw_kpi_readmission_by_age": kpi_by_age(cube),
              "vw_kpi_readmission_by_specialty": kpi_by_specialty(cube)}
    parts = [(served[name] if name in served else fn(base)).agg(F.count(F.lit(1)).alias("rows"))
             .select(F.lit(name).alias("view_name"), "rows") for name, fn in kpi.KPI_VIEWS.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
