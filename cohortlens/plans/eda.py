"""Exploratory queries (E1-E17) and the derived comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import expr as X
from ..operators.segments import (Count, Entities, Mean, Rate, Sum, adjacent_step, hundredths,
                                  present, segment_rates, share_of_total, versus_baseline)
from .kpi import EVENT, kpi_overall, prior_inpatient_band, readmission_status

RATE3 = lambda: [Count("encounters"), Sum("readmitted_30day", EVENT),
                 Rate("readmission_rate_pct", EVENT)]


def target_distribution(base: DataFrame) -> DataFrame:
    """Outcome classes with their share of all encounters."""
    counts = segment_rates(base, ["readmitted"], [Count("encounters")])
    return share_of_total(counts, "encounters").transform(present, F.desc("encounters"), "readmitted")


def rate_by(base: DataFrame, column: str, order_by_rate: bool = True) -> DataFrame:
    """Rate by one stored column."""
    out = segment_rates(base, [column], RATE3())
    return present(out, F.desc("readmission_rate_pct"), column) if order_by_rate else present(out, column)


def rate_by_race(base: DataFrame) -> DataFrame:
    """Rate by race, Unknown excluded."""
    return rate_by(base.filter(F.col("race") != C.UNKNOWN), "race")


def utilisation_by_outcome(base: DataFrame) -> DataFrame:
    """E5: six utilisation means and the polypharmacy share by outcome."""
    return segment_rates(base, [("readmission_outcome", readmission_status())], [
        Count("encounters"),
        Mean("avg_los_days", "time_in_hospital"), Mean("avg_medications", "num_medications"),
        Mean("avg_active_medications", "num_active_medications"),
        Mean("avg_lab_procedures", "num_lab_procedures"), Mean("avg_diagnoses", "number_diagnoses"),
        Mean("avg_prior_visits", "total_prior_visits"), Rate("polypharmacy_pct", "polypharmacy_flag"),
    ]).transform(present, "readmission_outcome")


def rate_by_los_band(base: DataFrame) -> DataFrame:
    """Length-of-stay bands."""
    band = X.upper_bands("time_in_hospital", C.LOS_BANDS, C.LOS_BAND_REST)
    return segment_rates(base, [("los_band", band)], RATE3()).transform(present, "los_band")


def rate_by_diagnosis(base: DataFrame) -> DataFrame:
    """Diagnosis chapters with mean length of stay."""
    return segment_rates(base, [("diagnosis_category", X.icd_chapter("diag_1"))],
                         RATE3() + [Mean("avg_los_days", "time_in_hospital")]) \
                             .transform(present, F.desc("readmission_rate_pct"), "diagnosis_category")


def top_specialties(base: DataFrame, k: int = C.TOP_SPECIALTIES,
                    min_rows: int = C.KPI_MIN_SPECIALTY) -> DataFrame:
    """The k largest specialties (>= min_rows, Unknown excluded).

    The limit is the feature (a top-k report); ties on volume are broken by
    name so the cut is deterministic.
    """
    out = segment_rates(base.filter(F.col("medical_specialty") != C.UNKNOWN), ["medical_specialty"],
                        RATE3() + [Mean("avg_los_days", "time_in_hospital")], min_rows=min_rows)
    return out.orderBy(F.desc("encounters"), "medical_specialty").limit(k)


def rate_by_admission_source(base: DataFrame) -> DataFrame:
    """Admission source code + label (label applied after grouping)."""
    out = segment_rates(base, ["admission_source_id"], RATE3())
    out = out.withColumn("source_label", X.code_label("admission_source_id", C.ADMISSION_SOURCE_LABELS))
    return out.select("admission_source_id", "source_label", "encounters", "readmitted_30day",
                      "readmission_rate_pct") \
                          .transform(present, F.desc("readmission_rate_pct"), "admission_source_id")


def change_by_diabetes_med(base: DataFrame) -> DataFrame:
    """Medication change x diabetes medication."""
    return segment_rates(base, [("medication_change", F.col("change")),
                                ("on_diabetes_medication", F.col("diabetesMed"))], RATE3()) \
                                    .transform(present, F.desc("readmission_rate_pct"), "medication_change", "on_diabetes_medication")


def rate_by_polypharmacy(base: DataFrame) -> DataFrame:
    """Polypharmacy versus standard medication burden."""
    burden = F.when(F.col("polypharmacy_flag") == 1, C.POLYPHARMACY_LABELS[0]) \
        .otherwise(C.POLYPHARMACY_LABELS[1])
    return segment_rates(base, [("medication_burden", burden)], RATE3()) \
        .transform(present, F.desc("readmission_rate_pct"), "medication_burden")


def encounter_tier() -> F.Column:
    return X.exact_bands("encounter_seq", C.ENCOUNTER_TIERS, C.ENCOUNTER_TIER_REST)


def rate_by_encounter_tier(base: DataFrame) -> DataFrame:
    """1st, 2nd, 3rd, 4th+ encounter of the patient."""
    return segment_rates(base, [("encounter_tier", encounter_tier())], RATE3()) \
        .transform(present, F.desc("readmission_rate_pct"), "encounter_tier")


def repeat_vs_first(base: DataFrame) -> DataFrame:
    """Repeat versus first-time patients with utilisation means."""
    from .kpi import patient_type
    return segment_rates(base, [("patient_type", patient_type())], RATE3() + [
        Mean("avg_los", "time_in_hospital"), Mean("avg_medications", "num_medications"),
        Mean("avg_prior_visits", "total_prior_visits")])


def age_volume_and_rate(base: DataFrame) -> DataFrame:
    """Encounters and rate per age band (dual-axis chart data)."""
    return segment_rates(base, ["age"], [Count("encounters"), Rate("readmission_rate_pct", EVENT)]) \
        .transform(present, "age")


# ------------------------------------------------------------- derived ----

def segments_vs_baseline(base: DataFrame, column: str) -> DataFrame:
    """A segment family against the overall 30-day rate."""
    return versus_baseline(rate_by(base, column), kpi_overall(base),
                           "readmission_rate_pct", "rate_30day_pct")


def diagnosis_vs_baseline(base: DataFrame) -> DataFrame:
    """Diagnosis chapters against the overall 30-day rate."""
    return versus_baseline(segment_rates(base, [("diagnosis_category", X.icd_chapter("diag_1"))], RATE3()),
                           kpi_overall(base), "readmission_rate_pct", "rate_30day_pct")


def segment_risk(base: DataFrame, segment: Column, event: str = EVENT) -> DataFrame:
    """D2/D3 for any two segments: ``segment`` is true (exposed), false (reference) or NULL (neither).

    One row: both rates, relative risk, % higher, and excess events
    = exposed rows x (exposed rate - reference rate).
    """
    s = base.select(segment.alias("_s"), F.col(event).alias("_e"))
    one = s.agg(F.count_if(F.col("_s")).alias("n1"), F.count_if(~F.col("_s")).alias("n0"),
                F.sum(F.when(F.col("_s"), F.col("_e"))).cast("long").alias("e1"),
                F.sum(F.when(~F.col("_s"), F.col("_e"))).cast("long").alias("e0"))
    return risk_from_counts(one)


def risk_from_counts(one: DataFrame) -> DataFrame:
    """(exposed_rate_pct, reference_rate_pct, relative_risk, pct_higher, excess_events) from
    counts n1, e1, n0, e0; products of counts are DECIMAL, so they cannot overflow."""
    w = lambda c: F.col(c).cast("decimal(18,0)")
    # rr = (e1/n1) / (e0/n0) = e1*n0 / (e0*n1)
    num, den = w("e1") * w("n0"), w("e0") * w("n1")
    return one.select(
        X.rate_pct("e1", "n1").alias("exposed_rate_pct"),
        X.rate_pct("e0", "n0").alias("reference_rate_pct"),
        X.round_ratio_wide(num, den, 2).alias("relative_risk"),
        X.round_ratio_wide((num - den).cast("decimal(35,0)") * F.lit(100).cast("decimal(3,0)"), den, 2).alias("pct_higher"),
        X.round_ratio_wide(num - den, w("n0"), 0).alias("excess_events"))


def relative_risk(base: DataFrame) -> DataFrame:
    """Repeat versus first-time patients."""
    return segment_risk(base, F.col("is_repeat_patient") == 1).withColumnsRenamed(
        {"exposed_rate_pct": "repeat_rate_pct", "reference_rate_pct": "first_time_rate_pct"})


def share_vs_events(base: DataFrame) -> DataFrame:
    """Each patient type's share of encounters vs share of events and the
    disproportionality index (event share / encounter share)."""
    from .kpi import patient_type
    r = segment_rates(base, [("patient_type", patient_type())], [Count("encounters"), Sum("events", EVENT)])
    r = share_of_total(r, "encounters", "share_of_encounters_pct")
    r = share_of_total(r, "events", "share_of_events_pct")
    return r.withColumn("disproportionality_index",
                        X.round_ratio(hundredths("share_of_events_pct"),
                                      hundredths("share_of_encounters_pct"), 2))


def tier_steps(base: DataFrame) -> DataFrame:
    """Rate step between adjacent encounter tiers."""
    return adjacent_step(rate_by_encounter_tier(base), "encounter_tier", "readmission_rate_pct")


def rows_per_entity(base: DataFrame) -> DataFrame:
    """Encounters per patient, by patient type."""
    from .kpi import patient_type
    return segment_rates(base, [("patient_type", patient_type())],
                         [Count("encounters"), Entities("patients", "patient_nbr")]) \
        .withColumn("encounters_per_patient", X.round_ratio("encounters", "patients", 2))


def age_by_prior_inpatient_matrix(base: DataFrame) -> DataFrame:
    """Age rows x prior-inpatient columns of the 30-day rate.

    The pivot values are the fixed band labels, so no extra job discovers them.
    """
    bands = [label for _, label in C.PRIOR_INPATIENT_BANDS] + [C.PRIOR_INPATIENT_REST]
    long = base.withColumn("prior_inpatient_band", prior_inpatient_band())
    wide = long.groupBy("age").pivot("prior_inpatient_band", bands).agg(
        F.sum(EVENT).cast("long").alias("s"), F.count(F.lit(1)).alias("n"))
    return wide.select("age", *[X.rate_pct(f"`{b}_s`", f"`{b}_n`").alias(b) for b in bands]) \
        .transform(present, "age")
