"""Sequenced encounter view (B0) and its sanity totals (B1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .sequence import DEFAULT_HOT_ROWS, sequence

# Columns carried from the clean table into the view, in view order.
BASE_CARRIED = (
    "encounter_id", "patient_nbr", "readmitted", "time_in_hospital",
    "admission_type_id", "discharge_disposition_id", "admission_source_id",
    "medical_specialty", "diag_1", "diag_2", "diag_3", "number_diagnoses",
    "num_lab_procedures", "num_procedures", "num_medications",
    "number_outpatient", "number_emergency", "number_inpatient",
    "total_prior_visits", "num_active_medications", "any_medication_change",
    "polypharmacy_flag", "age", "age_midpoint", "gender", "race", "insulin",
    "diabetesMed", "change", "A1Cresult", "max_glu_serum", "weight_available",
    "any_outlier_flag", "diag_1_missing_flag",
)

EXCLUSION_FLAGS = ("expired_or_hospice_flag", "gender_invalid_flag")


def valid_encounters(clean: DataFrame, carried: Sequence[str] = BASE_CARRIED,
                     exclusions: Sequence[str] = EXCLUSION_FLAGS) -> DataFrame:
    """Rows without an exclusion flag, with the view's columns."""
    for f in exclusions:
        clean = clean.filter(F.col(f) == 0)
    return clean.select(*carried)


def encounter_base(clean: DataFrame, *, pk: str = "encounter_id", entity: str = "patient_nbr",
                   target: str = "readmitted", carried: Sequence[str] = BASE_CARRIED,
                   exclusions: Sequence[str] = EXCLUSION_FLAGS,
                   hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """Valid population, sequenced per entity, with outcome flags.

    Exclusions are applied before sequencing, so an excluded encounter takes
    no sequence number and makes no patient a repeat patient.  The filter is
    on stored flags and reaches the parquet scan as a pushed filter.
    """
    valid = valid_encounters(clean, carried, exclusions)
    seq = sequence(valid, key=entity, order=[pk], seq="encounter_seq",
                   count="patient_total_encounters", prev={"prior_encounter_id": pk},
                   hot_rows=hot_rows)
    t = F.col(target)
    return seq.withColumns({
        "led_to_30day_readmission": X.flag(t == "<30"),
        "led_to_any_readmission": X.flag(t.isin("<30", ">30")),
        "is_itself_a_readmission": F.col("prior_encounter_id").isNotNull().cast("int"),
        "is_first_encounter": F.col("prior_encounter_id").isNull().cast("int"),
        "is_repeat_patient": X.flag(F.col("patient_total_encounters") > 1),
    })


def base_totals(base: DataFrame) -> DataFrame:
    """B1: one row of sanity totals over the view."""
    return base.agg(
        F.count(F.lit(1)).alias("total_valid_encounters"),
        F.sum("led_to_30day_readmission").cast("long").alias("will_be_readmitted_30day"),
        F.sum("led_to_any_readmission").cast("long").alias("will_be_readmitted_any"),
        F.sum("is_itself_a_readmission").cast("long").alias("are_readmissions"),
        F.sum("is_first_encounter").cast("long").alias("first_encounters"),
        F.sum("is_repeat_patient").cast("long").alias("repeat_patient_encounters"),
    )
