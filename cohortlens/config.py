"""Schema preset for encounter-grain tables.

Every operator in the library takes column names as arguments; this module is
the only place that names the encounter schema.  ``EncounterSchema`` bundles
the column groups, vocabularies and thresholds so a user can swap in another
table by constructing a different instance.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the analysed project's values for results to
# agree, so they are stated plainly here, in their natural order.
# ---------------------------------------------------------------------------

MISSING_SENTINEL = "?"

NUMERIC_COLS = (
    "time_in_hospital", "num_lab_procedures", "num_procedures",
    "num_medications", "number_outpatient", "number_emergency",
    "number_inpatient", "number_diagnoses",
)

ID_COLS = ("admission_type_id", "discharge_disposition_id", "admission_source_id")

DIAG_COLS = ("diag_1", "diag_2", "diag_3")

MEDICATION_COLS = (
    "metformin", "repaglinide", "nateglinide", "chlorpropamide",
    "glimepiride", "acetohexamide", "glipizide", "glyburide",
    "tolbutamide", "pioglitazone", "rosiglitazone", "acarbose",
    "miglitol", "troglitazone", "tolazamide", "examide",
    "citoglipton", "insulin", "glyburide-metformin",
    "glipizide-metformin", "glimepiride-pioglitazone",
    "metformin-rosiglitazone", "metformin-pioglitazone",
)

CATEGORICAL_COLS = (
    "race", "gender", "age", "weight", "payer_code",
    "medical_specialty", "max_glu_serum", "A1Cresult",
)

BINARY_COLS = ("change", "diabetesMed")

EXPIRED_DISPOSITIONS = (11, 13, 14, 19, 20, 21)
VALID_GENDER = ("Male", "Female")
VALID_READMITTED = ("<30", ">30", "NO")
VALID_MED_VALUES = ("No", "Steady", "Up", "Down")
VALID_CHANGE = ("Ch", "No")
VALID_DIABETES_MED = ("Yes", "No")
POLYPHARMACY_THRESHOLD = 10

AGE_ORDER = (
    "[0-10)", "[10-20)", "[20-30)", "[30-40)", "[40-50)",
    "[50-60)", "[60-70)", "[70-80)", "[80-90)", "[90-100)",
)

# Missing-value policy (fill values per column group).
FILL_UNKNOWN_COLS = ("payer_code", "medical_specialty", "race")
FILL_NONE_COLS = ("diag_2", "diag_3")

# Discharge disposition code -> label; anything else is "Other".
DISPOSITION_LABELS = (
    ("1", "Discharged to Home"),
    ("2", "Short-Term Hospital"),
    ("3", "Skilled Nursing Facility"),
    ("4", "Another Inpatient Institution"),
    ("5", "Another Type of Institution"),
    ("6", "Home with Health Service"),
    ("7", "Left Against Medical Advice"),
    ("9", "Admitted as Inpatient"),
    ("15", "Swing Bed"),
    ("17", "Other Institution"),
    ("18", "Another Type of Health Care"),
    ("22", "Rehabilitation Facility"),
    ("23", "Long-Term Care Hospital"),
    ("25", "Psychiatric Hospital"),
    ("28", "Psychiatric Transfer"),
)

# Admission source code -> label; anything else is "Other".
ADMISSION_SOURCE_LABELS = (
    ("1", "Physician Referral"),
    ("2", "Clinic Referral"),
    ("3", "HMO Referral"),
    ("4", "Transfer from Hospital"),
    ("5", "Transfer from SNF"),
    ("6", "Transfer from Another Facility"),
    ("7", "Emergency Room"),
    ("8", "Court / Law Enforcement"),
    ("9", "Not Available"),
)

# Admission type code -> label (data dictionary); anything else is "Other".
ADMISSION_TYPE_LABELS = (
    ("1", "Emergency"),
    ("2", "Urgent"),
    ("3", "Elective"),
    ("4", "Newborn"),
    ("6", "NULL"),
    ("7", "Trauma"),
)

# ICD-9 primary-diagnosis chapters in evaluation order (first match wins).
# Prefix rules come first, then inclusive numeric ranges, else "Other".
ICD_PREFIX_RULES = (
    ("^[Vv]", "Supplementary (V-codes)"),
    ("^[Ee]", "External Causes (E-codes)"),
)
ICD_EXACT_RULES = (("None", "No Primary Diagnosis"),)
ICD_RANGE_RULES = (
    (390, 459, "Circulatory"),
    (460, 519, "Respiratory"),
    (520, 579, "Digestive"),
    (250, 250.99, "Diabetes"),
    (800, 999, "Injury & Poisoning"),
    (710, 739, "Musculoskeletal"),
    (580, 629, "Genitourinary"),
    (140, 239, "Neoplasms"),
    (290, 319, "Mental Disorders"),
)
ICD_OTHER = "Other"

# Risk tiers, evaluated in order; the last tier takes every remaining row.
RISK_TIERS = (
    ("1 — High Risk", {"number_inpatient": 2, "time_in_hospital": 7, "num_medications": 15}),
    ("2 — Moderate Risk", {"number_inpatient": 1, "time_in_hospital": 4}),
)
RISK_TIER_REST = "3 — Low Risk"

READMISSION_STATUS_LABELS = (
    ("<30", "1 — Readmitted <30 Days"),
    (">30", "2 — Readmitted >30 Days"),
)
READMISSION_STATUS_REST = "3 — Not Readmitted"

# Length-of-stay bands: (upper bound inclusive, label); rest -> last label.
LOS_BANDS = (
    (2, "1 — 1-2 days"),
    (5, "2 — 3-5 days"),
    (7, "3 — 6-7 days"),
    (14, "4 — 8-14 days"),
)
LOS_BAND_REST = "5 — 15+ days"

# Prior inpatient visit bands: exact values, else the rest label.
PRIOR_INPATIENT_BANDS = (
    (0, "No Prior Inpatient"),
    (1, "1 Prior Inpatient"),
    (2, "2 Prior Inpatient"),
)
PRIOR_INPATIENT_REST = "3+ Prior Inpatient"

# Encounter sequence tiers: exact sequence numbers, else the rest label.
ENCOUNTER_TIERS = (
    (1, "1st Encounter"),
    (2, "2nd Encounter"),
    (3, "3rd Encounter"),
)
ENCOUNTER_TIER_REST = "4th+ Encounter"

REPEAT_LABELS = ("Repeat Patient", "First-Time Patient")
POLYPHARMACY_LABELS = ("Polypharmacy (10+ meds)", "Standard (<10 meds)")

KPI_MIN_DISPOSITION = 200
KPI_MIN_SPECIALTY = 50
TOP_SPECIALTIES = 15
UNKNOWN = "Unknown"

ALPHA = 0.05
CHI2_CRITICAL_DOF1 = 3.841458820694124
Z_CRITICAL_TWO_SIDED = 1.959963984540054

CORRELATION_EXTRA_COLS = ("num_active_medications", "age_midpoint", "total_prior_visits")


def snake(name: str) -> str:
    """Hyphenated source names are not valid SQL identifiers."""
    return name.replace("-", "_")


@dataclass(frozen=True)
class EncounterSchema:
    """Column groups and vocabularies of one encounter-grain table."""

    primary_key: str = "encounter_id"
    entity_key: str = "patient_nbr"
    target: str = "readmitted"
    sentinel: str = MISSING_SENTINEL
    numeric_cols: tuple[str, ...] = NUMERIC_COLS
    id_cols: tuple[str, ...] = ID_COLS
    medication_cols: tuple[str, ...] = MEDICATION_COLS
    categorical_cols: tuple[str, ...] = CATEGORICAL_COLS
    expired_dispositions: tuple[int, ...] = EXPIRED_DISPOSITIONS
    valid_gender: tuple[str, ...] = VALID_GENDER
    valid_target: tuple[str, ...] = VALID_READMITTED
    valid_med_values: tuple[str, ...] = VALID_MED_VALUES
    polypharmacy_threshold: int = POLYPHARMACY_THRESHOLD

    @property
    def medication_cols_clean(self) -> tuple[str, ...]:
        return tuple(snake(c) for c in self.medication_cols)

    @property
    def rename_map(self) -> dict[str, str]:
        return {c: snake(c) for c in self.medication_cols if "-" in c}


ENCOUNTERS = EncounterSchema()
