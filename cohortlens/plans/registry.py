"""Query registry: SURVEY operator id -> (Spark query, oracle SQL).

Every Spark query reads the driver tables of ``sf_dir`` (through the encounter
adapter and the materialised clean/base layers) and returns a DataFrame.  The
oracle SQL computes the same thing in DuckDB over the same tables; entries
without SQL (p-values need ``erfc``) are checked on row counts only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from . import eda as E
from . import kpi as K
from . import oracle as O
from ..operators.encounters import base_totals
from .pipeline import build_layers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def on_base(fn):
    return lambda spark, sf_dir: fn(build_layers(spark, sf_dir).base)


EV = "led_to_30day_readmission"


def _rate3() -> str:
    return (f"COUNT(*) AS encounters, {O.ssum(EV)} AS readmitted_30day, "
            f"{O.rate(EV)} AS readmission_rate_pct")


# ---------------------------------------------------------------- B / K ----

register("b1_base_totals", O.with_layers(
    "SELECT COUNT(*) AS total_valid_encounters, "
    f"{O.ssum(EV)} AS will_be_readmitted_30day, {O.ssum('led_to_any_readmission')} AS will_be_readmitted_any, "
    f"{O.ssum('is_itself_a_readmission')} AS are_readmissions, {O.ssum('is_first_encounter')} AS first_encounters, "
    f"{O.ssum('is_repeat_patient')} AS repeat_patient_encounters FROM base"))(on_base(base_totals))

K_SQL = {
    "k1_overall": (
        f"SELECT COUNT(*) AS total_encounters, {O.ssum(EV)} AS readmitted_30day, "
        f"{O.ssum('led_to_any_readmission')} AS readmitted_any, {O.rate(EV)} AS rate_30day_pct, "
        f"{O.rate('led_to_any_readmission')} AS rate_any_pct, COUNT(DISTINCT patient_nbr) AS unique_patients, "
        f"{O.mean('time_in_hospital')} AS avg_los_days, {O.mean('num_medications')} AS avg_medications FROM base"),
    "k2_diagnosis": (
        f"SELECT {O.icd_case()} AS diagnosis_category, COUNT(*) AS total_encounters, "
        f"{O.ssum(EV)} AS readmitted_30day, {O.rate(EV)} AS readmission_rate_pct, "
        f"{O.mean('time_in_hospital')} AS avg_los_days, {O.mean('num_medications')} AS avg_medications "
        f"FROM base GROUP BY 1"),
    "k3_disposition": (
        f"SELECT discharge_disposition_id, "
        f"{O.case_pairs('discharge_disposition_id', C.DISPOSITION_LABELS, 'Other')} AS disposition_label, "
        f"COUNT(*) AS total_encounters, {O.ssum(EV)} AS readmitted_30day, {O.rate(EV)} AS readmission_rate_pct, "
        f"{O.mean('time_in_hospital')} AS avg_los_days FROM base GROUP BY discharge_disposition_id "
        f"HAVING COUNT(*) >= {C.KPI_MIN_DISPOSITION}"),
    "k4_los_by_readmission": (
        f"SELECT {O.status_case()} AS readmission_status, COUNT(*) AS encounters, "
        f"{O.mean('time_in_hospital')} AS avg_los_days, "
        f"quantile_cont(time_in_hospital, 0.5) AS median_los_days, MIN(time_in_hospital) AS min_los, "
        f"MAX(time_in_hospital) AS max_los, {O.mean('num_medications')} AS avg_medications, "
        f"{O.mean('num_active_medications')} AS avg_active_medications, "
        f"{O.mean('number_diagnoses')} AS avg_diagnoses, {O.mean('total_prior_visits')} AS avg_prior_visits "
        f"FROM base GROUP BY 1"),
    "k5_age_prior_inpatient": (
        f"SELECT age, {O.exact_band_case('number_inpatient', C.PRIOR_INPATIENT_BANDS, C.PRIOR_INPATIENT_REST)} "
        f"AS prior_inpatient_band, COUNT(*) AS encounters, {O.ssum(EV)} AS readmitted_30day, "
        f"{O.rate(EV)} AS readmission_rate_pct, {O.mean('age_midpoint', 1, 2)} AS avg_age "
        f"FROM base GROUP BY 1, 2"),
    "k6_specialty": (
        f"SELECT medical_specialty, COUNT(*) AS total_encounters, {O.ssum(EV)} AS readmitted_30day, "
        f"{O.rate(EV)} AS readmission_rate_pct, {O.mean('time_in_hospital')} AS avg_los_days, "
        f"{O.mean('num_medications')} AS avg_medications, "
        f"{O.mean('num_active_medications')} AS avg_active_medications FROM base "
        f"WHERE medical_specialty != '{C.UNKNOWN}' GROUP BY medical_specialty "
        f"HAVING COUNT(*) >= {C.KPI_MIN_SPECIALTY}"),
    "k7_risk_tiers": (
        f"SELECT {O.risk_case()} AS risk_tier, COUNT(*) AS total_encounters, "
        f"COUNT(DISTINCT patient_nbr) AS unique_patients, {O.ssum(EV)} AS readmitted_30day, "
        f"{O.rate(EV)} AS readmission_rate_pct, {O.mean('time_in_hospital')} AS avg_los_days, "
        f"{O.mean('num_medications')} AS avg_medications, "
        f"{O.mean('num_active_medications')} AS avg_active_medications, "
        f"{O.mean('number_inpatient')} AS avg_prior_inpatient, "
        f"{O.mean('total_prior_visits')} AS avg_total_prior_visits, "
        f"{O.ssum('polypharmacy_flag')} AS polypharmacy_count, {O.rate('polypharmacy_flag')} AS polypharmacy_pct "
        f"FROM base GROUP BY 1"),
    "k8_repeat_patients": (
        f"SELECT CASE WHEN is_repeat_patient = 1 THEN '{C.REPEAT_LABELS[0]}' ELSE '{C.REPEAT_LABELS[1]}' END "
        f"AS patient_type, COUNT(*) AS total_encounters, COUNT(DISTINCT patient_nbr) AS unique_patients, "
        f"{O.ssum(EV)} AS readmitted_30day, {O.rate(EV)} AS readmission_rate_pct, "
        f"{O.mean('time_in_hospital')} AS avg_los_days, {O.mean('total_prior_visits')} AS avg_prior_visits, "
        f"{O.mean('num_medications')} AS avg_medications FROM base GROUP BY 1"),
}
K_FN = {
    "k1_overall": K.kpi_overall, "k2_diagnosis": K.kpi_by_diagnosis,
    "k3_disposition": K.kpi_by_disposition, "k4_los_by_readmission": K.kpi_los_by_readmission,
    "k5_age_prior_inpatient": K.kpi_by_age, "k6_specialty": K.kpi_by_specialty,
    "k7_risk_tiers": K.kpi_high_risk_segments, "k8_repeat_patients": K.kpi_repeat_patients,
}
for _name, _fn in K_FN.items():
    register(_name, O.with_layers(K_SQL[_name]))(on_base(_fn))

_VIEW_KEYS = list(K_FN)  # same order as K.KPI_VIEWS
register("k9_view_row_counts", O.with_layers(" UNION ALL ".join(
    f"SELECT '{view}' AS view_name, COUNT(*) AS \"rows\" FROM ({K_SQL[key]}) v_{i}"
    for i, (view, key) in enumerate(zip(K.KPI_VIEWS, _VIEW_KEYS)))))(on_base(K.kpi_view_row_counts))

# ---------------------------------------------------------------- E ------

E_SQL = {
    "e1_target_distribution": (
        "SELECT readmitted, COUNT(*) AS encounters, "
        f"{O.round_ratio('COUNT(*) * 100', 'SUM(COUNT(*)) OVER ()')} AS pct_of_total FROM base GROUP BY readmitted"),
    "e2_age": f"SELECT age, {_rate3()} FROM base GROUP BY age",
    "e3_gender": f"SELECT gender, {_rate3()} FROM base GROUP BY gender",
    "e4_race": f"SELECT race, {_rate3()} FROM base WHERE race != '{C.UNKNOWN}' GROUP BY race",
    "e5_utilisation_by_outcome": (
        f"SELECT {O.status_case()} AS readmission_outcome, COUNT(*) AS encounters, "
        f"{O.mean('time_in_hospital')} AS avg_los_days, {O.mean('num_medications')} AS avg_medications, "
        f"{O.mean('num_active_medications')} AS avg_active_medications, "
        f"{O.mean('num_lab_procedures')} AS avg_lab_procedures, {O.mean('number_diagnoses')} AS avg_diagnoses, "
        f"{O.mean('total_prior_visits')} AS avg_prior_visits, {O.rate('polypharmacy_flag')} AS polypharmacy_pct "
        f"FROM base GROUP BY 1"),
    "e6_los_band": (
        f"SELECT {O.upper_band_case('time_in_hospital', C.LOS_BANDS, C.LOS_BAND_REST)} AS los_band, "
        f"{_rate3()} FROM base GROUP BY 1"),
    "e7_diagnosis": (
        f"SELECT {O.icd_case()} AS diagnosis_category, {_rate3()}, "
        f"{O.mean('time_in_hospital')} AS avg_los_days FROM base GROUP BY 1"),
    "e8_top_specialties": (
        f"SELECT medical_specialty, {_rate3()}, {O.mean('time_in_hospital')} AS avg_los_days FROM base "
        f"WHERE medical_specialty != '{C.UNKNOWN}' GROUP BY medical_specialty "
        f"HAVING COUNT(*) >= {C.KPI_MIN_SPECIALTY} ORDER BY encounters DESC, medical_specialty "
        f"LIMIT {C.TOP_SPECIALTIES}"),
    "e9_admission_source": (
        f"SELECT admission_source_id, "
        f"{O.case_pairs('admission_source_id', C.ADMISSION_SOURCE_LABELS, 'Other')} AS source_label, "
        f"{_rate3()} FROM base GROUP BY admission_source_id"),
    "e10_insulin": f"SELECT insulin, {_rate3()} FROM base GROUP BY insulin",
    "e11_a1c": f"SELECT \"A1Cresult\", {_rate3()} FROM base GROUP BY \"A1Cresult\"",
    "e12_change_x_diabetes_med": (
        f"SELECT change AS medication_change, \"diabetesMed\" AS on_diabetes_medication, {_rate3()} "
        f"FROM base GROUP BY change, \"diabetesMed\""),
    "e13_polypharmacy": (
        f"SELECT CASE WHEN polypharmacy_flag = 1 THEN '{C.POLYPHARMACY_LABELS[0]}' "
        f"ELSE '{C.POLYPHARMACY_LABELS[1]}' END AS medication_burden, {_rate3()} FROM base GROUP BY 1"),
    "e14_encounter_tier": (
        f"SELECT {O.exact_band_case('encounter_seq', C.ENCOUNTER_TIERS, C.ENCOUNTER_TIER_REST)} "
        f"AS encounter_tier, {_rate3()} FROM base GROUP BY 1"),
    "e15_repeat_vs_first": (
        f"SELECT CASE WHEN is_repeat_patient = 1 THEN '{C.REPEAT_LABELS[0]}' ELSE '{C.REPEAT_LABELS[1]}' END "
        f"AS patient_type, {_rate3()}, {O.mean('time_in_hospital')} AS avg_los, "
        f"{O.mean('num_medications')} AS avg_medications, {O.mean('total_prior_visits')} AS avg_prior_visits "
        f"FROM base GROUP BY 1"),
    "e16_active_medications": (
        f"SELECT num_active_medications, {_rate3()} FROM base GROUP BY num_active_medications"),
    "e17_age_volume_rate": (
        f"SELECT age, COUNT(*) AS encounters, {O.rate(EV)} AS readmission_rate_pct FROM base GROUP BY age"),
}
E_FN = {
    "e1_target_distribution": E.target_distribution,
    "e2_age": lambda b: E.rate_by(b, "age", order_by_rate=False),
    "e3_gender": lambda b: E.rate_by(b, "gender"),
    "e4_race": E.rate_by_race,
    "e5_utilisation_by_outcome": E.utilisation_by_outcome,
    "e6_los_band": E.rate_by_los_band,
    "e7_diagnosis": E.rate_by_diagnosis,
    "e8_top_specialties": E.top_specialties,
    "e9_admission_source": E.rate_by_admission_source,
    "e10_insulin": lambda b: E.rate_by(b, "insulin"),
    "e11_a1c": lambda b: E.rate_by(b, "A1Cresult"),
    "e12_change_x_diabetes_med": E.change_by_diabetes_med,
    "e13_polypharmacy": E.rate_by_polypharmacy,
    "e14_encounter_tier": E.rate_by_encounter_tier,
    "e15_repeat_vs_first": E.repeat_vs_first,
    "e16_active_medications": lambda b: E.rate_by(b, "num_active_medications", order_by_rate=False),
    "e17_age_volume_rate": E.age_volume_and_rate,
}
for _name, _fn in E_FN.items():
    register(_name, O.with_layers(E_SQL[_name]))(on_base(_fn))

# ---------------------------------------------------------------- D ------

_OVERALL = f"(SELECT {O.rate(EV)} AS baseline_rate FROM base)"
_H = "CAST(ROUND({x} * 100) AS BIGINT)"


def _hund(x: str) -> str:
    return _H.format(x=x)


register("d1_gender_vs_baseline")(on_base(lambda b: E.segments_vs_baseline(b, "gender")))
register("d1_age_vs_baseline")(on_base(lambda b: E.segments_vs_baseline(b, "age")))
register("d1_diagnosis_vs_baseline")(on_base(E.diagnosis_vs_baseline))


def _risk_sql(segment: str) -> str:
    """D2/D3 of the rows where ``segment`` is true against those where it is false."""
    return O.with_layers("SELECT " + ", ".join([
        f"{O.round_ratio('e1 * 100', 'n1')} AS exposed_rate_pct", f"{O.round_ratio('e0 * 100', 'n0')} AS reference_rate_pct",
        f"{O.round_ratio('e1 * n0', 'e0 * n1')} AS relative_risk",
        f"{O.round_ratio('(e1 * n0 - e0 * n1) * 100', 'e0 * n1')} AS pct_higher",
        f"{O.round_ratio('e1 * n0 - e0 * n1', 'n0', 0)} AS excess_events"])
        + f" FROM (SELECT CAST(COUNT_IF(s) AS BIGINT) AS n1, CAST(COUNT_IF(NOT s) AS BIGINT) AS n0, CAST(SUM(CASE WHEN s THEN {EV} END) AS BIGINT) AS e1, "
        f"CAST(SUM(CASE WHEN NOT s THEN {EV} END) AS BIGINT) AS e0 FROM (SELECT *, ({segment}) AS s FROM base) b) t")


register("d2_polypharmacy_risk", _risk_sql("polypharmacy_flag = 1"))(
    on_base(lambda b: E.segment_risk(b, F.col("polypharmacy_flag") == 1)))
register("d2_untested_a1c_risk", _risk_sql("NOT (\"A1Cresult\" IS DISTINCT FROM 'None')"))(
    on_base(lambda b: E.segment_risk(b, F.col("A1Cresult").eqNullSafe(F.lit("None")))))

register("d2_relative_risk", O.with_layers(
    "SELECT " + ", ".join([
        f"{O.round_ratio('e1 * 100', 'n1')} AS repeat_rate_pct",
        f"{O.round_ratio('e0 * 100', 'n0')} AS first_time_rate_pct",
        f"{O.round_ratio('e1 * n0', 'e0 * n1')} AS relative_risk",
        f"{O.round_ratio('(e1 * n0 - e0 * n1) * 100', 'e0 * n1')} AS pct_higher",
        f"{O.round_ratio('e1 * n0 - e0 * n1', 'n0', 0)} AS excess_events"]) +
    " FROM (SELECT "
    f"MAX(CASE WHEN r = 1 THEN n END) AS n1, MAX(CASE WHEN r = 1 THEN e END) AS e1, "
    f"MAX(CASE WHEN r = 0 THEN n END) AS n0, MAX(CASE WHEN r = 0 THEN e END) AS e0 FROM "
    f"(SELECT is_repeat_patient AS r, COUNT(*) AS n, {O.ssum(EV)} AS e FROM base GROUP BY 1) t) s"))(
    on_base(E.relative_risk))

_SHARE = (f"SELECT CASE WHEN is_repeat_patient = 1 THEN '{C.REPEAT_LABELS[0]}' ELSE '{C.REPEAT_LABELS[1]}' END "
          f"AS patient_type, COUNT(*) AS encounters, {O.ssum(EV)} AS events FROM base GROUP BY 1")
register("d4_share_vs_events", O.with_layers(
    "SELECT *, " + O.round_ratio(_hund("share_of_events_pct"), _hund("share_of_encounters_pct")) +
    " AS disproportionality_index FROM (SELECT *, "
    f"{O.round_ratio('encounters * 100', 'SUM(encounters) OVER ()')} AS share_of_encounters_pct, "
    f"{O.round_ratio('events * 100', 'SUM(events) OVER ()')} AS share_of_events_pct FROM ({_SHARE}) s) t"))(
    on_base(E.share_vs_events))

register("d5_tier_steps", O.with_layers(
    "SELECT *, CAST(" + _hund("readmission_rate_pct") + " - LAG(" + _hund("readmission_rate_pct") +
    ") OVER (ORDER BY encounter_tier) AS DOUBLE) / 100 AS step_pts FROM (" +
    f"SELECT {O.exact_band_case('encounter_seq', C.ENCOUNTER_TIERS, C.ENCOUNTER_TIER_REST)} "
    f"AS encounter_tier, {_rate3()} FROM base GROUP BY 1) t"))(on_base(E.tier_steps))

register("d6_rows_per_entity", O.with_layers(
    f"SELECT CASE WHEN is_repeat_patient = 1 THEN '{C.REPEAT_LABELS[0]}' ELSE '{C.REPEAT_LABELS[1]}' END "
    f"AS patient_type, COUNT(*) AS encounters, COUNT(DISTINCT patient_nbr) AS patients, "
    f"{O.round_ratio('COUNT(*)', 'COUNT(DISTINCT patient_nbr)')} AS encounters_per_patient FROM base GROUP BY 1"))(
    on_base(E.rows_per_entity))

_BANDS = [lab for _, lab in C.PRIOR_INPATIENT_BANDS] + [C.PRIOR_INPATIENT_REST]
_BAND_CASE = O.exact_band_case("number_inpatient", C.PRIOR_INPATIENT_BANDS, C.PRIOR_INPATIENT_REST)
def _band_rate(band: str) -> str:
    match = f"{_BAND_CASE} = '{band}'"
    events = f"CAST(SUM(CASE WHEN {match} THEN {EV} END) AS BIGINT) * 100"
    rows = f"COUNT(CASE WHEN {match} THEN 1 END)"
    return f"{O.round_ratio(events, rows)} AS {O.q(band)}"


register("d7_age_prior_matrix", O.with_layers(
    "SELECT age, " + ", ".join(_band_rate(b) for b in _BANDS) + " FROM base GROUP BY age"))(
    on_base(E.age_by_prior_inpatient_matrix))

# ---------------------------------------------------------------- H ------

from . import battery as B  # noqa: E402


def _grp_sql(spec) -> str:
    return {"T1": "is_repeat_patient", "T2": "polypharmacy_flag", "T5": "gender",
            "T6": "CASE WHEN \"A1Cresult\" IS DISTINCT FROM 'None' THEN 1 ELSE 0 END",
            "T7": "change"}[spec.test]


register("h1_chi_square_tests", O.with_layers(" UNION ALL ".join(
    O.chi_square_sql(s.test, s.finding, _grp_sql(s), s.label1, s.label2, s.value1, s.value2)
    for s in B.CHI_SPECS)))(on_base(B.chi_square_tests))
register("h2_mann_whitney_tests", O.with_layers(" UNION ALL ".join(
    O.mann_whitney_sql(s.test, s.finding, s.value, s.reason) for s in B.RANK_SPECS)))(
    on_base(B.rank_tests))


def _erfc_sql(x: str) -> str:
    """erfc from the all-positive series of erf; 0 beyond 6."""
    term = (f"exp(2 * k * ln(2.0) + (2 * k + 1) * ln({x}) + lgamma(k + 1) - lgamma(2 * k + 2) - ({x}) * ({x}))")
    erf = f"2 / sqrt(pi()) * list_sum(list_transform(range(0, 300), lambda k: {term}))"
    return f"(CASE WHEN ({x}) <= 0 THEN 1.0 WHEN ({x}) > 6 THEN 0.0 ELSE greatest(0.0, 1 - {erf}) END)"


def _battery_sql() -> str:
    """H3-H8 from the two test families: wording, effect sizes, adjusted p-values."""
    chi = " UNION ALL ".join(O.chi_square_sql(s.test, s.finding, _grp_sql(s), s.label1, s.label2, s.value1, s.value2)
                             for s in B.CHI_SPECS)
    rank = " UNION ALL ".join(O.mann_whitney_sql(s.test, s.finding, s.value, s.reason) for s in B.RANK_SPECS)
    verdict = "CASE WHEN p_value < 0.05 THEN 'rejected' ELSE 'not rejected' END"
    return O.with_layers(f"""SELECT * FROM (
WITH chi_ AS (SELECT *, x AS _x, {_erfc_sql('x')} AS p_value FROM (SELECT *, sqrt(chi2 / 2) AS x FROM ({chi}) c0) c1),
rank_ AS (SELECT *, least(1.0, {_erfc_sql('x')}) AS p_value FROM (SELECT *, abs(z) / sqrt(2.0) AS x FROM ({rank}) r0) r1),
both_ AS (
SELECT test, finding, 'Chi-square' AS method, chi2 AS statistic, dof, p_value, n, CAST(NULL AS BIGINT) AS n1, CAST(NULL AS BIGINT) AS n0,
  group1, rate1 AS value1, group2, rate2 AS value2, ROUND(ABS(rate1 - rate2), 2) AS gap_pts,
  printf('Chi-square: %s %.2f%%, %s %.2f%%, gap %.2f points; independence %s at the 5%% level.', group1, rate1, group2, rate2,
    ABS(rate1 - rate2), {verdict}) AS interpretation,
  CASE WHEN p_value < 0.05 AND ABS(rate1 - rate2) < 0.5 THEN
    printf('Gap of %.2f points only: weigh its size, not the test alone.', ABS(rate1 - rate2)) END AS note,
  sqrt(chi2 / n) AS effect FROM chi_
UNION ALL
SELECT test, finding, 'Mann-Whitney U', u1, CAST(NULL AS INTEGER), p_value, n1 + n0, n1, n0, 'Readmitted', median1, 'Not readmitted', median0,
  ROUND(median1 - median0, 2),
  printf('Mann-Whitney: %s, medians %.2f and %.2f; equal distributions %s at the 5%% level (rank test because %s).',
    lower(finding), median1, median0, {verdict}, reason), CAST(NULL AS VARCHAR),
  2 * u1 / (CAST(n1 AS DOUBLE) * n0) - 1 FROM rank_),
ranked_ AS (SELECT *, COUNT(*) OVER () AS m, ROW_NUMBER() OVER (ORDER BY p_value, test) AS i,
  RANK() OVER (PARTITION BY method ORDER BY ABS(effect) DESC, test) AS strength_rank FROM both_),
adjusted_ AS (SELECT *, greatest(p_value, least(1.0, MIN(p_value * m / i) OVER (ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) AS bh FROM ranked_)
SELECT test, finding, method, statistic, dof, ROUND(p_value, 6) AS p_value, n, n1, n0, group1, value1, group2, value2, gap_pts,
  interpretation, note, p_value < 0.05 AS significant, ROUND(effect, 6) AS effect_size, strength_rank,
  ROUND(least(1.0, p_value * m), 6) AS p_bonferroni, ROUND(bh, 6) AS p_bh
FROM adjusted_) b_""")


SQL["h5_test_battery"] = _battery_sql()

# ------------------------------------------------------ quality family ----

from . import quality as Q  # noqa: E402

_RT = O.raw_types()
_q = O.q
_rr = O.round_ratio


def _q1_sql() -> str:
    parts = [f"SELECT '{c}' AS \"column\", '{t}' AS dtype, COUNT({_q(c)}) AS non_null, "
             f"COUNT(*) - COUNT({_q(c)}) AS null_count, "
             f"{_rr(f'(COUNT(*) - COUNT({_q(c)})) * 100', 'COUNT(*)')} AS null_pct, "
             f"COUNT(DISTINCT CAST({_q(c)} AS VARCHAR)) AS \"unique\", "
             f"COALESCE(CAST(MIN({_q(c)}) AS VARCHAR), 'ALL NULL') AS sample_value FROM raw_"
             for c, t in _RT.items()]
    return O.with_layers(O.union_all(parts), "raw")


def _q2_body() -> str:
    def one(c: str) -> str:
        hits = f"COUNT_IF({_q(c)} = '?')"
        return (f"SELECT '{c}' AS \"column\", CAST({hits} AS BIGINT) AS sentinel_count, "
                f"{_rr(hits + ' * 100', 'COUNT(*)')} AS sentinel_pct FROM raw_")
    return f"SELECT * FROM ({O.union_all([one(c) for c in O.STRING_RAW])}) s WHERE sentinel_count > 0"


def _topn_sql(cols, n: int, table: str = "raw_") -> str:
    parts = [f"SELECT '{c}' AS \"column\", CAST({_q(c)} AS VARCHAR) AS value, COUNT(*) AS count "
             f"FROM {table} GROUP BY 2" for c in cols]
    ranked = (f"SELECT *, ROW_NUMBER() OVER (PARTITION BY \"column\" ORDER BY count DESC, value ASC NULLS LAST) "
              f"AS rk FROM ({O.union_all(parts)}) u")
    return (f"SELECT \"column\", value, count, {_rr('count * 100', f'(SELECT COUNT(*) FROM {table})')} AS pct "
            f"FROM ({ranked}) r WHERE rk <= {n}")


def _q4_sql() -> str:
    parts = []
    for c in C.NUMERIC_COLS:
        x = f"CAST({_q(c)} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", COUNT({x}) AS \"count\", MIN({x}) AS \"min\", MAX({x}) AS \"max\", "
            f"ROUND(AVG({x}), 6) AS mean, quantile_cont({x}, 0.5) AS median, ROUND(stddev_samp({x}), 6) AS std, "
            f"quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3, ROUND(skewness({x}), 6) AS skew, "
            f"quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) AS iqr, MAX({x}) - MIN({x}) AS \"range\" "
            f"FROM raw_")
    return O.with_layers(O.union_all(parts), "raw")


register("q1_structure_profile", _q1_sql())(Q.q1)
register("q2_sentinel_report", O.with_layers(_q2_body(), "raw"))(Q.q2)
register("q3_cardinality_top10", O.with_layers(_topn_sql(C.CATEGORICAL_COLS, 10), "raw"))(Q.q3)
register("q4_numeric_profile", _q4_sql())(Q.q4)
register("q5_class_balance", O.with_layers(
    "SELECT readmitted, count, percentage, "
    f"{_rr('MAX(h) OVER ()', 'MIN(h) OVER ()', 1)} AS imbalance_ratio FROM ("
    "SELECT *, CAST(ROUND(percentage * 100) AS BIGINT) AS h FROM ("
    f"SELECT readmitted, count, {_rr('count * 100', 'SUM(count) OVER ()')} AS percentage FROM ("
    "SELECT readmitted, COUNT(*) AS count FROM raw_ WHERE readmitted IS NOT NULL GROUP BY 1) a) b) c",
    "raw"))(Q.q5)
register("q6_weight_drilldown", O.with_layers(
    "SELECT 'weight' AS \"column\", 'string' AS dtype, t.total_rows, v.value, v.count, t.equality_hits, "
    "t.regex_hits FROM (" + _topn_sql(["weight"], 5) + ") v CROSS JOIN (SELECT COUNT(*) AS total_rows, "
    "COUNT_IF(weight = '?') AS equality_hits, COUNT_IF(regexp_matches(weight, '^\\?$')) AS regex_hits "
    "FROM raw_) t", "raw"))(Q.q6)

register("c1_sentinel_replacement", O.with_layers(
    f"SELECT COUNT(*) AS columns_with_sentinel, CAST(SUM(sentinel_count) AS BIGINT) AS values_replaced "
    f"FROM ({_q2_body()}) q", "raw"))(Q.c1)
register("c2_duplicates", O.with_layers(
    "SELECT rows_before, rows_after, rows_before - rows_after AS duplicates_removed, pk_conflict_rows FROM "
    "(SELECT (SELECT COUNT(*) FROM raw_) AS rows_before, (SELECT COUNT(*) FROM c2f_) AS rows_after, "
    "(SELECT CAST(SUM(duplicate_flag) AS BIGINT) FROM c2f_) AS pk_conflict_rows) s", "clean"))(Q.c2)
register("a22_entity_frequency", O.with_layers(
    "SELECT COUNT_IF(n > 1) AS entities_with_repeats, MAX(n) AS max_rows_per_entity FROM "
    "(SELECT patient_nbr, COUNT(*) AS n FROM c2f_ GROUP BY 1) s", "clean"))(Q.a22)
register("c3_remaining_nulls", O.with_layers(
    "SELECT * FROM (" + O.union_all([
        f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({_q(c)}) AS null_count, "
        f"{_rr(f'(COUNT(*) - COUNT({_q(c)})) * 100', 'COUNT(*)')} AS null_pct FROM clean"
        for c in O.CLEAN_COLS]) + ") s WHERE null_count > 0", "clean"))(Q.c3)
register("c4_coercion_report", O.with_layers(O.union_all([
    f"SELECT '{c}' AS \"column\", COUNT_IF(TRY_CAST(CAST({c} AS VARCHAR) AS INTEGER) IS NULL) AS nulls_after, "
    f"COUNT_IF({c} IS NOT NULL AND TRY_CAST(CAST({c} AS VARCHAR) AS INTEGER) IS NULL) AS coercion_nulls FROM c3_"
    for c in C.NUMERIC_COLS]), "clean"))(Q.c4)
register("c5_vocabulary", O.with_layers(O.union_all([
    f"SELECT DISTINCT '{c}' AS \"column\", CAST({_q(c)} AS VARCHAR) AS value FROM clean WHERE {_q(c)} IS NOT NULL"
    for c in Q.VOCAB_COLS]), "clean"))(Q.c5)
register("c6_c7_exclusion_flags", O.with_layers(
    "SELECT CAST(SUM(gender_invalid_flag) AS BIGINT) AS gender_invalid, "
    "CAST(SUM(expired_or_hospice_flag) AS BIGINT) AS expired_or_hospice, COUNT(*) AS \"rows\" FROM clean",
    "clean"))(Q.c67)
_VALID_MED = ", ".join(f"'{v}'" for v in C.VALID_MED_VALUES)
register("c8_medication_validation", O.with_layers(O.union_all([
    f"SELECT '{m}' AS \"column\", CAST({_q(m)} AS VARCHAR) AS value, COUNT(*) AS \"rows\" FROM clean "
    f"WHERE {_q(m)} IS NOT NULL AND {_q(m)} NOT IN ({_VALID_MED}) GROUP BY 2"
    for m in C.ENCOUNTERS.medication_cols_clean]), "clean"))(Q.c8)
register("c9_outlier_report", O.with_layers(O.union_all([
    f"SELECT '{c}' AS \"column\", ROUND((SELECT {c}__lo FROM fence_), 2) AS lower_bound, "
    f"ROUND((SELECT {c}__hi FROM fence_), 2) AS upper_bound, "
    f"CAST(SUM({c}_outlier_flag) AS BIGINT) AS outlier_count, "
    f"{_rr(f'CAST(SUM({c}_outlier_flag) AS BIGINT) * 100', 'COUNT(*)')} AS outlier_pct FROM c9_"
    for c in C.NUMERIC_COLS]), "clean"))(Q.c9)
register("c9_any_outlier", O.with_layers(
    "SELECT CAST(SUM(any_outlier_flag) AS BIGINT) AS rows_with_outlier, COUNT(*) AS \"rows\", "
    f"{_rr('CAST(SUM(any_outlier_flag) AS BIGINT) * 100', 'COUNT(*)')} AS outlier_row_pct FROM clean",
    "clean"))(Q.c9_any)
register("f6_feature_summary", O.with_layers(O.union_all([
    f"SELECT '{f}' AS feature, CAST(MIN({f}) AS DOUBLE) AS \"min\", CAST(MAX({f}) AS DOUBLE) AS \"max\", "
    f"ROUND(AVG({f}), 6) AS mean FROM clean" for f in Q.FEATURES]), "clean"))(Q.f6)


def _a21_sql() -> str:
    cols = list(Q.CORR_COLS)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    cc = ", ".join(f"corr(CAST({cols[i]} AS DOUBLE), CAST({cols[j]} AS DOUBLE)) AS r{i}_{j}" for i, j in pairs)
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            r = "1.0" if i == j else f"ROUND(r{min(i, j)}_{max(i, j)}, 6)"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST({r} AS DOUBLE) AS r FROM cc_")
    return O.with_layers(f"SELECT * FROM (WITH cc_ AS (SELECT {cc} FROM clean) {O.union_all(parts)}) z", "clean")


def _g1_sql() -> str:
    parts = []
    for c in C.NUMERIC_COLS:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", q.grp AS readmitted, n, q1, median, q3, q3 - q1 AS iqr, "
            f"MIN(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END) AS whisker_low, "
            f"MAX(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_high, "
            f"CAST(SUM(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) "
            f"AS BIGINT) AS fliers FROM (SELECT CAST(readmitted AS VARCHAR) AS grp, COUNT({x}) AS n, "
            f"quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS q3 "
            f"FROM clean WHERE {x} IS NOT NULL GROUP BY 1) q JOIN (SELECT CAST(readmitted AS VARCHAR) AS grp, "
            f"{x} AS v FROM clean WHERE {x} IS NOT NULL) d ON d.grp = q.grp GROUP BY q.grp, n, q1, median, q3")
    return O.with_layers(O.union_all(parts), "clean")


def _g4_sql(col: str = "num_active_medications", bins: int = 20) -> str:
    def edge(i):
        return f"(CASE WHEN ({i}) >= {bins} THEN le ELSE ({i}) * step + fe END)"
    return O.with_layers(f"""SELECT grp AS readmitted, k3 AS bin, k3 * step + fe AS bin_low,
CASE WHEN k3 + 1 >= {bins} THEN le ELSE (k3 + 1) * step + fe END AS bin_high, COUNT(*) AS count FROM (
SELECT *, CASE WHEN v >= {edge('k2 + 1')} AND k2 <> {bins - 1} THEN k2 + 1 ELSE k2 END AS k3 FROM (
SELECT *, CASE WHEN v < {edge('k1')} THEN k1 - 1 ELSE k1 END AS k2 FROM (
SELECT *, CASE WHEN k0 >= {bins} THEN {bins - 1} ELSE k0 END AS k1 FROM (
SELECT f.grp, v, fe, le, (le - fe) / {bins} AS step,
CAST(FLOOR((v - fe) * ({float(bins)} / (le - fe))) AS INTEGER) AS k0 FROM
(SELECT CAST(readmitted AS VARCHAR) AS grp, CAST({col} AS DOUBLE) AS v FROM clean WHERE {col} IS NOT NULL) f
JOIN (SELECT CAST(readmitted AS VARCHAR) AS grp,
  CASE WHEN MIN({col}) = MAX({col}) THEN MIN({col}) - 0.5 ELSE CAST(MIN({col}) AS DOUBLE) END AS fe,
  CASE WHEN MIN({col}) = MAX({col}) THEN MAX({col}) + 0.5 ELSE CAST(MAX({col}) AS DOUBLE) END AS le
  FROM clean WHERE {col} IS NOT NULL GROUP BY 1) r ON r.grp = f.grp) a) b) c) d
GROUP BY grp, k3, step, fe, le""", "clean")


def _vs_baseline_sql(column: str) -> str:
    """Segment rates by ``column`` against the overall rate."""
    seg_h, base_h = _hund("g.readmission_rate_pct"), _hund("ov.baseline_rate")
    relative = _rr(f"({seg_h} - {base_h}) * 100", base_h)
    return O.with_layers(
        f"SELECT g.*, ov.baseline_rate, CAST({seg_h} - {base_h} AS DOUBLE) / 100 AS gap_pts, "
        f"{relative} AS relative_pct, "
        f"CASE WHEN g.readmission_rate_pct > ov.baseline_rate THEN 'Above' WHEN g.readmission_rate_pct < "
        f"ov.baseline_rate THEN 'Below' ELSE 'Equal' END AS vs_baseline "
        f"FROM (SELECT {column}, {_rate3()} FROM base GROUP BY {column}) g CROSS JOIN {_OVERALL} ov")


register("a21_correlation_matrix", _a21_sql())(Q.a21)
register("g1_box_stats", _g1_sql())(Q.g1)
register("g4_active_meds_histogram", _g4_sql())(Q.g4)

SQL["d1_gender_vs_baseline"] = _vs_baseline_sql("gender")
SQL["d1_age_vs_baseline"] = _vs_baseline_sql("age")
SQL["d1_diagnosis_vs_baseline"] = _vs_baseline_sql(f"{O.icd_case()} AS diagnosis_category").replace(
    f"GROUP BY {O.icd_case()} AS diagnosis_category", "GROUP BY 1")

register("g5_active_meds_vs_baseline", _vs_baseline_sql("num_active_medications"))(Q.g5)


def _audit_rows(checks: list[tuple[str, str, str, str]]) -> str:
    """(name, observed SQL, expected SQL, op) -> check rows."""
    return O.union_all([
        f"SELECT '{n}' AS \"check\", CAST({o} AS BIGINT) AS observed, CAST({e} AS BIGINT) AS expected, "
        f"COALESCE(CAST({o} AS BIGINT) {op} CAST({e} AS BIGINT), FALSE) AS passed FROM a_"
        for n, o, e, op in checks])


def _v1_sql() -> str:
    flags = [c for c in O.CLEAN_COLS if c.endswith("_flag")]
    sentinels = " + ".join(f"COUNT_IF({_q(c)} = '?')" for c in O.CLEAN_STRINGS)
    valid = ", ".join(f"'{v}'" for v in C.VALID_READMITTED)
    aggs = [f"COUNT(*) AS rows_", f"{sentinels} AS sentinels", "COUNT_IF(encounter_id IS NULL) AS pk_nulls",
            f"COUNT_IF(readmitted IS NULL OR readmitted NOT IN ({valid})) AS bad_target"]
    aggs += [f"COUNT_IF({f} NOT IN (0, 1) OR {f} IS NULL) AS nb_{i}" for i, f in enumerate(flags)]
    checks = [("rows", "rows_", "1", ">="), ("columns", str(len(O.CLEAN_COLS)), str(len(O.CLEAN_COLS)), "="),
              ("residual_sentinels", "sentinels", "0", "="), ("primary_key_nulls", "pk_nulls", "0", "="),
              ("unexpected_target_values", "bad_target", "0", "=")]
    checks += [(f"non_binary:{f}", f"nb_{i}", "0", "=") for i, f in enumerate(flags)]
    checks += [(f"feature_present:{f}", str(int(f in O.CLEAN_COLS)), "1", "=") for f in Q.EXPECTED_FEATURES]
    return O.with_layers(f"SELECT * FROM (WITH a_ AS (SELECT {', '.join(aggs)} FROM clean) "
                         f"{_audit_rows(checks)}) v", "clean")


def _v2_sql() -> str:
    flags = [c for c in O.CLEAN_COLS if c.endswith("_flag")]
    valid = ", ".join(f"'{v}'" for v in C.VALID_READMITTED)
    non_binary = " + ".join(f"COUNT_IF({f} NOT IN (0, 1) OR {f} IS NULL)" for f in flags)
    out_of_range = " + ".join(f"COUNT_IF({c} IS NOT NULL AND NOT ({c} BETWEEN {lo} AND {hi}))"
                              for c, (lo, hi) in Q.FEATURE_RANGES.items())
    aggs = ["COUNT(*) AS rows_", "COUNT(DISTINCT encounter_id) AS keys_", "COUNT_IF(encounter_id IS NULL) AS pk_nulls",
            f"COUNT_IF(readmitted IS NULL OR readmitted NOT IN ({valid})) AS bad_target",
            f"{non_binary} AS non_binary",
            "SUM(CASE WHEN expired_or_hospice_flag = 1 OR gender_invalid_flag = 1 THEN 1 ELSE 0 END) AS excluded",
            f"{out_of_range} AS out_of_range", "(SELECT COUNT(*) FROM c2f_) AS source_rows",
            f"(SELECT COUNT_IF(COALESCE(TRY_CAST(discharge_disposition_id AS DOUBLE) IN ({', '.join(str(x) for x in C.ENCOUNTERS.expired_dispositions)}), FALSE) "
            f"OR COALESCE(lower(trim(gender)) NOT IN ({', '.join(repr(g.lower()) for g in C.VALID_GENDER)}), FALSE)) FROM c2f_) AS expected_excluded"]
    checks = [("row_count_matches_source", "rows_", "source_rows", "="),
              ("primary_key_unique", "rows_ - keys_", "0", "="), ("primary_key_not_null", "pk_nulls", "0", "="),
              ("target_in_vocabulary", "bad_target", "0", "="), ("flags_binary", "non_binary", "0", "="),
              ("exclusions_flagged", "excluded", "expected_excluded", "="), ("features_in_range", "out_of_range", "0", "=")]
    return O.with_layers(f"SELECT * FROM (WITH a_ AS (SELECT {', '.join(aggs)} FROM clean) "
                         f"{_audit_rows(checks)}) v", "clean")


register("v1_pre_export_audit", _v1_sql())(Q.v1)
register("v2_post_load_validation", _v2_sql())(Q.v2)
register("v4_vocabulary_check", O.with_layers(O.union_all([
    f"SELECT '{c}' AS \"column\", CAST({_q(c)} AS VARCHAR) AS value, COUNT(*) AS \"rows\" FROM clean "
    f"WHERE {_q(c)} IS NOT NULL AND {_q(c)} NOT IN ({', '.join(repr(v) for v in vals)}) GROUP BY 2"
    for c, vals in Q.V4_VOCAB.items()]), "clean"))(Q.v4)
register("v5_views_non_empty", O.with_layers(
    "SELECT *, \"rows\" > 0 AS passed FROM (" + " UNION ALL ".join(
        f"SELECT '{view}' AS view_name, COUNT(*) AS \"rows\" FROM ({K_SQL[key]}) v_{i}"
        for i, (view, key) in enumerate(zip(K.KPI_VIEWS, _VIEW_KEYS))) + ") k"))(Q.v5)
register("v6_null_reconciliation", O.with_layers(O.union_all([
    f"SELECT '{c}' AS \"column\", COUNT_IF({_q(c)} = '?') AS sentinels_before, "
    f"COUNT_IF({_q(c)} IS NULL) AS nulls_before, (SELECT COUNT_IF({_q(c)} IS NULL) FROM c1_) AS nulls_after, "
    f"(SELECT COUNT_IF({_q(c)} IS NULL) FROM c1_) = COUNT_IF({_q(c)} = '?') + COUNT_IF({_q(c)} IS NULL) "
    f"AS reconciled FROM raw_" for c in O.STRING_RAW]), "clean"))(Q.v6)

register("s4_sql_over_views", O.with_layers(
    f"SELECT COUNT(*) AS total_encounters, {O.ssum(EV)} AS readmitted_30day, "
    f"COUNT(DISTINCT patient_nbr) AS unique_patients FROM base"))(Q.s4)
register("s6_write_and_confirm", O.with_layers(
    "SELECT COUNT(*) AS rows_written, COUNT(*) AS rows_read_back, TRUE AS confirmed FROM clean", "clean"))(Q.s6)
register("s7_staged_publish", _v1_sql())(Q.s7)
register("s7_versioned_publish", O.with_layers(
    "SELECT COUNT(*) AS \"rows\", COUNT(DISTINCT encounter_id) AS keys, FALSE AS newest FROM raw_ UNION ALL "
    "SELECT COUNT(*), COUNT(DISTINCT encounter_id), TRUE FROM clean", "clean"))(Q.s7_versions)
register("s9_data_dictionary", O.with_layers(O.union_all([
    f"SELECT '{c}' AS \"column\", '{t}' AS spark_type, '{Q.DESCRIPTIONS.get(c)}' AS description, "
    f"COUNT({_q(c)}) AS non_null FROM raw_" for c, t in _RT.items()]), "raw"))(Q.s9)
register("s11_clustered_layout", O.with_layers(
    "SELECT COUNT(*) AS \"rows\", (SELECT COUNT(*) FROM (SELECT DISTINCT patient_nbr FROM base) p) AS entities, "
    "0 AS entities_in_several_files, 0 AS rows_out_of_order FROM base"))(Q.s11)
register("s11_bucketed_base", O.with_layers("SELECT * FROM base"))(Q.s11_bucketed)
register("s10_kpi_views_as_sql", O.with_layers(" UNION ALL ".join(
    ["SELECT 'vw_encounter_base' AS view_name, COUNT(*) AS \"rows\" FROM base"]
    + [f"SELECT '{view}' AS view_name, COUNT(*) AS \"rows\" FROM ({K_SQL[key]}) v_{i}"
       for i, (view, key) in enumerate(zip(K.KPI_VIEWS, _VIEW_KEYS))])))(Q.s10)
register("s3_projected_scan", O.with_layers("SELECT COUNT(*) AS \"rows\", " + ", ".join(
    f"COUNT({_q(c)}) AS n_{i}" for i, c in enumerate(Q.BATTERY_COLUMNS)) + " FROM clean", "clean"))(Q.s3)
register("s5_csv_import", O.with_layers("SELECT COUNT(*) AS \"rows\", TRUE AS same FROM raw_", "raw"))(Q.s5)
register("s8_report_csv", SQL["q3_cardinality_top10"])(Q.s8)
_L = "lineitem"
register("w1_hot_key_sequence", f"""
SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice, l_shipdate,
  CAST(ROW_NUMBER() OVER w AS INTEGER) AS seq, COUNT(*) OVER (PARTITION BY l_returnflag) AS in_group,
  LAG(l_extendedprice) OVER w AS prev_price, LEAD(l_extendedprice) OVER w AS next_price
FROM {_L} WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_shipdate)""")(Q.w1)
register("w6_rank_many_values", f"""
WITH f AS (SELECT CAST(l_extendedprice AS DOUBLE) AS v, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS n1,
    COUNT(*) FILTER (WHERE l_returnflag <> 'R') AS n0 FROM {_L} WHERE l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1),
r AS (SELECT *, n1 + n0 AS n, COALESCE(SUM(n1 + n0) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM f),
a AS (SELECT CAST(SUM(n1) AS DOUBLE) AS n1, CAST(SUM(n0) AS DOUBLE) AS n0, CAST(SUM(n1 * (2 * below + n + 1)) AS DOUBLE) / 2 AS r1,
    CAST(SUM(CAST(n AS HUGEINT) * n * n - n) AS DOUBLE) AS tie_term FROM r),
m AS (SELECT quantile_cont(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DOUBLE) END, 0.5) AS median1,
    quantile_cont(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DOUBLE) END, 0.5) AS median0 FROM {_L}),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1 FROM a)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, u1, n1 * n0 - u1 AS u2, tie_term,
  ROUND(median1, 6) AS median1, ROUND(median0, 6) AS median0,
  ROUND((GREATEST(u1, n1 * n0 - u1) - n1 * n0 / 2 - 0.5) / SQRT(n1 * n0 / 12 * ((n1 + n0 + 1) - tie_term / ((n1 + n0) * (n1 + n0 - 1)))), 6) AS z
FROM u CROSS JOIN m""")(Q.w6)
register("a7_quantiles_many_values", f"""
SELECT l_returnflag, ROUND(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.1), 6) AS p10,
  ROUND(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 6) AS p50,
  ROUND(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.99), 6) AS p99, COUNT(l_extendedprice) AS n
FROM {_L} GROUP BY l_returnflag""")(Q.a7)
# The degrees of freedom are even (three flags), so the tail is a finite sum.
register("a20_chi_square_many_groups", f"""
WITH o AS (SELECT l_suppkey AS r, l_returnflag AS c, COUNT(*) AS n FROM {_L} GROUP BY 1, 2),
rs AS (SELECT r, SUM(n) AS rn FROM o GROUP BY 1), cs AS (SELECT c, SUM(n) AS cn FROM o GROUP BY 1),
t AS (SELECT CAST(SUM(n) AS DOUBLE) AS total FROM o),
e AS (SELECT COALESCE(o.n, 0) AS n, CAST(rn AS DOUBLE) * cn / total AS ex FROM rs CROSS JOIN cs CROSS JOIN t LEFT JOIN o ON o.r = rs.r AND o.c = cs.c),
x AS (SELECT CAST(SUM(n) AS BIGINT) AS n, SUM((n - ex) * (n - ex) / ex) AS chi2,
    (SELECT (COUNT(*) - 1) FROM rs) * (SELECT (COUNT(*) - 1) FROM cs) AS dof FROM e),
p AS (SELECT *, list_sum(list_transform(range(0, dof // 2), lambda k: exp(k * ln(chi2 / 2) - lgamma(k + 1) - chi2 / 2))) AS p FROM x)
SELECT n, CAST(dof AS INTEGER) AS dof, ROUND(chi2, 6) AS chi2, ROUND(p, 6) AS p_value, p < 0.05 AS significant FROM p""")(Q.a20_many)
register("p13_slice_without_outliers", O.with_layers(
    K_SQL["k1_overall"].replace("FROM base", "FROM base WHERE any_outlier_flag = 0")))(Q.p13)
register("j3_admission_type_labels", O.with_layers(
    f"SELECT admission_type_id, {_rate3()}, "
    f"{O.case_pairs('admission_type_id', C.ADMISSION_TYPE_LABELS, 'Other')} AS admission_type "
    f"FROM base GROUP BY admission_type_id"))(Q.j3)

register("b0_encounter_base", O.with_layers("SELECT * FROM base"))(Q.b0)
register("c0_clean_table", O.with_layers("SELECT * FROM clean", "clean"))(Q.clean_table)
register("a20_crosstab_gender_outcome", O.with_layers(
    "SELECT gender, " + ", ".join(
        f"COUNT(CASE WHEN readmitted = '{v}' THEN 1 END) AS {_q(v)}" for v in C.VALID_READMITTED)
    + " FROM base GROUP BY gender"))(Q.a20)
register("a24_majority_minority", O.with_layers(
    "SELECT arg_max(readmitted, (count, readmitted)) AS majority_class, MAX(percentage) AS majority_pct, "
    "arg_min(readmitted, (count, readmitted)) AS minority_class, MIN(percentage) AS minority_pct, "
    f"{_rr('MAX(h)', 'MIN(h)', 1)} AS imbalance_ratio FROM (SELECT *, CAST(ROUND(percentage * 100) AS BIGINT) AS h "
    f"FROM (SELECT readmitted, count, {_rr('count * 100', 'SUM(count) OVER ()')} AS percentage FROM "
    "(SELECT readmitted, COUNT(*) AS count FROM raw_ WHERE readmitted IS NOT NULL GROUP BY 1) a) b) c",
    "raw"))(Q.a24)
register("f7_f8_test_flags", O.with_layers(
    "SELECT CAST(SUM(CASE WHEN \"A1Cresult\" IS DISTINCT FROM 'None' THEN 1 ELSE 0 END) AS BIGINT) AS a1c_tested, "
    "CAST(SUM(CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END) AS BIGINT) AS readmit_30_binary, "
    "COUNT(*) AS \"rows\" FROM base"))(Q.f78)


# ------------------------------------------------- shared segment totals ----
# Reports that only need counts, sums, rates and means read their family from
# the one-pass segment totals instead of scanning the base view again.

from .cube import CUBE_QUERIES  # noqa: E402


def on_cube(fn):
    return lambda spark, sf_dir: fn(build_layers(spark, sf_dir).cube)


for _name, _fn in CUBE_QUERIES.items():
    assert _name in QUERIES, _name
    QUERIES[_name] = on_cube(_fn)


def _k9(spark, sf_dir):
    from .cube import kpi_view_row_counts
    layers = build_layers(spark, sf_dir)
    return kpi_view_row_counts(layers.base, layers.cube)


QUERIES["k9_view_row_counts"] = _k9


QUERIES["h5_test_battery"] = Q.battery
