"""Profiling, cleaning-report, audit, distribution and sink queries over the
three layers (raw, clean, base) of one dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..operators import audit as V
from ..operators import clean as CL
from ..operators import distributions as G
from ..operators import profile as P
from ..operators.encounters import base_totals
from ..operators.features import feature_summary
from ..session import checkpoint_dir
from ..sources import sinks as S
from .kpi import KPI_VIEW_ORDER, kpi_overall, register_kpi_views
from .oracle import CLEAN_COLS
from .pipeline import MISSING_POLICY, bucketed_base, build_layers

S_ = C.ENCOUNTERS
FEATURES = ("num_active_medications", "any_medication_change", "age_midpoint",
            "total_prior_visits", "polypharmacy_flag")
EXPECTED_FEATURES = FEATURES + ("weight_available",)
VOCAB_COLS = ("gender", "readmitted", "change", "diabetesMed")
CORR_COLS = C.NUMERIC_COLS + C.CORRELATION_EXTRA_COLS
FEATURE_RANGES = {"num_active_medications": (0, len(C.MEDICATION_COLS)), "age_midpoint": (0, 100),
                  "total_prior_visits": (0, 10_000)}
V4_VOCAB = {"gender": C.VALID_GENDER, "readmitted": C.VALID_READMITTED,
            "change": C.VALID_CHANGE, "diabetesMed": C.VALID_DIABETES_MED}

# Columns that the test battery reads (S3).
BATTERY_COLUMNS = ["encounter_id", "patient_nbr", "gender", "age", "time_in_hospital", "number_inpatient",
                   "total_prior_visits", "num_medications", "num_active_medications", "polypharmacy_flag",
                   "A1Cresult", "change", "readmitted", "expired_or_hospice_flag", "gender_invalid_flag"]

# Short column descriptions for the data dictionary (our own wording).
DESCRIPTIONS = {
    "encounter_id": "Unique identifier of the encounter",
    "patient_nbr": "Identifier of the patient; repeats across encounters",
    "race": "Recorded race",
    "gender": "Recorded gender",
    "age": "Age band [lo-hi)",
    "weight": "Weight band; mostly not recorded",
    "admission_type_id": "Admission type code",
    "discharge_disposition_id": "Discharge disposition code",
    "admission_source_id": "Admission source code",
    "time_in_hospital": "Length of stay in days",
    "payer_code": "Payer code",
    "medical_specialty": "Specialty of the admitting physician",
    "num_lab_procedures": "Lab procedures during the encounter",
    "num_procedures": "Non-lab procedures during the encounter",
    "num_medications": "Distinct medications administered",
    "number_outpatient": "Outpatient visits in the prior year",
    "number_emergency": "Emergency visits in the prior year",
    "number_inpatient": "Inpatient visits in the prior year",
    "diag_1": "Primary diagnosis code (ICD-9)",
    "diag_2": "Secondary diagnosis code (ICD-9)",
    "diag_3": "Additional diagnosis code (ICD-9)",
    "number_diagnoses": "Diagnoses entered",
    "max_glu_serum": "Glucose serum test result, or None if not taken",
    "A1Cresult": "A1c test result, or None if not taken",
    "change": "Whether diabetic medication was changed (Ch/No)",
    "diabetesMed": "Whether any diabetic medication was prescribed (Yes/No)",
    "readmitted": "Readmission outcome: <30, >30 or NO",
}
DESCRIPTIONS.update({m: "Dose status of this medication (No/Steady/Up/Down)" for m in C.MEDICATION_COLS})


def layers(spark: SparkSession, sf_dir: str):
    return build_layers(spark, sf_dir)


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored de-duplicated rows with the key-conflict flag."""
    return CL.flag_key_conflicts(layers(spark, sf_dir).deduplicated, S_.primary_key)


# ------------------------------------------------------------- profile ----

def q1(spark, d):
    return P.profile_structure(layers(spark, d).raw)


def q2(spark, d):
    return P.sentinel_counts(layers(spark, d).raw, S_.sentinel)


def q3(spark, d):
    return P.profile_cardinality(layers(spark, d).raw, S_.categorical_cols, top_n=10)


def q4(spark, d):
    return P.profile_numerics(layers(spark, d).raw, S_.numeric_cols)


def q5(spark, d):
    return P.class_balance(layers(spark, d).raw, S_.target)


def q6(spark, d):
    return P.column_drilldown(layers(spark, d).raw, "weight", S_.sentinel, top_n=5)


# ------------------------------------------------------------- cleaning ---

def c1(spark, d):
    rep = P.sentinel_counts(layers(spark, d).raw, S_.sentinel)
    return rep.agg(F.count(F.lit(1)).alias("columns_with_sentinel"),
                   F.sum("sentinel_count").cast("long").alias("values_replaced"))


def c2(spark, d):
    return CL.duplicate_summary(layers(spark, d).raw, S_.primary_key, layers(spark, d).deduplicated)


def a22(spark, d):
    return CL.entity_frequency(layers(spark, d).deduplicated, S_.entity_key)


def c3(spark, d):
    return CL.null_report(layers(spark, d).clean).filter(F.col("null_count") > 0)


def c4(spark, d):
    pre = CL.treat_missing(deduped(spark, d), **MISSING_POLICY)
    return CL.coercion_report(pre, S_.numeric_cols)


def c5(spark, d):
    return CL.vocabulary(layers(spark, d).clean, VOCAB_COLS)


def c67(spark, d):
    return layers(spark, d).clean.agg(
        F.sum("gender_invalid_flag").cast("long").alias("gender_invalid"),
        F.sum("expired_or_hospice_flag").cast("long").alias("expired_or_hospice"),
        F.count(F.lit(1)).alias("rows"))


def c8(spark, d):
    return CL.validate_vocabulary(layers(spark, d).clean, S_.medication_cols_clean, S_.valid_med_values)


def c9(spark, d):
    return layers(spark, d).outliers


def c9_any(spark, d):
    from ..functions import expr as X
    return layers(spark, d).clean.agg(F.sum("any_outlier_flag").cast("long").alias("rows_with_outlier"),
                                      F.count(F.lit(1)).alias("rows")) \
        .withColumn("outlier_row_pct", X.rate_pct("rows_with_outlier", "rows"))


def f6(spark, d):
    return feature_summary(layers(spark, d).clean, FEATURES)


# ------------------------------------------------------- distributions ----

def a21(spark, d):
    return G.correlation_matrix(layers(spark, d).clean, CORR_COLS)


def g1(spark, d):
    return G.box_stats(layers(spark, d).clean, S_.numeric_cols, by=S_.target)


def g4(spark, d):
    return G.histogram(layers(spark, d).clean, "num_active_medications", by=S_.target)


def g5(spark, d):
    return G.rate_by_value_vs_baseline(layers(spark, d).base, "num_active_medications",
                                       "led_to_30day_readmission")


# --------------------------------------------------------------- audit ----

def v1(spark, d):
    return V.pre_export_audit(layers(spark, d).clean, S_.primary_key, S_.target, S_.valid_target,
                              EXPECTED_FEATURES, S_.sentinel, len(CLEAN_COLS))


def excluded_in_source(rows: DataFrame) -> DataFrame:
    """Rows that the exclusion rules hit, judged on the source's own values."""
    code = F.col("discharge_disposition_id").cast("string").try_cast("double")
    gender = F.lower(F.btrim("gender"))
    hit = (F.coalesce(code.isin([float(x) for x in S_.expired_dispositions]), F.lit(False))
           | F.coalesce(~gender.isin([g.lower() for g in S_.valid_gender]), F.lit(False)))
    return rows.agg(F.count_if(hit).alias("excluded"))


def v2(spark, d):
    source = layers(spark, d).deduplicated
    src = source.agg(F.count(F.lit(1)).alias("source_rows"))
    return V.post_load_validation(layers(spark, d).clean, src, S_.primary_key, S_.target,
                                  S_.valid_target, ("expired_or_hospice_flag", "gender_invalid_flag"),
                                  FEATURE_RANGES, excluded_in_source(source))


def v4(spark, d):
    return V.vocabulary_check(layers(spark, d).clean, V4_VOCAB)


def v5(spark, d):
    from .cube import kpi_view_row_counts
    return V.views_non_empty(kpi_view_row_counts(layers(spark, d).base, layers(spark, d).cube))


def v6(spark, d):
    raw = layers(spark, d).raw
    return V.null_reconciliation(raw, CL.replace_sentinel(raw, S_.sentinel), S_.sentinel)


# --------------------------------------------------------------- sinks ----

def _scratch(spark: SparkSession, name: str) -> str:
    import uuid
    folder = checkpoint_dir(spark)
    if folder is None:
        raise RuntimeError("no spark.checkpoint.dir configured for written tables")
    return f"{folder.rstrip('/')}/cohortlens/{name}-{uuid.uuid4().hex}"


def s6(spark, d):
    clean = layers(spark, d).clean
    return S.write_table(clean, _scratch(spark, "published-clean"))


def s7(spark, d):
    clean = layers(spark, d).clean
    target = _scratch(spark, "clean-table")

    def audit(staged):
        return V.pre_export_audit(staged, S_.primary_key, S_.target, S_.valid_target,
                                  EXPECTED_FEATURES, S_.sentinel, len(CLEAN_COLS))
    S.staged_publish(clean, target, audit)
    return audit(spark.read.parquet(target))


def s7_versions(spark, d):
    """The raw table, then the clean one, published under one path; a row per version that
    readers can still open, and whether it is the one that they get."""
    target = _scratch(spark, "clean-versions")
    S.publish_version(layers(spark, d).raw, target)
    before = S.read_published(spark, target)          # a reader from before the second publish
    S.publish_version(layers(spark, d).clean, target, lambda staged: V.pre_export_audit(
        staged, S_.primary_key, S_.target, S_.valid_target, EXPECTED_FEATURES, S_.sentinel, len(CLEAN_COLS)))
    rows = F.count(F.lit(1)).alias("rows")
    keys = F.count_distinct(S_.primary_key).alias("keys")
    return (before.agg(rows, keys).withColumn("newest", F.lit(False))
            .unionByName(S.read_published(spark, target).agg(rows, keys).withColumn("newest", F.lit(True))))


def s9(spark, d):
    return S.data_dictionary(layers(spark, d).raw, DESCRIPTIONS)


def s11(spark, d):
    """The written layout, checked: every entity lies in one file, every file is sorted by
    (entity, key), nothing is lost."""
    path = _scratch(spark, "base-layout")
    S.write_layout(layers(spark, d).base, path, S_.entity_key, [S_.primary_key])
    rows = spark.read.parquet(path)
    placed = rows.select(S_.entity_key, F.col("_metadata.file_name").alias("_file"))
    per_entity = placed.groupBy(S_.entity_key).agg(F.count_distinct("_file").alias("files"), F.count(F.lit(1)).alias("n"))
    place = F.struct(S_.entity_key, S_.primary_key)
    at = Window.partitionBy("_file").orderBy("_row")
    ordered = (rows.select(place.alias("_place"), F.col("_metadata.row_index").alias("_row"), F.col("_metadata.file_name").alias("_file"))
               .withColumn("_before", F.lag("_place").over(at)))
    unsorted = ordered.agg(F.count_if(F.col("_before") > F.col("_place"))).scalar()
    return per_entity.agg(F.sum("n").cast("long").alias("rows"), F.count(F.lit(1)).alias("entities"),
                          F.count_if(F.col("files") > 1).alias("entities_in_several_files")) \
        .withColumn("rows_out_of_order", unsorted)


def s11_bucketed(spark, d):
    """The base view over a table bucketed by patient: no shuffle for the windows."""
    path = _scratch(spark, "base-buckets")
    return bucketed_base(layers(spark, d).clean, "encounters_" + path.rsplit("-", 1)[-1], path)


def s4(spark, d):
    """SQL text over registered views."""
    base = layers(spark, d).base
    S.register_view(base, "vw_encounter_base")
    return spark.sql(
        "SELECT COUNT(*) AS total_encounters, "
        "CAST(SUM(led_to_30day_readmission) AS BIGINT) AS readmitted_30day, "
        "COUNT(DISTINCT patient_nbr) AS unique_patients FROM vw_encounter_base")


def s10(spark, d):
    """The base and KPI views dropped and registered again in order, then read as SQL text."""
    base = layers(spark, d).base
    for name in reversed(["vw_encounter_base", *KPI_VIEW_ORDER]):
        S.drop_view(spark, name)
    register_kpi_views(base)
    parts = [f"SELECT '{n}' AS view_name, COUNT(*) AS rows FROM {n}" for n in ("vw_encounter_base", *KPI_VIEW_ORDER)]
    return spark.sql(" UNION ALL ".join(parts))


def s3(spark, d):
    """S3: a narrow scan of the stored clean table (the columns of the test battery)."""
    from ..sources.readers import project
    return project(layers(spark, d).clean, BATTERY_COLUMNS).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(BATTERY_COLUMNS)])


def s5(spark, d):
    """The raw table as CSV with a header, imported again with its schema; all rows compared."""
    from ..sources.readers import read_raw
    raw = layers(spark, d).raw
    path = _scratch(spark, "raw-csv")
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False) \
        .option("emptyValue", "\u0001").csv(path)
    back = read_raw(spark, path, raw.schema, "csv", emptyValue="\u0001")
    h = F.sum(F.xxhash64(*raw.columns).cast("decimal(38,0)"))
    return back.agg(F.count(F.lit(1)).alias("rows"), h.alias("h")).select(
        "rows", (F.col("h") == raw.agg(h).scalar()).alias("same"))


def s8(spark, d):
    """A report written as one CSV file with a header and read again."""
    path = _scratch(spark, "report-csv")
    S.write_report_csv(q3(spark, d), path)
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).schema("column string, value string, count long, pct double").csv(path)


def p13(spark, d):
    """Population slice (outlier toggle) on the already-sequenced view."""
    return kpi_overall(layers(spark, d).base.filter(F.col("any_outlier_flag") == 0), sliced=True)


def j3(spark, d):
    """Code -> label through a broadcast dimension join (J1-J3 as joins).

    The dimension is the fixed code list (six rows, a proven bound)."""
    from ..operators.segments import Count, Rate, Sum, segment_rates
    base = layers(spark, d).base
    dim = spark.createDataFrame(list(C.ADMISSION_TYPE_LABELS), "admission_type_id string, admission_type string")
    seg = segment_rates(base, ["admission_type_id"], [Count("encounters"), Sum("readmitted_30day",
                        "led_to_30day_readmission"), Rate("readmission_rate_pct", "led_to_30day_readmission")])
    return (seg.join(F.broadcast(dim), "admission_type_id", "left")
            .withColumn("admission_type", F.coalesce("admission_type", F.lit("Other"))))


# ------------------------------------------------------- whole layers ----

def b0(spark, d):
    """The sequenced base view itself."""
    return layers(spark, d).base


def clean_table(spark, d):
    """The clean (silver) table: every cleaning rule and feature at once."""
    return layers(spark, d).clean


def a20(spark, d):
    """Wide contingency table gender x outcome (fixed outcome values)."""
    from ..operators.stats import crosstab_wide
    return crosstab_wide(layers(spark, d).base, "gender", "readmitted", C.VALID_READMITTED)


def a24(spark, d):
    """Majority and minority class with their shares and ratio."""
    bal = P.class_balance(layers(spark, d).raw, S_.target)
    by = F.struct("count", S_.target)   # ties on the count go by name
    return bal.agg(F.max_by(S_.target, by).alias("majority_class"),
                   F.max("percentage").alias("majority_pct"),
                   F.min_by(S_.target, by).alias("minority_class"),
                   F.min("percentage").alias("minority_pct"),
                   F.first("imbalance_ratio").alias("imbalance_ratio"))


def f78(spark, d):
    """A1C-tested and 30-day binary flags, counted."""
    from ..operators.features import add_test_flags
    flagged = add_test_flags(layers(spark, d).base)
    return flagged.agg(F.sum("a1c_tested").cast("long").alias("a1c_tested"),
                       F.sum("readmit_30_binary").cast("long").alias("readmit_30_binary"),
                       F.count(F.lit(1)).alias("rows"))


# ------------------------------------------- skewed keys, many values ----

def _lineitem(spark, d):
    from ..sources.readers import read_table
    return read_table(spark, d, "lineitem")


def w1(spark, d):
    """W1-W3 on a key with three values: line items in order within their return flag, with
    the hot path forced (a key may have 5,000 rows before it is sliced)."""
    from ..operators.sequence import sequence
    df = _lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_shipdate")
    return sequence(df, "l_returnflag", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"], seq="seq", count="in_group",
                    prev={"prev_price": "l_extendedprice"}, nxt={"next_price": "l_extendedprice"}, hot_rows=5_000)


def _returned_prices(spark, d):
    from ..operators.stats import rank_frequencies
    return rank_frequencies(_lineitem(spark, d), "l_extendedprice", F.col("l_returnflag") == "R")


def w6(spark, d):
    """W6/H2 on a continuous column: ranks over sliced prefix sums."""
    from ..operators.stats import mann_whitney_from_freq
    out = mann_whitney_from_freq(_returned_prices(spark, d), rows_per_slice=2_000)
    return out.select("n1", "n0", "u1", "u2", F.col("tie_term").cast("double").alias("tie_term"),
                      F.round("median1", 6).alias("median1"), F.round("median0", 6).alias("median0"), F.round("z", 6).alias("z"))


def a7(spark, d):
    """Exact quantiles of a continuous column per group, from sliced prefix sums."""
    from ..operators.quantiles import exact_quantiles
    freq = _lineitem(spark, d).groupBy("l_returnflag", F.col("l_extendedprice").cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    q = exact_quantiles(freq, ["l_returnflag"], "v", "n", [0.1, 0.5, 0.99])
    return q.select("l_returnflag", *[F.round(F.col("_q")[i], 6).alias(n) for i, n in enumerate(("p10", "p50", "p99"))], "n")


def a20_many(spark, d):
    """H1/A20 with one group per supplier: more degrees of freedom than any fixed table has."""
    from ..operators.stats import chi_square_test
    out = chi_square_test(_lineitem(spark, d), "l_suppkey", "l_returnflag", correction=False)
    return out.select("n", "dof", F.round("chi2", 6).alias("chi2"), F.round("p_value", 6).alias("p_value"), "significant")


def battery(spark, d):
    """H3-H8 with p-values, effect sizes and adjusted values to six places, as reported."""
    from .battery import battery as run
    out = run(layers(spark, d).base)
    return out.withColumns({c: F.round(c, 6) for c in ("p_value", "effect_size", "p_bonferroni", "p_bh")})
