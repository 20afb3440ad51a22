"""Independent ANSI-SQL (DuckDB dialect) expression of the same pipeline.

Used as the correctness oracle: the driver runs these statements on the same
parquet tables and compares them with the Spark results.  Only the fixture
expressions of the encounter adapter are shared; cleaning, features,
sequencing and every query are written here a second time, in SQL.
"""

from __future__ import annotations

from .. import config as C
from ..operators.encounters import BASE_CARRIED
from ..sources.adapter import DUPLICATE_EVERY, PATIENT_EXPR, raw_row_exprs

STRING_RAW = [n for n, _ in raw_row_exprs()
              if n not in ("encounter_id", "patient_nbr") and n not in C.NUMERIC_COLS]
RAW_COLS = [n for n, _ in raw_row_exprs()]


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def round_ratio(num: str, den: str, digits: int = 2) -> str:
    """Exact ROUND(num/den, digits), half away from zero, as DOUBLE."""
    s = 10 ** digits
    return (f"(CASE WHEN ({den}) > 0 THEN CAST(SIGN({num}) * ((2 * {s} * ABS({num}) + ({den})) "
            f"// (2 * ({den}))) AS DOUBLE) / {s} END)")


def rate(flag: str, digits: int = 2) -> str:
    return round_ratio(f"CAST(SUM({flag}) AS BIGINT) * 100", "COUNT(*)", digits)


def mean(col: str, digits: int = 2, scale: int = 1) -> str:
    v = f"CAST({col} * {scale} AS BIGINT)" if scale != 1 else col
    return round_ratio(f"CAST(SUM({v}) AS BIGINT)", f"COUNT({col}) * {scale}", digits)


def ssum(col: str) -> str:
    return f"CAST(SUM({col}) AS BIGINT)"


def title(x: str) -> str:
    return (f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: "
            f"CASE WHEN i = 1 OR NOT regexp_matches(substr({x}, i - 1, 1), '[A-Za-z]') "
            f"THEN upper(substr({x}, i, 1)) ELSE lower(substr({x}, i, 1)) END), '')")


def case_pairs(x: str, pairs, other: str) -> str:
    whens = " ".join(f"WHEN {x} = '{a}' THEN '{b}'" for a, b in pairs)
    return f"CASE {whens} ELSE '{other}' END"


def icd_case(x: str = "diag_1") -> str:
    parts = [f"WHEN regexp_matches({x}, '{p}') THEN '{lab}'" for p, lab in C.ICD_PREFIX_RULES]
    parts += [f"WHEN {x} = '{v}' THEN '{lab}'" for v, lab in C.ICD_EXACT_RULES]
    parts += [f"WHEN regexp_matches({x}, '^\\d+\\.?\\d*$') AND TRY_CAST({x} AS DECIMAL(20,6)) "
              f"BETWEEN {lo} AND {hi} THEN '{lab}'" for lo, hi, lab in C.ICD_RANGE_RULES]
    return "CASE " + " ".join(parts) + f" ELSE '{C.ICD_OTHER}' END"


def risk_case() -> str:
    parts = []
    for label, mins in C.RISK_TIERS:
        cond = " AND ".join(f"{k} >= {v}" for k, v in mins.items())
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + f" ELSE '{C.RISK_TIER_REST}' END"


def status_case(x: str = "readmitted") -> str:
    return case_pairs(x, C.READMISSION_STATUS_LABELS, C.READMISSION_STATUS_REST)


def exact_band_case(x: str, pairs, rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {v} THEN '{lab}'" for v, lab in pairs) + f" ELSE '{rest}' END"


def upper_band_case(x: str, pairs, rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {v} THEN '{lab}'" for v, lab in pairs) + f" ELSE '{rest}' END"


# ---------------------------------------------------------------------------
# Layers as CTEs
# ---------------------------------------------------------------------------

def raw_ctes() -> list[str]:
    rows = ",\n  ".join(f"{e} AS {q(n)}" for n, e in raw_row_exprs())
    patient = PATIENT_EXPR
    return [
        "o0_ AS (SELECT o_orderkey AS k, o_custkey AS p, o_orderdate, o_orderstatus, o_orderpriority "
        "FROM orders)",
        f"o1_ AS (SELECT *, {patient} AS patient FROM o0_)",
        "o2_ AS (SELECT *, LEAD(o_orderdate) OVER (PARTITION BY patient ORDER BY o_orderdate, k) "
        "AS next_date FROM o1_)",
        "li_ AS (SELECT l_orderkey, COUNT(*) AS n_lines, SUM(l_quantity) AS qty, "
        "SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_r, "
        "SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS n_a, "
        "SUM(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS n_n, "
        "COUNT(DISTINCT l_suppkey) AS n_supp, SUM(l_partkey % 23) AS lab, "
        "SUM(CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END) AS procs FROM lineitem GROUP BY l_orderkey)",
        "cu_ AS (SELECT c_custkey, c_mktsegment AS seg, r_name AS region FROM customer "
        "LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)",
        "src_ AS (SELECT * FROM o2_ LEFT JOIN li_ ON l_orderkey = k LEFT JOIN cu_ ON c_custkey = p)",
        f"raw1_ AS (SELECT {rows} FROM src_)",
        f"raw_ AS MATERIALIZED (SELECT * FROM raw1_ UNION ALL SELECT * FROM raw1_ "
        f"WHERE encounter_id % {DUPLICATE_EVERY} = 0)",
    ]


def clean_ctes() -> list[str]:
    """Sentinels, duplicates, missing policy, codes, text, flags, outliers, features."""
    strings = set(STRING_RAW)
    c1 = ", ".join(f"NULLIF({q(c)}, '?') AS {q(c)}" if c in strings else q(c) for c in RAW_COLS)
    fills = {**{c: C.UNKNOWN for c in C.FILL_UNKNOWN_COLS}, **{c: "None" for c in C.FILL_NONE_COLS}}
    c3 = ", ".join(f"COALESCE({q(c)}, '{fills[c]}') AS {q(c)}" if c in fills else q(c)
                   for c in RAW_COLS + ["duplicate_flag"])
    c3 += (", CASE WHEN weight IS NOT NULL THEN 1 ELSE 0 END AS weight_available"
           ", CASE WHEN diag_1 IS NULL THEN 1 ELSE 0 END AS diag_1_missing_flag")
    after3 = RAW_COLS + ["duplicate_flag", "weight_available", "diag_1_missing_flag"]
    c4 = ", ".join(f"split_part(CAST({q(c)} AS VARCHAR), '.', 1) AS {q(c)}" if c in C.ID_COLS
                   else f"TRY_CAST(CAST({q(c)} AS VARCHAR) AS INTEGER) AS {q(c)}" if c in C.NUMERIC_COLS
                   else q(c) for c in after3)
    c5a = ", ".join(f"regexp_replace({q(c)}, '^\\s+|\\s+$', '', 'g') AS {q(c)}" if c in strings else q(c)
                    for c in after3)
    renamed = [C.snake(c) for c in after3]

    def t(c):
        out = title(q(c))
        if c == "readmitted":
            out = f"upper({out})"
        return f"{out} AS {q(C.snake(c))}"
    c5b = ", ".join(t(c) if c in strings else q(c) for c in after3)
    codes = ", ".join(f"{float(x)}" for x in C.EXPIRED_DISPOSITIONS)
    valid_g = ", ".join(f"'{g}'" for g in C.VALID_GENDER)
    c67 = (f"*, CASE WHEN gender IS NOT NULL AND gender NOT IN ({valid_g}) THEN 1 ELSE 0 END "
           f"AS gender_invalid_flag, CASE WHEN TRY_CAST(discharge_disposition_id AS DOUBLE) IN ({codes}) "
           f"THEN 1 ELSE 0 END AS expired_or_hospice_flag")
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS {c}__q1, quantile_cont({c}, 0.75) AS {c}__q3"
                   for c in C.NUMERIC_COLS)
    fences = ", ".join(f"{c}__q1 - 1.5 * ({c}__q3 - {c}__q1) AS {c}__lo, "
                       f"{c}__q3 + 1.5 * ({c}__q3 - {c}__q1) AS {c}__hi" for c in C.NUMERIC_COLS)
    flags = ", ".join(f"CASE WHEN {c} < {c}__lo OR {c} > {c}__hi THEN 1 ELSE 0 END AS {c}_outlier_flag"
                      for c in C.NUMERIC_COLS)
    any_flag = " + ".join(f"{c}_outlier_flag" for c in C.NUMERIC_COLS)
    keep = renamed + ["gender_invalid_flag", "expired_or_hospice_flag"]
    meds = [C.snake(c) for c in C.MEDICATION_COLS]
    active = " + ".join(f"CASE WHEN {q(m)} IS DISTINCT FROM 'No' THEN 1 ELSE 0 END" for m in meds)
    change = " OR ".join(f"{q(m)} IN ('Up', 'Down')" for m in meds)
    pat = "'\\[(\\d+)-(\\d+)\\)'"
    age_mid = (f"CASE WHEN regexp_matches(age, {pat}) THEN (CAST(regexp_extract(age, {pat}, 1) AS DOUBLE) "
               f"+ CAST(regexp_extract(age, {pat}, 2) AS DOUBLE)) / 2.0 END")
    return [
        f"c1_ AS (SELECT {c1} FROM raw_)",
        "c2_ AS (SELECT DISTINCT * FROM c1_)",
        "c2f_ AS (SELECT *, CASE WHEN COUNT(*) OVER (PARTITION BY encounter_id) > 1 THEN 1 ELSE 0 END "
        "AS duplicate_flag FROM c2_)",
        f"c3_ AS (SELECT {c3} FROM c2f_)",
        f"c4_ AS (SELECT {c4} FROM c3_)",
        f"c5a_ AS (SELECT {c5a} FROM c4_)",
        f"c5_ AS (SELECT {c5b} FROM c5a_)",
        f"c67_ AS (SELECT {c67} FROM c5_)",
        f"qs_ AS (SELECT {qs} FROM c67_)",
        f"fence_ AS (SELECT {fences} FROM qs_)",
        f"c9a_ AS (SELECT {', '.join(q(c) for c in keep)}, {flags} FROM c67_ CROSS JOIN fence_)",
        f"c9_ AS (SELECT *, CASE WHEN {any_flag} > 0 THEN 1 ELSE 0 END AS any_outlier_flag FROM c9a_)",
        f"clean AS MATERIALIZED (SELECT *, {active} AS num_active_medications, "
        f"CASE WHEN {change} THEN 1 ELSE 0 END AS any_medication_change, "
        f"{age_mid} AS age_midpoint, "
        f"number_outpatient + number_emergency + number_inpatient AS total_prior_visits, "
        f"CASE WHEN num_medications >= {C.POLYPHARMACY_THRESHOLD} THEN 1 ELSE 0 END AS polypharmacy_flag "
        f"FROM c9_)",
    ]


def base_ctes() -> list[str]:
    carried = ", ".join(q(c) for c in BASE_CARRIED)
    return [
        f"valid_ AS (SELECT {carried} FROM clean WHERE expired_or_hospice_flag = 0 "
        f"AND gender_invalid_flag = 0)",
        "seq_ AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY patient_nbr ORDER BY encounter_id) AS INTEGER) "
        "AS encounter_seq, COUNT(*) OVER (PARTITION BY patient_nbr) AS patient_total_encounters, "
        "LAG(encounter_id) OVER (PARTITION BY patient_nbr ORDER BY encounter_id) AS prior_encounter_id "
        "FROM valid_)",
        "base AS MATERIALIZED (SELECT *, CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END AS led_to_30day_readmission, "
        "CASE WHEN readmitted IN ('<30', '>30') THEN 1 ELSE 0 END AS led_to_any_readmission, "
        "CASE WHEN prior_encounter_id IS NOT NULL THEN 1 ELSE 0 END AS is_itself_a_readmission, "
        "CASE WHEN prior_encounter_id IS NULL THEN 1 ELSE 0 END AS is_first_encounter, "
        "CASE WHEN patient_total_encounters > 1 THEN 1 ELSE 0 END AS is_repeat_patient FROM seq_)",
    ]


def with_layers(body: str, layers: str = "base") -> str:
    ctes = raw_ctes()
    if layers in ("clean", "base"):
        ctes += clean_ctes()
    if layers == "base":
        ctes += base_ctes()
    return "WITH " + ",\n".join(ctes) + "\n" + body


# ---------------------------------------------------------------------------
# Statistical tests
# ---------------------------------------------------------------------------

def chi_square_sql(test: str, finding: str, grp: str, label1: str, label2: str, v1, v2,
                   event: str = "led_to_30day_readmission", crit: float = C.CHI2_CRITICAL_DOF1) -> str:
    """One chi-square test (Yates when dof = 1) as a scalar-row subquery."""
    rate = lambda v: (f"(SELECT {round_ratio('CAST(ev AS BIGINT) * 100', 'tot')} FROM rt_ "  # noqa: E731
                      f"WHERE r = '{v}')")
    return f"""SELECT * FROM (
WITH o_ AS (SELECT CAST({grp} AS VARCHAR) AS r, {event} AS c, COUNT(*) AS n FROM base GROUP BY 1, 2),
g_ AS (SELECT rr.r, cc.c, COALESCE(o_.n, 0) AS n FROM (SELECT DISTINCT r FROM o_) rr
       CROSS JOIN (SELECT DISTINCT c FROM o_) cc LEFT JOIN o_ ON o_.r = rr.r AND o_.c = cc.c),
m_ AS (SELECT *, SUM(n) OVER () AS n_all, SUM(n) OVER (PARTITION BY r) AS n_r,
       SUM(n) OVER (PARTITION BY c) AS n_c, (SELECT COUNT(DISTINCT r) FROM g_) AS k_r,
       (SELECT COUNT(DISTINCT c) FROM g_) AS k_c FROM g_),
e_ AS (SELECT *, CAST(n_r AS DOUBLE) * n_c / n_all AS ex, (k_r - 1) * (k_c - 1) AS dof FROM m_),
d_ AS (SELECT *, CASE WHEN dof = 1 THEN GREATEST(ABS(n - ex) - 0.5, 0.0) ELSE ABS(n - ex) END AS dev FROM e_),
s_ AS (SELECT CAST(MAX(n_all) AS BIGINT) AS n, CAST(MAX(dof) AS INTEGER) AS dof,
       ROUND(SUM(dev * dev / ex), 6) AS chi2 FROM d_),
rt_ AS (SELECT r, SUM(CASE WHEN c = 1 THEN n ELSE 0 END) AS ev, SUM(n) AS tot FROM g_ GROUP BY r)
SELECT '{test}' AS test, '{finding}' AS finding, n, dof, chi2, chi2 > {crit} AS significant,
       '{label1}' AS group1, {rate(v1)} AS rate1, '{label2}' AS group2, {rate(v2)} AS rate2 FROM s_) t_{test}"""


def mann_whitney_sql(test: str, finding: str, value: str, reason: str,
                     event: str = "led_to_30day_readmission",
                     zcrit: float = C.Z_CRITICAL_TWO_SIDED) -> str:
    return f"""SELECT * FROM (
WITH f_ AS (SELECT CAST({value} AS DOUBLE) AS v, SUM(CASE WHEN {event} = 1 THEN 1 ELSE 0 END) AS n1,
       SUM(CASE WHEN {event} = 1 THEN 0 ELSE 1 END) AS n0 FROM base
       WHERE {value} IS NOT NULL AND {event} IS NOT NULL GROUP BY 1),
r_ AS (SELECT *, n1 + n0 AS n, COALESCE(SUM(n1 + n0) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING
       AND 1 PRECEDING), 0) AS below FROM f_),
a_ AS (SELECT CAST(SUM(n1) AS DOUBLE) AS n1, CAST(SUM(n0) AS DOUBLE) AS n0,
       SUM(n1 * (below + (n + 1) / 2.0)) AS r1, CAST(SUM(n * n * n - n) AS DOUBLE) AS tie_term FROM r_),
md_ AS (SELECT quantile_cont(CASE WHEN {event} = 1 THEN CAST({value} AS DOUBLE) END, 0.5) AS median1,
        quantile_cont(CASE WHEN {event} = 0 THEN CAST({value} AS DOUBLE) END, 0.5) AS median0 FROM base),
u_ AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1 FROM a_),
z_ AS (SELECT *, n1 * n0 - u1 AS u2 FROM u_),
zz_ AS (SELECT *, ROUND((GREATEST(u1, u2) - n1 * n0 / 2.0 - 0.5) / SQRT(n1 * n0 / 12.0 *
        ((n1 + n0 + 1) - tie_term / ((n1 + n0) * ((n1 + n0) - 1)))), 6) AS z FROM z_)
SELECT '{test}' AS test, '{finding}' AS finding, '{reason}' AS reason, CAST(n1 AS BIGINT) AS n1,
       CAST(n0 AS BIGINT) AS n0, u1, u2, tie_term, median1, median0, z, ABS(z) > {zcrit} AS significant
FROM zz_ CROSS JOIN md_) t_{test}"""


# ---------------------------------------------------------------------------
# Column inventories of the layers (for per-column report SQL)
# ---------------------------------------------------------------------------

def raw_types() -> dict[str, str]:
    from ..sources.adapter import raw_schema
    return {f.name: f.dataType.simpleString() for f in raw_schema().fields}


AFTER3 = RAW_COLS + ["duplicate_flag", "weight_available", "diag_1_missing_flag"]
CLEAN_COLS = ([C.snake(c) for c in AFTER3] + ["gender_invalid_flag", "expired_or_hospice_flag"]
              + [f"{c}_outlier_flag" for c in C.NUMERIC_COLS] + ["any_outlier_flag"]
              + ["num_active_medications", "any_medication_change", "age_midpoint",
                 "total_prior_visits", "polypharmacy_flag"])
CLEAN_STRINGS = [C.snake(c) for c in STRING_RAW]


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)
