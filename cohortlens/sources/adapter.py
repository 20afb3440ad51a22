"""Encounter adapter over the driver's relational tables.

The analysed project works on one raw encounter table (50 columns).  The
driver tables hold orders, line items and customers instead, so this module
derives a raw encounter table from them:

* an encounter is an order, the patient is its customer (one third of the
  orders get a patient of their own so that single-visit patients exist),
* utilisation counts come from the order's line items,
* the outcome (``<30`` / ``>30`` / ``NO``) is the real gap to the patient's
  next order,
* raw-data mess is injected deterministically (``?`` sentinels, padded and
  upper/lower-case text, ``6.0`` style codes, unknown vocabulary, exact
  duplicate rows) so the cleaning operators have work to do.

The per-row fixture expressions are SQL text shared with the DuckDB oracle so
both engines see the same input; the operators under test are implemented
separately on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..operators.sequence import sequence
from .readers import read_table

#: The driver tables that the encounter table is derived from.
TABLES = ("orders", "lineitem", "customer")

# Patients of their own for one third of the orders: an id range no customer
# key reaches.
SINGLETON_PATIENT_BASE = 10_000_000_000_000
DUPLICATE_EVERY = 50          # every 50th encounter is loaded twice
READMIT_WINDOW_DAYS = 30

PATIENT_EXPR = f"CASE WHEN k % 3 = 2 THEN {SINGLETON_PATIENT_BASE} + k ELSE p END"

_PAYERS = ("MC", "BC", "HM", "SP", "CP", "UN", "MD")


def _med_expr(i: int, name: str) -> str:
    if name in ("examide", "citoglipton"):
        return "'No'"
    if name == "insulin":
        return ("CASE o_orderstatus WHEN 'F' THEN 'Steady' WHEN 'O' THEN 'No' "
                "ELSE CASE WHEN k % 5 < 2 THEN 'Up' ELSE 'Down' END END")
    m = 20 if i < 6 else 50
    h = f"((k * {2 * i + 1} + {i}) % {m})"
    generic = (f"CASE WHEN {h} < {m - 8} THEN 'No' WHEN {h} < {m - 3} THEN 'Steady' "
               f"WHEN {h} < {m - 1} THEN 'Up' ELSE 'Down' END")
    if name == "metformin":
        return f"CASE WHEN k % 101 = 0 THEN '?' ELSE {generic} END"
    if name == "repaglinide":
        return f"CASE WHEN k % 199 = 0 THEN 'steady ' ELSE {generic} END"
    if name == "nateglinide":
        return f"CASE WHEN k % 211 = 0 THEN 'UNK' ELSE {generic} END"
    return generic


def _code_with_mess(value: str, every: int, rest: int) -> str:
    v = f"CAST({value} AS STRING)"
    return f"CASE WHEN k % {every} = {rest} THEN {v} || '.0' ELSE {v} END"


def raw_row_exprs() -> list[tuple[str, str]]:
    """(column, SQL expression) of the raw encounter table, in schema order.

    Inputs: k (order key), p (customer key), patient, o_orderdate, next_date,
    o_orderstatus, o_orderpriority, seg (market segment), region (region
    name), and per-order line aggregates n_lines, qty, n_r, n_a, n_n, n_supp,
    lab, procs (NULL when the order has no lines).
    """
    payer = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_PAYERS))
    gender = ("CASE WHEN k % 2500 = 7 THEN 'Unknown/Invalid' "
              "WHEN p % 2 = 0 THEN 'Female' ELSE 'Male' END")
    readmitted = (f"CASE WHEN next_date IS NULL THEN 'NO' "
                  f"WHEN next_date <= o_orderdate + INTERVAL '{READMIT_WINDOW_DAYS}' DAY "
                  f"THEN '<30' ELSE '>30' END")
    exprs = [
        ("encounter_id", "k"),
        ("patient_nbr", "patient"),
        ("race", "CASE WHEN k % 40 = 0 THEN '?' WHEN k % 19 = 3 THEN lower(region) "
                 "ELSE region END"),
        ("gender", f"CASE WHEN k % 11 = 5 THEN ' ' || upper({gender}) || ' ' ELSE {gender} END"),
        ("age", "'[' || CAST(10 * (p % 10) AS STRING) || '-' || "
                "CAST(10 * (p % 10) + 10 AS STRING) || ')'"),
        ("weight", "CASE WHEN k % 25 = 0 THEN '[' || CAST(25 * (k % 8) AS STRING) || '-' || "
                   "CAST(25 * (k % 8) + 25 AS STRING) || ')' ELSE '?' END"),
        ("admission_type_id", _code_with_mess("1 + k % 8", 9, 4)),
        ("discharge_disposition_id", _code_with_mess("1 + k % 28", 7, 3)),
        ("admission_source_id", _code_with_mess("1 + (k * 7) % 25", 13, 6)),
        ("time_in_hospital", "CAST(COALESCE(n_lines, 0) AS INT)"),
        ("payer_code", f"CASE WHEN k % 5 IN (0, 2) THEN '?' ELSE CASE k % 7 {payer} END END"),
        ("medical_specialty", "CASE WHEN k % 10 < 4 THEN '?' "
                              "WHEN k % 10 = 9 THEN seg || '-general' "
                              "WHEN k % 13 = 1 THEN lower(seg) || '  ' ELSE seg END"),
        ("num_lab_procedures", "CAST(COALESCE(lab, 0) + 1 AS INT)"),
        ("num_procedures", "CAST(COALESCE(procs, 0) AS INT)"),
        ("num_medications", "CAST(FLOOR(COALESCE(qty, 0) / 8) AS INT)"),
        ("number_outpatient", "CAST(COALESCE(n_n, 0) AS INT)"),
        ("number_emergency", "CAST(COALESCE(n_a, 0) AS INT)"),
        ("number_inpatient", "CAST(COALESCE(n_r, 0) AS INT)"),
        ("diag_1", "CASE WHEN k % 83 = 0 THEN '?' "
                   "WHEN k % 97 = 0 THEN CASE WHEN k % 194 = 97 THEN 'v' ELSE 'V' END "
                   "|| CAST(k % 90 AS STRING) "
                   "WHEN k % 89 = 0 THEN 'E' || CAST(900 + k % 90 AS STRING) "
                   "WHEN k % 3 = 0 THEN CAST(k % 1000 AS STRING) || '.' || CAST(k % 100 AS STRING) "
                   "ELSE CAST(k % 1000 AS STRING) END"),
        ("diag_2", "CASE WHEN k % 53 = 0 THEN '?' ELSE CAST((k * 7) % 1000 AS STRING) END"),
        ("diag_3", "CASE WHEN k % 31 = 0 THEN '?' ELSE CAST((k * 11) % 1000 AS STRING) END"),
        ("number_diagnoses", "CAST(COALESCE(n_supp, 0) AS INT)"),
        ("max_glu_serum", "CASE k % 20 WHEN 0 THEN '>200' WHEN 1 THEN '>300' "
                          "WHEN 2 THEN 'Norm' ELSE 'None' END"),
        ("A1Cresult", "CASE o_orderpriority WHEN '1-URGENT' THEN '>8' WHEN '2-HIGH' THEN '>7' "
                      "WHEN '3-MEDIUM' THEN 'Norm' ELSE 'None' END"),
    ]
    exprs += [(name, _med_expr(i, name)) for i, name in enumerate(C.MEDICATION_COLS)]
    exprs += [
        ("change", "CASE WHEN k % 23 = 0 THEN 'ch' WHEN k % 11 < 5 THEN 'Ch' ELSE 'No' END"),
        ("diabetesMed", "CASE WHEN k % 29 = 0 THEN 'YES' WHEN k % 4 <> 0 THEN 'Yes' ELSE 'No' END"),
        ("readmitted", f"CASE WHEN k % 17 = 0 THEN lower({readmitted}) || ' ' ELSE {readmitted} END"),
    ]
    return exprs


_INT_COLS = set(C.NUMERIC_COLS)


def raw_schema() -> T.StructType:
    """Explicit schema of the raw encounter table (codes stay text)."""
    fields = []
    for name, _ in raw_row_exprs():
        if name in ("encounter_id", "patient_nbr"):
            t = T.LongType()
        elif name in _INT_COLS:
            t = T.IntegerType()
        else:
            t = T.StringType()
        fields.append(T.StructField(name, t, True))
    return T.StructType(fields)


def _line_aggregates(lineitem: DataFrame) -> DataFrame:
    """Per-order utilisation counts.

    The few columns read are dealt by order once; the distinct count and the sums then need
    no further shuffle (an order has few lines, so a partial aggregation would not shrink them)."""
    lines = lineitem.select("l_orderkey", "l_quantity", "l_returnflag", "l_suppkey", "l_partkey")
    return lines.repartition("l_orderkey").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("l_quantity").alias("qty"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_r"),
        F.count_if(F.col("l_returnflag") == "A").alias("n_a"),
        F.count_if(F.col("l_returnflag") == "N").alias("n_n"),
        F.countDistinct("l_suppkey").alias("n_supp"),
        F.sum(F.col("l_partkey") % 23).alias("lab"),
        F.count_if(F.col("l_partkey") % 4 == 0).alias("procs"),
    )


def raw_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze encounter table (with injected mess and duplicate rows)."""
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("p"),
        "o_orderdate", "o_orderstatus", "o_orderpriority")
    orders = orders.withColumn("patient", F.expr(PATIENT_EXPR))
    # Next visit of the same patient (skew-safe ordered sequencing).
    orders = sequence(orders, key="patient", order=["o_orderdate", "k"],
                      nxt={"next_date": "o_orderdate"})

    lines = _line_aggregates(read_table(spark, sf_dir, "lineitem"))
    # nation/region are tiny dimension tables; the planner broadcasts them
    # after checking their size against spark.sql.autoBroadcastJoinThreshold.
    geo = (read_table(spark, sf_dir, "nation")
           .join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
           .select("n_nationkey", F.col("r_name").alias("region")))
    cust = (read_table(spark, sf_dir, "customer")
            .select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("seg"))
            .join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select("c_custkey", "seg", "region"))

    src = (orders
           .join(lines, F.col("k") == F.col("l_orderkey"), "left")
           .join(cust, F.col("p") == F.col("c_custkey"), "left"))
    raw = src.select(*[F.expr(e).alias(n) for n, e in raw_row_exprs()])
    # Exact duplicate rows without re-running the plan: explode a copy marker.
    copies = F.when(F.col("encounter_id") % DUPLICATE_EVERY == 0, F.array(F.lit(0), F.lit(1))) \
        .otherwise(F.array(F.lit(0)))
    raw = raw.withColumn("_copy", F.explode(copies)).drop("_copy")
    schema = raw_schema()
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
