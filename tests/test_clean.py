import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortlens.operators import clean as CL


def test_sentinel_replacement_and_report(spark):
    df = spark.createDataFrame([("?", "a", 1), ("x", "?", 2), ("?", None, 3)], "s1 string, s2 string, n int")
    out = CL.replace_sentinel(df, "?")
    assert out.filter(F.col("s1").isNull()).count() == 2
    rep = {r.column: (r.sentinel_count, r.sentinel_pct) for r in CL.sentinel_counts(df, "?").collect()}
    assert rep == {"s1": (2, 66.67), "s2": (1, 33.33)}


def test_remove_duplicates_flags_key_conflicts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, None), (3, None)], "k long, v string")
    out = CL.remove_duplicates(df, "k").orderBy("k", "v")
    rows = [(r.k, r.v, r.duplicate_flag) for r in out.collect()]
    assert rows == [(1, "a", 0), (2, "b", 1), (2, "c", 1), (3, None, 0)]
    s = CL.duplicate_summary(df, "k").first()
    assert (s.rows_before, s.rows_after, s.duplicates_removed, s.pk_conflict_rows) == (6, 4, 2, 2)


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_two_phase_duplicates_equal_one_phase(spark):
    nan, none = float("nan"), None
    rows = [(1, "a", 1.0, [1]), (1, "a", 1.0, [1]), (1, "a", nan, none), (1, "a", nan, none), (2, none, 0.0, [2]), (2, none, -0.0, [2]),
            (none, "b", none, [none]), (none, "b", none, [none]), (none, none, none, none), (3, "", 1.0, []), (3, none, 1.0, [])]
    df = spark.createDataFrame([(*r, i % 2 == 9) for i, r in enumerate(rows)], "`k.x` int, `a-b` string, d double, l array<int>, same boolean")
    want = _rows(df.dropDuplicates())
    assert _rows(CL.drop_exact_duplicates(df)) == want and len(want) == 7
    assert _rows(CL.drop_exact_duplicates(df, list_rows=1)) == want
    alone = spark.range(50).withColumn("v", F.col("id") % 3)
    assert CL.drop_exact_duplicates(alone).count() == 50
    assert CL.drop_exact_duplicates(alone.limit(0)).columns == ["id", "v"]


def test_digests_that_agree_by_chance_keep_both_rows(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c")], "k long, v string")
    monkeypatch.setattr(CL, "row_digest", lambda _: [F.lit(5), F.lit(6)])
    assert _rows(CL.drop_exact_duplicates(df)) == _rows(df.dropDuplicates())


def test_rows_without_a_twin_are_not_shuffled(spark):
    df = spark.range(1000).withColumn("v", F.concat(F.lit("text "), F.col("id").cast("string")))
    df = df.unionAll(df.filter("id < 5"))
    plan = CL.drop_exact_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    moved = plan[plan.index("Exchange hashpartitioning"):]
    assert plan.count("Exchange hashpartitioning") == 1 and "LeftSemi" in moved and "LeftAnti" not in moved
    plan = CL.flag_key_conflicts(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    flags = CL.flag_key_conflicts(df, "id"), CL.flag_key_conflicts(df, "id", list_rows=1)
    assert _rows(flags[0]) == _rows(flags[1]) and flags[0].filter("duplicate_flag = 1").count() == 10


def test_missing_policy(spark):
    df = spark.createDataFrame([(None, None, None), ("75", "x", "250")], "weight string, payer string, diag string")
    out = CL.treat_missing(df, presence_flags={"weight": "w_av"}, fills={"payer": "Unknown"},
                           missing_flags={"diag": "d_miss"}).orderBy("w_av").collect()
    assert (out[0].payer, out[0].w_av, out[0].d_miss) == ("Unknown", 0, 1)
    assert (out[1].payer, out[1].w_av, out[1].d_miss) == ("x", 1, 0)


def test_correct_dtypes_and_code_flags(spark):
    df = spark.createDataFrame([("6.0", "3"), ("11", "x"), (None, "4"), ("x", "5")], "code string, num string")
    out = CL.correct_dtypes(df, ["code"], ["num"])
    got = [(r.code, r.num) for r in out.collect()]
    assert got == [("6", 3), ("11", None), (None, 4), ("x", 5)]
    rep = CL.coercion_report(df, ["num"]).first()
    assert (rep.nulls_after, rep.coercion_nulls) == (1, 1)
    flagged = CL.flag_codes(out, "code", [11, 13], "expired")
    assert [r.expired for r in flagged.collect()] == [0, 1, 0, 0]


def test_standardize_text_and_vocabulary(spark):
    df = spark.createDataFrame([(" FEMALE ", "no ", "a"), ("Unknown/Invalid", "<30", "b")],
                               "gender string, readmitted string, `glyburide-metformin` string")
    out = CL.standardize_text(df, upper_cols=["readmitted"], rename={"glyburide-metformin": "glyburide_metformin"})
    rows = out.collect()
    assert out.columns == ["gender", "readmitted", "glyburide_metformin"]
    assert [(r.gender, r.readmitted) for r in rows] == [("Female", "NO"), ("Unknown/Invalid", "<30")]
    flagged = CL.flag_invalid(out, "gender", ["Male", "Female"], "bad")
    assert [r.bad for r in flagged.collect()] == [0, 1]
    voc = [(r.column, r.value) for r in CL.vocabulary(out, ["gender"]).collect()]
    assert voc == [("gender", "Female"), ("gender", "Unknown/Invalid")]


def test_validate_vocabulary(spark):
    df = spark.createDataFrame([("No", "Up"), ("Unk", None), ("Steady", "Down")], "a string, b string")
    bad = [(r.column, r.value, r.rows) for r in CL.validate_vocabulary(df, ["a", "b"], ["No", "Steady", "Up", "Down"]).collect()]
    assert bad == [("a", "Unk", 1)]


def test_iqr_fences_match_pandas(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"x": rng.integers(0, 30, 500).astype(float), "y": rng.poisson(2, 500).astype(float)})
    pdf.loc[::37, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    flagged, report = CL.flag_iqr_outliers(df, ["x", "y"], 1.5)
    rep = {r.column: r for r in report.collect()}
    any_mask = pd.Series(False, index=pdf.index)
    for c in ["x", "y"]:
        q1, q3 = pdf[c].quantile(0.25), pdf[c].quantile(0.75)
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        mask = (pdf[c] < lo) | (pdf[c] > hi)
        any_mask |= mask
        assert rep[c].lower_bound == round(lo, 2) and rep[c].upper_bound == round(hi, 2)
        assert rep[c].outlier_count == int(mask.sum())
        assert flagged.agg(F.sum(f"{c}_outlier_flag")).first()[0] == int(mask.sum())
    assert flagged.agg(F.sum("any_outlier_flag")).first()[0] == int(any_mask.sum())
    assert flagged.count() == len(pdf)


def test_rows_that_share_a_null_key_are_in_conflict(spark):
    from cohortlens.operators.clean import flag_key_conflicts
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    got = {r.v: r.duplicate_flag for r in flag_key_conflicts(df, "k").collect()}
    assert got == {"a": 1, "b": 1, "c": 0, "d": 1, "e": 1}


def test_strip_takes_all_unicode_white_space(spark):
    from pyspark.sql import functions as F

    from cohortlens.functions import expr as X
    texts = ["\u2003a b\u3000", "\u00a0x\u2028", " plain\t", "", "\u1680"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(X.strip(F.col("t")).alias("s")).collect()] == [t.strip() for t in texts]


def test_twins_are_found_by_the_key(spark):
    nan, none = float("nan"), None
    rows = [(1, "a", 1.0), (1, "a", 1.0), (1, "b", 1.0), (2, none, nan), (2, none, nan), (3, "a", 1.0), (4, "a", 1.0),
            (none, "a", none), (none, "a", none), (none, "b", none), (5, "", 0.0), (5, "", -0.0)]
    df = spark.createDataFrame(rows, "`k.x` long, v string, d double")
    want = _rows(df.dropDuplicates())
    assert _rows(CL.drop_exact_duplicates(df, key="k.x")) == want and len(want) == 8
    assert _rows(CL.drop_exact_duplicates(df, key="k.x", list_keys=1)) == want
    assert _rows(CL.drop_exact_duplicates(df, list_rows=1, key="k.x", list_keys=1)) == want
    assert CL.drop_exact_duplicates(df.filter("v = 'a'").dropDuplicates(), key="k.x").count() == 4


def test_finding_twins_reads_the_key_only(spark, tmp_path, monkeypatch):
    seen = []
    whole = CL.repeated
    monkeypatch.setattr(CL, "repeated", lambda df, *keys: seen.append(df.select(*keys)) or whole(df, *keys))
    spark.range(100).selectExpr("id % 90 AS k", "id % 90 AS a", "'x' AS b").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert CL.drop_exact_duplicates(df, key="k").count() == 90
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:bigint>" in plan, plan


def test_row_pass_is_two_projections_of_small_methods(spark, monkeypatch):
    """Generated methods above 8,000 bytes are never compiled by the JVM, unless it is told so."""
    import re

    from cohortlens import config as C
    from cohortlens.plans import pipeline
    from cohortlens.sources.adapter import raw_schema
    monkeypatch.setattr(CL, "flag_key_conflicts", lambda df, pk: df.withColumn("duplicate_flag", F.lit(0)))
    monkeypatch.setattr(CL, "iqr_fences", lambda freq, m: spark.createDataFrame([(c, 1.0, 9.0) for c in C.NUMERIC_COLS], "column string, lower_bound double, upper_bound double"))
    raw = spark.createDataFrame([], raw_schema())
    clean, _ = pipeline.clean_encounters(raw, cached=[])
    debug = spark._jvm.org.apache.spark.sql.execution.debug
    plan = clean._jdf.queryExecution().executedPlan()
    assert plan.toString().count("Project [") <= 2, plan.toString()
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", getattr(debug, "package").codegenString(plan))]
    assert sizes and all(n < 8000 for n in sizes), sizes


def test_features_of_medications_with_nulls(spark):
    from cohortlens.operators.features import active_count, any_in
    df = spark.createDataFrame([("No", "No"), (None, "No"), ("Up", None), ("Steady", "x"), (None, None)], "a string, b string")
    got = df.select(active_count(["a", "b"]).alias("n"), any_in(["a", "b"], ("Up", "Down")).alias("f"))
    assert dict(got.dtypes) == {"n": "int", "f": "int"}
    assert [tuple(r) for r in got.collect()] == [(0, 0), (1, 0), (2, 1), (2, 0), (2, 0)]


def test_tables_without_text_keep_their_columns(spark):
    df = spark.createDataFrame([(1, 2.0)], "`a-b` int, c double")
    assert CL.standardize_text(df, rename={"a-b": "a_b"}).columns == ["a_b", "c"]
