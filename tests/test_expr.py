from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.functions import expr as X


def test_round_ratio_matches_exact_half_up(spark):
    pairs = [(n, d) for d in (1, 3, 7, 8, 40, 99_340) for n in (0, 1, 2, 5, 37, 11_314, 99_339)]
    pairs += [(-5, 8), (-1, 3), (125, 1000), (1125, 10000)]
    df = spark.createDataFrame(pairs, "n long, d long")
    got = df.select("n", "d", X.round_ratio("n", "d", 2).alias("r")).collect()
    for row in got:
        exp = (Decimal(row.n) / Decimal(row.d)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
        assert row.r == float(exp), (row.n, row.d, row.r, exp)


def test_rate_pct_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(0, 0)], "s long, n long")
    assert df.select(X.rate_pct("s", "n").alias("r")).first().r is None


TITLE_CASES = [" unknown/INVALID  ", "AfricanAmerican", "surgery-general", "[70-80)", "v45.81",
               "e11a", "MIDDLE EAST", "o'neil mc\tx", "Ch", "None", ">30", "", "ÉCOLE élan", "3rd"]


def test_title_case_matches_python(spark):
    df = spark.createDataFrame([(s,) for s in TITLE_CASES] + [(None,)], "s string")
    got = {r.s: r.t for r in df.select("s", X.title_case("s").alias("t")).collect()}
    for s in TITLE_CASES:
        assert got[s] == s.title(), (s, got[s], s.title())
    assert got[None] is None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZ -/.'[)09é", max_size=12), min_size=1, max_size=20))
def test_title_case_property(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    for r in df.select("s", X.title_case(X.strip("s")).alias("t")).collect():
        assert r.t == r.s.strip().title()


def test_icd_chapters(spark):
    cases = {"250.83": "Diabetes", "250": "Diabetes", "459.5": "Other", "459": "Circulatory",
             "V57": "Supplementary (V-codes)", "v12": "Supplementary (V-codes)",
             "E909": "External Causes (E-codes)", "None": "No Primary Diagnosis", "800": "Injury & Poisoning",
             "715.2": "Musculoskeletal", "140": "Neoplasms", "319": "Mental Disorders", "12ab": "Other"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "d string")
    got = {r.d: r.c for r in df.select("d", X.icd_chapter("d").alias("c")).collect()}
    for k, v in cases.items():
        assert got[k] == v, k
    assert got[None] == "Other"


def test_null_safe_flags(spark):
    df = spark.createDataFrame([("No",), ("Up",), (None,)], "m string")
    rows = df.select("m", X.not_equal_null_true("m", "No").cast("int").alias("active"),
                     X.flag(F.col("m").isin("Up", "Down")).alias("chg")).collect()
    got = {r.m: (r.active, r.chg) for r in rows}
    assert got["No"] == (0, 0) and got["Up"] == (1, 1) and got[None] == (1, 0)


def test_age_midpoint(spark):
    df = spark.createDataFrame([("[70-80)",), ("[0-10)",), ("x",), (None,)], "a string")
    got = {r.a: r.m for r in df.select("a", X.age_midpoint("a").alias("m")).collect()}
    assert got["[70-80)"] == 75.0 and got["[0-10)"] == 5.0 and got["x"] is None and got[None] is None


def test_sql_form_of_strip_title_equals_column_form(spark):
    vals = TITLE_CASES + ["  tab\tsep ", " nbsp ", "x-y/z'w", "ÉCOLE élan"]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "s string")
    rows = df.select("s", F.expr(X.strip_title_sql("s")).alias("a"), X.title_case(X.strip("s")).alias("b"),
                     F.expr(X.strip_title_sql("s", upper=True)).alias("u")).collect()
    for r in rows:
        assert r.a == r.b
        if r.s is not None:
            assert r.a == r.s.strip().title() and r.u == r.s.strip().title().upper()


def test_many_texts_in_one_array_equal_each_alone(spark):
    """Matched text must be exactly text that strip and title case leave as it is."""
    texts = ["", "No", "no", "NO", "AB", "aB", "Ab", "A", "a", "6a", "6A", "A6b", "A6B", "O'neil", "O'Neil", ">300", "[0-10)", "250.13", "V27", "v27",
             "No ", " No", "No\n", "\nNo", "No\u2003", "\u00a0x", "Up Down", "Up  down", "up-DOWN", "Up-Down", "Up--Down-", "\u00c4rger", "\u00e4RGER",
             "St\u00e9", "a\u0001 b", "\u0001", "Tab\there", "?", "Unknown/Invalid", "UNKNOWN/invalid", "'", "`x", "`X", "\\A", "\u01c6", "\u00df", "X\u0301y", None]
    df = spark.createDataFrame([(t, (t or "") + "Zz") for t in texts], "`a-b` string, y string")
    got = df.select(F.expr(X.strip_title_all_sql(["a-b", "y"])).alias("t"), F.expr(X.strip_title_sql("a-b")).alias("s"),
                    F.expr(X.strip_title_sql("y")).alias("u")).collect()
    assert [list(r.t) for r in got] == [[r.s, r.u] for r in got]
