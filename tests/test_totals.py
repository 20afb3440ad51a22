"""Segment totals, entity counts and distinct sketches."""

from conftest import SMOKE
from pyspark.sql import functions as F

from cohortlens.operators.segments import Count, Distinct, Entities, Family, from_cube, segment_cube, segment_rates


def _layers(spark):
    from cohortlens.plans.pipeline import build_layers
    return build_layers(spark, SMOKE)


def test_entities_equal_distinct_counts(spark):
    from cohortlens.plans.kpi import patient_type
    base = _layers(spark).base
    for by in ([], [("patient_type", patient_type())]):
        got = segment_rates(base, by, [Entities("n", "patient_nbr")])
        want = segment_rates(base, by, [Distinct("n", "patient_nbr")])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "patient_nbr" not in plan[:plan.index("Scan") if "Scan" in plan else None].split("HashAggregate")[1]


def test_null_entities_are_not_counted(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (7, 1), (7, 2), (8, 1)], "p int, encounter_seq int")
    assert segment_rates(df, [], [Entities("n", "p")]).first().n == 2


def test_rows_are_aggregated_before_they_are_expanded(spark):
    from cohortlens.plans.cube import encounter_cube
    plan = encounter_cube(_layers(spark).base)._jdf.queryExecution().optimizedPlan().toString()
    for part in plan.split("Generate")[1:]:
        assert "Aggregate" in part                  # below every expansion lies an aggregation


def test_distinct_sketches_merge_over_families(spark):
    rows = [(f"a{i % 3}", f"b{i % 5}", i % 90, 1) for i in range(900)] + [("a0", None, None, 1)]
    df = spark.createDataFrame(rows, "a string, b string, p int, flag int")
    fams = [Family("a", (("a", lambda: F.col("a")),), "ab"), Family("b", (("b", lambda: F.col("b")),), "ab"),
            Family("all", (), "ab")]
    cube = segment_cube(df, fams, ["flag"], {}, sketches=["p"])
    for fam, key in zip(fams, ("a", "b", None), strict=True):
        got = from_cube(cube, fam, ["string"], [Count("n"), Distinct("d", "p", approx=True)]).collect()
        want = df.groupBy(*([key] if key else [])).agg(F.count("*").alias("n"), F.countDistinct("p").alias("d")).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))      # few values: the sketch is exact


def test_empty_table_has_no_segments(spark):
    df = spark.createDataFrame([], "a string, flag int")
    assert segment_cube(df, [Family("all"), Family("a", (("a", lambda: F.col("a")),))], ["flag"], {}).count() == 0
