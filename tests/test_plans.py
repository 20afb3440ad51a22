"""Scale properties of every registered query, read from the physical plans."""

import pytest

from conftest import SMOKE

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")
LLM = ("op", "pipeline")   # the training-data operators are tested in tests/llm
PYTHON = ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    import __spark_entry__ as E
    return {name: _plan(fn(spark, SMOKE)) for name, fn in E.queries().items()
            if not name.startswith(LLM)}


def test_no_cross_products_anywhere(plans):
    bad = {n: op for n, p in plans.items() for op in FORBIDDEN if op in p}
    assert not bad


def test_python_only_for_p_values(plans):
    with_python = {n for n, p in plans.items() if any(op in p for op in PYTHON)}
    assert with_python <= {"h1_chi_square_tests", "h5_test_battery", "a20_chi_square_many_groups"}


def test_base_view_plan_is_one_exchange_with_pushed_filters(spark):
    from cohortlens.operators.encounters import encounter_base
    from cohortlens.plans.pipeline import build_layers
    df = encounter_base(build_layers(spark, SMOKE).clean)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    formatted = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(expired_or_hospice_flag,0)" in formatted and "EqualTo(gender_invalid_flag,0)" in formatted


def test_base_view_over_buckets_has_no_exchange(spark, tmp_path):
    from cohortlens.plans.pipeline import bucketed_base, build_layers
    layers = build_layers(spark, SMOKE)
    got = bucketed_base(layers.clean, "base_in_buckets", str(tmp_path / "t"), buckets=3)
    assert "Exchange" not in _plan(got)
    want = layers.base.select(got.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    files = spark.table("base_in_buckets").select("_metadata.file_name").distinct().count()
    assert files <= 3 * 4
    spark.sql("DROP TABLE base_in_buckets")


def test_no_local_checkpoint_in_library():
    import pathlib
    root = pathlib.Path(__file__).resolve().parents[1] / "cohortlens"
    offenders = [str(p) for p in root.rglob("*.py") if "localCheckpoint" in p.read_text()]
    assert not offenders


def test_line_items_are_dealt_by_order_once(spark):
    """The distinct supplier count needs no shuffle of its own."""
    from cohortlens.sources.adapter import _line_aggregates
    lines = spark.createDataFrame([(1, 10, 2.0, "R", 5), (1, 11, 3.0, "A", 5), (1, 12, 1.0, "R", 6), (2, 8, 4.0, "N", 7), (None, 4, None, None, None)],
                                  "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string, l_suppkey long")
    out = _line_aggregates(lines)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1, plan
    got = {r["l_orderkey"]: tuple(r)[1:] for r in out.collect()}
    assert got == {1: (3, 6.0, 2, 1, 0, 2, 33, 1), 2: (1, 4.0, 0, 0, 1, 1, 8, 1), None: (1, None, 0, 0, 0, 0, 4, 1)}


def test_reports_read_their_columns_of_the_base_view(spark):
    """A report on two columns does not first copy the whole view into memory."""
    import __spark_entry__ as E
    plan = _plan(E.queries()["a20_crosstab_gender_outcome"](spark, SMOKE))
    assert "InMemoryTableScan" not in plan
    assert "ReadSchema: struct<readmitted:string,gender:string>" in plan, plan
