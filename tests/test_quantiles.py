"""Exact quantiles by radix selection."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators.quantiles import exact_quantiles, ordered_bits


def _frequencies(spark, pdf, keys):
    return spark.createDataFrame(pdf).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))


def test_ordered_bits_are_the_stored_bits(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 20_000, dtype=np.int64).view(np.float64)
    powers = 2.0 ** np.arange(-1074, 1024)
    x = np.concatenate([x[~np.isnan(x)], powers, np.nextafter(powers[60:], 0), [0.0, 5e-324, np.inf]])
    x = np.concatenate([x, -x])
    got = spark.createDataFrame(pd.DataFrame({"v": x})).select("v", ordered_bits(F.col("v")).alias("b")).toPandas()
    bits = got.v.abs().to_numpy().view(np.int64)
    assert (np.where(got.v < 0, -bits, bits) == got.b).all()
    special = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double")
    nan, inf, null = (r.b for r in special.select(ordered_bits(F.col("v")).alias("b")).collect())
    assert nan > inf and null is None


def test_groups_with_nulls_and_close_values(spark):
    rng = np.random.default_rng(3)
    # Values that share 20, and 42, leading bits: all three passes are needed.
    base = 1000.0 + rng.integers(0, 50, 900) * 1e-3 + rng.integers(0, 4, 900) * 2.0**-43
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 900), "v": base})
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r.g: (list(r._q), r.n) for r in exact_quantiles(_frequencies(spark, pdf, ["g"]), ["g"], "v", "n", probs).collect()}
    for g, part in pdf.groupby("g", dropna=False):
        g = None if pd.isna(g) else g
        assert np.allclose(got[g][0], part.v.quantile(probs), rtol=0, atol=1e-12) and got[g][1] == len(part)


def test_weights_zero_weights_and_missing_values(spark):
    freq = spark.createDataFrame([(1.0, 3), (2.0, 0), (7.0, 1), (None, 5)], "v double, n long")
    row = exact_quantiles(freq, [], "v", "n", [0.5, 0.9]).first()
    assert row.n == 4 and row._q[0] == 1.0 and abs(row._q[1] - np.quantile([1, 1, 1, 7], 0.9)) < 1e-12
    none = exact_quantiles(freq.filter("v is null"), [], "v", "n", [0.5]).collect()
    assert [(r._q, r.n) for r in none] == [([None], None)]       # like an aggregate without groups
    keyed = freq.withColumn("k", F.lit("a"))
    assert exact_quantiles(keyed.filter("v is null"), ["k"], "v", "n", [0.5]).count() == 0


@settings(max_examples=8, deadline=None)
@given(values=st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=40))
def test_any_finite_values(spark, values):
    pdf = pd.DataFrame({"v": np.array(values, float)})
    got = exact_quantiles(_frequencies(spark, pdf, []), [], "v", "n", [0.25, 0.75]).first()
    assert np.allclose(got._q, pdf.v.quantile([0.25, 0.75]), rtol=1e-12, atol=0)


def test_input_is_read_once_and_fences_add_no_scan(spark):
    from conftest import SMOKE

    from cohortlens.plans.pipeline import build_layers, clean_encounters
    kept = build_layers(spark, SMOKE).deduplicated
    clean, _ = clean_encounters(kept, cached=[])
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2        # the rows and their key conflicts
    assert plan.count("\n") < 150 and "Subquery" not in plan
    freq = spark.range(50).select((F.col("id") % 7).cast("double").alias("v"), F.lit(1).alias("n"))
    q = exact_quantiles(freq, [], "v", "n", [0.5])
    assert "Range" not in q._jdf.queryExecution().executedPlan().toString()   # served from the stored state
