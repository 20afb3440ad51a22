import numpy as np
import pandas as pd

from cohortlens.operators import distributions as G


def _pdf(seed=5):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"grp": rng.choice(["A", "B", "C"], 400), "x": rng.integers(0, 7, 400).astype(float),
                         "y": rng.gamma(2.0, 3.0, 400).round(1)})


def test_histogram_matches_numpy(spark):
    pdf = _pdf()
    pdf.loc[pdf.grp == "C", "x"] = 4.0          # a constant group
    got = G.histogram(spark.createDataFrame(pdf), "x", "grp", bins=20).collect()
    for g, part in pdf.groupby("grp"):
        counts, _ = np.histogram(part["x"], bins=20)
        mine = np.zeros(20, dtype=int)
        for r in got:
            if r.grp == g:
                mine[r.bin] = r["count"]
        assert (mine == counts).all(), g


def test_box_stats_match_numpy(spark):
    pdf = _pdf()
    got = {(r.column, r.grp): r for r in G.box_stats(spark.createDataFrame(pdf), ["y"], "grp").collect()}
    for g, part in pdf.groupby("grp"):
        v = part["y"].to_numpy()
        q1, med, q3 = np.percentile(v, [25, 50, 75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        r = got[("y", g)]
        assert (r.q1, r.median, r.q3) == (q1, med, q3)
        assert r.whisker_low == v[v >= lo].min() and r.whisker_high == v[v <= hi].max()
        assert r.fliers == int(((v < lo) | (v > hi)).sum())


def test_correlation_matches_pandas(spark):
    pdf = _pdf()
    pdf.loc[::9, "y"] = np.nan
    got = {(r.col_a, r.col_b): r.r for r in G.correlation_matrix(spark.createDataFrame(pdf), ["x", "y"]).collect()}
    exp = pdf[["x", "y"]].corr()
    assert abs(got[("x", "y")] - exp.loc["x", "y"]) < 1e-6 and got[("y", "x")] == got[("x", "y")]
    assert got[("x", "x")] == 1.0
