import math
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import stats as S


def _frame(spark, cells):
    """Rows from (group, event, count) cells."""
    df = spark.createDataFrame(cells, "g string, e int, n int")
    return df.select("g", "e", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("_")).drop("_")


# Published contingency counts (encounters / 30-day events) and the
# chi-square values those counts give with the continuity correction.
GOLDEN = [
    ({"Repeat": (45_694, 9_027), "First": (53_646, 2_287)}, 5866.8626, None),
    ({"Poly": (79_274, 9_511), "Std": (20_066, 1_803)}, 143.6741, None),
    ({"Female": (53_454, 6_128), "Male": (45_886, 5_186)}, 0.6272, 0.428375),
    ({"None": (82_506, 9_641), "Tested": (3_775 + 8_137 + 4_922, 383 + 809 + 481)}, 42.1086, None),
    ({"Ch": (46_120, 5_545), "No": (30_597 + 22_623, 3_536 + 2_233)}, 34.1506, None),
]


@pytest.mark.parametrize("groups,chi2,p", GOLDEN)
def test_yates_chi_square_reproduces_published_values(spark, groups, chi2, p):
    cells = []
    for g, (n, ev) in groups.items():
        cells += [(g, 1, ev), (g, 0, n - ev)]
    res = S.chi_square_test(_frame(spark, cells), "g", "e").first()
    assert res.dof == 1
    assert round(res.chi2, 4) == chi2
    if p is not None:
        assert round(res.p_value, 6) == p


def test_chi_square_without_correction_for_larger_tables(spark):
    cells = [("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("b", "y", 5), ("c", "x", 7), ("c", "y", 9)]
    df = spark.createDataFrame(cells, "r string, c string, n int")
    df = df.select("r", "c", F.explode(F.array_repeat(F.lit(1), F.col("n")))).drop("col")
    res = S.chi_square_test(df, "r", "c").first()
    obs = {(r, c): n for r, c, n in cells}
    rows, cols = {r for r, _ in obs}, {c for _, c in obs}
    N = sum(obs.values())
    exp = sum((obs[(r, c)] - sum(obs[(r, k)] for k in cols) * sum(obs[(k, c)] for k in rows) / N) ** 2
              / (sum(obs[(r, k)] for k in cols) * sum(obs[(k, c)] for k in rows) / N) for r in rows for c in cols)
    assert res.dof == 2 and abs(res.chi2 - exp) < 1e-9
    assert abs(res.p_value - math.exp(-exp / 2)) < 1e-12   # chi-square with 2 dof: p = exp(-x/2)


def _mwu_brute(x, y):
    u1 = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in x for b in y)
    n1, n0 = len(x), len(y)
    allv = sorted(x + y)
    ties = {}
    for v in allv:
        ties[v] = ties.get(v, 0) + 1
    t = sum(c ** 3 - c for c in ties.values())
    n = n1 + n0
    sigma = math.sqrt(n1 * n0 / 12 * ((n + 1) - t / (n * (n - 1))))
    u = max(u1, n1 * n0 - u1)
    z = (u - n1 * n0 / 2 - 0.5) / sigma
    return u1, z, math.erfc(z / math.sqrt(2))


def test_mann_whitney_matches_brute_force(spark):
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 12), 1) for _ in range(60)] + [(rnd.randint(0, 9), 0) for _ in range(90)]
    df = spark.createDataFrame(rows, "v int, g int")
    res = S.mann_whitney_test(df, "v", F.col("g") == 1).first()
    u1, z, p = _mwu_brute([float(v) for v, g in rows if g == 1], [float(v) for v, g in rows if g == 0])
    assert res.u1 == u1 and abs(res.z - z) < 1e-9 and abs(res.p_value - p) < 1e-12
    assert res.u1 + res.u2 == 60 * 90


def test_prefix_sum_over_slices(spark):
    df = spark.createDataFrame([(float(v), v % 4 + 1) for v in range(200)], "v double, n int")
    got = S.prefix_sum(df, "v", "n", "below", rows_per_slice=29).orderBy("v").collect()
    running = 0
    for r in got:
        assert r.below == running
        running += r.n


def test_p_value_adjustments(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "test string, p_value double")
    out = {r.test: (r.p_bonferroni, r.p_bh) for r in S.adjust_p_values(df).collect()}
    assert out["a"][0] == pytest.approx(0.04) and out["d"][0] == 1.0
    # BH: sorted p = .01,.03,.04,.5 -> .04, .0533, .0533, .5
    assert out["a"][1] == pytest.approx(0.04) and out["c"][1] == pytest.approx(0.04 * 4 / 3)
    assert out["b"][1] == pytest.approx(0.04 * 4 / 3) and out["d"][1] == pytest.approx(0.5)


def test_chi2_tail_function():
    assert S.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert S.chi2_sf(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-12)
    assert S.CHI2_CRITICAL[3] == pytest.approx(7.814727903251178, abs=1e-9)


def test_rank_test_over_many_values_is_exact_and_repeatable(spark):
    """200,000 distinct values in slices of 5,000: U equals the count by numpy, twice."""
    import numpy as np
    df = spark.range(200_000).select(F.substring(F.concat(F.lit("a"), "id"), 1, 1).alias("g"), (F.col("id") * 1.5).alias("v"),
                                     (F.pmod(F.xxhash64("id"), F.lit(3)) + 1).alias("n1"),
                                     F.pmod(F.xxhash64("id", F.lit(9)), F.lit(4)).alias("n0"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    rows = df.select("v", "n1", "n0").toPandas().sort_values("v")
    n1, n0 = rows.n1.to_numpy(), rows.n0.to_numpy()
    below = np.cumsum(n0) - n0
    u1 = float((n1 * below).sum() + (n1 * n0).sum() / 2)
    for freq in (df, df.drop("g"), df):
        got = S.mann_whitney_from_freq(freq, rows_per_slice=5_000).first()
        assert got.u1 == u1
        assert got.median1 == np.median(np.repeat(rows.v.to_numpy(), n1))
        assert got.median0 == np.median(np.repeat(rows.v.to_numpy(), n0))


def test_rank_test_with_very_large_ties(spark):
    df = spark.createDataFrame([("a", float(v), 1_700_000, 1_700_000) for v in range(6)], "g string, v double, n1 long, n0 long")
    got = S.mann_whitney_from_freq(df).first()
    assert int(got.tie_term) == 6 * (3_400_000 ** 3 - 3_400_000)
    assert got.u1 == got.u2


def test_chi_square_with_39_degrees_of_freedom_and_empty_cells(spark):
    import numpy as np
    rows = [(r, c, 40 + (r * 7 + c * 3) % 11) for r in range(40) for c in range(2) if (r, c) != (3, 1)]
    df = spark.createDataFrame(rows, "r int, c int, n int").select("r", "c", F.explode(F.sequence(F.lit(1), "n")))
    got = S.chi_square_test(df, "r", "c").first()
    grid = np.zeros((40, 2))
    for r, c, n in rows:
        grid[r, c] = n
    ex = grid.sum(1, keepdims=True) * grid.sum(0) / grid.sum()
    assert got.dof == 39 and got.chi2 == pytest.approx(((grid - ex) ** 2 / ex).sum())
    assert got.significant is not None
    limit = spark.range(1).select(S.critical_value(F.lit(39)).alias("x")).first().x
    assert limit == pytest.approx(54.572227758941736)


def test_two_by_two_with_empty_cells(spark):
    for cells in ({(0, 0): 30, (0, 1): 9, (1, 0): 21}, {(0, 0): 30, (1, 1): 12}):
        df = spark.createDataFrame([(*k, n) for k, n in cells.items()], "r int, c int, n int").select(
            "r", "c", F.explode(F.sequence(F.lit(1), "n")))
        n = sum(cells.values())
        R_ = [sum(v for (r, _), v in cells.items() if r == i) for i in (0, 1)]
        C_ = [sum(v for (_, c), v in cells.items() if c == i) for i in (0, 1)]
        want = sum(max(abs(cells.get((r, c), 0) - R_[r] * C_[c] / n) - 0.5, 0) ** 2 / (R_[r] * C_[c] / n) for r in (0, 1) for c in (0, 1))
        assert S.chi_square_test(df, "r", "c").first().chi2 == pytest.approx(want)


def test_segment_risk_at_billions_of_rows(spark):
    from cohortlens.plans.eda import risk_from_counts
    one = spark.createDataFrame([(3_000_000_000, 5_000_000_000, 600_000_000, 500_000_000)], "n1 long, n0 long, e1 long, e0 long")
    got = risk_from_counts(one).first()
    assert (got.relative_risk, got.pct_higher, got.excess_events) == (2.0, 100.0, 300_000_000.0)


def test_rank_test_reads_its_values_once(spark, monkeypatch):
    """The value frequencies are stored, and ranks over more slices than one tree node has are exact."""
    stored = []
    real = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name, **kw: stored.append(name) or real(df, name, **kw))
    df = spark.range(6_000).select(((F.col("id") * 7919) % 4_001 / 8).alias("x"), (F.col("id") % 3 == 0).alias("first"))
    got = S.mann_whitney_from_freq(S.rank_frequencies(df, "x", F.col("first")), rows_per_slice=40).first()
    assert stored == ["rank-frequencies"]
    rows = [(r["x"], r["first"]) for r in df.collect()]
    one, other = [[x for x, f in rows if f is side] for side in (True, False)]
    import bisect
    other.sort()
    u1 = sum((bisect.bisect_left(other, x) + bisect.bisect_right(other, x)) / 2 for x in one)
    assert (got["n1"], got["n0"], got["u1"], got["u2"]) == (2_000, 4_000, u1, 8_000_000 - u1)
