import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score double, v int, anchor string"


def vectors(spark, rows):
    """rows: (vec_id, vector, label); the extra columns clash with the operator's own names."""
    return spark.createDataFrame([(*r, "x", 1.0, 7, "y") for r in rows], SCHEMA)


def brute(rows, dims, positives=5, negatives=10):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (dims - len(v)), lab) for i, v, lab in rows
          if i is not None and v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (ai, av, al) in enumerate(ok):
        if ai % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(av, v)), i, n) for n, (i, v, _) in enumerate(ok) if n != a]
        for ps, pid, _ in sorted(s for s in scored if ok[s[2]][2] == al)[:positives]:
            neg = sorted(s for s in scored if ok[s[2]][2] != al and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:negatives]
            out += [(ai, pid, r, i, -ps, -s) for r, (s, i, _) in enumerate(neg, 1)]
    return sorted(out)


def run(spark, rows, **kw):
    got = H.mine(vectors(spark, rows), F.col("label"), F.col("vec_id") % 100 == 0, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def sample(n, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=dims).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]


def test_equals_brute_force_with_edge_rows(spark):
    rows = sample(420) + [
        (None, [1.0] * 16, 1), (500, None, 1), (501, [1.0] * 15 + [None], 2), (502, [float("nan")] * 16, 2),
        (503, [float("inf")] + [0.0] * 15, 1), (600, [1.0] * 16, None), (700, [0.0] * 16, 1), (800, [], 2),
        (900, [0.5] * 9, 3), (900, [0.5] * 9, 3), (901, [0.5] * 9, 3), (902, [0.5] * 9, 1), (902, [0.5] * 9, 1)]
    rows += [(1000 + i, [0.25] * 16, 0) for i in range(120)]          # one common vector: ties by id
    want = brute(rows, 16)
    assert run(spark, rows) == want and want
    assert run(spark, rows, round_queries=3) == want                  # several rounds of anchors


def test_wide_and_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=150) * 300).astype(np.float32).tolist(), i % 3) for i in range(0, 900, 10)]
    assert run(spark, rows) == brute(rows, 150)


def test_residues_reconstruct_signed_products():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-9_000, 9_000, (50, 70)), rng.integers(-9_000, 9_000, (40, 70))
    bound = int((np.abs(a).max(axis=0).astype(object) * np.abs(b).max(axis=0)).sum())
    primes = H.primes_for(bound)
    got = H.reconstruct(H.products(H.residues(a, primes), H.residues(b, primes), primes), primes)
    assert (got == a @ b.T).all()
    with pytest.raises(ValueError):
        H.primes_for(1 << 51)


def test_empty_table_and_no_anchor(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert run(spark, [(0, [1.0], 1)]) == []


def test_query_equals_sql(spark):
    import duckdb
    from conftest import SMOKE

    from cohortlens.llm.queries import QUERIES, SQL
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMOKE}/embeddings.parquet'")
    want = sorted(con.execute(SQL["op11_hard_negatives"]).fetchall())
    got = QUERIES["op11_hard_negatives"](spark, SMOKE)
    assert sorted(tuple(r) for r in got.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == want
