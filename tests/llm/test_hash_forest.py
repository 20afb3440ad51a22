import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm import hash_forest as H

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score double, query string, v int"


def run(spark, rows, k=20, **kw):
    df = spark.createDataFrame([(*r, 1, "x", 1.0, "y", 7) for r in rows], SCHEMA)
    got = H.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k, **kw)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def brute(rows, k=20):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None
          and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (q, v) in enumerate(ok):
        if q % 20 == 0:
            near = sorted((-float(v @ w), i) for m, (i, w) in enumerate(ok) if m != n)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


def close(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)


def sample(n, dims=64, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dims)).astype(np.float32)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_small_tables_ascend_to_every_row(spark):
    rows = [(i, v) for i, v in sample(50, 8)] + [
        (None, [1.0] * 8), (100, None), (120, [0.0] * 8), (140, [float("nan")] * 8), (160, [1.0] * 7 + [None]),
        (180, [float("-inf")] + [1.0] * 7), (200, [])]
    close(run(spark, rows), brute(rows))


def test_common_vector_repeated_rows_and_ties(spark):
    # Components are eighths, so scores are exact and equal ones tie: the smaller id comes first.
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-8, 9, 6) / 8).tolist()) for i in range(1, 60)]
    rows = [r for r in rows if any(r[1])] + [(100 + i, [0.5] * 6) for i in range(90)] + [(100, [0.5] * 6)]
    got, want = run(spark, rows, shard_rows=40, min_candidates=10_000), brute(rows)
    close(got, want)


def test_recall_against_brute_force_with_unequal_norms(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (np.array(v) * rng.uniform(0.7, 1.0)).astype(np.float32).tolist()) for i, v in sample(6_000)]
    got, want = run(spark, rows, shard_rows=3_000), brute(rows)
    hits = {(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}
    assert len(hits) >= 0.9 * len(want)
    scores = {(q, i): s for q, _, i, s in want}
    assert all(abs(scores[q, i] - s) < 1e-12 for q, _, i, s in got if (q, i) in scores)
    assert all(r == n % 20 + 1 for n, (_, r, _, _) in enumerate(got))


def test_rounds_give_the_same_result(spark):
    rows = sample(400, 16)
    assert run(spark, rows, round_queries=3) == run(spark, rows)


def test_ascent_takes_whole_prefixes_until_there_are_enough():
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(3_000, 64)), rng.normal(size=(25, 64))
    strings, queries = H.hash_strings(x, 6), H.hash_strings(q, 6)
    start, stop = H.candidate_places(np.sort(strings.T, axis=1), queries, 300)
    for i in range(25):
        def shared(bits, i=i):
            return ((strings ^ queries[i]) >> np.uint32(H.BITS - bits) == 0).sum(axis=0) if bits else np.full(6, 3_000)
        depth = max(b for b in range(H.BITS + 1) if shared(b).sum() >= 300)
        assert (stop[i] - start[i]).tolist() == shared(depth).tolist()


def test_empty_table_and_no_query(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 0.0])]) == []
    assert run(spark, [(20, [1.0, 2.0])]) == []
