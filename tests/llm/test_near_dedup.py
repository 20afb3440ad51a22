import random

import numpy as np
import pytest
from llm_data import edge_rows, frame, words

from cohortlens.llm import near_dedup as N
from cohortlens.llm.components import connected_components


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    if len(w) >= k:
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def brute(rows, k, num, den):
    """Smallest reachable id of every row."""
    s = [sets_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and den * both >= num * len(s[i] | s[j]):
                root[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return [(rows[i][0], len(s[i]), low.get(top(i))) for i in range(len(rows))]


def near_copies(seed, groups=12, size=9):
    rnd = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = words(rnd, rnd.randint(30, 200), 3000).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randint(0, len(w) // 25)):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
            rows.append((i, " ".join(w)))
            i += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_components_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    for k, num in ((3, 85), (5, 80)):
        rows = near_copies(k)
        got = N.near_components(frame(spark, rows), shingle=k, num=num, den=100).collect()
        want = {d: (n, c) for d, n, c in brute(rows, k, num, 100)}
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edge_cases(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    df = frame(spark, edge_rows()).selectExpr("*", "1 AS v", "2 AS kept")
    found = N.near_components(df, shingle=3, num=85, den=100)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str)
    want = sorted(((d, n, c if c is not None else d) for d, n, c in brute(rows, 3, 85, 100)), key=str)
    assert got == want
    kept = N.one_per_group(df, found)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    # 5 copies 1 (as 9 and 11 may); the blank ones and both texts of id 12 stay.
    alone = {c for _, _, c in want}
    assert set(ids) == alone and ids.count(12) == 2 and ids.count(5) == 0
    assert N.near_components(df.limit(0)).count() == 0


def test_one_of_repeated_rows_stays(spark):
    df = frame(spark, [(1, "a b c d e f g")] * 3 + [(2, "x y")] * 2 + [(3, None)])
    kept = N.one_per_group(df, N.near_components(df))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


def test_odd_sketch_estimates_high_similarities():
    rng = np.random.default_rng(1)
    mult = N.multipliers(N.SAMPLES)
    for j in (0.8, 0.9, 0.97):
        n = 3000
        both = rng.integers(0, 2**63, int(n * 2 * j / (1 + j)), dtype=np.uint64)
        a = np.unique(np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)]))
        b = np.unique(np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)]))
        bits = np.bitwise_count(N.odd_sketch(a, mult) ^ N.odd_sketch(b, mult)).sum()
        assert abs(N.estimate(np.array([bits]))[0] - j) < 0.04


def test_bands_keep_pairs_at_the_threshold():
    for t in (0.8, 0.85):
        assert (1 - t ** N.ROWS) ** N.bands_needed(t) <= 1e-6


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200, 202: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
