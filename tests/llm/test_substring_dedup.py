import hashlib
import random

import numpy as np
import pytest
from llm_data import edge_rows, frame, words
from pyspark.sql import functions as F

from cohortlens.llm import substring_dedup as S


def brute(rows, w):
    first = {}
    for i, t in rows:
        if i is None:
            continue
        ws = (t or "").encode().split()
        for s in range(len(ws) - w + 1):
            k = tuple(ws[s:s + w])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        ws = (t or "").encode().split()
        gone = [False] * len(ws)
        for s in range(len(ws) - w + 1):
            if i is not None and first[tuple(ws[s:s + w])] < i:
                gone[s:s + w] = [True] * w
        kept = b" ".join(x for x, g in zip(ws, gone) if not g)
        out.append((i, len(ws), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    rows = df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h")).collect()
    return sorted((tuple(r) for r in rows), key=str)


def passages(seed, w):
    """Documents that share passages around the threshold, chains of overlaps, periodic text."""
    rnd = random.Random(seed)
    shared = [words(rnd, n, 2000).split() for n in (w - 1, w, w + 1, 3 * w, 5 * w)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            parts += words(rnd, rnd.randint(0, 40), 2000).split()
            p = rnd.choice(shared)
            a = rnd.randint(0, len(p) // 2)
            parts += p[a:]
        rows.append((i, " ".join(parts)))
    rows += [(70, "same " * 300), (71, "x " + "same " * 200 + "y"), (72, "a b " * 100), (73, "b a " * 90), (74, rows[3][1]), (75, rows[3][1].replace(" ", "\n"))]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot_rows", [S.HOT_ROWS, 3])
@pytest.mark.parametrize("w", [12, 50])
def test_removal_against_brute_force(spark, w, hot_rows):
    rows = passages(w, w)
    got = S.remove_repeats(frame(spark, rows), window=w, hot_rows=hot_rows)
    assert result(got) == brute(rows, w)


def test_edge_cases(spark):
    df = frame(spark, edge_rows()).selectExpr("*", "1 AS key", "2 AS n_words", "'q' AS spans_", "3 AS lo")
    assert result(S.remove_repeats(df)) == brute([(r[0], r[1]) for r in edge_rows()], 50)
    assert S.remove_repeats(df.limit(0)).count() == 0
    out = S.without_repeats(frame(spark, edge_rows()))
    assert out.columns == frame(spark, edge_rows()).columns
    by = {r.doc_id: r for r in out.collect()}
    assert by[5].text == "" and by[5].n_chars == 0 and by[4].text == " \n\t " and by[2].text is None


def test_automaton_matching_statistics():
    rnd = random.Random(5)
    for _ in range(40):
        a, texts = S.SuffixAutomaton(), []
        for _ in range(rnd.randint(1, 4)):
            t = [rnd.choice("abc") for _ in range(rnd.randint(1, 25))]
            texts.append(t)
            a.add(t)
        q = [rnd.choice("abc") for _ in range(30)]
        for least in (1, 2, 4):
            subs = {tuple(t[i:i + least]) for t in texts for i in range(len(t) - least + 1)}
            assert a.ends(q, least) == [i for i in range(least - 1, 30) if tuple(q[i - least + 1:i + 1]) in subs]


def test_anchor_runs_name_equal_windows_alike():
    h = np.random.default_rng(2).integers(0, 40, 400).astype(np.uint64)
    names = {}
    anchors, lo, hi = S.anchor_runs(h, 20)
    assert lo[0] == 0 and hi[-1] == 380 and (lo[1:] == hi[:-1] + 1).all()
    g = S.gram_hash(h, S.GRAM)
    for a, x, y in zip(anchors, lo, hi):
        for s in range(x, y + 1):
            assert g[s:s + 20 - S.GRAM + 1].min() == a
            assert names.setdefault(tuple(h[s:s + 20]), a) == a
