import math
import random
from collections import Counter, defaultdict

import pytest
from llm_data import edge_rows, frame, words

from cohortlens.llm import quality_lm as K


def brute(trusted, docs, langs, vocabulary=K.VOCABULARY, shrink=20.0):
    """Interpolated modified Kneser-Ney bigrams with dictionaries."""
    tok = lambda t: [K.plain(w) for w in K.words_of(t)]
    counts = Counter(w.strip(".,;:!?") for t in trusted for w in t.lower().split() if w.strip(".,;:!?"))
    top = sorted((w for w in counts if counts[w] > 1), key=lambda w: (-counts[w], w))[:vocabulary]
    rare = len(counts) - len(top)
    known = set(top)
    cls = lambda w: w if w in known else "<unk>"
    pairs = Counter(p for t in trusted for p in zip(["<s>", *map(cls, tok(t))], map(cls, tok(t))))
    n = Counter(pairs.values())
    d = K.discounts(n[1], n[2], n[3], n[4])
    total, kinds, cont = Counter(), defaultdict(Counter), Counter()
    for (v, w), c in pairs.items():
        total[v] += c
        kinds[v][min(c, 3)] += 1
        cont[w] += 1
    size = len(top) + 2
    low = lambda w: (max(cont[w] - 0.75, 0) + 0.75 * len(cont) / size) / max(1, sum(cont.values()))
    logp = {}
    for i, t in docs.items():
        s, ws = 0.0, [cls(w) for w in tok(t)]
        for v, w in zip(["<s>", *ws], ws):
            c = pairs[v, w]
            g = sum(d[k] * m for k, m in kinds[v].items()) / total[v] if total[v] else 1.0
            p = max(c - d[min(c, 3)], 0) / max(total[v], 1) + g * low(w)
            s += math.log(max(p, 1e-12)) - (math.log(max(1, rare)) if w == "<unk>" else 0)
        logp[i] = (s, len(ws))
    out = {}
    for i, (s, m) in logp.items():
        same = [logp[j] for j in logp if langs[j] == langs[i]]
        mean = sum(x for x, _ in same) / max(1, sum(k for _, k in same))
        out[i] = math.exp(-(s + shrink * mean) / (m + shrink)) if m else None
    return out


def test_perplexity_against_brute_force(spark):
    rnd = random.Random(8)
    rows = [(i, words(rnd, rnd.randint(1, 80), 60) + rnd.choice(["", ".", "!?", " ..."]), rnd.choice(["en", "fr"]), "s") for i in range(120)]
    rows += [(500, "unseen things only", "en", "s"), (501, None, "en", "s"), (502, "", "fr", "s")]
    df = frame(spark, rows)
    trusted = spark.createDataFrame([(i,) for i in range(0, 120, 2)], "doc_id long")
    got = {r.doc_id: r for r in K.score_quality(df, trusted, chunk_words=500).collect()}
    learned = {r.doc_id for r in trusted.filter(~K.held_back(trusted.doc_id)).collect()}
    assert 30 < len(learned) < 60
    want = brute([t for i, t, *_ in rows if i in learned], {i: t for i, t, *_ in rows}, {r[0]: r[2] for r in rows})
    assert set(got) == set(want)
    for i, p in want.items():
        assert (got[i].perplexity is None) == (p is None) and (p is None or got[i].perplexity == pytest.approx(p, rel=1e-9)), i
    assert not got[501].kept and not got[502].kept and got[501].n_words == 0


def test_trusted_text_is_kept_and_junk_is_not(spark):
    rnd = random.Random(3)
    good = [(i, words(rnd, 80, 50), "en", "s") for i in range(350)]
    junk = [(900 + i, " ".join(f"z{rnd.random()}$$" for _ in range(80)), "en", "s") for i in range(20)]
    trusted = spark.createDataFrame([(i,) for i in range(250)], "doc_id long")
    got = {r.doc_id: r.kept for r in K.score_quality(frame(spark, good + junk), trusted).collect()}
    # Documents that the model has not seen are judged like the trusted ones.
    assert sum(got[i] for i in range(250, 350)) >= 92 and not any(got[900 + i] for i in range(20))


def test_edge_cases(spark):
    rows = edge_rows()
    df = frame(spark, rows).selectExpr("*", "1 AS perplexity", "2 AS chunk")
    trusted = spark.createDataFrame([(1,), (8,), (None,), (8,), (77,)], "doc_id long")
    got = K.score_quality(df, trusted).collect()
    assert len(got) == len(rows) and {r.lang for r in got if r.doc_id == 4} == {""}
    none = spark.createDataFrame([], "doc_id long")
    free = K.score_quality(df, none).collect()
    assert len(free) == len(rows) and all(r.kept == (r.n_words > 0) for r in free)
    assert K.score_quality(df.limit(0), trusted).count() == 0


def test_discounts_of_sparse_counts():
    assert list(K.discounts(0, 1, 1, 1)) == [0, 0.75, 0.75, 0.75]
    d = K.discounts(100, 40, 20, 12)
    y = 100 / 180
    assert d[1] == pytest.approx(1 - 2 * y * 0.4) and d[2] == pytest.approx(2 - 3 * y * 0.5) and d[3] == pytest.approx(3 - 4 * y * 0.6)


def test_members_round_trip():
    import numpy as np
    runs = [[5], [0, 0, 3, 64_999], [64_999], [1, 2, 2], [0]]
    places, holders = np.array(sum(runs, []), "<u2"), np.array([len(r) for r in runs])
    packed = K.squeezed_members(places, np.cumsum(holders) - holders)
    assert K.unsqueezed_members(packed, holders).tolist() == places.tolist()


def test_merged_shards_and_sparse_sums_equal_one_shard(spark, monkeypatch):
    rnd = random.Random(12)
    rows = [(i, words(rnd, rnd.randint(1, 30), 300), "en", "s") for i in range(200)]
    df, trusted = frame(spark, rows), spark.createDataFrame([(i,) for i in range(150)], "doc_id long")
    got = {r.doc_id: r.perplexity for r in K.score_quality(df, trusted).collect()}
    monkeypatch.setattr(K, "MIN_SHARDS", 1)
    one = {r.doc_id: r.perplexity for r in K.score_quality(df, trusted).collect()}
    assert one.keys() == got.keys() and all(got[i] == pytest.approx(p, rel=1e-9) for i, p in one.items())


def test_counts_in_several_arrow_batches_are_used(spark):
    """A vocabulary of thousands of words and a shard's counts in several Arrow batches, against brute force."""
    rnd = random.Random(4)
    many = [f"w{i}" for i in range(35_000)] * 2
    rnd.shuffle(many)
    rows = [(i, " ".join(many[700 * i:700 * i + 700]), "en", "s") for i in range(100)]
    df, trusted = frame(spark, rows), spark.createDataFrame([(i,) for i in range(100)], "doc_id long")
    learned = {r.doc_id for r in trusted.filter(~K.held_back(trusted.doc_id)).collect()}
    want = brute([t for i, t, *_ in rows if i in learned], {i: t for i, t, *_ in rows}, {r[0]: r[2] for r in rows}, vocabulary=None)
    got = {r.doc_id: r.perplexity for r in K.score_quality(df, trusted).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(p, rel=1e-9) for i, p in want.items())
