import random

from llm_data import edge_rows, frame

from cohortlens.llm import language_id as L
from cohortlens.llm.common import read_table

WORDS = {"en": "the and of that with house river stone water morning".split(), "fr": "le la et les avec maison rivière pierre eau matin".split(),
         "de": "der die und von mit haus fluss stein wasser morgen".split()}


def docs(spark, n=240, extra=()):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, " ".join(rnd.choices(WORDS[lang], k=30)), lang, f"www.{lang}site.example.com"))
    return frame(spark, rows + list(extra))


def test_documents_of_the_test_data(spark):
    d = "/root/testdata/sf0.01"
    got = L.identify(read_table(spark, d, "documents"), evidence=L.page_evidence(read_table(spark, d, "pages"))).toPandas()
    truth = read_table(spark, d, "documents").toPandas().set_index("doc_id").lang
    assert len(got) == len(truth) and (got.language == got.doc_id.map(truth)).mean() > 0.97
    assert got.kept.mean() > 0.99


def test_host_and_declared_language_decide_short_texts(spark):
    both = [(900, "a b", "fr", "www.frsite.example.com"), (901, "a b", "de", "www.desite.example.com")]
    got = {r.doc_id: r for r in L.identify(docs(spark, extra=both)).collect()}
    assert got[900].language == "fr" and got[901].language == "de"
    # Clear text beats a wrong declaration and host.
    odd = [(902, " ".join(WORDS["de"] * 8), "fr", "www.frsite.example.com")]
    assert {r.doc_id: r for r in L.identify(docs(spark, extra=odd)).collect()}[902].language == "de"


def test_posterior_against_brute_force(spark):
    """The fusion formula on the operator's own text scores."""
    import numpy as np
    df = docs(spark)
    rows = df.selectExpr("doc_id AS id", "text", "lang AS declared", "source AS host")
    langs, table = L.fit_text_model(rows, L.TRAIN_ROWS)
    scored = L.text_scores(rows, table, 200).toPandas()
    best = np.array([np.argmax(s) for s in scored.scores])
    n = len(langs)
    total = np.bincount(best, minlength=n)
    prior = (total + 1) / (total.sum() + n)

    def level(groups, above):
        out = {}
        for g in set(groups):
            c = np.bincount(best[groups == g], minlength=n)
            out[g] = (c + 20 * above(g)) / (c.sum() + 20)
        return out
    host = scored.host.to_numpy()
    suffix = level(np.array(["com"] * len(host)), lambda g: prior)
    domain = level(np.array(["example.com"] * len(host)), lambda g: suffix["com"])
    hosts = level(host, lambda g: domain["example.com"])
    want = {}
    for i, r in scored.iterrows():
        said = np.array([((best == k) & (scored.declared == r.declared)).sum() for k in range(n)])
        x = np.array(r.scores) + np.log(hosts[r.host]) + np.log((said + 0.5) / (total + 0.5 * (n + 1)))
        p = np.exp(x - x.max())
        want[r.id] = (langs[int(np.argmax(x))], 1 / p.sum())
    for r in L.identify(df).collect():
        assert r.language == want[r.doc_id][0] and abs(r.posterior - want[r.doc_id][1]) < 1e-9


def test_edge_cases(spark):
    rows = [(1000 + i if r[0] is not None else None, *r[1:]) for i, r in enumerate(edge_rows())]
    df = docs(spark, extra=rows).selectExpr("*", "'x' AS key", "1 AS host")
    got = L.identify(df).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got}
    for i in (1001, 1002, 1003):   # null, empty, blank
        assert by[i].language is None and not by[i].kept
    kept = L.accepted_documents(df, L.identify(df))
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    assert L.identify(df.limit(0)).count() == 0
    assert {r.kept for r in L.identify(frame(spark, [(1, "text", None, None)])).collect()} == {False}


def test_more_than_64_languages(spark):
    rows = [(i, " ".join(f"x{i % 70}y{k}" for k in range(20)), chr(97 + i % 70 // 26) + chr(97 + i % 70 % 26), "h") for i in range(280)]
    got = L.identify(frame(spark, rows)).collect()
    want = {r[0]: r[2] for r in rows}
    assert len({r.language for r in got}) == len(set(want.values())) > 64
    assert sum(r.language == want[r.doc_id] for r in got) > 0.95 * len(rows)


def test_markup_language_wherever_the_tag_stands(spark):
    late = "<!-- " + "x" * 10_000 + " -->\n<html class='" + "y" * 500 + "' lang=\"fr-CA\"><body>"
    pages = spark.createDataFrame([
        (1, "http://a.example.com/p/7.html", "<html><body>"), (2, "http://b.example.com/p/7", late),
        (3, "http://c.example.com/p/8", "<htmlx lang=en><HTML\nLANG = de>"), (4, "http://d.example.com/p/9", None),
        (5, "http://e.example.com/p/10", "<html><p lang=es>")], "page_id long, url string, html string")
    got = {r.id: (r.declared, r.host) for r in L.page_evidence(pages).collect()}
    assert got == {7: ("fr-CA", "b.example.com"), 8: ("de", "c.example.com"), 9: ("", "d.example.com"), 10: ("", "e.example.com")}
