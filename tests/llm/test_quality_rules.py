import re
from collections import Counter

from llm_data import edge_rows, frame

from cohortlens.llm import quality_rules as Q


def brute(text):
    text = text or ""
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    count = Counter(wins)
    covered = {j for i, w in enumerate(wins) if count[w] > 1 for j in range(i, i + 5)}
    n = len(ws)
    return (n, sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


TEXTS = ["a b c d e a b c d e a b c d e f g h i j", "x\n\nx\n x\ny\ny", "#*$%&|<> " * 12, "w " * 40,
         "the quick \u00e9t\u00e9 \U0001f600 fox jumps over the lazy dog and runs off again", "a\x0bb\x0cc\rd\x1ce\u00a0f"]


def test_measures_against_brute_force(spark):
    rows = [(100 + i, t) for i, t in enumerate(TEXTS)] + edge_rows()
    got = Q.quality_rules(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), r.doc_id
        assert not (r.base_failed and r.kept)


def test_plain_prose_is_kept_and_junk_is_not(spark):
    prose = "The history of the town is long and the people of the region tell it in many ways. It was built near a river."
    got = {r.doc_id: r for r in Q.quality_rules(frame(spark, [(1, prose), (2, "### " * 40), (3, prose.replace(" ", " | "))])).collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept and "symbol_ratio" in got[3].failed_rules


def test_empty_table_clashing_columns_and_plan(spark):
    df = frame(spark, [(1, "a b")]).selectExpr("*", "7 AS n_words", "'x' AS kept", "1 AS __words")
    r = Q.quality_rules(df).first()
    assert r.n_words == 2 and r.kept is False and r["__words"] == 1
    assert Q.quality_rules(df.limit(0)).count() == 0
    plan = Q.quality_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
