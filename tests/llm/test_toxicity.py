import random
import zlib

import numpy as np
from llm_data import edge_rows, frame, words

from cohortlens.llm import toxicity as T
from cohortlens.llm.common import read_table


def test_held_out_accuracy_on_the_given_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    model = T.fit(docs, labels.filter(~T.held_out(labels.doc_id)))
    got = T.score_toxicity(docs.select("doc_id", "text"), model).toPandas()
    assert ((got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4) == 2) == got.held_out).all()
    m = got.merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    assert ((m.predicted == 1) == (m.score >= 0.3)).all()
    rank = m.score.rank()
    pos, neg = (m.toxic == 1).sum(), (m.toxic == 0).sum()
    assert (rank[m.toxic == 1].sum() - pos * (pos + 1) / 2) / (pos * neg) > 0.85


def _trained(spark):
    rnd = random.Random(2)
    rows = [(i, words(rnd, 60) + (" nastyword" if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    return T.fit(frame(spark, rows), labels)


def test_unseen_documents_and_edge_cases(spark):
    model = _trained(spark)
    rows = edge_rows() + [(100, words(random.Random(9), 50) + " nastyword nastywords")]
    df = frame(spark, rows).selectExpr("*", "5 AS score", "true AS held_out")
    got = T.score_toxicity(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[100].predicted == 1 and by[1].predicted == 0 and by[2].score == by[3].score == by[4].score
    assert by[None].held_out is False
    assert T.score_toxicity(df.limit(0), model).count() == 0


def test_score_depends_on_the_text_only(spark):
    model = _trained(spark)
    a = frame(spark, [(1, "some text here", "en", "src0"), (2, "some text here", "fr", "src9")])
    assert len({r.score for r in T.score_toxicity(a, model).collect()}) == 1


def test_labels_of_one_class_or_none(spark):
    docs = frame(spark, [(1, "a b c"), (2, "d e f")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    for labels, low, high in ((none, 0.49, 0.51), (one, 0.0, 0.01)):
        s = [r.score for r in T.score_toxicity(docs, T.fit(docs, labels)).collect()]
        assert all(low <= x <= high for x in s)


def test_grams_cover_long_words_whole():
    assert set(T.word_grams("a" * 30 + "zq")) & set(T.word_grams("zq")) and len(T.word_grams("")) >= 1
    assert np.isclose(T.shrink(np.array([0.0, 1.0, 25.0])), [5, 5, 1]).all()
