"""Every operator on inputs that carry columns named like the operators' own."""

import pytest
from llm_data import frame, words
from pyspark.sql import functions as F

NAMES = ("key", "__key", "__key_", "id", "__id", "__doc", "row", "__row", "text_key", "__text", "y", "spans", "__spans",
         "__span_key", "hash", "v", "n", "u", "m", "band", "bands", "hub", "declared", "host", "__host", "codes", "copies",
         "__listed", "__block", "__in", "__hit", "__slot", "chunk", "ids", "query", "score_", "component", "vertex", "part")


@pytest.fixture(scope="module")
def docs(spark):
    import random
    rnd = random.Random(8)
    text = [words(rnd, 80) for _ in range(24)]
    rows = [(i, text[i % 20] + (" tail" if i >= 20 else "")) for i in range(24)] + [(24, None), (25, "")]
    return with_names(frame(spark, rows))


def with_names(df):
    return df.withColumns({c: F.lit(f"{c} of the input") for c in NAMES if c not in df.columns})


def _items(spark):
    return with_names(spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string"))


def _pages(spark):
    rows = [(1, "http://a.net/en/1.html", "<html lang=en>"), (2, "http://b.org/x", None), (3, None, "x")]
    return with_names(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine")))


def decontamination(spark, docs):
    from cohortlens.llm import decontaminate as D
    return D.clean_documents(docs, D.find_leaks(docs, _items(spark)))


def url_filter(spark, docs):
    from cohortlens.llm import url_filter as U
    listed = with_names(spark.createDataFrame([("a.net/en/1",)], "canonical string"))
    out = U.filter_urls(_pages(spark), listed)
    assert out.select("__key").distinct().collect()[0][0] == "__key of the input"
    return out


def license_scan(spark, docs):
    from cohortlens.llm import license_scan as L
    return L.scan_licenses(docs)


def quality_classifier(spark, docs):
    from cohortlens.llm import quality_lm as Q
    return Q.score_quality(docs, with_names(docs.select("doc_id").filter("doc_id < 15")))


def language_id(spark, docs):
    from cohortlens.llm import language_id as L
    return L.accepted_documents(docs, L.identify(docs, evidence=L.page_evidence(_pages(spark))))


def near_dedup(spark, docs):
    from cohortlens.llm import near_dedup as N
    return N.one_per_group(docs, N.near_components(docs))


def quality_rules(spark, docs):
    from cohortlens.llm import quality_rules as Q
    return Q.quality_rules(docs)


def substring_dedup(spark, docs):
    from cohortlens.llm import substring_dedup as S
    return S.without_repeats(docs)


def packing(spark, docs):
    from cohortlens.llm import packing as P
    return P.with_crc32(P.pack(docs))


def toxicity(spark, docs):
    from cohortlens.llm import toxicity as T
    labels = with_names(docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    return T.score_toxicity(docs, T.fit(docs, labels))


@pytest.mark.parametrize("operator", [decontamination, url_filter, license_scan, quality_classifier, language_id, near_dedup,
                                      quality_rules, substring_dedup, packing, toxicity], ids=lambda f: f.__name__)
def test_clashing_columns(spark, docs, operator):
    rows = operator(spark, docs).collect()
    assert rows
    whole = {"license_scan", "quality_classifier", "quality_rules", "substring_dedup", "toxicity"}
    assert operator.__name__ not in whole or len(rows) == 26


def test_repeated_ids_do_not_multiply_training_rows(spark):
    from cohortlens.llm import toxicity as T
    docs = frame(spark, [(1, f"text {i}") for i in range(50)] + [(2, "other")])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in T.training_rows(docs, labels, "doc_id", "toxic", 10).collect()) == [("other", 0), ("text 0", 1)]
