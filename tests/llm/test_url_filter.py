import re

from pyspark.sql import functions as F

from cohortlens.llm import url_filter as U

URLS = ["http://Example.ORG/es/a?x=1", "https://m.sub.example.org/en/12.html", "https://example.org/en/2", "http://a.com/de/1",
        "http://a.com/fr/1#top", "ftp://x.net", "http://spam.net/a/", "https://www.spam.net/a.html?utm=1", "http://spam.net:80/a",
        "no scheme", "", None, "://", "http://notexample.org.evil.net/es/", "http://h?x://y/de/", "http://a.com", "a://b://c/d",
        "http://spam.net/b", "http://\u00dcber.com/de/x", "http://com/de/", "http://org"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    tail = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", tail)[0]
    path = re.match(r"[^?#]*", tail[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in U.BASE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits) if fits else None


def test_rules_and_list_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    listed = spark.createDataFrame([("spam.net/a",), (None,), ("other.net/z",)], "canonical string")
    got = {r.page_id: r for r in U.filter_urls(pages, listed).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule = brute(url)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule[1] if rule else None), url
        assert r.verdict == (rule[2] if rule else "block" if r.canonical == "spam.net/a" else "allow"), url
    assert {URLS[i] for i, r in got.items() if r.listed} == {"http://spam.net/a/", "https://www.spam.net/a.html?utm=1", "http://spam.net:80/a"}


def test_filter_passes_every_listed_url_and_the_join_removes_false_hits(spark):
    n = 3000
    pages = spark.range(2 * n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.net/p"), "id").alias("url"))
    listed = spark.range(n).select(F.concat(F.lit("h.net/p"), F.col("id") * 2).alias("canonical"))
    got = U.filter_urls(pages, listed, bits_per_item=8)
    counts = got.agg(F.count_if("listed").alias("listed"), F.count_if("possible_hit").alias("possible"),
                     F.count_if((F.col("page_id") % 2 == 0) != F.col("listed")).alias("wrong"),
                     F.count_if(F.col("listed") & ~F.col("possible_hit")).alias("missed")).first()
    assert counts.listed == n and counts.wrong == 0 and counts.missed == 0
    assert n <= counts.possible < n + n // 4
    shuffled = U.filter_urls(pages, listed, broadcast_blocks=0)
    assert shuffled.agg(F.count_if("listed")).first()[0] == n


def test_empty_tables_extra_columns_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "mine", 5), (1, "http://a.net/x", "mine", 5)], "page_id long, url string, verdict string, b0 int")
    none = spark.createDataFrame([], "canonical string")
    rows = U.filter_urls(pages.withColumnRenamed("b0", "other"), none).collect()
    assert [r.verdict for r in rows] == ["allow", "allow"] and rows[0].other == 5
    assert U.filter_urls(pages.limit(0), none).count() == 0


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    plan = U.filter_urls(pages, spark.createDataFrame([("a.net/x",)], "canonical string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
