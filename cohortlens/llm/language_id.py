r"""Language identification by Bayesian evidence fusion.

For every document the posterior over languages is the product of

* the text's likelihood: character 3-grams inside words, multinomial with add-one
  smoothing, fitted on at most about ``train_rows`` rows (a hash filter on the id,
  so the expected number is bounded; a documented parameter) with their declared
  language as label; a long text counts as ``max_grams`` grams at most in weight,
  though all of its grams are read;
* the likelihood of the declared (markup) language given the true one, from grouped
  counts of (declared, text language) over all documents;
* a prior from the address: counts of text languages per host, smoothed towards the
  registered domain, that towards the address suffix, that towards the corpus.

Text scores are one map over the documents; everything after it works on slim rows
(id, scores, host, declared) and grouped counts with map-side combining, so a host
that holds a third of all rows is one row per map task.  The prior tables are joined
by host and by domain as ordinary joins (splittable when skewed).

``kept`` is false where the text has no letters or digits, or where no language
reaches ``min_posterior``.

Defined cases: null and empty texts have a null language and are rejected.  A null
declared language or host is its own value (``""``), shared with the empty string.
Repeated rows get equal results.  An empty table gives an empty result.  Extra
columns are ignored by ``identify``; ``accepted_documents`` returns the input's
columns unchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, key_list, lean, row_key, stored

BITS = 15
TRAIN_ROWS = 8_000


def word_grams(word: str) -> list[int]:
    w = b" " + word.encode("utf-8", "surrogatepass") + b" "
    return [zlib.crc32(w[i:i + 3]) & ((1 << BITS) - 1) for i in range(max(1, len(w) - 2))]


class WordRows(dict):
    """word -> row of ``table``: the sums of the word's grams' columns.  Rows past
    ``limit`` are scratch, rewritten by each call of ``sum``."""

    SCRATCH = 4096

    def __init__(self, grams: np.ndarray, limit: int):
        super().__init__()
        self.grams, self.limit, self.n, self.spare = grams, limit, 0, 0
        self.table = np.zeros((limit + self.SCRATCH, grams.shape[1]), grams.dtype)
        self.new: list[tuple[int, str]] = []

    def __missing__(self, word: str) -> int:
        if self.n < self.limit:
            at = self[word] = self.n
            self.n += 1
        else:
            at = self.limit + self.spare
            self.spare += 1
        self.new.append((at, word))
        return at

    def fill(self) -> None:
        """Compute the rows of the words that have just been met."""
        grams = [word_grams(w) for _, w in self.new]
        first = np.cumsum([0, *[len(g) for g in grams[:-1]]])
        flat = self.grams[np.array([x for g in grams for x in g], np.int64)]
        self.table[[at for at, _ in self.new]] = np.add.reduceat(flat, first, axis=0)
        self.new = []

    def sum(self, words: list[str]) -> np.ndarray:
        out = np.zeros(self.table.shape[1], np.float64)
        for i in range(0, len(words), self.SCRATCH):
            self.spare = 0
            part = words[i:i + self.SCRATCH]
            rows = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            if self.new:
                self.fill()
            out += self.table[rows].sum(0, dtype=np.float64)
        return out


def primary_tag(code: Column) -> Column:
    """``pt-BR`` -> ``pt``; null -> empty."""
    return F.lower(F.regexp_extract(F.coalesce(code, F.lit("")), "^([A-Za-z]*)", 1))


def registered_domain(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1)


def host_suffix(host: Column) -> Column:
    return F.regexp_extract(host, r"\.([^.]*)$", 1)


def fit_text_model(rows: DataFrame, train_rows: int) -> tuple[list[str], np.ndarray]:
    """Languages and log P(gram | language), from ``rows`` (id, text, declared)."""
    total = rows.select("id").count()
    if not total:
        return [], np.zeros((1 << BITS, 0), np.float32)
    share = min(1.0, train_rows / total)
    sample = rows.filter((F.col("declared") != "") & F.col("text").isNotNull())
    if share < 1:
        sample = sample.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("declared"), strict=True):
                grams = [g for w in text.as_py().lower().split() for g in word_grams(w)]
                if lang.as_py() not in held:
                    held[lang.as_py()] = np.zeros(1 << BITS, np.int64)
                held[lang.as_py()] += np.bincount(np.array(grams, np.int64), minlength=1 << BITS)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])],
                                             ["lang", "g", "n"])

    counts = stored(sample.select("text", "declared").mapInArrow(lean(count), "lang string, g long, n long")
                    .groupBy("lang", "g").agg(F.sum("n").alias("n")), "language-grams")
    # Every language that the sample declares; the sample's size bounds them.
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    table = np.ones((1 << BITS, len(langs)))
    place = {lang: i for i, lang in enumerate(langs)}
    # At most 2 ** BITS rows for each language.
    for lang, g, n in counts.collect():
        table[g, place[lang]] += n
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def text_scores(rows: DataFrame, table: np.ndarray, max_grams: int) -> DataFrame:
    """id, key, declared, host, scores (log likelihood by language, weighted), n_letters."""
    slim = rows.select("id", row_key("id", "text").alias("key"), "declared", "host", "text")
    kind = slim.schema["id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(table)   # 2 ** BITS x languages floats

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordRows(np.concatenate([shared.value, np.ones((1 << BITS, 1), np.float32)], 1), 250_000)
        for batch in batches:
            scores, known = [], []
            for text in batch.column("text"):
                s = words_of.sum((text.as_py() or "").lower().split())
                n = s[-1]
                scores.append((s[:-1] * min(1.0, max_grams / n)).tolist() if n else s[:-1].tolist())
                known.append(bool(n) and any(map(str.isalnum, text.as_py())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "key", "declared", "host")]
                + [pa.array(scores, pa.list_(pa.float64())), pa.array(known)],
                ["id", "key", "declared", "host", "scores", "known"])

    return slim.mapInArrow(lean(score), f"id {kind}, key long, declared string, host string, scores array<double>, known boolean")


def _smoothed(own: list[Column], above: list[Column], weight: float) -> list[Column]:
    n = own[0]
    for c in own[1:]:
        n = n + c
    return [(c + weight * p) / (n + weight) for c, p in zip(own, above, strict=True)]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang",
             host_col: str = "source", evidence: DataFrame | None = None, train_rows: int = TRAIN_ROWS,
             max_grams: int = 200, smoothing: float = 20.0, min_posterior: float = 0.5) -> DataFrame:
    """One row per document: id_col, language, posterior, text_language, declared, host, kept, __key.

    ``evidence`` (id, declared, host), at most one row per id, overrides the declared
    language and host that come with the documents."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       primary_tag(F.col(declared_col)).alias("declared"),
                       F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))
    langs, table = fit_text_model(rows, train_rows)
    names = ["id", "key", "language", "posterior", "text_language", "declared", "host", "kept"]
    if not langs:
        none = F.lit(None).cast("string")
        out = rows.select("id", row_key("id", "text").alias("key"), none.alias("language"), F.lit(0.0).alias("posterior"),
                          none.alias("text_language"), "declared", "host", F.lit(False).alias("kept"))
        return out.select(*names).withColumnsRenamed({"id": id_col, "key": "__key"})
    scored = stored(text_scores(rows, table, max_grams), "language-scores")
    if evidence is not None:
        seen = evidence.select(F.col("id").alias("__id"), primary_tag(F.col("declared")).alias("__declared"),
                               F.col("host").alias("__host"))
        scored = (scored.join(seen, F.col("id") == F.col("__id"), "left")
                  .withColumn("declared", F.when(F.coalesce("__declared", F.lit("")) != "", F.col("__declared"))
                              .otherwise(F.col("declared")))
                  .withColumn("host", F.coalesce("__host", "host")).drop("__id", "__declared", "__host"))
    known_langs = F.array(*[F.lit(x) for x in langs])
    best = F.array_position("scores", F.array_max("scores")).cast("int")
    scored = (scored.withColumn("best", F.when(F.col("known"), best - 1))
              .withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", host_suffix(F.col("host"))))

    size = range(len(langs))
    counted = [F.sum(F.when(F.col("best") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in size]
    summed = [F.sum(f"n{i}").alias(f"n{i}") for i in size]
    # Grouped counts, from the finest level upwards; each level re-groups the one below.
    by_host = scored.groupBy("host", "domain", "suffix").agg(*counted)
    by_domain = by_host.groupBy("domain", "suffix").agg(*summed)
    by_suffix = by_domain.groupBy("suffix").agg(*summed)
    overall = by_suffix.agg(*summed).collect()[0]
    total = sum(overall[i] or 0 for i in size)
    base = [F.lit(((overall[i] or 0) + 1) / (total + len(langs))) for i in size]

    def level(df: DataFrame, key: str, above: list[Column]) -> DataFrame:
        return df.select(key, *[c.alias(f"p_{key}{i}") for i, c in enumerate(
            _smoothed([F.col(f"n{i}") for i in size], above, smoothing))])

    suffixes = level(by_suffix, "suffix", base)
    domains = level(by_domain.join(suffixes, "suffix"), "domain", [F.col(f"p_suffix{i}") for i in size])
    hosts = level(by_host.join(domains, "domain"), "host", [F.col(f"p_domain{i}") for i in size])
    # P(declared | language): one row per declared code.
    codes = scored.groupBy("declared").agg(*counted)
    codes = codes.select("declared", *[
        F.log((F.col(f"n{i}") + 0.5) / F.lit((overall[i] or 0) + 0.5 * (len(langs) + 1))).alias(f"d{i}") for i in size])

    df = scored.join(hosts, "host").join(codes, "declared")
    logs = F.array(*[F.get("scores", F.lit(i)) + F.log(F.col(f"p_host{i}")) + F.col(f"d{i}") for i in size])
    df = df.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    norm = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    df = (df.withColumn("language", F.when(F.col("known"), F.get(known_langs, F.array_position("logs", F.col("top")).cast("int") - 1)))
          .withColumn("posterior", F.when(F.col("known"), 1 / norm).otherwise(0.0))
          .withColumn("text_language", F.get(known_langs, F.col("best"))))
    df = df.withColumn("kept", F.col("known") & (F.col("posterior") >= min_posterior))
    return df.select(*names).withColumnsRenamed({"id": id_col, "key": "__key"})


def page_evidence(pages: DataFrame) -> DataFrame:
    """(id, declared, host) from crawled pages: the document number at the end of the
    url's path, the language of the first ``<html ...>`` tag, wherever it stands, and the
    host.  The smallest page that declares a language speaks, without one the smallest."""
    path = F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    number = F.regexp_extract(path, r"/(\d{1,18})(?:\.html|/)?$", 1)
    tag = F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), r"(?i)<html(?:\s[^>]*)?>", 0)
    found = pages.select(
        F.when(number != "", number.cast("long")).alias("id"), "page_id",
        F.regexp_extract(tag, r"(?i)\slang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("declared"),
        F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)).alias("host"))
    silent = (F.col("declared") == "").alias("silent")
    return (found.filter(F.col("id").isNotNull())
            .groupBy("id").agg(F.min(F.struct(silent, "page_id", "declared", "host")).alias("p"))
            .select("id", "p.declared", "p.host"))


def accepted_documents(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected rows."""
    key, row = fresh(docs, "key"), fresh(docs, "row")
    gone = key_list(decisions.filter(~F.col("kept")).select(F.col("__key").alias(key)).distinct(), "language-rejected")
    keyed = docs.withColumn(row, row_key(id_col, F.col(text_col).cast("string")))
    return keyed.join(gone, F.col(row) == F.col(key), "left_anti").drop(row)
