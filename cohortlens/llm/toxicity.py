r"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features: character 3- to 5-grams inside words (with word borders), hashed into
``2 ** BITS`` buckets; a document has as value of a bucket the number of its
distinct words that hold the gram, divided by the square root of the number of its
distinct words.  That number's logarithm is one more input.  Training, on labelled rows only:

1. ``ratios``: document counts per bucket and class by grouped aggregation;
   ``r = log((p + 1) / (P + 2)) - log((n + 1) / (N + 2))``.
2. ``fit``: logistic regression (L2, Newton-like steps on a diagonal bound) over
   the values times ``r``.  Only buckets whose ratio is at least ``min_ratio`` away
   from 0 and that ``min_docs`` documents hold take part.

Both use at most ``train_rows`` labelled rows (those with the smallest hash of
their id): a documented bound, so the training matrix fits in one place.  Scoring
covers every row and whole texts.  The score is linear in words, so a worker
process remembers each word's sum and a document costs one lookup per word.

Inputs of a score are the text's characters only.

Defined cases: null and empty texts have no features; their score is that of the
intercept.  Without labelled rows of both classes the score is the share of toxic
labels (0.5 without any).  Repeated ids in the labels are each an example.  Extra
columns of the documents are carried; result columns replace input columns of the
same name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bounded, fresh, lean

BITS = 18
GRAMS = (3, 4, 5)
TRAIN_ROWS = 12_000
THRESHOLD = 0.3


def word_grams(word: str) -> list[int]:
    """Distinct buckets of a word's n-grams; long words count with all their characters."""
    w = b" " + word.encode("utf-8", "surrogatepass") + b" "
    mask = (1 << BITS) - 1
    return list({zlib.crc32(w[i:i + n]) & mask for n in GRAMS for i in range(max(1, len(w) - n + 1))})


def distinct_words(text: str | None) -> set[str]:
    return set(text.lower().split()) if text else set()


def shrink(size: np.ndarray) -> np.ndarray:
    """Scale of a document's values, by its number of distinct words."""
    return 5 / np.sqrt(np.maximum(size, 1))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray   # weight times ratio, by bucket
    bias: float
    length: float         # of log(1 + distinct words)

    def word(self, word: str) -> float:
        return float(self.weights[word_grams(word)].sum())


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, train_rows: int) -> DataFrame:
    """At most ``train_rows`` labelled documents (text, y); of an id's several texts the smallest."""
    chosen = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y"))
              .orderBy(F.xxhash64("__id"), "__id", "y").limit(train_rows))
    # The chosen rows are at most train_rows pairs of numbers.
    texts = docs.select(F.col(id_col).alias("__doc"), F.col("text").cast("string").alias("__text"))
    found = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    return found.groupBy("__id", "y").agg(F.min("__text").alias("text")).select("text", "y")


def ratios(train: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(toxic documents, other documents) by bucket, and the two class sizes."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Bounded(word_grams, 200_000)
        held = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y"), strict=True):
                held[int(y.as_py() == 1), list({g for w in distinct_words(text.as_py()) for g in grams[w]})] += 1
                held[int(y.as_py() == 1), -1] += 1
        at = np.flatnonzero(held.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[1, at]), pa.array(held[0, at])], ["g", "p", "n"])

    rows = (train.mapInArrow(count, "g long, p long, n long").groupBy("g").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
            .toPandas())   # at most 2 ** BITS + 1 rows
    held = np.zeros((2, (1 << BITS) + 1))
    if len(rows):
        held[1, rows.g], held[0, rows.g] = rows.p, rows.n
    return held[1, :-1], held[0, :-1], held[1, -1], held[0, -1]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic",
        train_rows: int = TRAIN_ROWS, min_ratio: float = 1.0, min_docs: int = 3, l2: float = 1.0,
        steps: int = 400) -> Model:
    train = training_rows(docs, labels, id_col, label_col, train_rows)
    p, n, size_p, size_n = ratios(train)
    weights = np.zeros(1 << BITS, np.float32)
    if not size_p or not size_n:
        share = size_p / (size_p + size_n) if size_p + size_n else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(weights, float(np.log(share / (1 - share))), 0.0)
    r = np.log((p + 1) / (size_p + 2)) - np.log((n + 1) / (size_n + 2))
    used = (np.abs(r) >= min_ratio) & (p + n >= min_docs)
    column = np.full(1 << BITS, -1, np.int32)
    column[used] = np.arange(used.sum())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Bounded(lambda w: [c for c in column[word_grams(w)].tolist() if c >= 0], 200_000)
        for batch in batches:
            cols, counts, sizes = [], [], []
            for text in batch.column("text"):
                words = distinct_words(text.as_py())
                sizes.append(len(words))
                got = np.array([c for w in words for c in kept[w]], np.int32)
                c, k = np.unique(got, return_counts=True)
                cols.append(c.astype(np.int32).tobytes())
                counts.append(k.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols, pa.binary()), pa.array(counts, pa.binary()), pa.array(sizes, pa.int32()), batch.column("y")],
                ["c", "k", "size", "y"])

    # At most train_rows rows, each with the selected grams it holds.
    rows = train.mapInArrow(encode, "c binary, k binary, size int, y int").toPandas()
    col = [np.frombuffer(x, np.int32) for x in rows.c]
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in col])
    col = np.concatenate(col)
    size = rows["size"].to_numpy(float)
    val = np.concatenate([np.frombuffer(x, np.int32) for x in rows.k]) * r[used][col] * shrink(size)[doc]
    log_size = np.log1p(size)
    y = (rows.y.to_numpy() == 1).astype(float)
    m = int(used.sum())
    w, b = np.zeros(m), float(np.log(size_p / size_n))
    # Diagonal bound on the curvature (each document's values share its row sum).
    row = np.bincount(doc, np.abs(val), len(y)) + 1 + log_size
    bound = np.bincount(col, np.abs(val) * row[doc], m) / 4 + l2
    bound_b, bound_s = row.sum() / 4, (log_size * row).sum() / 4 + 1e-9
    momentum, velocity, velocity_b, velocity_s, slope = 0.9, np.zeros(m), 0.0, 0.0, 0.0
    for _ in range(steps):
        z = b + slope * log_size + np.bincount(doc, val * w[col], len(y))
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        velocity = momentum * velocity - (np.bincount(col, val * e[doc], m) + l2 * w) / bound
        velocity_b = momentum * velocity_b - e.sum() / bound_b
        velocity_s = momentum * velocity_s - (e * log_size).sum() / bound_s
        w, b, slope = w + velocity, b + velocity_b, slope + velocity_s
    weights[used] = w * r[used]
    return Model(weights, float(b), float(slope))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (less the text) with held_out, score and predicted."""
    names = ["score", "predicted"]
    carried = [f for f in docs.schema.fields if f.name != text_col and f.name.lower() not in (*names, "held_out")]
    whole = fresh(docs, "text")
    rows = docs.select(*[F.col(f"`{f.name}`") for f in carried], F.col(text_col).cast("string").alias(whole))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in carried) + "score double, predicted int"
    shared = docs.sparkSession.sparkContext.broadcast(model)   # 2 ** BITS floats

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        sums = Bounded(fitted.word, 500_000)
        for batch in batches:
            z, size = np.zeros(len(batch)), np.zeros(len(batch))
            for i, text in enumerate(batch.column(whole)):
                words = distinct_words(text.as_py())
                z[i], size[i] = math.fsum(map(sums.__getitem__, words)), len(words)
            z = fitted.bias + fitted.length * np.log1p(size) + z * shrink(size)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in carried] + [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                [f.name for f in carried] + names)

    out = rows.mapInArrow(lean(score), schema)
    return out.withColumn("held_out", F.coalesce(held_out(F.col(id_col)), F.lit(False)))
