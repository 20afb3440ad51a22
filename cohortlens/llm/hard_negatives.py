"""Hard negatives by exact integer scores from small-prime matrix products.

1. Components become whole numbers, ``floor(scale * x)``.
2. Residue number system.  For each of a few primes below 1024 the component matrices are
   reduced to centred residues and multiplied in float32.  At most ``DEPTH`` products of
   residues are summed before the sum is reduced again, so every partial sum is a whole
   number below 2^24, which float32 holds exactly.  The primes are as many as the largest
   possible score needs: by Cauchy-Schwarz no score exceeds the largest squared norm,
   which one aggregate over all rows gives.
3. Chinese remaindering in balanced mixed radix turns the residues into the signed score.
4. Anchors go to all tasks in rounds of a bounded number; each task streams its rows
   against them and keeps the best rows of every anchor.  The first pass finds an anchor's
   positives (best rows of its label), the second the best rows of other labels between
   ``low`` and ``high`` hundredths of each positive's score.
5. Windows over the tasks' few candidates rank the result.

No pair of rows is shuffled but those candidates: at most tasks x anchors x positives x
negatives rows, however many rows share a label.

Defined cases: rows with a null label, id or vector, or a null or non-finite component take
no part.  Vectors of unequal length count as padded with zeros; empty vectors have score 0.
Repeated rows are rows of their own, ties go to the smaller id.  A positive with a negative
score has no negatives.  No anchors or an empty table give no rows.  Extra columns are
ignored.  Scores that could reach 2^51 raise a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import ROUND_QUERIES, Best, finite, matrix, rounds, with_row

#: Primes below 1024, the largest first; 64 products of centred residues stay below 2^24.
PRIMES = (1021, 1019, 1013, 1009, 997, 991)
DEPTH = 64
TILE = 1_024
FOUND = "anchor long, score long, id long, row long"


def primes_for(bound: int) -> tuple[int, ...]:
    """As many primes as whole numbers from ``-bound`` to ``bound`` need."""
    if bound >= 1 << 51:
        raise ValueError("components are too large for exact 64-bit scores")
    product = 1
    for i, p in enumerate(PRIMES):
        product *= p
        if product > 2.1 * bound + 1:    # a little room: centred digits may exceed p/2 by a rounding
            return PRIMES[:i + 1]
    raise ValueError("components are too large for the primes")


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """float32 whole numbers reduced to about -p/2..p/2 (one more where p/2 rounds)."""
    return x - np.float32(p) * np.rint(x / np.float32(p))


def residues(x: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    """Centred residues of a whole-number matrix, float32, one matrix per prime."""
    out = []
    for p in primes:
        r = np.mod(x, p)
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def products(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> list[np.ndarray]:
    """Residues of ``a @ b.T``: float32 products over at most ``DEPTH`` columns, then reduced."""
    out = []
    for p, x, y in zip(primes, a, b, strict=True):
        total = np.zeros((len(x), len(y)), np.float32)
        for at in range(0, x.shape[1], DEPTH):
            total = centred(total + centred(x[:, at:at + DEPTH] @ y[:, at:at + DEPTH].T, p), p)
        out.append(total)
    return out


def reconstruct(parts: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The signed whole numbers with these residues (Chinese remaindering, balanced digits)."""
    digits = []
    for i, p in enumerate(primes):
        known = np.zeros_like(parts[0])
        for q, d in zip(reversed(primes[:i]), reversed(digits)):   # Horner, modulo p
            known = centred(known * np.float32(q % p if q % p <= p // 2 else q % p - p) + d, p)
        inverse = pow(int(np.prod([q % p for q in primes[:i]], dtype=object) if i else 1), -1, p)
        inverse = inverse - p if inverse > p // 2 else inverse
        digits.append(centred(centred(parts[i] - known, p) * np.float32(inverse), p))
    out = np.zeros(parts[0].shape, np.int64)
    for p, d in zip(reversed(primes), reversed(digits)):
        out = out * p + d.astype(np.int64)
    return out


def _score_tiles(batches: Iterator[pa.RecordBatch], dims: int, scale: float, anchors: list[np.ndarray], primes):
    """(scores rows x anchors, ids, row numbers, labels) of every tile of rows and anchors."""
    for batch in batches:
        whole = np.floor(scale * matrix(batch.column("v"), dims))
        ids, row, label = (batch.column(c).to_numpy() for c in ("id", "row", "label"))
        for at in range(0, len(ids), TILE):
            part = slice(at, at + TILE)
            r = residues(whole[part], primes)
            for first in range(0, len(anchors[0]), TILE):
                some = [a[first:first + TILE] for a in anchors]
                yield reconstruct(products(r, some, primes), primes), ids[part], row[part], label[part], first


def mine(vectors: DataFrame, label: Column, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         round_queries: int = ROUND_QUERIES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), see the module."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"),
                          F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = with_row(rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v"))), "hard-negative-rows")
    norm = F.aggregate("v", F.lit(0.0), lambda total, x: total + F.pow(F.floor(x * scale).cast("double"), F.lit(2.0)))
    dims, bound = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    primes = primes_for(int(bound) + 1)
    anchors = rows.filter("is_anchor").select("row", "id", "label", "v")
    data = rows.select("id", "row", "label", "v")
    sc = vectors.sparkSession.sparkContext

    found = []
    for table in rounds(anchors, "row", round_queries):
        sent = sc.broadcast((residues(np.floor(scale * matrix(table["v"].combine_chunks(), dims)), primes),
                             table["label"].to_numpy(), table["row"].to_numpy()))

        def same_label(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            mats, labels, numbers = sent.value
            best = Best(len(labels), positives, np.iinfo(np.int64).min)
            for s, ids, row, lab, first in _score_tiles(batches, dims, scale, mats, primes):
                some = slice(first, first + s.shape[1])
                hit = ((lab[:, None] == labels[None, some]) & (row[:, None] != numbers[None, some])
                       & (s >= best.floor[None, some]))
                i, j = np.nonzero(hit)
                best.add(j + first, s[i, j], ids[i], row[i])
            yield _found(best.rows(), numbers)

        near = data.mapInArrow(same_label, FOUND)
        w = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
        near = stored(near.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= positives), "positives")
        # At most ``positives`` rows for each anchor of the round.
        got = near.select("anchor", "score", "n").toArrow()
        place = {a: i for i, a in enumerate(table["row"].to_pylist())}
        limits = np.full((2, len(place), positives), 0, np.int64)
        limits[0], limits[1] = 1, 0                     # no positive: an empty interval
        if got.num_rows:
            at = np.array([place[a] for a in got["anchor"].to_pylist()])
            score, n = got["score"].to_numpy(), got["n"].to_numpy() - 1
            limits[0, at, n], limits[1, at, n] = -((-low * score) // 100), (high * score) // 100
        ranges = sc.broadcast(limits)

        def other_label(batches: Iterator[pa.RecordBatch], sent=sent, ranges=ranges) -> Iterator[pa.RecordBatch]:
            mats, labels, numbers = sent.value
            lo, hi = ranges.value
            best = Best(len(labels) * positives, negatives, np.iinfo(np.int64).min)
            for s, ids, row, lab, first in _score_tiles(batches, dims, scale, mats, primes):
                some = slice(first, first + s.shape[1])
                other = lab[:, None] != labels[None, some]
                for n in range(positives):
                    floor = np.maximum(lo[some, n], best.floor[n::positives][some])
                    i, j = np.nonzero(other & (s >= floor[None, :]) & (s <= hi[None, some, n]))
                    best.add((j + first) * positives + n, s[i, j], ids[i], row[i])
            query, score, ident, row = best.rows()
            # A row inside the intervals of several positives is sent once.
            anchor = query // positives
            order = np.lexsort((row, anchor))
            again = (np.diff(anchor[order]) == 0) & (np.diff(row[order]) == 0)
            once = np.delete(order, 1 + np.flatnonzero(again))
            yield _found((anchor[once], score[once], ident[once], row[once]), numbers)

        far = stored(data.mapInArrow(other_label, FOUND), "negatives")
        p = near.select(F.col("anchor").alias("of"), F.col("row").alias("positive_row"), F.col("id").alias("positive_id"),
                        F.col("score").alias("positive_score"))
        pairs = far.join(p, F.col("anchor") == F.col("of")).filter(
            (F.col("positive_score") * low <= F.col("score") * 100) & (F.col("score") * 100 <= F.col("positive_score") * high))
        w = Window.partitionBy("anchor", "positive_row").orderBy(F.desc("score"), "id", "row")
        pairs = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= negatives)
        names = anchors.select(F.col("row").alias("of"), F.col("id").alias("anchor_id"))
        found.append(pairs.drop("of").join(names, F.col("anchor") == F.col("of")).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")))
    if not found:
        kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return vectors.sparkSession.createDataFrame([], kind)
    return reduce(DataFrame.unionByName, found)


def _found(best: tuple[np.ndarray, ...], numbers: np.ndarray) -> pa.RecordBatch:
    query, score, ident, row = best
    return pa.RecordBatch.from_arrays([pa.array(numbers[query], pa.int64()), pa.array(score, pa.int64()),
                                       pa.array(ident, pa.int64()), pa.array(row, pa.int64())],
                                      names=["anchor", "score", "id", "row"])
