"""Nearest neighbours by inner product: a hash-prefix forest over every row.

1. Hash strings.  A tree turns a vector into a string of ``SYMBOLS`` symbols of 7 bits.  A
   symbol is the closest of 128 signed axes after a random projection of the tree's own
   onto 64 directions (its sign and its axis), so vectors at a small angle tend to share
   long prefixes.  Inner products of vectors of unequal norms become angles by one more
   component, ``sqrt(largest norm^2 - norm^2)`` for rows and 0 for queries.
2. The index.  Rows lie in shards of at most ``shard_rows`` rows.  A shard holds, for
   every tree, its hash strings as a sorted array with the rows' places; all rows are
   indexed, and the index is a stored table.
3. Search.  Queries go to all tasks in rounds of a bounded number.  In every shard a query
   descends each tree to its longest matching prefix (binary search); then it ascends all
   trees at once, bit by bit, until the rows under the matched prefixes add up to
   ``min_candidates``, or all of them do.  The strings' bits are the steps of the ascent.
4. Exact inner products of the candidates only; a task keeps the best ``k`` of each query
   over all its shards, and a window over the tasks' few rows ranks the result.

Nothing is shuffled but the tasks' best rows: vectors that many rows share meet in no
bucket outside their shard, and a bucket is never cut.  The only sampled thing is the
projections' seed; the largest norm is that of all rows.

Defined cases: vectors that are null, zero or hold null or non-finite components and rows
without id take no part.  Vectors of unequal length count as padded with zeros.  Repeated
rows are rows of their own (each finds the other); ties go to the smaller id.  With fewer
than ``k`` candidates all are returned.  An empty table or no query gives no rows; extra
columns are ignored.
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

TREES = 48
SHARD_ROWS = 8_192
MIN_CANDIDATES = 2_560
SYMBOLS, SYMBOL_BITS = 4, 7
BITS = SYMBOLS * SYMBOL_BITS
AXES = 1 << (SYMBOL_BITS - 1)
SEED = 20_11

INDEX = "ids binary, row_numbers binary, vectors binary, strings binary, places binary"
FOUND = "query long, score double, id long, row long"


def hash_strings(x: np.ndarray, trees: int, seed: int = SEED) -> np.ndarray:
    """Hash strings (rows x trees) of ``BITS`` bits as unsigned 32-bit numbers."""
    out = np.zeros((len(x), trees), np.uint32)
    x = x.astype(np.float32)
    for tree in range(trees):
        directions = np.random.default_rng((seed, tree)).standard_normal((x.shape[1], SYMBOLS * AXES), np.float32)
        turned = (x @ directions).reshape(len(x), SYMBOLS, AXES)
        axis = np.abs(turned).argmax(axis=2)
        sign = np.take_along_axis(turned, axis[:, :, None], axis=2)[:, :, 0] < 0
        symbol = (2 * axis + sign).astype(np.uint32)
        for s in range(SYMBOLS):
            out[:, tree] = (out[:, tree] << np.uint32(SYMBOL_BITS)) | symbol[:, s]
    return out


def _lifted(x: np.ndarray, top: float, query: bool) -> np.ndarray:
    """Unit-free directions whose angles order inner products: one component more (see 1)."""
    if query:
        extra = np.zeros(len(x))
        norm = np.sqrt((x * x).sum(axis=1))
        return np.column_stack([x / np.maximum(norm, np.finfo(float).tiny)[:, None], extra])
    scale = 1.0 / np.sqrt(top)
    y = x * scale
    return np.column_stack([y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(axis=1)))])


def build_forest(rows: DataFrame, dims: int, top: float, trees: int = TREES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The stored index of (row, id, v): one row per shard (see 2)."""
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= shard_rows:
                table = pa.Table.from_batches(waiting)
                full = len(table) // shard_rows * shard_rows
                for at in range(0, full, shard_rows):
                    yield shard(table.slice(at, shard_rows))
                waiting = table.slice(full).to_batches()
        if sum(map(len, waiting)):
            yield shard(pa.Table.from_batches(waiting))

    def shard(table: pa.Table) -> pa.RecordBatch:
        x = matrix(table["v"].combine_chunks(), dims)
        strings = hash_strings(_lifted(x, top, query=False), trees).T
        places = np.argsort(strings, axis=1, kind="stable")
        arrays = (table["id"].to_numpy(), table["row"].to_numpy(), x,
                  np.take_along_axis(strings, places, axis=1), places.astype("<u4"))
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays],
                                          schema=pa.schema([(n, pa.binary()) for n in
                                                            ("ids", "row_numbers", "vectors", "strings", "places")]))

    return stored(rows.select("row", "id", "v").mapInArrow(shards, INDEX), "forest")


def _matches(strings: np.ndarray, prefix: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (from, to) in one tree's sorted array of the rows that share ``bits`` bits with each query."""
    free = np.uint64(BITS - bits)
    low = (prefix.astype(np.uint64) >> free) << free
    return (np.searchsorted(strings, low.astype(np.uint32), "left"),
            np.searchsorted(strings, (low + (np.uint64(1) << free) - np.uint64(1)).astype(np.uint32), "right"))


def candidate_places(strings: np.ndarray, queries: np.ndarray, min_candidates: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to), queries x trees: the places under each query's prefixes after the ascent.

    ``strings``: trees x rows, sorted; ``queries``: queries x trees.
    """
    n, trees = queries.shape
    start, stop = np.zeros((n, trees), np.int64), np.full((n, trees), strings.shape[1], np.int64)
    # Descent: the longest prefix that a neighbour in the sorted array shares.
    longest = 0
    for tree in range(trees):
        at = np.searchsorted(strings[tree], queries[:, tree])
        for near in (np.minimum(at, strings.shape[1] - 1), np.maximum(at - 1, 0)):
            differ = int((strings[tree][near] ^ queries[:, tree]).min()) if n else 0
            longest = max(longest, BITS - differ.bit_length())
    # Ascent, all trees together: queries that have enough rows stay at their depth.
    open_ = np.arange(n)
    for bits in range(longest, 0, -1):
        if not len(open_):
            break
        spans = [_matches(strings[tree], queries[open_, tree], bits) for tree in range(trees)]
        lo, hi = (np.stack(side, axis=1) for side in zip(*spans, strict=True))
        enough = (hi - lo).sum(axis=1) >= min_candidates
        start[open_[enough]], stop[open_[enough]] = lo[enough], hi[enough]
        open_ = open_[~enough]
    return start, stop     # at depth 0 every row matches


def search(forest: DataFrame, queries: DataFrame, dims: int, top: float, k: int, trees: int = TREES,
           min_candidates: int = MIN_CANDIDATES, round_queries: int = ROUND_QUERIES) -> DataFrame | None:
    """(query row number, score, id, row, rank) of the best ``k`` found; None without queries."""
    sc = forest.sparkSession.sparkContext
    found = []
    for table in rounds(queries, "row", round_queries):
        q = matrix(table["v"].combine_chunks(), dims)
        sent = sc.broadcast((q, hash_strings(_lifted(q, top, query=True), trees), table["row"].to_numpy()))

        def nearest(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q, strings, numbers = sent.value
            best = Best(len(q), k, -np.inf)
            for batch in batches:
                for shard in batch.to_pylist():
                    _search_shard(shard, q, strings, numbers, best, trees, min_candidates)
            query, score, ident, row = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(numbers[query], pa.int64()), pa.array(score, pa.float64()),
                                              pa.array(ident, pa.int64()), pa.array(row, pa.int64())],
                                             names=["query", "score", "id", "row"])

        w = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
        near = forest.mapInArrow(nearest, FOUND).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        found.append(stored(near, "neighbours"))
    return reduce(DataFrame.unionByName, found) if found else None


def _search_shard(shard: dict, q: np.ndarray, strings: np.ndarray, numbers: np.ndarray, best: Best,
                  trees: int, min_candidates: int) -> None:
    ids, rows = (np.frombuffer(shard[c], np.int64) for c in ("ids", "row_numbers"))
    x = np.frombuffer(shard["vectors"]).reshape(len(ids), -1)
    sorted_strings = np.frombuffer(shard["strings"], np.uint32).reshape(trees, -1)
    places = np.frombuffer(shard["places"], "<u4").reshape(trees, -1)
    start, stop = candidate_places(sorted_strings, strings, min_candidates)
    for i in range(len(q)):
        under = np.zeros(len(ids), bool)
        for tree in range(trees):
            under[places[tree, start[i, tree]:stop[i, tree]]] = True
            if tree == 0 and under.all():
                break      # an ascent to the root: every row is a candidate
        under[rows == numbers[i]] = False
        some = np.flatnonzero(under)
        score = x[some] @ q[i]
        keep = np.flatnonzero(score >= best.floor[i])
        if len(keep) > 4 * best.k:      # most of a first shard's candidates cannot be among the best
            least = np.partition(score[keep], len(keep) - best.k)[len(keep) - best.k]
            keep = keep[score[keep] >= least]
        best.add(np.full(len(keep), i), score[keep], ids[some[keep]], rows[some[keep]])


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
                       vector_col: str = "embedding", trees: int = TREES, shard_rows: int = SHARD_ROWS,
                       min_candidates: int = MIN_CANDIDATES, round_queries: int = ROUND_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` nearest rows found."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.filter(F.col("id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0.0))
    rows = with_row(rows, "forest-rows")
    norm = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    dims, top = rows.agg(F.max(F.size("v")), F.max(norm)).first()
    got = None
    if dims:
        queries = rows.filter("is_query").select("row", "id", "v")
        forest = build_forest(rows, dims, top, trees, shard_rows)
        got = search(forest, queries, dims, top, k, trees, min_candidates, round_queries)
    if got is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    names = queries.select(F.col("row").alias("of"), F.col("id").alias("query_id"))
    return got.join(names, F.col("query") == F.col("of")).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")
