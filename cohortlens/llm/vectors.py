"""Helpers of the vector operators: valid rows, bounded query rounds, best rows per query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Queries that go to all tasks at once; more are searched in further rounds.
ROUND_QUERIES = 4_096


def finite(vector: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & ok, F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as a float64 matrix; shorter vectors are padded with zeros."""
    lists = column.cast(pa.list_(pa.float64()))
    flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rounds(queries: DataFrame, key: str, size: int = ROUND_QUERIES):
    """Arrow tables of about ``size`` stored queries each, by a hash of the unique ``key``."""
    n = -(-queries.count() // size)
    for r in range(n):
        yield queries.filter(F.pmod(F.xxhash64(key), F.lit(n)) == r).toArrow()


class Best:
    """The ``k`` best (score, then smaller id) rows of each query, over many tiles of rows.

    Memory is bounded by ``k`` rows a query and the buffer of ``room`` rows; what ``floor``
    excludes (worse than a query's present k-th best) need not be added at all.
    """

    def __init__(self, queries: int, k: int, low, room: int = 400_000):
        self.k, self.room, self.size = k, room, 0
        self.floor = np.full(queries, low)
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        self.parts.append((query, score, ident, row))
        self.size += len(query)
        if self.size > self.room:
            self.rows()

    def rows(self) -> tuple[np.ndarray, ...]:
        """(query, score, id, row) of the best so far; raises the floors."""
        if not self.parts:
            return tuple(np.empty(0, t) for t in (np.int64, self.floor.dtype, np.int64, np.int64))
        query, score, ident, row = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((row, ident, -score, query))
        sorted_query = query[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query)
        last = order[rank == self.k - 1]
        self.floor[query[last]] = score[last]
        keep = order[rank < self.k]
        out = query[keep], score[keep], ident[keep], row[keep]
        self.parts, self.size = [out], 0
        return out


def with_row(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored, with a number of its own for every row (repeated rows differ)."""
    return stored(df.withColumn("row", F.monotonically_increasing_id()), name)
