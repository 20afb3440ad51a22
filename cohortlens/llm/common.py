"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: ASCII white space as the contracts use it: space and \x09-\x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    The files are visible to the driver and every executor, cut the lineage and
    survive lost executors.  Without a checkpoint folder (a cluster session that
    sets none) this raises instead of falling back to a machine-local path.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{folder.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Key lists (a few numbers each) up to this many entries go to all tasks; longer ones are shuffled.
BROADCAST_ROWS = 500_000


def key_list(df: DataFrame, name: str, entries: Column | None = None) -> DataFrame:
    """``df``, a list of keys, stored; with a broadcast hint only if its counted entries are
    few.  ``entries``: the entries of a row, where a row holds an array (default 1)."""
    out = stored(df, name)
    size = out.agg(F.sum(F.lit(1) if entries is None else entries)).first()[0] or 0
    return F.broadcast(out) if size <= BROADCAST_ROWS else out


def lean(fn):
    """``fn`` for ``mapInArrow``, giving freed memory back to the system when a task ends.

    Python workers are used again by later tasks and stages; memory that the allocators
    keep would add up over a pipeline of stages."""
    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release_memory()
    return run


def release_memory() -> None:
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):      # another C library
        pass


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (inputs may carry clashing names)."""
    name = f"__{base}"
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: Column | str, text: Column | str) -> Column:
    """A 64-bit key of (id, text): repeated rows share it and get the same result."""
    i = F.col(id_col) if isinstance(id_col, str) else id_col
    t = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(i, t)


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text: str | None, lower: bool = False) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` as UTF-8 (``bytes.split`` splits on just these)."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


#: Odd 64-bit multiplier (golden ratio) and a finaliser for combining word hashes.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift, multiply), in place on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(words: Sequence) -> np.ndarray:
    """Seed-free 64-bit hashes of words (the same on every machine and run)."""
    if not len(words):
        return np.empty(0, np.uint64)
    a = np.empty(len(words), dtype=object)
    a[:] = words
    return pd.util.hash_array(a, categorize=len(words) > 2000)


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * GOLDEN + mix(h[i:i + n] + np.uint64(i + 1))
    return mix(out)


class Bounded(dict):
    """A memo per worker process: ``self[key]`` computes missing values with
    ``fn(key)`` and keeps the first ``limit`` of them (frequent keys come early);
    later ones are computed each time."""

    def __init__(self, fn, limit: int):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        value = self.fn(key)
        if len(self) < self.limit:
            self[key] = value
        return value


def regex_union(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) for w in words)
