"""Ordered slices of a table by a deterministic expression of the row.

A slice number that came from a partition number would depend on which exchange
produced it; two readers of the same frame could see different slices.  Here the
split points are rows of the data itself: a hash of the row picks a sample (the same
one in every evaluation), every so-many-th sampled row of a key is a split point, and
a row's slice is the number of its key's split points at or below its order value.
Equal order values therefore share a slice, and any number of readers agree.

The split points are stored and found level by level, like the nodes of a search tree of
``FANOUT`` children: a row meets one node of each level by an equality join and compares
itself with four of its points.  So a row costs the logarithm of the number of slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SAMPLES_PER_SLICE = 32
ROWS_PER_SLICE = 200_000
#: Children of a node of the search tree over split points.
FANOUT = 16
#: Lists of keys or split points up to this many rows go to all tasks.
LIST_ROWS = 500_000


def order_key(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def same_keys(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Null-safe equality of key columns (a NULL key is a key)."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & a.eqNullSafe(b)
    return out


def split_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_slice: int) -> DataFrame:
    """(_k0.., _slice, _o): split points, about one per ``rows_per_slice`` rows of a key; the
    n-th smallest of a key begins slice n.  They are stored, so that all readers see the same.
    ``keys`` are real columns: for one group over all rows pass none, not a constant.

    Keys with at most ``rows_per_slice`` rows have none and do not appear.
    """
    renamed = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    large = (df.groupBy(*renamed).agg(F.count(F.lit(1)).alias("_rows"))
             .filter(F.col("_rows") > rows_per_slice))
    slices = F.ceil(F.col("_rows") / rows_per_slice)
    rate = F.least(F.lit(1.0), slices * SAMPLES_PER_SLICE / F.col("_rows"))
    large = materialize(large.select(*names, slices.alias("_slices"), rate.alias("_rate")), "large-keys")
    rows = df.select(*renamed, order_key(order).alias("_o"))
    # The sample is a function of the row: 2^40 hash values, so rates far below 1e-9 still work.
    draw = F.pmod(F.xxhash64("_o", F.lit(29)), F.lit(1 << 40)) / float(1 << 40)
    if names:
        big = large.select(*[F.col(n).alias(f"_l{n}") for n in names], "_slices", "_rate")
        rows = rows.join(short_list(big, large.count()), same_keys([F.col(n) for n in names], [F.col(f"_l{n}") for n in names]))
        rows = rows.filter(draw < F.col("_rate"))
    else:
        one = large.select(F.struct("_slices", "_rate")).scalar()
        rows = rows.withColumn("_slices", one["_slices"]).filter(draw < one["_rate"])
    # Few rows per key: at most about SAMPLES_PER_SLICE for each slice.
    sample = rows.groupBy(*names, "_o").agg(F.first("_slices").alias("_slices"))
    w = Window.partitionBy(*names)
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / F.col("_slices")))
    ranked = sample.withColumn("_i", F.row_number().over(w.orderBy("_o"))).withColumn("_step", step)
    points = ranked.filter((F.col("_i") % F.col("_step")) == 0)
    return materialize(points.select(*names, (F.col("_i") / F.col("_step")).cast("long").alias("_slice"), "_o"), "split-points")


def short_list(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of ``rows`` rows, for a join: a short list goes to all tasks."""
    return F.broadcast(df) if rows <= LIST_ROWS else df


def ordered_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_slice: int,
                   out: str = "_slice") -> DataFrame:
    """``df`` with slice numbers that rise with ``order`` inside every key."""
    points = split_points(df, keys, order, rows_per_slice)
    names = [f"_k{i}" for i in range(len(keys))]
    n, last = points.agg(F.count(F.lit(1)), F.max("_slice")).first()
    levels = 0
    while FANOUT ** levels <= (last or 0):
        levels += 1
    columns = df.columns

    def passed(low: int, high: int) -> Column:
        """How many of the node's points are at or below the row; missing ones are the last."""
        if low == high:
            return F.lit(low)
        mid = (low + high + 1) // 2
        return F.when(F.col("_points")[f"p{mid}"] <= order_key(order), passed(mid, high)).otherwise(passed(low, mid - 1))

    df = df.withColumn(out, F.lit(0).cast("long"))
    for level in reversed(range(levels)):
        width = FANOUT ** level
        # Every width-th point, without those of the levels above.
        own = points.filter((F.col("_slice") % width == 0) & (F.col("_slice") % (width * FANOUT) != 0))
        child = F.floor(F.col("_slice") / width) % FANOUT
        nodes = (own.groupBy(*names, F.floor(F.col("_slice") / (width * FANOUT)).alias("_node"))
                 .agg(*[F.first(F.when(child == c, F.col("_o")), ignorenulls=True).alias(f"p{c}") for c in range(1, FANOUT)]))
        nodes = nodes.select(*names, "_node", F.struct(*[f"p{c}" for c in range(1, FANOUT)]).alias("_points"))
        if keys or level < levels - 1:
            on = same_keys([F.col(k) for k in keys], [F.col(k) for k in names]) & (F.col(out) == F.col("_node"))
            df = df.join(short_list(nodes, n), on, "left")
        else:      # one root
            df = df.withColumn("_points", nodes.select("_points").scalar())
        df = df.select(*[c for c in columns if c != out], (F.col(out) * FANOUT + passed(0, FANOUT - 1)).alias(out))
    return df.withColumn(out, F.col(out).cast("int"))


def prefix_sum(df: DataFrame, order_col: str, value_col: str, out: str,
               group_cols: Sequence[str] = (), rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Exclusive running sum of ``value_col`` in ``order_col`` order.

    Groups of more than ``rows_per_slice`` rows are cut into ordered slices by an
    expression of the row (``ordered_slices``); each slice's total is one
    row, and the running offsets over those rows are joined back.  No task ever
    holds more than one slice, and every reader sees the same slices.
    """
    g = list(group_cols)
    part = ordered_slices(df, g, [order_col], rows_per_slice)
    tot = part.groupBy(*g, "_slice").agg(F.sum(value_col).alias("_slice_total"))
    ws = Window.partitionBy(*g).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)], F.col("_slice").alias("_s"),
                     F.coalesce(F.sum("_slice_total").over(ws), F.lit(0)).alias("_offset"))
    wl = Window.partitionBy(*g, "_slice").orderBy(order_col) \
        .rowsBetween(Window.unboundedPreceding, -1)
    local = part.withColumn("_local", F.coalesce(F.sum(value_col).over(wl), F.lit(0)))
    on = same_keys([F.col(c) for c in g], [F.col(f"_g{i}") for i in range(len(g))]) & (F.col("_slice") == F.col("_s"))
    return (local.join(tot, on).withColumn(out, F.col("_offset") + F.col("_local"))
            .drop("_slice", "_offset", "_local", "_s", *[f"_g{i}" for i in range(len(g))]))
