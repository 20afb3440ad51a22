"""Ordered sequencing of rows per entity (ROW_NUMBER / COUNT / LAG / LEAD).

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.  If
one entity holds a large share of the table that task becomes the whole job,
so ``sequence`` splits the work:

* keys with few rows use ordinary window functions;
* keys with more than ``hot_rows`` rows are cut into ordered slices by split
  points taken from the data (``slicing.ordered_slices``): the slice is an
  expression of the row, so every reader of the sliced frame agrees on it.
  Window functions run per slice and their rows are stored; a small per-slice
  summary (row count, first and last row), read from the rows at the slice edges,
  supplies the offsets and the neighbours across slice edges.

Both ways give the same columns; ``hot_rows`` only decides who does the work.
Whether any key is hot is decided by one small count (each key's rows are counted
with map-side combining), so a table without hot keys gets the plain one-shuffle
plan.  The hot-key list and the slice summary are stored and counted; short ones go to
all tasks, so no join gathers the rows of a hot key in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .slicing import ordered_slices, short_list

DEFAULT_HOT_ROWS = 2_000_000


def _order_cols(order: Sequence[str]):
    return [F.col(c).asc() for c in order]


def sequence(df: DataFrame, key: str, order: Sequence[str], *,
             seq: str | None = None, count: str | None = None,
             prev: dict[str, str] | None = None, nxt: dict[str, str] | None = None,
             hot_rows: int = DEFAULT_HOT_ROWS, slices: int | None = None) -> DataFrame:
    """Add per-``key`` sequence columns ordered by ``order`` (ascending).

    seq:   ROW_NUMBER() OVER (PARTITION BY key ORDER BY order)
    count: COUNT(*) OVER (PARTITION BY key)
    prev:  {out: src} -> LAG(src)  OVER (...)
    nxt:   {out: src} -> LEAD(src) OVER (...)

    ``order`` should be a total order within a key (add a tie-breaker);
    otherwise ties are numbered in an arbitrary order, as in SQL.
    """
    prev = dict(prev or {})
    nxt = dict(nxt or {})
    cols = df.columns

    hot = (df.groupBy(F.col(key).alias("_hot_key")).agg(F.count(F.lit(1)).alias("_rows"))
           .filter(F.col("_rows") > hot_rows).select("_hot_key", F.lit(1).alias("_hot")))
    # One small job decides the plan; only the number of hot keys reaches the driver.
    hot = materialize(hot, "hot-keys")
    n_hot = hot.count()

    # ---- ordinary keys: one window over the key partition ---------------
    w = Window.partitionBy(key).orderBy(*_order_cols(order))
    w_all = Window.partitionBy(key)
    add = {}
    if seq:
        add[seq] = F.row_number().over(w)
    if count:
        add[count] = F.count(F.lit(1)).over(w_all)
    for out, src in prev.items():
        add[out] = F.lag(src).over(w)
    for out, src in nxt.items():
        add[out] = F.lead(src).over(w)
    if not n_hot:
        out = df.withColumns(add)
        return _finish(out, seq, count)
    tagged = df.join(short_list(hot, n_hot), F.col(key).eqNullSafe(F.col("_hot_key")), "left").drop("_hot_key")
    cold = tagged.filter(F.col("_hot").isNull())
    cold = cold.withColumns(add).select(*cols, *add.keys())

    # ---- hot keys: ordered slices + slice summary ----------------------
    per_slice = max(1, hot_rows // max(1, slices)) if slices else hot_rows
    hot_part = ordered_slices(tagged.filter(F.col("_hot").isNotNull()).drop("_hot"), [key], order, per_slice)
    ws = Window.partitionBy(key, "_slice").orderBy(*_order_cols(order))
    ws_all = Window.partitionBy(key, "_slice")
    carried = sorted(set(prev.values()) | set(nxt.values()))
    local = materialize(hot_part.withColumns({
        "_rn": F.row_number().over(ws),
        "_n": F.count(F.lit(1)).over(ws_all),
        **{f"_lag_{s}": F.lag(s).over(ws) for s in carried},
        **{f"_lead_{s}": F.lead(s).over(ws) for s in carried},
    }), "slices")
    edges = local.filter((F.col("_rn") == 1) | (F.col("_rn") == F.col("_n")))
    row = F.struct(*[F.col(s) for s in carried])
    summary = edges.groupBy(key, "_slice").agg(
        F.max("_n").alias("_slice_rows"),
        *([F.first(F.when(F.col("_rn") == 1, row), ignorenulls=True).alias("_first"),
           F.first(F.when(F.col("_rn") == F.col("_n"), row), ignorenulls=True).alias("_last")]
          if carried else []),
    )
    wk = Window.partitionBy(key).orderBy("_slice")
    summary = summary.withColumns({
        "_offset": F.coalesce(F.sum("_slice_rows").over(
            wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_key_rows": F.sum("_slice_rows").over(Window.partitionBy(key)),
        **({"_prev_last": F.lag("_last").over(wk), "_next_first": F.lead("_first").over(wk)}
           if carried else {}),
    })
    summary = materialize(summary.withColumnRenamed(key, "_skey").withColumnRenamed("_slice", "_sslice"), "slice-summary")
    joined = local.join(short_list(summary, summary.count()), F.col(key).eqNullSafe(F.col("_skey")) & (F.col("_slice") == F.col("_sslice")))
    hot_add = {}
    if seq:
        hot_add[seq] = (F.col("_rn") + F.col("_offset")).cast("int")
    if count:
        hot_add[count] = F.col("_key_rows")
    for out, src in prev.items():
        hot_add[out] = F.when(F.col("_rn") == 1, F.col("_prev_last")[src]).otherwise(F.col(f"_lag_{src}"))
    for out, src in nxt.items():
        hot_add[out] = F.when(F.col("_rn") == F.col("_n"), F.col("_next_first")[src]) \
            .otherwise(F.col(f"_lead_{src}"))
    hot_out = joined.withColumns(hot_add).select(*cols, *hot_add.keys())

    return _finish(cold.unionByName(hot_out), seq, count)


def _finish(out: DataFrame, seq: str | None, count: str | None) -> DataFrame:
    if count:
        out = out.withColumn(count, F.col(count).cast("long"))
    if seq:
        out = out.withColumn(seq, F.col(seq).cast("int"))
    return out
