"""Exact quantiles by radix selection on a value-frequency table.

A double is read as a 64-bit number of the same order.  All wanted ranks of all groups
are narrowed together, some bits (``DIGITS``) at a time: count the rows of the current prefix by
their next digit, step over the digits below the rank, and go on inside the digit that
holds it.  The state is one row per (group, rank) and the counts are at most
four million per row of the state, so nothing is sorted and no task holds the
values of a group.  The first pass already tells whole numbers up to 511 apart.  Equal values, however many, are one row of the frequency table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import materialize
from .slicing import same_keys

#: Bits of each pass: sign, exponent and 8 bits of the fraction, then the rest.
DIGITS = (20, 22, 22)

_SMALLEST_NORMAL = 2.0 ** -1022
_FRACTION = 1 << 52


def _power_of_two(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def ordered_bits(v: Column) -> Column:
    """A double as a LONG of the same order (equal doubles, and only those, are equal).

    The magnitude is exponent times 2^52 plus fraction, as a double is stored; the sign
    is the number's sign.  -0.0 and 0.0 are one value; NaN is the largest, NULL is NULL.
    """
    def magnitude(a: Column) -> Column:
        # log2 is rounded: next to a power of two the guess may be one off.
        def exponent(guess: Column) -> Column:
            return guess + F.when(a < _power_of_two(guess), -1).when(a >= _power_of_two(guess + 1), 1).otherwise(0)

        def normal(e: Column) -> Column:
            return (e + 1023) * _FRACTION + ((a / _power_of_two(e) - 1.0) * float(_FRACTION)).cast("long")

        # Below 2^-1022 the fraction counts units of 2^-1074, reached in two exact steps.
        return (F.when(a == 0.0, F.lit(0).cast("long"))
                .when(a < _SMALLEST_NORMAL, (a / _SMALLEST_NORMAL * float(_FRACTION)).cast("long"))
                .when(a == float("inf"), F.lit(2047 * _FRACTION))
                .otherwise(_let(_let(F.floor(F.log2(a)), exponent), normal)))

    bits = _let(F.abs(v), magnitude)
    return F.when(F.isnan(v), F.lit(2047 * _FRACTION + 1)).when(v < 0, -bits).otherwise(bits)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` written, and evaluated, once."""
    return F.transform(F.array(value), body)[0]


def exact_quantiles(freq: DataFrame, group_cols: Sequence[str], value: str, weight: str,
                    probs: Sequence[float], out: str = "_q") -> DataFrame:
    """(group..., out array, n): exact quantiles with linear interpolation, from a value-frequency table.

    ``freq`` is read once: its rows are stored with their ordered bits, and each pass
    reads that table and stores its state.  Ranks whose cell holds a single value are
    done; the passes end when all are, after three passes at the latest.  NULL
    values carry no rank; ``n`` counts the ranked rows.  A NULL group is a group; groups
    without a ranked row are left out (without group columns: one row of NULLs).
    """
    g = [f"_g{i}" for i in range(len(group_cols))]
    v = F.col(value).cast("double")
    rows = (freq.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
            .select(*[F.col(c).alias(n) for c, n in zip(group_cols, g, strict=True)],
                    ordered_bits(v).alias("_bits"), v.alias("_v"), F.col(weight).cast("long").alias("_w")))
    rows = materialize(rows, "quantiles")

    found, state = [], None
    for level in range(len(DIGITS)):
        state, pending = _narrowed(rows, g, state, level, probs)
        found.append(state.filter(_resolved()))
        if not pending:
            break
        state = state.filter(~_resolved())

    ids = range(2 * len(probs))
    picks = [F.max(F.when(F.col("_id") == i, F.col("_low"))).alias(f"_v{i}") for i in ids]
    ranked = reduce(DataFrame.unionByName, found).groupBy(*g).agg(F.first("_total").alias("n"), *picks)
    q = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        q.append(lo + (hi - lo) * (at - F.floor(at)))
    return ranked.select(*[F.col(n).alias(c) for c, n in zip(group_cols, g, strict=True)], F.array(*q).alias(out), "n")


def _narrowed(rows: DataFrame, g: list[str], state: DataFrame | None, level: int,
              probs: Sequence[float]) -> tuple[DataFrame, int]:
    """One pass: the stored state with prefixes of ``level + 1`` digits, and how many ranks are open.

    State: (g..., _id, _prefix, _rank inside the prefix, _total rows of the group, and
    the prefix's least and greatest value).  The first pass makes it from the ranks.
    """
    def prefix(levels: int) -> Column:
        return F.shiftright("_bits", 64 - sum(DIGITS[:levels]))     # signed: keeps the order

    cell = prefix(level + 1).alias("_prefix")
    counts = [F.sum("_w").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    if state is None:
        w = Window.partitionBy(*g)
        cells = rows.groupBy(*g, cell).agg(*counts).withColumn("_total", F.sum("_n").over(w))
        ranks = [side(F.lit(float(p)) * (F.col("_total") - 1)).cast("long") for p in probs for side in (F.floor, F.ceil)]
        cells = cells.withColumn("_below", _running(w)).select("*", F.posexplode(F.array(*ranks)).alias("_id", "_rank"))
    else:
        s = state.select(*[F.col(n).alias(f"_s{n}") for n in g], "_id", F.col("_prefix").alias("_at"), "_rank", "_total")
        inside = rows.join(s, same_keys([F.col(n) for n in g], [F.col(f"_s{n}") for n in g])
                           & (prefix(level) == F.col("_at")))
        cells = (inside.groupBy(*g, "_id", cell)
                 .agg(*counts, F.first("_rank").alias("_rank"), F.first("_total").alias("_total"))
                 .withColumn("_below", _running(Window.partitionBy(*g, "_id"))))
    state = (cells.filter((F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_n")))
             .select(*g, "_id", "_prefix", (F.col("_rank") - F.col("_below")).alias("_rank"), "_total", "_low", "_high"))
    seen = Observation()
    state = materialize(state.observe(seen, F.count_if(~_resolved()).alias("open")), "quantile-ranks")
    return state, seen.get["open"]


def _resolved() -> Column:
    return F.col("_low").eqNullSafe(F.col("_high"))


def _running(w) -> Column:
    return F.coalesce(F.sum("_n").over(w.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
