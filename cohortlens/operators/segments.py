"""Segment-rate aggregation: group -> counts, event sums, exact rates, means.

Every KPI and EDA query of the analysed project is "group the base view by
some (possibly computed) key and report encounters, events, rate %, rounded
means".  ``segment_rates`` is that one operator; metrics are declared with the
small spec classes below.  Rates and means are rounded with exact integer
arithmetic (``round_ratio``), so ``ROUND(x, 2)`` is HALF_UP on the exact
quotient as in a NUMERIC database, never a binary-float approximation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from .quantiles import exact_quantiles
from .slicing import same_keys


@dataclass(frozen=True)
class Metric:
    name: str

    def aggs(self) -> list[Column]:
        raise NotImplementedError

    def post(self) -> Column:
        return F.col(self.name)

    def from_totals(self) -> Column:
        """The metric from pre-aggregated totals (see ``segment_cube``)."""
        raise ValueError(f"{type(self).__name__} cannot be derived from segment totals")


@dataclass(frozen=True)
class Count(Metric):
    """COUNT(*)"""

    def aggs(self):
        return [F.count(F.lit(1)).alias(self.name)]

    def from_totals(self):
        return F.col("n")


@dataclass(frozen=True)
class Sum(Metric):
    """SUM(col) as BIGINT."""
    column: str = ""

    def aggs(self):
        return [F.sum(self.column).cast("long").alias(self.name)]

    def from_totals(self):
        return F.col(f"s_{self.column}")


@dataclass(frozen=True)
class Rate(Metric):
    """ROUND(SUM(flag) * 100.0 / COUNT(*), digits)."""
    flag: str = ""
    digits: int = 2

    def aggs(self):
        return [F.sum(self.flag).cast("long").alias(f"_{self.name}_s"),
                F.count(F.lit(1)).alias(f"_{self.name}_n")]

    def post(self):
        return X.rate_pct(f"_{self.name}_s", f"_{self.name}_n", self.digits)

    def from_totals(self):
        return X.rate_pct(f"s_{self.flag}", "n", self.digits)



@dataclass(frozen=True)
class Mean(Metric):
    """ROUND(AVG(col), digits) of an integral column (NULLs ignored).

    ``scale`` handles half-integral columns: AVG(x) = SUM(x*scale)/(COUNT*scale).
    """
    column: str = ""
    digits: int = 2
    scale: int = 1

    def aggs(self):
        v = F.col(self.column) * self.scale if self.scale != 1 else F.col(self.column)
        return [F.sum(v.cast("long")).alias(f"_{self.name}_s"),
                F.count(self.column).alias(f"_{self.name}_n")]

    def post(self):
        return X.round_ratio(f"_{self.name}_s", F.col(f"_{self.name}_n") * self.scale, self.digits)

    def from_totals(self):
        return X.round_ratio(f"s_{self.column}_x{self.scale}", F.col(f"c_{self.column}") * self.scale,
                             self.digits)



@dataclass(frozen=True)
class Median(Metric):
    """PERCENTILE_CONT(q) (exact, linear interpolation) as DOUBLE.

    The exact form selects in the group's value frequencies by radix (see
    ``exact_quantiles``), so no task holds a group's values.  ``approx=True`` uses
    the mergeable ``percentile_approx`` sketch in the same aggregate.
    """
    column: str = ""
    q: float = 0.5
    approx: bool = False
    accuracy: int = 10_000

    def aggs(self):
        if self.approx:
            return [F.percentile_approx(F.col(self.column), self.q, self.accuracy).cast("double").alias(self.name)]
        return []

    def joined(self, df: DataFrame, keys: Sequence[tuple[str, Column]]) -> DataFrame:
        """(_m0.., name): the exact quantile per group of ``keys``."""
        names = [f"_m{i}" for i in range(len(keys))]
        freq = (df.select(*[c.alias(n) for n, (_, c) in zip(names, keys, strict=True)], F.col(self.column).alias("_v"))
                .groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("_w")))
        return exact_quantiles(freq, names, "_v", "_w", [self.q]).select(*names, F.col("_q")[0].alias(self.name))


@dataclass(frozen=True)
class Min(Metric):
    column: str = ""

    def aggs(self):
        return [F.min(self.column).alias(self.name)]


@dataclass(frozen=True)
class Max(Metric):
    column: str = ""

    def aggs(self):
        return [F.max(self.column).alias(self.name)]


@dataclass(frozen=True)
class Distinct(Metric):
    """COUNT(DISTINCT col), exact (``approx=True`` -> HyperLogLog++)."""
    column: str = ""
    approx: bool = False

    def aggs(self):
        f = F.approx_count_distinct if self.approx else F.countDistinct
        return [f(self.column).alias(self.name)]

    def from_totals(self):
        if not self.approx:
            return super().from_totals()
        return F.coalesce(F.hll_sketch_estimate(f"d_{self.column}"), F.lit(0)).alias(self.name)


@dataclass(frozen=True)
class Entities(Metric):
    """COUNT(DISTINCT entity), exact, as the number of first rows of an entity.

    For sequenced rows (``seq`` is 1 on exactly one row of every entity) and groups that
    hold all rows of an entity or none: no entity id is shuffled.  Like COUNT(DISTINCT),
    a NULL entity is not counted.
    """
    column: str = ""
    seq: str = "encounter_seq"

    def aggs(self):
        return [F.count_if((F.col(self.seq) == 1) & F.col(self.column).isNotNull()).alias(self.name)]


def segment_rates(df: DataFrame, by: Sequence[str | tuple[str, Column]], metrics: Sequence[Metric],
                  min_rows: int | None = None) -> DataFrame:
    """GROUP BY ``by`` with ``metrics``; ``min_rows`` is a HAVING COUNT(*) >= k.

    ``by`` holds column names or ``(name, expression)`` pairs for computed
    keys (a CASE band, a label).  The aggregation is partial on the map side,
    so a hot segment is pre-aggregated before the shuffle.
    """
    pairs = [(b, F.col(b)) if isinstance(b, str) else b for b in by]
    aggs = [a for m in metrics for a in m.aggs()]
    if min_rows is not None:
        aggs.append(F.count(F.lit(1)).alias("_having_n"))
    out = df.groupBy(*[c.alias(n) for n, c in pairs]).agg(*aggs)
    if min_rows is not None:
        out = out.filter(F.col("_having_n") >= min_rows)
    for m in metrics:
        if isinstance(m, Median) and not m.approx:
            q = m.joined(df, pairs)
            if pairs:
                names = [f"_m{i}" for i in range(len(pairs))]
                out = out.join(q, same_keys([F.col(n) for n, _ in pairs], [F.col(n) for n in names]), "left").drop(*names)
            else:
                out = out.withColumn(m.name, q.select(m.name).scalar())
    return out.select(*[n for n, _ in pairs], *[m.post().alias(m.name) for m in metrics])


# ---------------------------------------------------------------------------
# Many segment families in one pass
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Family:
    """A segment family: a name and up to two (key name, key expression) pairs.

    Expressions are zero-argument callables so families can be declared
    before a Spark session exists.  Families of one ``bundle`` are first aggregated
    together over all their keys; bundle keys of few joint values.
    """
    name: str
    keys: tuple = ()
    bundle: str | None = None


def segment_cube(df: DataFrame, families, flags, measures, sketches: Sequence[str] = ()) -> DataFrame:
    """Totals of every family's segments, in two levels.

    A bundle of families is one aggregation of the rows over all its keys (partial on
    the map side, no copies of rows); its few joint segments are then expanded into one
    (family, k1, k2) entry per family and added up.  Per segment: the row count ``n``,
    ``s_<flag>`` sums, ``s_<col>_x<scale>`` / ``c_<col>`` sums and counts for the means
    (``measures`` is {column: scale}) and, for ``sketches``, a mergeable distinct
    sketch ``d_<col>``.  The output has one row per segment of every family (small), and
    ``from_cube`` derives any count / sum / rate / mean metric from it.
    Keys are carried as text and cast back by ``from_cube``.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(f).cast("long").alias(f"s_{f}") for f in flags]
    aggs += [F.sum((F.col(c) * scale if scale != 1 else F.col(c)).cast("long")).alias(f"s_{c}_x{scale}")
             for c, scale in measures.items()]
    aggs += [F.count(c).alias(f"c_{c}") for c in measures]
    aggs += [F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.col(c))).alias(f"d_{c}") for c in sketches]
    totals = ["n", *[f"s_{f}" for f in flags], *[f"s_{c}_x{scale}" for c, scale in measures.items()],
              *[f"c_{c}" for c in measures]]
    merge = [F.sum(t).alias(t) for t in totals] + [F.hll_union_agg(f"d_{c}").alias(f"d_{c}") for c in sketches]

    bundles: dict[str, list] = {}
    for fam in families:
        bundles.setdefault(fam.bundle or fam.name, []).append(fam)
    parts = []
    for members in bundles.values():
        named = {name: expr for fam in members for name, expr in fam.keys}
        cols = {name: f"_k{i}" for i, name in enumerate(named)}
        joint = df.groupBy(*[expr().cast("string").alias(cols[name]) for name, expr in named.items()]).agg(*aggs)
        entries = []
        for fam in members:
            ks = [F.col(cols[name]) for name, _ in fam.keys] + [F.lit(None).cast("string")] * (2 - len(fam.keys))
            entries.append(F.struct(F.lit(fam.name).alias("family"), ks[0].alias("k1"), ks[1].alias("k2")))
        joint = joint.filter(F.col("n") > 0)   # an empty table has no segments
        parts.append(joint.select(F.inline(F.array(*entries)), *totals, *[f"d_{c}" for c in sketches]))
    return reduce(DataFrame.unionByName, parts).groupBy("family", "k1", "k2").agg(*merge)


def from_cube(cube: DataFrame, family: Family, key_types, metrics, min_rows: int | None = None,
              where: Column | None = None) -> DataFrame:
    """One family's segments from ``segment_cube`` totals: the same result as
    ``segment_rates`` over the rows (``where`` filters segments by key)."""
    t = cube.filter(F.col("family") == family.name)
    keys = [F.col(k).cast(tp).alias(name) for k, (name, _), tp in zip(("k1", "k2"), family.keys, key_types)]
    t = t.select(*keys, *[c for c in cube.columns if c not in ("family", "k1", "k2")])
    if where is not None:
        t = t.filter(where)
    if min_rows is not None:
        t = t.filter(F.col("n") >= min_rows)
    return t.select(*[name for name, _ in family.keys], *[m.from_totals().alias(m.name) for m in metrics])


def share_of_total(df: DataFrame, count_col: str, name: str = "pct_of_total",
                   digits: int = 2) -> DataFrame:
    """``count * 100.0 / SUM(count) OVER ()`` on an aggregated frame.

    The frame is already one row per group, so the empty window is tiny.
    """
    total = F.sum(count_col).over(Window.partitionBy())
    return df.withColumn(name, X.round_ratio(F.col(count_col).cast("long") * 100, total, digits))


def present(df: DataFrame, *order) -> DataFrame:
    """Sort a small report frame (one row per segment) for presentation.

    The finished rows are moved into one partition and sorted there, which avoids
    the range-partition sampling job a global ``orderBy`` would start; the
    aggregation before it keeps its own partitions (a ``coalesce`` would run it in
    one task).  Only for frames bounded by the number of segments.
    """
    return df.repartition(1).sortWithinPartitions(*order)


def hundredths(c: str | Column) -> Column:
    """A 2-decimal rate as an exact integer number of hundredths."""
    return F.round(X.col(c) * 100).cast("long")


def versus_baseline(segments: DataFrame, overall: DataFrame, rate_col: str,
                    baseline_col: str) -> DataFrame:
    """Point gap and relative % versus the overall baseline, Above/Below.

    ``overall`` is a one-row frame; its rate enters as a scalar subquery
    (evaluated once).  Gaps are computed in integer hundredths, so they are
    exact.
    """
    baseline = overall.select(F.col(baseline_col)).scalar()
    gap = hundredths(rate_col) - hundredths("baseline_rate")
    return (segments.withColumn("baseline_rate", baseline)
            .withColumns({
                "gap_pts": gap.cast("double") / 100.0,
                "relative_pct": X.round_ratio(gap * 100, hundredths("baseline_rate"), 2),
                "vs_baseline": F.when(gap > 0, "Above").when(gap < 0, "Below").otherwise("Equal"),
            }))


def adjacent_step(df: DataFrame, order_col: str, rate_col: str, name: str = "step_pts") -> DataFrame:
    """Rate minus the previous tier's rate, on an aggregated (tiny) frame."""
    w = Window.orderBy(order_col)
    step = hundredths(rate_col) - F.lag(hundredths(rate_col)).over(w)
    return df.withColumn(name, step.cast("double") / 100.0)
