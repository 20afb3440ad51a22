"""Validation operators (V1-V6).

Each audit is one aggregate pass that yields a small frame of
(check, observed, expected, passed) rows.  ``enforce`` turns a failed audit
into an exception before anything is published (the analysed pipeline only
printed its audit).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .clean import string_columns


def _check(name: str, observed: Column, expected, op: str = "==") -> Column:
    exp = (expected if isinstance(expected, Column) else F.lit(expected)).cast("long")
    obs = observed.cast("long")
    passed = {"==": obs == exp, ">=": obs >= exp, "<=": obs <= exp, ">": obs > exp}[op]
    return F.struct(F.lit(name).alias("check"), obs.alias("observed"), exp.alias("expected"),
                    F.coalesce(passed, F.lit(False)).alias("passed"))


def pre_export_audit(df: DataFrame, pk: str, target: str, valid_target: Sequence[str],
                     expected_features: Sequence[str], sentinel: str = "?", expected_columns: int | None = None) -> DataFrame:
    """V1: residual sentinels, key nulls, binary flags, expected features,
    target vocabulary (a NULL target is outside it), plus the frame's shape:
    at least one row, and ``expected_columns`` columns if given."""
    strings = string_columns(df)
    flags = [c for c in df.columns if c.endswith("_flag")]
    sentinel_hits = sum((F.count_if(F.col(c) == sentinel) for c in strings), F.lit(0))
    aggs = [F.count(F.lit(1)).alias("rows"), sentinel_hits.alias("sentinels"),
            F.count_if(F.col(pk).isNull()).alias("pk_nulls"),
            F.count_if(F.col(target).isNull() | ~F.col(target).isin(list(valid_target))).alias("bad_target")]
    aggs += [F.count_if(~F.col(f).isin(0, 1) | F.col(f).isNull()).alias(f"nb_{i}") for i, f in enumerate(flags)]
    one = df.agg(*aggs)
    checks = [_check("rows", F.col("rows"), 1, ">="),
              *([_check("columns", F.lit(len(df.columns)), expected_columns)] if expected_columns is not None else []),
              _check("residual_sentinels", F.col("sentinels"), 0),
              _check("primary_key_nulls", F.col("pk_nulls"), 0),
              _check("unexpected_target_values", F.col("bad_target"), 0)]
    checks += [_check(f"non_binary:{f}", F.col(f"nb_{i}"), 0) for i, f in enumerate(flags)]
    checks += [_check(f"feature_present:{f}", F.lit(int(f in df.columns)), 1) for f in expected_features]
    return one.select(F.inline(F.array(*checks)))


def post_load_validation(loaded: DataFrame, source_rows: DataFrame, pk: str, target: str,
                         valid_target: Sequence[str], exclusion_flags: Sequence[str],
                         ranges: dict[str, tuple[float, float]], expected_excluded: DataFrame | None = None) -> DataFrame:
    """V2: the seven integrity checks on a loaded table.

    row count = source rows, key unique, key non-null, target vocabulary,
    flags binary, excluded rows = rows that match the exclusion rules in the source
    (``expected_excluded``, a one-row frame), feature ranges.
    """
    flags = [c for c in loaded.columns if c.endswith("_flag")]
    excluded = X.row_any([F.col(f) == 1 for f in exclusion_flags])
    out_of_range = sum((F.count_if(F.col(c).isNotNull() & ~F.col(c).between(lo, hi))
                        for c, (lo, hi) in ranges.items()), F.lit(0))
    non_binary = sum((F.count_if(~F.col(f).isin(0, 1) | F.col(f).isNull()) for f in flags), F.lit(0))
    one = loaded.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(pk).alias("keys"),
        F.count_if(F.col(pk).isNull()).alias("pk_nulls"),
        F.count_if(F.col(target).isNull() | ~F.col(target).isin(list(valid_target))).alias("bad_target"),
        non_binary.alias("non_binary"), F.sum(excluded).alias("excluded"),
        out_of_range.alias("out_of_range"))
    one = one.withColumn("source_rows", source_rows.select(F.col(source_rows.columns[0])).scalar())
    expected = expected_excluded.select(F.col(expected_excluded.columns[0])).scalar() if expected_excluded is not None else F.col("excluded")
    one = one.withColumn("expected_excluded", expected)
    checks = [_check("row_count_matches_source", F.col("rows"), F.col("source_rows"), "=="),
              _check("primary_key_unique", F.col("rows") - F.col("keys"), 0),
              _check("primary_key_not_null", F.col("pk_nulls"), 0),
              _check("target_in_vocabulary", F.col("bad_target"), 0),
              _check("flags_binary", F.col("non_binary"), 0),
              _check("exclusions_flagged", F.col("excluded"), F.col("expected_excluded")),
              _check("features_in_range", F.col("out_of_range"), 0)]
    return one.select(F.inline(F.array(*checks)))


def vocabulary_check(df: DataFrame, vocab: dict[str, Sequence[str]]) -> DataFrame:
    """V4: per column, distinct values outside its vocabulary (NULL ignored)."""
    long = df.unpivot([], [F.col(c).cast("string").alias(c) for c in vocab], "column", "value")
    valid = F.lit(False)
    for c, values in vocab.items():
        valid = valid | ((F.col("column") == c) & F.col("value").isin(list(values)))
    bad = long.filter(F.col("value").isNotNull() & ~valid)
    return bad.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))


def views_non_empty(view_counts: DataFrame) -> DataFrame:
    """V5: every KPI view returns rows."""
    return view_counts.withColumn("passed", F.col("rows") > 0)


def null_reconciliation(raw: DataFrame, replaced: DataFrame, sentinel: str = "?",
                        columns: Sequence[str] | None = None) -> DataFrame:
    """V6: nulls after sentinel replacement = sentinels before + nulls before."""
    cols = list(columns or string_columns(raw))
    before = raw.agg(*[F.count_if(F.col(c) == sentinel).alias(f"s{i}") for i, c in enumerate(cols)],
                     *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    after = replaced.agg(F.struct(*[F.count_if(F.col(c).isNull()).alias(f"a{i}")
                                    for i, c in enumerate(cols)])).scalar()
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("sentinels_before"),
                     F.col(f"n{i}").alias("nulls_before"), after[f"a{i}"].alias("nulls_after"),
                     (after[f"a{i}"] == F.col(f"s{i}") + F.col(f"n{i}")).alias("reconciled"))
            for i, c in enumerate(cols)]
    return before.select(F.inline(F.array(*rows)))


def enforce(report: DataFrame, passed_col: str = "passed") -> DataFrame:
    """Raise if any check failed (the report is a handful of rows)."""
    failed = report.filter(~F.col(passed_col)).collect()
    if failed:
        raise ValueError("audit failed: " + "; ".join(str(r.asDict()) for r in failed))
    return report
