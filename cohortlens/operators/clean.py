"""Rule-based cleaning that flags rather than drops.

Every operator is ``DataFrame -> DataFrame`` (plus, where the analysed
pipeline prints a report, a second small report DataFrame).  Row-level steps
are narrow projections and fuse into one code-generated stage; only
de-duplication (C2) and the IQR fences (C9) need a shuffle: of row digests and
keys, and of value frequencies; both pre-aggregate on the map side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..session import materialize
from .quantiles import exact_quantiles


def string_columns(df: DataFrame) -> list[str]:
    """Column selection by type (driver-side schema inspection, no job)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _unpivot(df: DataFrame, cols: Sequence[str], value_type: str = "string") -> DataFrame:
    """Long form (column, value) of ``cols``; NULL values are kept."""
    return df.unpivot([], [F.col(c).cast(value_type).alias(c) for c in cols], "column", "value")


# ---------------------------------------------------------------- C1 ------

def replace_sentinel(df: DataFrame, sentinel: str = "?",
                     columns: Sequence[str] | None = None) -> DataFrame:
    """Sentinel text -> NULL on every string column (or ``columns``)."""
    targets = set(columns if columns is not None else string_columns(df))
    return df.select(*[X.nullif(c, sentinel).alias(c) if c in targets else F.col(c)
                       for c in df.columns])


def sentinel_counts(df: DataFrame, sentinel: str = "?",
                    columns: Sequence[str] | None = None) -> DataFrame:
    """(column, sentinel_count, sentinel_pct) for string columns with hits.

    One pass: a single aggregate of ``count_if`` per column, unpivoted.
    """
    cols = list(columns if columns is not None else string_columns(df))
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c) == sentinel).alias(c) for c in cols])
    long = one.unpivot(["_rows"], cols, "column", "sentinel_count")
    return (long.filter(F.col("sentinel_count") > 0)
            .select("column", F.col("sentinel_count").cast("long").alias("sentinel_count"),
                    X.rate_pct("sentinel_count", "_rows").alias("sentinel_pct")))


# ---------------------------------------------------------------- C2 ------

#: Lists of repeated keys up to this many rows (two numbers each) go to all tasks.
LIST_ROWS = 500_000
#: The same for lists of one number each.
LIST_NUMBERS = 2_000_000


def repeated(df: DataFrame, *keys: Column) -> tuple[DataFrame, int]:
    """(list of the key values that more than one row has, its length); the list is stored.

    Keys are counted with map-side combining, so a hot key costs one row per map task."""
    names = [f"_k{i}" for i in range(len(keys))]
    found = (df.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)]).groupBy(*names)
             .agg(F.count(F.lit(1)).alias("_copies")).filter(F.col("_copies") > 1).select(*names))
    found = materialize(found, "repeated")
    return found, found.count()


def row_digest(df: DataFrame) -> list[Column]:
    """128 bits of a row: equal rows (NULL equals NULL, NaN equals NaN) have equal digests."""
    cols = [F.col(_quoted(c)) for c in df.columns]
    # Hashes pass over NULLs, so the places of the NULLs are hashed as well.
    nulls = F.array(*[c.isNull() for c in cols])
    return [F.xxhash64(*cols, nulls), F.xxhash64(F.lit(1), nulls, *cols)]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def drop_exact_duplicates(df: DataFrame, list_rows: int = LIST_ROWS, key: str | None = None,
                          list_keys: int = LIST_NUMBERS) -> DataFrame:
    """``dropDuplicates`` in two phases: only rows that may have a twin are moved.

    First the digests are counted (16 bytes a row are shuffled, not the row).  Rows whose
    digest is unique have no twin and stay where they are; the others are compared in full
    by ``dropDuplicates``, so digests that agree by chance do no harm.  The list of repeated
    digests is counted; beyond ``list_rows`` entries many rows have to be moved anyway and
    the one-phase way is taken.  ``df`` is read three times: store it first if it is costly.

    Twins agree in every column, so in ``key`` (the primary key, if the table has one): then
    only rows whose key repeats may have a twin.  They are found by reading one column, and
    stored; the rest needs no digests.  Beyond ``list_keys`` repeated keys all rows get digests.
    """
    columns = [F.col(_quoted(c)) for c in df.columns]
    if key is not None:
        number = F.xxhash64(F.col(_quoted(key)))
        keys, n = repeated(df, number)
        if n == 0:
            return df
        if n <= list_keys:
            keyed = df.withColumn("_key_number", number)
            same = F.col("_key_number") == F.col("_k0")
            rest = keyed.join(F.broadcast(keys), same, "left_anti").select(*columns)
            candidates = materialize(keyed.join(F.broadcast(keys), same, "left_semi").select(*columns), "same-key")
            return rest.unionAll(drop_exact_duplicates(candidates, list_rows))
    digest = row_digest(df)
    twins, n = repeated(df, *digest)
    if n == 0:
        return df
    if n > list_rows:
        return df.dropDuplicates()
    keyed = df.select("*", *[d.alias(f"_row_digest{i}") for i, d in enumerate(digest)])
    same = (F.col("_row_digest0") == F.col("_k0")) & (F.col("_row_digest1") == F.col("_k1"))
    unique = keyed.join(F.broadcast(twins), same, "left_anti").select(*columns)
    copies = keyed.join(F.broadcast(twins), same, "left_semi").select(*columns)
    return unique.unionAll(copies.dropDuplicates())


def remove_duplicates(df: DataFrame, pk: str, flag_col: str = "duplicate_flag") -> DataFrame:
    """Drop exact duplicate rows, then flag every copy of a conflicting key."""
    return flag_key_conflicts(drop_exact_duplicates(df), pk, flag_col)


def flag_key_conflicts(deduped: DataFrame, pk: str, flag_col: str = "duplicate_flag",
                       list_rows: int = LIST_ROWS) -> DataFrame:
    """Flag (1) every row whose key appears more than once.

    The keys are counted first (only keys are shuffled).  A list of conflicting keys of up
    to ``list_rows`` entries goes to the rows, which stay where they are; a longer one is
    joined by a shuffle, whose hot partitions AQE splits.  ``deduped`` is read twice, so
    callers that computed it expensively should store it first.
    """
    found, n = repeated(deduped, F.col(pk))
    conflicts = found.select(F.col("_k0").alias("_pk"), F.lit(1).alias("_in_conflict"))
    # Null-safe: rows that share a NULL key are in conflict as well.
    return (deduped.join(F.broadcast(conflicts) if n <= list_rows else conflicts, F.col(pk).eqNullSafe(F.col("_pk")), "left")
            .withColumn(flag_col, F.coalesce(F.col("_in_conflict"), F.lit(0)).cast("int"))
            .select(*[F.col(_quoted(c)) for c in deduped.columns if c != flag_col], flag_col))


def entity_frequency(df: DataFrame, entity: str) -> DataFrame:
    """One row: entities with more than one row, and the most rows of one entity."""
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("entities_with_repeats"),
                   F.max("n").alias("max_rows_per_entity"))


def duplicate_summary(raw: DataFrame, pk: str, deduplicated: DataFrame | None = None) -> DataFrame:
    """One row: exact duplicate rows removed and rows flagged as key conflicts.

    ``deduplicated`` is the stored de-duplicated table, if there is one."""
    deduped = remove_duplicates(raw, pk) if deduplicated is None else flag_key_conflicts(deduplicated, pk)
    after = deduped.agg(F.struct(F.count(F.lit(1)).alias("rows"),
                                 F.sum("duplicate_flag").cast("long").alias("conflicts"))).scalar()
    return raw.agg(F.count(F.lit(1)).alias("rows_before")).select(
        "rows_before", after["rows"].alias("rows_after"),
        (F.col("rows_before") - after["rows"]).alias("duplicates_removed"),
        after["conflicts"].alias("pk_conflict_rows"))


# ---------------------------------------------------------------- C3 ------

def treat_missing(df: DataFrame, *, presence_flags: Mapping[str, str] = (),
                  fills: Mapping[str, str] = (), missing_flags: Mapping[str, str] = ()) -> DataFrame:
    """Declarative missing-value policy.

    presence_flags: {source: flag} -> 1 when the value is present
    fills:          {column: value} -> NULL replaced by value
    missing_flags:  {source: flag} -> 1 when the value is missing (kept NULL)
    """
    presence_flags, fills, missing_flags = dict(presence_flags), dict(fills), dict(missing_flags)
    out = df.select(*[F.coalesce(F.col(c), F.lit(fills[c])).alias(c) if c in fills else F.col(c)
                      for c in df.columns])
    adds = {flag: F.col(src).isNotNull().cast("int") for src, flag in presence_flags.items()}
    adds.update({flag: F.col(src).isNull().cast("int") for src, flag in missing_flags.items()})
    return out.withColumns(adds)


def null_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, null_count, null_pct) for every column in one pass."""
    cols = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = one.unpivot(["_rows"], cols, "column", "null_count")
    return long.select("column", F.col("null_count").cast("long").alias("null_count"),
                       X.rate_pct("null_count", "_rows").alias("null_pct"))


# ---------------------------------------------------------------- C4 ------

def correct_dtypes(df: DataFrame, id_cols: Sequence[str], numeric_cols: Sequence[str],
                   numeric_type: str = "int") -> DataFrame:
    """Code columns -> clean text (drop a ``.0`` suffix); measures -> numbers.

    Unparsable measures become NULL (``try_cast``) instead of failing the job;
    measures that have the type already stay as they are.
    """
    typed = {c for c, t in df.dtypes if t == numeric_type}
    ids, nums = set(id_cols), set(numeric_cols) - typed
    return df.select(*[
        X.split_first(F.col(c).cast("string")).alias(c) if c in ids
        else F.col(c).cast("string").try_cast(numeric_type).alias(c) if c in nums
        else F.col(c)
        for c in df.columns])


def coercion_report(before: DataFrame, numeric_cols: Sequence[str],
                    numeric_type: str = "int") -> DataFrame:
    """(column, nulls_after, coercion_nulls) of the numeric coercion."""
    aggs = []
    for c in numeric_cols:
        casted = F.col(c).cast("string").try_cast(numeric_type)
        aggs += [F.count_if(casted.isNull()).alias(f"{c}__after"),
                 F.count_if(F.col(c).isNotNull() & casted.isNull()).alias(f"{c}__new")]
    one = before.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__after").alias("nulls_after"),
                     F.col(f"{c}__new").alias("coercion_nulls")) for c in numeric_cols]
    return one.select(F.inline(F.array(*rows)))


# ---------------------------------------------------------------- C5 ------

def standardize_text(df: DataFrame, upper_cols: Sequence[str] = (),
                     rename: Mapping[str, str] | None = None,
                     columns: Sequence[str] | None = None) -> DataFrame:
    """Strip + title-case every string column; ``upper_cols`` upper-cased
    afterwards; then rename (e.g. hyphenated names to snake_case)."""
    targets = list(columns if columns is not None else string_columns(df))
    uppers = set(upper_cols)
    rename = dict(rename or {})
    place = {c: i for i, c in enumerate(targets)}

    def fix(c: str) -> Column:
        if c not in place:
            return F.col(c)
        text = F.col("_standard")[place[c]]
        return F.upper(text) if c in uppers else text

    if not targets:
        return df.withColumnsRenamed(rename)
    # One array for all columns (the same as title_case(strip(c)) of each).
    standard = df.withColumn("_standard", F.expr(X.strip_title_all_sql(targets)))
    return standard.select(*[fix(c).alias(rename.get(c, c)) for c in df.columns])


def vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted distinct non-null values per column, long form (column, value)."""
    return (_unpivot(df, columns).filter(F.col("value").isNotNull())
            .distinct().orderBy("column", "value"))


# ------------------------------------------------------------ C6, C7 ------

def flag_invalid(df: DataFrame, column: str, valid: Sequence[str], flag_col: str) -> DataFrame:
    """1 when a non-null value is outside ``valid``."""
    c = F.col(column)
    return df.withColumn(flag_col, X.flag(c.isNotNull() & ~c.isin(list(valid))))


def flag_codes(df: DataFrame, column: str, codes: Sequence[int], flag_col: str) -> DataFrame:
    """1 when the column, read as a number, is one of ``codes``."""
    value = F.col(column).cast("string").try_cast("double")
    return df.withColumn(flag_col, X.flag(value.isin([float(x) for x in codes])))


# ---------------------------------------------------------------- C8 ------

def validate_vocabulary(df: DataFrame, columns: Sequence[str], valid: Sequence[str]) -> DataFrame:
    """(column, value, rows) for every non-null value outside the vocabulary."""
    cols = [c for c in columns if c in df.columns]
    long = _unpivot(df, cols)
    bad = long.filter(F.col("value").isNotNull() & ~F.col("value").isin(list(valid)))
    return bad.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- C9 ------

def value_frequencies(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) frequency table of numeric columns.

    The partial aggregation collapses repeated values on the map side, so the
    shuffle carries distinct values only; every quantile below is computed
    from this table instead of the raw rows.
    """
    long = df.unpivot([], [X.num(c).alias(c) for c in cols], "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def iqr_fences(freq: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """(column, q1, q3, lower_bound, upper_bound, rows) per column.

    Quantiles are exact with linear interpolation (radix selection on the
    frequency table, NULL values ignored), matching PERCENTILE_CONT and pandas; ``rows`` counts every row, NULLs included.
    """
    rows = freq.groupBy("column").agg(F.sum("n").alias("rows"))
    q = rows.join(exact_quantiles(freq, ["column"], "value", "n", [0.25, 0.75]).drop("n"), "column", "left")
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    return q.select("column", q1.alias("q1"), q3.alias("q3"),
                    (q1 - F.lit(multiplier) * (q3 - q1)).alias("lower_bound"),
                    (q3 + F.lit(multiplier) * (q3 - q1)).alias("upper_bound"), "rows")


def flag_iqr_outliers(df: DataFrame, cols: Sequence[str], multiplier: float = 1.5,
                      any_flag: str = "any_outlier_flag") -> tuple[DataFrame, DataFrame]:
    """Per-column ``<col>_outlier_flag`` (strictly outside the fences) plus a
    composite flag; returns (flagged frame, report).

    The fences are computed once, from the stored value frequencies: a few passes
    over distinct values, one row per column, which then enter the plan as literals.
    So the row pass is a narrow projection over one scan, however many flags it
    sets.  The report counts values outside the fences from the same frequencies.
    """
    freq = materialize(value_frequencies(df, cols), "value-frequencies")
    fences = {r["column"]: r for r in iqr_fences(freq, multiplier).collect()}   # one row per column

    def bound(c: str, side: str) -> Column:
        return F.lit(fences[c][side] if c in fences else None).cast("double")

    flags = {f"{c}_outlier_flag": X.flag((X.num(c) < bound(c, "lower_bound")) | (X.num(c) > bound(c, "upper_bound")))
             for c in cols}
    # The composite flag repeats the comparisons: reading the flags would need a second projection.
    flagged = df.select(*df.columns, *[e.alias(n) for n, e in flags.items()],
                        F.greatest(F.lit(0), *flags.values()).alias(any_flag))

    lo, hi = (F.element_at(F.create_map(*[x for c in cols for x in (F.lit(c), bound(c, side))]), F.col("column"))
              for side in ("lower_bound", "upper_bound"))
    outside = (F.col("value") < lo) | (F.col("value") > hi)
    report = (freq.groupBy("column")
              .agg(F.sum("n").alias("rows"), F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("outlier_count"))
              .select("column", F.round(lo, 2).alias("lower_bound"), F.round(hi, 2).alias("upper_bound"),
                      F.col("outlier_count").cast("long").alias("outlier_count"),
                      X.rate_pct("outlier_count", "rows").alias("outlier_pct")))
    return flagged, report
