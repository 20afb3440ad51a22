"""Column expressions shared by the operators.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage code generation; no Python runs per
row.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# Exact rounding
# ---------------------------------------------------------------------------

def idiv(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Integral division (SQL ``a div b``)."""
    return F.call_function("div", col(a), col(b))


def round_ratio(num: ColumnOrName, den: ColumnOrName, digits: int = 2) -> Column:
    """``ROUND(num / den, digits)`` half away from zero, exactly, as DOUBLE.

    ``num`` and ``den`` must be integral (counts and sums of counts).  The
    quotient is rounded with integer arithmetic, so the result equals an exact
    NUMERIC ``ROUND`` and is bit-identical in every engine.  NULL when
    ``den`` is 0 or NULL.
    """
    scale = 10 ** digits
    n = col(num).cast("long")
    d = col(den).cast("long")
    q = idiv(F.abs(n) * (2 * scale) + d, d * 2)
    signed = F.when(n < 0, -q).otherwise(q)
    return F.when(d > 0, signed.cast("double") / F.lit(float(scale)))


def round_ratio_wide(num: Column, den: Column, digits: int = 2) -> Column:
    """``round_ratio`` for products of counts: the arithmetic is DECIMAL(38,0)."""
    wide = "decimal(38,0)"
    n, d = num.cast(wide), den.cast(wide)
    twice = F.lit(2 * 10 ** digits).cast("decimal(6,0)")
    top = (F.abs(n).cast("decimal(31,0)") * twice + d).cast(wide)
    q = idiv(top, (d.cast("decimal(37,0)") * F.lit(2).cast("decimal(1,0)")).cast(wide)).cast("double")
    signed = F.when(n < 0, -q).otherwise(q)
    return F.when(d > 0, signed / F.lit(float(10 ** digits)))


def rate_pct(events: ColumnOrName, total: ColumnOrName, digits: int = 2) -> Column:
    """``ROUND(events * 100.0 / total, digits)``."""
    return round_ratio(col(events).cast("long") * 100, total, digits)


# ---------------------------------------------------------------------------
# Null-safe 0/1 flags (pandas truth table: comparisons with NaN are False)
# ---------------------------------------------------------------------------

def flag(cond: Column) -> Column:
    """Boolean condition -> INT 0/1 where NULL counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def not_equal_null_true(c: ColumnOrName, value) -> Column:
    """``c != value`` where NULL != value is True (pandas object semantics)."""
    return ~col(c).eqNullSafe(F.lit(value))


def nullif(c: ColumnOrName, sentinel: str) -> Column:
    c = col(c)
    return F.when(c != F.lit(sentinel), c)


# ---------------------------------------------------------------------------
# Text
# ---------------------------------------------------------------------------

_TITLE_MARK = "\u0001"
_ASCII_LETTERS_SPACE = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ "


# The characters ``str.strip`` removes (all Unicode white space).
_WHITESPACE = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


def strip(c: ColumnOrName) -> Column:
    """Remove leading/trailing whitespace (``str.strip``), without a regex."""
    return F.btrim(col(c), F.lit(_WHITESPACE))


def title_case(c: ColumnOrName) -> Column:
    """Python ``str.title``: upper-case a letter that follows a non-letter,
    lower-case every other letter.

    ``initcap`` only starts words after spaces, so a marker and a space are put
    after every non-letter, ``initcap`` runs, and the markers are removed.
    """
    c = col(c)
    marked = F.regexp_replace(c, r"([^\p{L}])", "$1" + _TITLE_MARK + " ")
    general = F.replace(F.initcap(marked), F.lit(_TITLE_MARK + " "), F.lit(""))
    # Fast path without a regex: letters and spaces only -> initcap is exact.
    simple = F.translate(c, _ASCII_LETTERS_SPACE, "") == F.lit("")
    return F.when(simple, F.initcap(c)).otherwise(general)


def _sql_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_unicode(text: str) -> str:
    """A SQL string literal with every character written as a unicode escape."""
    return "'" + "".join(f"\\u{ord(ch):04x}" for ch in text) + "'"


def _title_sql(x: str) -> str:
    """``title_case`` of the stripped SQL expression ``x``."""
    marked = f"regexp_replace({x}, '([^\\\\p{{L}}])', concat('$1', {_sql_unicode(_TITLE_MARK + ' ')}))"
    general = f"replace(initcap({marked}), {_sql_unicode(_TITLE_MARK + ' ')}, '')"
    simple = f"translate({x}, '{_ASCII_LETTERS_SPACE}', '') = ''"
    # Values without letters (codes, bands, doses) have no case to change.
    caseless = f"upper({x}) = lower({x})"
    return f"CASE WHEN {simple} THEN initcap({x}) WHEN {caseless} THEN {x} ELSE {general} END"


def strip_title_sql(name: str, upper: bool = False) -> str:
    """``title_case(strip(name))`` (optionally upper-cased) as one SQL expression.

    The same expression tree as the Column functions, written as text so a
    wide projection costs one call into the JVM per column.
    """
    out = _title_sql(f"btrim({_sql_ident(name)}, {_sql_unicode(_WHITESPACE)})")
    return f"upper({out})" if upper else out


# Text that ``title_case(strip(x))`` leaves as it is: printable ASCII without spaces in
# which a capital follows no letter and a small letter follows one.
_STANDARD_TEXT = r"^[!-@\[-`{-~]*+(?:[A-Z][a-z]*+(?:[!-@\[-`{-~]++|\z))*+\z"


def strip_title_all_sql(names: Sequence[str]) -> str:
    """``title_case(strip(c))`` of many columns as one array, in the order of ``names``.

    One function runs over the array, so the generated code does not grow with the columns;
    text that is already standard (most of it) costs one match.
    """
    general = f"transform(array(btrim(x, {_sql_unicode(_WHITESPACE)})), y -> {_title_sql('y')})[0]"
    return (f"transform(array({', '.join(map(_sql_ident, names))}), "
            f"x -> CASE WHEN x RLIKE {_sql_unicode(_STANDARD_TEXT)} THEN x ELSE {general} END)")


def split_first(c: ColumnOrName, sep_regex: str = r"\.") -> Column:
    """``astype(str).str.split('.').str[0]`` (NULL stays NULL)."""
    return F.split(col(c), sep_regex).getItem(0)


def num(c: ColumnOrName) -> Column:
    """Numeric value as DOUBLE with NaN read as missing (pandas semantics)."""
    v = col(c).cast("double")
    return F.nanvl(v, F.lit(None).cast("double"))


# ---------------------------------------------------------------------------
# Row-wise reductions
# ---------------------------------------------------------------------------

def row_count(conds: Iterable[Column]) -> Column:
    """Number of true conditions per row (NULL counts as false)."""
    return reduce(lambda a, b: a + b, [flag(c) for c in conds])


def row_any(conds: Iterable[Column]) -> Column:
    return flag(reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conds]))


def row_sum(cols: Sequence[ColumnOrName]) -> Column:
    """``a + b + c`` with SQL/NaN propagation (any NULL -> NULL)."""
    return reduce(lambda a, b: a + b, [col(c) for c in cols])


# ---------------------------------------------------------------------------
# Lookups and bands (searched CASE, first match wins)
# ---------------------------------------------------------------------------

def code_label(c: ColumnOrName, pairs: Sequence[tuple[str, str]], other: str = "Other") -> Column:
    """Simple CASE code -> label for a fixed, small code list."""
    c = col(c)
    out = None
    for code, label in pairs:
        out = (F.when(c == F.lit(code), F.lit(label)) if out is None
               else out.when(c == F.lit(code), F.lit(label)))
    return out.otherwise(F.lit(other))


def exact_bands(c: ColumnOrName, pairs: Sequence[tuple[int, str]], rest: str) -> Column:
    c = col(c)
    out = None
    for v, label in pairs:
        out = F.when(c == v, F.lit(label)) if out is None else out.when(c == v, F.lit(label))
    return out.otherwise(F.lit(rest))


def upper_bands(c: ColumnOrName, pairs: Sequence[tuple[int, str]], rest: str) -> Column:
    c = col(c)
    out = None
    for hi, label in pairs:
        out = F.when(c <= hi, F.lit(label)) if out is None else out.when(c <= hi, F.lit(label))
    return out.otherwise(F.lit(rest))


def icd_chapter(c: ColumnOrName) -> Column:
    """ICD-9 primary diagnosis -> chapter label.

    Numeric ranges only apply to codes that look numeric; ``try_cast`` keeps a
    V/E code from failing the cast (Spark's ANSI mode raises on bad casts).
    NULL fails every branch and lands in ``Other``.
    """
    c = col(c)
    numeric = c.rlike(r"^\d+\.?\d*$")
    value = c.try_cast("decimal(20,6)")
    out = None
    for pattern, label in C.ICD_PREFIX_RULES:
        cond = c.rlike(pattern)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    for exact, label in C.ICD_EXACT_RULES:
        out = out.when(c == exact, label)
    for lo, hi, label in C.ICD_RANGE_RULES:
        out = out.when(numeric & value.between(F.lit(lo), F.lit(hi)), label)
    return out.otherwise(C.ICD_OTHER)


def risk_tier(tiers=C.RISK_TIERS, rest: str = C.RISK_TIER_REST) -> Column:
    out = None
    for label, minimums in tiers:
        cond = reduce(lambda a, b: a & b, [F.col(k) >= v for k, v in minimums.items()])
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(rest)


def age_bounds(c: ColumnOrName) -> tuple[Column, Column]:
    """Lower/upper bound of an ``[lo-hi)`` band as DOUBLE (NULL if no match)."""
    pattern = r"\[(\d+)-(\d+)\)"
    c = col(c)
    matched = c.rlike(pattern)
    lo = F.when(matched, F.regexp_extract(c, pattern, 1).cast("double"))
    hi = F.when(matched, F.regexp_extract(c, pattern, 2).cast("double"))
    return lo, hi


def age_midpoint(c: ColumnOrName) -> Column:
    lo, hi = age_bounds(c)
    return (lo + hi) / 2.0


def skew_unbiased(g1: Column, n: Column) -> Column:
    """Population skewness g1 -> bias-corrected G1 (pandas ``skew``)."""
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
