"""Column-level building blocks (built-in Spark functions only)."""

from .expr import (  # noqa: F401
    age_bounds,
    age_midpoint,
    code_label,
    exact_bands,
    flag,
    icd_chapter,
    idiv,
    not_equal_null_true,
    nullif,
    rate_pct,
    risk_tier,
    round_ratio,
    row_any,
    row_count,
    row_sum,
    skew_unbiased,
    split_first,
    strip,
    title_case,
    upper_bands,
)
