r"""Quality rules: a table of thresholds compiled into one projection.

``MEASURES`` turns a text into per-document numbers with Spark functions only;
``RULES`` is the threshold table (measure, ratio denominator, lowest, highest,
from how many words the rule applies).  ``quality_rules`` compiles both into a
single narrow projection: no shuffle, no Python, any number of rules.

Exact repeats inside a document: a 5-word window is compared by its text.  Most
documents repeat no window, which a distinct count over the windows' 64-bit
hashes shows (equal windows have equal hashes); only when that count falls short
are the window texts sorted next to each other, so that equal ones are adjacent.

Defined cases: null text has no words, all counts 0, and fails (fewer than 10
words); an empty text likewise; texts of any length are read whole; repeated rows
get equal results.  Extra columns are carried; result columns replace input
columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, fresh

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of the four corpus languages; fixed values.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "are", "with", "as"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "nicht"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
}


@dataclass(frozen=True)
class Rule:
    """``low <= measure / per <= high`` for documents of at least ``min_words`` words."""
    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: Thresholds of the method's own verdict.
RULES = (
    Rule("length", "n_words", None, 10, 1_000_000),
    Rule("mean_word_chars", "word_chars", "n_words", 2, 15),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.3),
    Rule("stop_kinds", "n_stop_kinds", None, 1, None, 60),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    Rule("ellipsis_ratio", "n_ellipsis_lines", "n_lines", None, 0.5),
)


def _not_empty(x: Column) -> Column:
    return x != ""


def _symbols(text: Column) -> Column:
    kept = text
    for s in SYMBOLS:
        kept = F.replace(kept, F.lit(s), F.lit(""))
    return F.length(text) - F.length(kept)


def _windows(words: Column, n: Column) -> Column:
    """(window text, start) of every 5-word window."""
    return F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)),
                       lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i")))


def _repeat_words(words: Column, n: Column, sorted_windows: Column) -> Column:
    """Words covered by windows that equal a neighbour in sorted order."""
    size = F.size(sorted_windows)
    hits = F.filter(F.sequence(F.lit(0), size - 1), lambda k: (
        ((k > 0) & (F.get(sorted_windows, k - 1)["w"] == F.get(sorted_windows, k)["w"]))
        | ((k < size - 1) & (F.get(sorted_windows, k + 1)["w"] == F.get(sorted_windows, k)["w"]))))
    starts = F.array_sort(F.transform(hits, lambda k: F.get(sorted_windows, k)["i"]))
    # Union length: each start adds 5 words less its overlap with the start before it.
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n"), s.alias("last")),
        lambda a: a["n"])


def measures(df: DataFrame, text_col: str) -> DataFrame:
    """All measures as columns, over whole texts."""
    text, words, lines, hashes, sortedw = (fresh(df, x) for x in ("text", "words", "lines", "hashes", "sorted"))
    drop = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_stop_kinds", "n_ellipsis_lines")
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = df.withColumn(text, t).drop(*[c for c in df.columns if c in drop and c != text_col])
    stops = F.array(*[F.lit(w) for w in sorted({w for ws in STOP_WORDS.values() for w in ws})])
    df = df.withColumn(words, F.filter(F.split(F.col(text), SPACE_CLASS + "+"), _not_empty))
    df = df.withColumn(lines, F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size(words)
    df = df.withColumn(hashes, F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(WINDOW)]))))
    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    df = df.withColumn(sortedw, F.when(repeated, F.array_sort(_windows(F.col(words), n))))
    return (df
            .withColumn("n_words", n.cast("long"))
            .withColumn("word_chars", F.length(F.array_join(words, "")).cast("long"))
            .withColumn("n_symbols", _symbols(F.col(text)).cast("long"))
            .withColumn("n_lines", F.size(lines).cast("long"))
            .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
            .withColumn("n_repeat_words", F.coalesce(
                _repeat_words(F.col(words), n, F.col(sortedw)), F.lit(0)).cast("long"))
            .withColumn("n_stop_kinds", F.size(F.array_intersect(F.col(words), stops)).cast("long"))
            .withColumn("n_ellipsis_lines", F.size(F.filter(
                lines, lambda x: x.endswith("...") | x.endswith("…"))).cast("long"))
            .drop(text, words, lines, hashes, sortedw))


def compile_rules(rules: Sequence[Rule]) -> list[tuple[str, Column]]:
    """(name, failed) for every row of the table; comparisons are on integers
    multiplied out, so no rule divides by zero."""
    out = []
    for r in rules:
        m, per = F.col(r.measure), F.col(r.per) if r.per else F.lit(1)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (m < F.lit(r.low) * per)
        if r.high is not None:
            bad = bad | (m > F.lit(r.high) * per)
        out.append((r.name, bad & (F.col("n_words") >= r.min_words)))
    return out


def quality_rules(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with measures, base_failed, failed_rules (names) and kept."""
    df = measures(docs, text_col)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in compile_rules(rules)]),
                      lambda x: x.isNotNull())
    return (df.withColumn("base_failed", base)
            .withColumn("failed_rules", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))
