"""Small frames for the training-data operators' tests."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *("en", "src0")[len(r) - 2:]) if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOC)


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def edge_rows(seed=5):
    """Nulls in every column, empty, blank, one-word and very long texts, repeated rows and ids."""
    rnd = random.Random(seed)
    base = words(rnd, 120)
    return [
        (1, base, "en", "src0"), (2, None, "en", "src0"), (3, "", "fr", "src1"), (4, " \n\t ", None, None),
        (5, base, "en", "src0"), (5, base, "en", "src0"), (6, "one", "de", "src2"), (7, "two words", "de", None),
        (None, words(rnd, 90), "en", "src0"), (8, words(rnd, 20_000), "en", "src0"), (9, "Ünïcödé ß 漢字 \U0001f600 " + base, "de", "src3"),
        (10, "x" * 50_000, "en", "src0"), (11, base + " tail", None, "src1"), (12, words(rnd, 60), "en", "src1"),
        (12, words(rnd, 60), "en", "src1"),
    ]
