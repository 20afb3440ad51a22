r"""Near-duplicate documents: banded MinHash, odd sketches, exact check, components.

Documents whose sets of word shingles have a Jaccard similarity of at least
``num / den`` are linked; a document's component is what it reaches over links.

1. Map: the set of distinct shingles (64-bit hashes) of every whole text, a digest
   of the set and ``bands`` band keys of four MinHash values each.  The number of
   bands follows from the threshold: a pair at the threshold shares no band with a
   probability below ``miss``.
2. Documents with equal sets are one class (grouped by digest), so exact copies cost
   one row from here on.  Classes that share a band key are candidates; components of
   the (class, band key) graph are *families*, found without listing any pair.
3. Only families' texts are read again.  Each class gets an *odd sketch*: ``SAMPLES``
   MinHash values folded into a parity bitmap, bit = parity of the samples hashed to
   it.  XOR of two bitmaps leaves the parities of the samples that differ, so
   ``1 + bits / (4 * samples) * ln(1 - 2 * popcount / bits)`` estimates the similarity
   with a small error exactly where it is high.
4. A task takes a block of at most ``BLOCK`` classes of a family, compares sketches by
   XOR and population count, and checks pairs in the order of their estimates on the
   full sets, skipping pairs that are already connected; it returns only each class's
   link to the smallest class of its part.  Pairs whose estimate is more than ``MARGIN`` standard
   errors below the threshold are not checked (a pair at the threshold: about one in 1e9, against
   the bands' one in 1e6).
5. Families larger than a block are first done block by block; then, for families
   that are still in several parts, the classes outside the largest part meet all
   others, again in pairs of blocks.  No pair list is written and no task holds more
   than two blocks, however large a family is.
6. A family that fits one block is done; the large ones' links go through a
   components search.  The smallest id speaks for each component.

Defined cases: null text, empty text or text of white space only: empty set, no
links.  Fewer words than a shingle: the whole sequence is the one shingle.  Rows with
a null id take part but never speak for a component that has another id.  Repeated rows
are each returned.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, gram_hash, hash_words, key_list, lean, mix, row_key, space_words, stored
from .components import connected_components

ROWS = 4            # MinHash values in a band
SAMPLES = 1024      # MinHash values folded into a sketch
SKETCH_BITS = 8192
MARGIN = 6.0
BLOCK = 1024


def bands_needed(threshold: float, miss: float = 1e-6) -> int:
    return max(1, math.ceil(math.log(miss) / math.log(1 - threshold ** ROWS))) if threshold < 1 else 1


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = [space_words(t, lower=True) for t in texts]
    flat = hash_words([w for ws in words for w in ws])
    out, at = [], 0
    for ws in words:
        h = flat[at:at + len(ws)]
        at += len(ws)
        if len(h) >= k:
            out.append(np.unique(gram_hash(h, k)))
        elif len(h):
            out.append(mix(gram_hash(h, len(h)) + np.uint64(len(h))))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def min_hashes(s: np.ndarray, mult: np.ndarray, rows: int = 512) -> np.ndarray:
    """Smallest product with each multiplier, over blocks of the set."""
    best = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), rows):
        np.minimum(best, (s[i:i + rows, None] * mult).min(0), out=best)
    return best


def odd_sketch(s: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (position, MinHash) samples, as bytes."""
    spots = mix(min_hashes(s, mult) + np.arange(len(mult), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.packbits(np.bincount((spots % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1)


def estimate(differing: np.ndarray) -> np.ndarray:
    x = np.minimum(2.0 * differing / SKETCH_BITS, 0.999)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log1p(-x)


def signatures(rows: DataFrame, k: int, bands: int) -> DataFrame:
    """id, key, n, v (class: a 64-bit digest of the set), bands."""
    kind = rows.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = multipliers(bands * ROWS)
        for big in batches:
            for start in range(0, len(big), 500):
                batch = big.slice(start, 500)
                sets = shingle_sets(batch.column("text").to_pylist(), k)
                v = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None
                     for s in sets]
                keys = [gram_hash_rows(min_hashes(s, mult).reshape(bands, ROWS)).tolist() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(v, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "key", "n", "v", "bands"])

    return rows.mapInArrow(lean(sign), f"id {kind}, key long, n long, v long, bands array<long>")


def gram_hash_rows(m: np.ndarray) -> np.ndarray:
    """A key for each band from its MinHash values and its number."""
    out = np.arange(1, len(m) + 1, dtype=np.uint64)
    for i in range(m.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + m[:, i])
    return out.view(np.int64)


def sketches(classes: DataFrame, k: int) -> DataFrame:
    """v, family, members, shingles, sketch from one text of each class."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = multipliers(SAMPLES)
        for big in batches:
            for start in range(0, len(big), 200):
                batch = big.slice(start, 200)
                sets = shingle_sets(batch.column("text").to_pylist(), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("v"), batch.column("family"),
                     pa.array([s.tobytes() for s in sets], pa.binary()),
                     pa.array([odd_sketch(s, mult).tobytes() for s in sets], pa.binary())],
                    ["v", "family", "shingles", "sketch"])

    return classes.select("v", "family", "text").mapInArrow(lean(make), "v long, family long, shingles binary, sketch binary")


def forest(pdf: pd.DataFrame, num: int, den: int, across: bool) -> pd.DataFrame:
    """Links of parts that confirmed pairs connect: (a, b), from each part to the smallest one it
    reaches; ``across``: only pairs between sides 0 and 1 are compared."""
    t = num / den
    low = t - MARGIN * math.sqrt(t * (1 - t) / SAMPLES)
    pdf = pdf.drop_duplicates("v").sort_values("v", kind="stable")
    v, part = pdf["v"].to_numpy(), pdf["part"].to_numpy()
    bits = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(v), -1)
    sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    size = np.array([len(s) for s in sets])
    side = pdf["side"].to_numpy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(v) - 1):
        rest = slice(i + 1, None)
        # Exact conditions first: different parts, and sizes that can reach the threshold.
        ok = (part[rest] != part[i]) & (den * np.minimum(size[rest], size[i]) >= num * np.maximum(size[rest], size[i]))
        if across:
            ok &= side[rest] != side[i]
        j = np.flatnonzero(ok) + i + 1
        if len(j):
            est = estimate(np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64))
            keep = est >= low
            found.append((np.full(keep.sum(), i), j[keep], est[keep]))
    root: dict[int, int] = {}
    if found:
        a, b, est = (np.concatenate(x) for x in zip(*found, strict=True))
        root = {p: p for p in part}

        def top(p: int) -> int:
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            return p

        for x in np.argsort(-est, kind="stable"):
            i, j = a[x], b[x]
            pi, pj = top(part[i]), top(part[j])
            if pi != pj:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if den * both >= num * (size[i] + size[j] - both):
                    root[max(pi, pj)] = min(pi, pj)
    out = [(p, top(p)) for p in root if root[p] != p]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def class_parts(members: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """(v, part) for the classes of all families: classes that confirmed links connect share a part;
    ``members``: v, family, shingles, sketch (stored); ``sizes``: family, m."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = members.join(sizes, "family").withColumn("blocks", blocks)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("v", F.lit(3)), F.col("blocks")).cast("int"))
    columns = ["v", "shingles", "sketch"]

    def task(across: bool):
        return lambda pdf: forest(pdf, num, den, across)

    first = stored(rows.select("family", "block", *columns, F.col("v").alias("part"), F.lit(0).alias("side"))
                   .groupBy("family", "block").applyInPandas(task(False), "a long, b long"), "near-links")
    parts = members.select("v", "family").distinct().join(first, F.col("v") == F.col("a"), "left").select(
        "v", "family", F.coalesce("b", "v").alias("part"))
    large = sizes.filter(F.col("m") > BLOCK).select("family")
    if large.limit(1).count() == 0:
        return parts.select("v", "part")
    # Families of several blocks: their parts so far, and the largest part of each family.
    large = stored(large.join(parts, "family").select("v", "family", "part"), "near-large-parts")
    by_part = large.groupBy("family", "part").agg(F.count("*").alias("n"))
    main = by_part.groupBy("family").agg(F.max(F.struct("n", "part")).alias("x"), F.sum("n").alias("m"), F.count("*").alias("parts"))
    main = main.filter("parts > 1").select(F.col("family").alias("f"), F.col("x.part").alias("main"),
                                           F.ceil(F.col("x.n") / BLOCK).cast("int").alias("g"),
                                           F.ceil((F.col("m") - F.col("x.n")) / BLOCK).cast("int").alias("r"))
    rows = (large.join(main, F.col("family") == F.col("f")).withColumn("side", (F.col("part") == F.col("main")).cast("int"))
            .select(F.col("v").alias("w"), "part", "side", "g", "r"))
    own = F.pmod(F.xxhash64("v", F.lit(4)), F.when(F.col("side") == 1, F.col("g")).otherwise(F.col("r"))).cast("int")
    rows = stored(members.dropDuplicates(["v"]).join(rows, F.col("v") == F.col("w")).withColumn("own", own).drop("w"), "near-large")
    last = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    # Pairs of blocks: (outside, main) and (outside, outside).
    with_main = (rows.filter("side = 1").withColumn("a", F.explode(last("r"))).withColumn("b", F.col("own"))
                 .unionByName(rows.filter("side = 0").withColumn("a", F.col("own")).withColumn("b", F.explode(last("g")))))
    outside = rows.filter("side = 0").withColumn("x", F.explode(last("r")))
    outside = outside.withColumn("a", F.least("own", "x")).withColumn("b", F.greatest("own", "x")).drop("x")
    more = (with_main.groupBy("family", "a", "b").applyInPandas(task(True), "a long, b long")
            .unionAll(outside.withColumn("side", F.lit(0)).groupBy("family", "a", "b").applyInPandas(task(False), "a long, b long")))
    # Parts are vertices now.
    joined = connected_components(more, "a", "b", "near-parts")
    return parts.join(joined, F.col("part") == F.col("vertex"), "left").select("v", F.coalesce("component", "part").alias("part"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    num: int = 80, den: int = 100) -> DataFrame:
    """id_col, n_shingles, component_id, kept, __key, __group (one row per input row)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", row_key("id", "text"))
    bands = bands_needed(num / den)
    sig = stored(signatures(rows, shingle, bands), "near-signatures")

    # A class: documents with equal sets; one of its rows (smallest key) lends its text.
    classes = sig.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("rep"), F.min(F.struct("key", "bands")).alias("one"))
    classes = stored(classes.select("v", "rep", F.col("one.key").alias("key"), F.col("one.bands").alias("bands")), "near-classes")
    band = classes.select("v", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.min("v").alias("hub"), F.max("v").alias("other")).filter("hub <> other").drop("other")
    edges = band.join(shared, "band").select("v", "hub")
    families = connected_components(edges, "v", "hub", "near-families")
    families = stored(families.withColumnsRenamed({"vertex": "v", "component": "family"}), "near-families")
    sizes = families.groupBy("family").agg(F.count("*").alias("m"))
    wanted = key_list(classes.select("v", "key").join(families, "v"), "near-wanted")
    # Repeated rows share a key; their classes are the same and dropped in the tasks.
    texts = rows.select("key", "text").join(wanted, "key")
    members = stored(sketches(texts, shingle), "near-sketches")
    parts = class_parts(members, sizes, num, den).withColumnsRenamed({"v": "w"})

    classes = classes.select("v", "rep").join(parts, F.col("v") == F.col("w"), "left").withColumn("part", F.coalesce("part", "v"))
    ids = classes.groupBy("part").agg(F.min("rep").alias("component_id"))
    label = classes.join(ids, "part").select("v", "part", "component_id")
    out = sig.select("id", "key", "n", "v").join(label, "v", "left")
    component = F.coalesce(F.col("component_id"), F.col("id")).cast(kind)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"), F.col("key").alias("__key"),
                      F.coalesce("part", "key").alias("__group"))


def one_per_group(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near duplicates: the kept id's, of several such
    rows the one with the smallest key, of repeated rows one.  Documents without words stay
    (repeated rows of them once).  ``found``: the result of ``near_components``."""
    found = stored(found, "near-found")
    best = found.groupBy("__group").agg(F.min(F.struct(~F.col("kept"), F.col("__key"))).getField("__key").alias("best"))
    best = best.select(F.col("__group").alias("g"), "best")
    rows = found.groupBy("__group", "__key").agg(F.count("*").alias("m")).join(best, F.col("__group") == F.col("g"))
    gone = key_list(rows.filter((F.col("__key") != F.col("best")) | (F.col("m") > 1)).select("__key").distinct(), "near-gone")
    again = key_list(rows.filter((F.col("__key") == F.col("best")) & (F.col("m") > 1)).select("__key").distinct(), "near-repeated")
    key, of = fresh(docs, "row"), fresh(docs, "key")
    keyed = docs.withColumn(key, row_key(id_col, F.col(text_col).cast("string")))
    once = keyed.join(gone.withColumnRenamed("__key", of), F.col(key) == F.col(of), "left_anti")
    repeated = keyed.join(again.withColumnRenamed("__key", of), F.col(key) == F.col(of), "left_semi").dropDuplicates([key])
    return once.unionByName(repeated).drop(key)
