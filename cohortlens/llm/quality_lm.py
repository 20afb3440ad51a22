r"""Quality classifier: perplexity under a Kneser-Ney model of trusted text.

Model: interpolated modified Kneser-Ney bigrams over the words that the trusted text
has more than once (the words met once are one class that spreads its mass over them).
It is trained on all trusted documents outside the held-back fifth, and the vocabulary
follows them.  The tables by word, 32 bytes a word, go to every task; the bigram counts
stay sharded.

Scoring covers every document as a sharded count join:

1. a map over the documents turns ``chunk_words`` words of documents at a time into
   bigram keys and writes, for each shard, the chunk's sorted distinct keys and the
   documents that hold each;
2. every shard's task holds that shard of the model's counts and streams the chunks'
   keys past it; a chunk and shard give the log-probability sums of the documents hit
   (as a whole vector where most are);
3. the sums of a chunk meet again (one group is one chunk, of bounded size: at most ten
   bytes a word); they are added as whole numbers, so the order does not matter.

A shard's work is streamed and keys are spread by hash, so no word pair, source or
language makes a large group.  What the join moves grows with the corpus.

Perplexity: a document's mean log-probability is shrunk towards its language's mean
with the weight of ``shrink_words`` words (a handful of words is no evidence).  The
threshold of a language is the ``keep_quantile`` quantile of its trusted documents that
the model has not seen (a fifth, by a hash of the id, is held back from training);
languages with fewer than ``min_trusted`` of them use the threshold of all languages, and
if these are too few as well, that of all trusted documents.  Documents above it are not kept.

Defined cases: null and empty texts have 0 words and a null perplexity and are not
kept.  A null language is the language ``""``.  Without trusted documents every
document with words is kept.  Repeated rows are scored each.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bounded, key_list, lean, mix, stored

#: None: every word that the trusted text has more than once, every trusted document.
VOCABULARY: int | None = None
TRAIN_ROWS: int | None = None
CHUNK_WORDS = 3_000_000
#: Sums of log-probabilities travel as whole multiples of this, so their order does not matter.
UNIT = 2.0 ** -31
#: Bigrams in a shard of the model (16 bytes each in a task), and the least number of shards.
SHARD_KEYS = 4_000_000
MIN_SHARDS = 32


def held_back(doc_id: Column) -> Column:
    """The fifth of the trusted documents that sets the thresholds."""
    return F.pmod(F.xxhash64(doc_id, F.lit(13)), F.lit(5)) == 0


def plain(word: str) -> str:
    return word.strip(".,;:!?") or word


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


@dataclass(frozen=True)
class Tables:
    """By word of the vocabulary; index 0 is the class of other words, 1 the start."""
    hashes: np.ndarray     # sorted hashes of the words; the first has index 2
    follow: np.ndarray     # p_cont by word: the lower order's probability
    weight: np.ndarray     # by context: mass for the lower order (1 for unseen contexts)
    total: np.ndarray      # by context: number of bigrams
    discount: np.ndarray   # by count 0, 1, 2, 3+
    other: float           # log share of one word of the class


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Modified Kneser-Ney discounts from the counts of counts."""
    if min(n1, n2, n3) <= 0:
        return np.array([0.0, 0.75, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *[min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]])


def word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def encoder(hashes: np.ndarray, limit: int = 400_000) -> Bounded:
    def index(word: str) -> int:
        h = word_hash(plain(word))
        at = int(np.searchsorted(hashes, h))
        return at + 2 if at < len(hashes) and hashes[at] == h else 0

    return Bounded(index, limit)


def bigram_keys(encode: Bounded, text: str | None, size: int) -> np.ndarray:
    """``left * size + right`` for every word and the one before it."""
    words = words_of(text)
    at = np.fromiter(map(encode.__getitem__, words), np.int64, len(words))
    return np.concatenate([[1], at[:-1]]) * size + at if len(at) else at


def power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def fit(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, vocabulary: int | None = VOCABULARY,
        train_rows: int | None = TRAIN_ROWS, shard_keys: int = SHARD_KEYS) -> tuple[Tables, DataFrame, int] | None:
    """Tables by word, the bigram counts as (shard, keys, counts) rows (keys as deltas), and
    the number of shards; ``trusted`` holds ids."""
    chosen = trusted.select(F.col(id_col).alias("__id")).filter(F.col("__id").isNotNull()).distinct()
    if train_rows is not None:
        chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text"))
    train = texts.join(key_list(chosen, "trusted"), F.col("__doc") == F.col("__id")).select("text")
    word = F.explode(F.split(F.lower("text"), r"\s+"))
    words = train.select(word.alias("w")).select(F.regexp_replace("w", r"^[.,;:!?]+|[.,;:!?]+$", "").alias("w")).filter("w <> ''")
    counts = stored(words.groupBy("w").agg(F.count("*").alias("n")), "trusted-words")
    top = counts.filter("n > 1")
    if vocabulary is not None:
        top = top.orderBy(F.desc("n"), "w").limit(vocabulary)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([word_hash(w.as_py()) for w in batch.column("w")], pa.int64())], ["h"])

    # A number per word; Arrow columns, no row objects on the driver.
    hashes = np.unique(top.select("w").mapInArrow(lean(hashed), "h long").toArrow().column("h").to_numpy())
    seen = counts.agg(F.count("*").alias("kinds"), F.sum("n").alias("words")).first()
    rare = seen["kinds"] - len(hashes)
    if not len(hashes) and not rare:
        return None
    size = len(hashes) + 2
    shared = docs.sparkSession.sparkContext.broadcast(hashes)
    # Powers of two: a shard of the joins below is a whole number of these.
    parts = max(MIN_SHARDS, power_of_two(-(-seen["words"] // shard_keys)))
    schema, names = "shard long, keys binary, counts binary", ["shard", "keys", "counts"]

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, keys = encoder(shared.value), []
        words = 0

        def flush() -> pa.RecordBatch:
            k, n = np.unique(np.concatenate(keys), return_counts=True)
            return rows_of([(s, squeezed(np.diff(k[at], prepend=0)), squeezed(n[at])) for s, at in shard_slices(k, parts)])

        for batch in batches:
            for text in batch.column("text"):
                k = bigram_keys(encode, text.as_py(), size)
                if len(k):
                    keys.append(k)
                    words += len(k)
                if words >= CHUNK_WORDS:
                    yield flush()
                    keys, words = [], 0
        if keys:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, waiting = None, [], 0

        def whole() -> tuple[np.ndarray, np.ndarray]:
            k, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(k, kind="stable")
            k = k[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            return k[first], np.add.reduceat(n[order], first)

        def out() -> Iterator[pa.RecordBatch]:
            k, n = whole()
            for i in range(0, len(k), 1_000_000):
                yield rows_of([(at, squeezed(np.diff(k[i:i + 1_000_000], prepend=0)), squeezed(n[i:i + 1_000_000]))])

        for batch in batches:
            for shard, k, n in zip(*[batch.column(c) for c in names], strict=True):
                if shard.as_py() != at:
                    if held:
                        yield from out()
                    at, held, waiting = shard.as_py(), [], 0
                held.append((np.cumsum(unsqueezed(k.as_py())), unsqueezed(n.as_py())))
                waiting += len(held[-1][0])
                if waiting > max(2_000_000, 2 * len(held[0][0])):     # distinct keys so far, and as many again
                    held, waiting = [whole()], 0
        if held:
            yield from out()

    pieces = train.mapInArrow(lean(count), schema).repartition(parts, "shard").sortWithinPartitions("shard")
    model = stored(pieces.mapInArrow(lean(merge), schema), "trusted-bigrams")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By left word (0): count and kinds met 1, 2, 3+ times; by right word (1): kinds; by count (2): kinds."""
        for batch in batches:
            for k, n in zip(batch.column("keys"), batch.column("counts"), strict=True):
                k, n = np.cumsum(unsqueezed(k.as_py())), unsqueezed(n.as_py())
                v, first = np.unique(k // size, return_index=True)
                sums = [np.add.reduceat(x, first) for x in (n, *[(np.minimum(n, 3) == i).astype(np.int64) for i in (1, 2, 3)])]
                w, kinds = np.unique(k % size, return_counts=True)
                few, of_few = np.unique(n[n <= 4], return_counts=True)
                none = np.zeros(len(w) + len(few), np.int64)
                side = np.repeat(np.arange(3), [len(v), len(w), len(few)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(side), pa.array(np.concatenate([v, w, few])), pa.array(np.concatenate([sums[0], kinds, of_few])),
                     *[pa.array(np.concatenate([m, none])) for m in sums[1:]]], ["side", "x", "c", "m1", "m2", "m3"])

    # Two rows per word of the vocabulary at most, as Arrow columns.
    facts = (model.mapInArrow(lean(summarise), "side long, x long, c long, m1 long, m2 long, m3 long").groupBy("side", "x")
             .agg(*[F.sum(c).alias(c) for c in ("c", "m1", "m2", "m3")]).toArrow())
    side, x, c, m1, m2, m3 = (facts.column(i).to_numpy() for i in range(6))
    of_counts = dict(zip(x[side == 2].tolist(), c[side == 2].tolist(), strict=True))
    d = discounts(*[of_counts.get(i, 0) for i in (1, 2, 3, 4)])
    weight, total, follow = np.ones(size), np.zeros(size), np.zeros(size)
    left, right = side == 0, side == 1
    total[x[left]] = c[left]
    weight[x[left]] = (d[1] * m1[left] + d[2] * m2[left] + d[3] * m3[left]) / c[left]
    follow[x[right]] = c[right]
    # Lower order: continuation counts, discounted and interpolated with the uniform distribution.
    types = (follow > 0).sum()
    lower = (np.maximum(follow - 0.75, 0) + 0.75 * types / size) / max(1.0, follow.sum())
    tables = Tables(hashes, lower, weight, total, d, -float(np.log(max(1, rare))))
    shards = min(parts, max(MIN_SHARDS, power_of_two(-(-int(follow.sum()) // shard_keys))))
    return tables, model.withColumn("shard", F.col("shard") % shards), shards


def squeezed(x: np.ndarray) -> bytes:
    """Compressed by byte planes: the high bytes are mostly 0."""
    return zlib.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unsqueezed(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def squeezed_members(places: np.ndarray, first: np.ndarray) -> bytes:
    """Places in runs (one per key, ascending) that begin at ``first``: steps in a run, by byte planes."""
    step = np.diff(places.astype(np.int64), prepend=0)
    step[first] = places[first]
    return zlib.compress(step.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), 1)


def unsqueezed_members(x: bytes, holders: np.ndarray) -> np.ndarray:
    step = np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(2, -1).T).view("<u2").ravel().astype(np.int64)
    first = np.cumsum(holders) - holders
    total = np.cumsum(step)
    return total - np.repeat(total[first] - step[first], holders)


def shard_slices(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    s = (mix(keys.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(s, kind="stable")
    cut = np.searchsorted(s[order], np.arange(shards + 1))
    for i in range(shards):
        if cut[i] < cut[i + 1]:
            yield i, order[cut[i]:cut[i + 1]]


def chunks(rows: DataFrame, tables: Tables, shards: int, chunk_words: int) -> DataFrame:
    """A row per chunk and shard: sorted distinct keys (as deltas), how many documents hold
    each, and those documents' places in the chunk (as steps); and one row per chunk with its documents."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = ("shard long, chunk long, keys binary, holders binary, members binary, "
              f"ids array<{kind}>, langs array<string>, sizes array<long>")
    shared = rows.sparkSession.sparkContext.broadcast(tables)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = encoder(shared.value.hashes), len(shared.value.hashes) + 2
        names = [x.split()[0] for x in schema.split(", ")]
        chunk = TaskContext.get().partitionId() << 32
        keys: list[np.ndarray] = []
        ids: list = []
        langs: list = []

        def flush() -> pa.RecordBatch:
            places = np.repeat(np.arange(len(keys), dtype="<u2"), [len(k) for k in keys])
            flat, out = np.concatenate(keys), []
            for s, at in shard_slices(flat, shards):
                o = at[np.argsort(flat[at], kind="stable")]
                k = flat[o]
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                delta = np.diff(k[first], prepend=0)
                holders = np.diff(first, append=len(k))
                out.append((s, chunk, squeezed(delta), squeezed(holders),
                            squeezed_members(places[o], first), None, None, None))
            out.append((chunk % shards, chunk, None, None, None, ids, langs, [len(k) for k in keys]))
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(id_type),
                     pa.list_(pa.string()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        words = 0
        for batch in batches:
            id_type = batch.schema.field("id").type
            for i, lang, text in zip(batch.column("id"), batch.column("lang"), batch.column("text"), strict=True):
                k = bigram_keys(encode, text.as_py(), size)
                keys.append(k)
                ids.append(i.as_py())
                langs.append(lang.as_py())
                words += len(k)
                if words >= chunk_words or len(keys) == 65_000:
                    yield flush()
                    chunk, words = chunk + 1, 0
                    keys, ids, langs = [], [], []
        if keys:
            yield flush()

    return rows.mapInArrow(lean(make), schema)


def join_shards(sent: DataFrame, model: DataFrame, tables: Tables, shards: int) -> DataFrame:
    """(chunk, places, sums) for every chunk and shard: the shard's counts come first, then the
    chunks stream past them; the chunks' document rows pass unchanged.  Null places: all."""
    shared = sent.sparkSession.sparkContext.broadcast(tables)
    first = model.select("shard", F.lit(-1).cast("long").alias("chunk"), "keys", F.col("counts").alias("holders"),
                         *[F.lit(None).cast(sent.schema[c].dataType).alias(c) for c in ("members", "ids", "langs", "sizes")])
    # Partitions of whole shards; the model's row (chunk -1) sorts before the chunks' rows.
    both = sent.unionByName(first).repartition(shards, "shard").sortWithinPartitions("shard", "chunk")
    names = ["chunk", "places", "sums", "ids", "langs", "sizes"]
    schema = ", ".join(f"{c} {'binary' if c in ('places', 'sums') else sent.schema[c].dataType.simpleString()}" for c in names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tables = shared.value
        size = len(t.hashes) + 2
        at, keys, counts, held = None, np.empty(0, np.int64), np.zeros(1, np.int64), []
        for batch in batches:
            hit, sums = [], []
            for shard, chunk, k, h, m in zip(*[batch.column(c).to_pylist() for c in ("shard", "chunk", "keys", "holders", "members")],
                                             strict=True):
                if shard != at:
                    at, keys, counts = shard, np.empty(0, np.int64), np.zeros(1, np.int64)
                    held = []
                hit.append(None)
                sums.append(None)
                if chunk == -1:      # a shard's counts come in several rows
                    held.append((np.cumsum(unsqueezed(k)), unsqueezed(h)))
                elif k is not None:
                    if held:
                        keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
                        order = np.argsort(keys)
                        keys, counts, held = keys[order], np.append(counts[order], 0), []
                    key = np.cumsum(unsqueezed(k))
                    spot = np.searchsorted(keys, key)
                    found = np.zeros(len(key), bool)
                    inside = spot < len(keys)
                    found[inside] = keys[spot[inside]] == key[inside]
                    c = np.where(found, counts[spot], 0)
                    v, w = np.divmod(key, size)
                    high = np.maximum(c - t.discount[np.minimum(c, 3)], 0) / np.maximum(t.total[v], 1)
                    logs = np.log(np.maximum(high + t.weight[v] * t.follow[w], 1e-12)) + np.where(w == 0, t.other, 0.0)
                    holders = unsqueezed(h)
                    places = unsqueezed_members(m, holders)
                    total = np.bincount(places, np.repeat(logs, holders))
                    some = np.flatnonzero(np.bincount(places))
                    if 10 * len(some) < 8 * len(total):
                        hit[-1], total = some.astype("<u2").tobytes(), total[some]
                    sums[-1] = squeezed(np.rint(total / -UNIT).astype(np.int64))
            out = pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(hit, pa.binary()), pa.array(sums, pa.binary()),
                                              *[batch.column(c) for c in names[3:]]], names)
            yield out.filter(pa.array([c != -1 for c in batch.column("chunk").to_pylist()]))

    return both.mapInArrow(lean(join), schema)


def add_up(joined: DataFrame) -> DataFrame:
    """id, lang, n_words, logp; a group is one chunk."""
    kind = joined.schema["ids"].dataType.elementType.simpleString()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = pdf[pdf.ids.notna()].iloc[0]
        total = np.zeros(len(docs.ids), np.int64)
        for places, x in pdf.loc[pdf.sums.notna(), ["places", "sums"]].itertuples(index=False):
            v = unsqueezed(x)
            total[slice(len(v)) if places is None else np.frombuffer(places, "<u2")] += v
        return pd.DataFrame({"id": docs.ids, "lang": docs.langs, "n_words": docs.sizes, "logp": total * -UNIT})

    return joined.groupBy("chunk").applyInPandas(add, f"id {kind}, lang string, n_words long, logp double")


def score_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  vocabulary: int | None = VOCABULARY, train_rows: int | None = TRAIN_ROWS, chunk_words: int = CHUNK_WORDS,
                  shrink_words: float = 20.0, keep_quantile: float = 0.99, min_trusted: int = 30) -> DataFrame:
    """id_col, lang, n_words, perplexity, threshold, kept.  ``trusted`` has the trusted ids.
    ``docs`` should be a table scan or otherwise keep its rows' order when recomputed."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    learned = trusted.filter(~held_back(F.col(id_col)))
    if not learned.limit(1).count():
        learned = trusted
    fitted = fit(docs, learned, id_col, text_col, vocabulary, train_rows)
    if fitted is None:
        n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
        none = F.lit(None).cast("double")
        return rows.select(F.col("id").alias(id_col), "lang", n.alias("n_words"), none.alias("perplexity"),
                           none.alias("threshold"), (n > 0).alias("kept"))
    tables, model, shards = fitted
    scored = stored(add_up(join_shards(chunks(rows, tables, shards, chunk_words), model, tables, shards)), "perplexity")
    means = key_list(scored.groupBy("lang").agg(F.try_divide(F.sum("logp"), F.sum("n_words")).alias("mean")), "language-means")
    scored = scored.join(means, "lang").withColumn("perplexity", F.when(
        F.col("n_words") > 0, F.exp(-(F.col("logp") + shrink_words * F.col("mean")) / (F.col("n_words") + shrink_words))))
    seen = scored.join(trusted.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi").filter("n_words > 0")
    new = seen.filter(held_back(F.col("id")))
    bound = F.percentile_approx("perplexity", keep_quantile, 10_000)
    by_lang = key_list(new.groupBy("lang").agg(bound.alias("bound"), F.count("*").alias("m")), "language-thresholds")
    whole = new.agg(bound.alias("b"), F.count("*").alias("m")).first()
    overall = F.lit(whole["b"] if whole["m"] >= min_trusted else seen.agg(bound.alias("b")).first()["b"]).cast("double")
    out = scored.join(by_lang, "lang", "left").withColumn(
        "threshold", F.when(F.col("m") >= min_trusted, F.col("bound")).otherwise(overall))
    return out.select(F.col("id").alias(id_col), "lang", "n_words", "perplexity", "threshold",
                      F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
