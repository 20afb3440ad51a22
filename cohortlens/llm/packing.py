r"""Mixture-controlled packing: deficit round-robin over source queues.

1. Tokenise once.  Each document becomes chunks of at most ``seq_len`` tokens,
   written with their ids (two bytes a token) to the shared checkpoint folder;
   everything up to step 4 reads only (row, chunk, source, length).
2. Queues.  A source's queue is its chunks ordered by a hash, so a queue is
   sliced by the hash's leading bits without sampling and without a task that
   holds one whole source.  Chunk positions in the queue are prefix sums: sums of
   (source, slice), a running sum over the slices, then a running sum inside each.
3. Deficit round-robin.  Source ``s`` gets quantum ``q_s`` (its share of the target
   mixture) of every window's tokens; it sends whole chunks while its credit lasts
   and carries the rest.  A chunk that ends at token ``E`` of its queue is therefore
   sent in the round in which the accumulated credit reaches ``E``: its window
   follows from ``E`` alone, in closed form, and the deficit that a source carries
   into a window is its accumulated credit less what it has sent.  An empty queue
   gives up its quantum, so the others' credit grows faster from there on.
4. Windows are joined into one stream by a two-level prefix sum over their lengths
   and cut every ``seq_len`` tokens, so all sequences but the last are full; a chunk
   is cut in two at most once.  One join by chunk brings the ids to the pieces.

No step needs one source, one window range or the document list in one task; a
window holds about ``window_tokens`` tokens, whatever the input's size.

Defined cases: null and empty texts are one token (the end id).  A null source is
a queue of its own, shared with the empty name.  Repeated rows, also with equal
ids, are packed each.  An empty table gives no pieces.  Extra columns of the input
are ignored; the result has its own columns only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Bounded, lean, stored

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SLICE_ROWS = 2_000
#: Letters, digits and marks up to U+024F; other texts take the tokenizer's own path.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-ɏ]*")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[0-9²³¹¼-¾]|(?:[^\w\s]|_)+")


def _byte_names() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + n)
    return names


class WordTokens:
    """Ids of a text as little-endian 16-bit bytes, memoised by word.

    The vocabulary drops white space, lowers case and never merges across words,
    so a text's ids are its words' ids in order.  Texts outside ``PLAIN`` (composed
    marks, other scripts, control characters) or with a special token's string are
    encoded whole by the tokenizer.
    """

    def __init__(self, vocabulary: str, limit: int = 200_000):
        import os

        import public_tokenizers
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = vocabulary if os.sep in vocabulary else public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.model, self.names = self.tokenizer.model, _byte_names()
        self.part = Bounded(self._part, limit // 2)
        self.word = Bounded(self._word, limit)

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = "".join([self.names[b] for b in part.encode()])
        return np.array([t.id for t in self.model.tokenize(part)], "<u2").tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join([self.part[p] for p in PARTS.findall(word)])

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text and PLAIN.fullmatch(text):
            return b"".join(map(self.word.__getitem__, text.lower().split()))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


_TOKENS: dict[str, WordTokens] = {}


def _tokens(vocabulary: str) -> WordTokens:
    if vocabulary not in _TOKENS:
        _TOKENS[vocabulary] = WordTokens(vocabulary)
    return _TOKENS[vocabulary]


def tokenize(docs: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str, seq_len: int) -> DataFrame:
    """Chunks: row_id, chunk, doc_id, source, start, n, doc_tokens, ids (16-bit bytes)."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row_id long, chunk long, doc_id {kind}, source string, start long, n long, doc_tokens long, ids binary"
    end = np.array([END_ID], "<u2").tobytes()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokens(vocabulary)
        for batch in batches:
            row, start, ids, total = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                got = encode(text.as_py()) + end
                for at in range(0, len(got), 2 * seq_len):
                    row.append(i)
                    start.append(at // 2)
                    ids.append(got[at:at + 2 * seq_len])
                    total.append(len(got) // 2)
            take = batch.take(pa.array(row, pa.int32()))
            at = pa.array(start, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [take.column("row_id"), pa.array([s // seq_len for s in start], pa.int64()), take.column("doc_id"),
                 take.column("source"), at, pa.array([len(x) // 2 for x in ids], pa.int64()),
                 pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                ["row_id", "chunk", "doc_id", "source", "start", "n", "doc_tokens", "ids"])

    return rows.mapInArrow(lean(chunks), schema)


def running_start(df: DataFrame, key: str, length: str, out: str, per_block: int = 4096) -> DataFrame:
    """Adds ``out``: the sum of ``length`` over smaller ``key`` (distinct, 0, 1, 2, ...).

    Two levels: blocks of ``per_block`` keys; only the block sums meet in one task.
    """
    block = F.floor(F.col(key) / per_block)
    sums = df.groupBy(block.alias("__blk")).agg(F.sum(length).alias("__n"))
    sums = sums.select("__blk", (F.sum("__n").over(W.orderBy("__blk")) - F.col("__n")).alias("__before"))
    inner = W.partitionBy("__blk").orderBy(key)
    df = df.withColumn("__blk", block).withColumn("__own", F.sum(length).over(inner) - F.col(length))
    return df.join(sums, "__blk").withColumn(out, F.col("__before") + F.col("__own")).drop("__blk", "__own", "__before")


def _served(v: Column, sources: list[tuple[float, float]]) -> Column:
    """Tokens that all queues have sent when the virtual time is ``v``; ``sources``: (tokens, weight)."""
    return F.aggregate(
        F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in sources]),
        F.lit(0.0), lambda a, s: a + F.least(s["w"] * v, s["t"]))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         seq_len: int = 4096, mixture: Mapping[str, float] | None = None, window_tokens: int = 131_072,
         vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces: doc_id, start, length, ids (16-bit little-endian), doc_tokens, sequence_id,
    offset, source, window.  ``mixture`` maps sources to target weights (others share what
    they hold); None targets the corpus's own proportions."""
    if seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    tokens = stored(tokenize(docs, id_col, text_col, source_col, vocabulary, seq_len), "tokens")
    units = tokens.select("row_id", "chunk", "source", "n").withColumn("h", F.xxhash64("row_id", "chunk"))
    n_units = tokens.count()
    bits = max(0, (max(1, n_units) // SLICE_ROWS).bit_length())
    units = units.withColumn("slice", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))

    # Positions in the queues.
    sums = units.groupBy("source", "slice").agg(F.sum("n").alias("m"))
    queue = W.partitionBy("source")
    sums = sums.select("source", "slice", (F.sum("m").over(queue.orderBy("slice")) - F.col("m")).alias("before"),
                       F.sum("m").over(queue).alias("queue_tokens"))
    inside = W.partitionBy("source", "slice").orderBy("h", "row_id", "chunk")
    units = (units.withColumn("own", F.sum("n").over(inside)).join(sums, ["source", "slice"])
             .withColumn("end", (F.col("before") + F.col("own")).cast("double")))

    # Rounds: virtual time at which the credit of the chunk's source reaches its end.
    if mixture is None:
        total = sums.agg(F.sum(F.when(F.col("before") == 0, F.col("queue_tokens")))).scalar()
        v = F.col("end") / F.col("queue_tokens")
        served = v * total
    else:
        # As many rows as ``mixture`` names sources, and one for all others.
        named = F.when(F.col("source").isin(*mixture), F.col("source"))
        held = {r["s"]: r["t"] for r in tokens.groupBy(named.alias("s")).agg(F.sum("n").alias("t")).collect()}
        rest, share = held.pop(None, 0), sum(mixture.values())
        all_tokens = max(1, sum(held.values()) + rest)
        weights = {s: w / share * (all_tokens - rest) for s, w in mixture.items() if held.get(s)}
        sources = [(held[s], w) for s, w in weights.items()] + ([(rest, rest)] if rest else [])
        weight = F.col("queue_tokens").cast("double")
        for s, w in weights.items():
            weight = F.when(F.col("source") == s, F.lit(float(w))).otherwise(weight)
        v = F.col("end") / weight
        served = _served(v, sources) if sources else F.lit(0.0)
    units = units.withColumn("v", v).withColumn(
        "window", F.greatest(F.ceil(served / F.lit(float(window_tokens))) - 1, F.lit(0)).cast("long"))

    # One stream of tokens over all windows, cut every seq_len tokens.
    per_window = units.groupBy("window").agg(F.sum("n").alias("m"))
    starts = running_start(per_window, "window", "m", "window_start").select("window", "window_start")
    order = W.partitionBy("window").orderBy("v", "source", "row_id", "chunk")
    units = (units.withColumn("in_window", F.sum("n").over(order) - F.col("n")).join(starts, "window")
             .withColumn("at", F.col("window_start") + F.col("in_window")))
    first, last = F.floor(F.col("at") / seq_len), F.floor((F.col("at") + F.col("n") - 1) / seq_len)
    cuts = units.select("row_id", "chunk", "window", "at", "n", F.explode(F.sequence(first, last)).alias("sequence_id"))
    lo = F.greatest(F.col("at"), F.col("sequence_id") * seq_len)
    hi = F.least(F.col("at") + F.col("n"), (F.col("sequence_id") + 1) * seq_len)
    cuts = cuts.select("row_id", "chunk", "window", "sequence_id", (lo - F.col("sequence_id") * seq_len).alias("offset"),
                       (lo - F.col("at")).alias("skip"), (hi - lo).alias("length"))
    return (tokens.drop("n").join(cuts, ["row_id", "chunk"])
            .select("doc_id", (F.col("start") + F.col("skip")).alias("start"), "length",
                    F.substring("ids", 2 * F.col("skip") + 1, 2 * F.col("length")).alias("ids"), "doc_tokens",
                    "sequence_id", "offset", "source", "window"))


def with_crc32(pieces: DataFrame) -> DataFrame:
    """Replaces ``ids`` by ids_crc32 over unsigned little-endian 32-bit ids."""
    fields = [f for f in pieces.schema.fields if f.name != "ids"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ids_crc32 long"

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(np.frombuffer(x.as_py(), "<u2").astype("<u4").tobytes()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in fields] + [pa.array(sums, pa.int64())],
                [f.name for f in fields] + ["ids_crc32"])

    return pieces.mapInArrow(lean(crc), schema)
