"""Alignment of two tokenizers over distinct texts.

1. Exact-text deduplication: one aggregation by the full text (partial on the map side, so
   a text that a third of all rows share is one row of each task) counts its copies.
2. Each distinct text is tokenised by both vocabularies and aligned once.  Tokens become
   byte ranges; where a token of A and a token of B end together the text is cut into
   groups, and the two tokens are linked.  The result is stored: counts, the digest of the
   groups and the distinct linked id pairs with their numbers.
3. Corpus-wide counts of id pairs, each text's numbers times its copies: summed in the
   tasks, emitted whenever ``ROOM`` distinct pairs are held, and added up by pair.  A window
   over each B id's pairs (at most as many as A has ids) marks the highest count.
4. The pair table goes to all tasks in blocks of at most ``BLOCK_PAIRS`` pairs (one block
   unless there are more), each giving the texts' partial measures.
5. Measures return to the documents by a digest of the text.  Texts that hold more than a
   thousandth of all documents (so at most a thousand) are joined by broadcast, the others
   by key, so no hot text gathers in one task.

Defined cases: null and empty texts, and texts whose joined token bytes differ from space +
text, have no tokens: zeros and an empty digest.  Strings of special tokens are plain text.
Repeated rows and ids give a row each; a null id stays.  An empty table gives no rows.
Extra columns of the input are ignored.  A text is tokenised whole, however long.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pair code: B id times this plus A id, in 32 bits.
CODES = 1 << 16
BLOCK_PAIRS = 2_000_000
ROOM = 1_000_000
#: The split of GPT-2's byte-level tokenizers, a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ALIGNED = ("text_key binary, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, "
           "codes binary, numbers binary")
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _path(vocabulary: str) -> str:
    import os

    import public_tokenizers
    return vocabulary if os.sep in vocabulary else public_tokenizers.path(vocabulary)


class ByteTokens:
    """Tokens of a byte-level BPE file: ids of space + text, and every id's bytes.

    The file's vocabulary lists tokens in merge order, which is all that a rank-based
    encoder needs; special tokens are left out, so their strings are ordinary text.
    """

    def __init__(self, vocabulary: str):
        import tiktoken

        from .packing import _byte_names
        with open(_path(vocabulary), encoding="utf-8") as f:
            file = json.load(f)
        special = {t["id"] for t in file.get("added_tokens", ())}
        value = {c: b for b, c in _byte_names().items()}
        ranks = {bytes(value[c] for c in token): i for token, i in file["model"]["vocab"].items() if i not in special}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.bytes[i] = raw

    def __call__(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(" " + text)


class PieceTokens:
    """Tokens of a sentence-piece file, which puts the space before the text itself."""

    def __init__(self, vocabulary: str):
        import sentencepiece
        self.processor = sentencepiece.SentencePieceProcessor(model_file=_path(vocabulary))
        self.bytes = []
        for i in range(self.processor.get_piece_size()):
            piece = self.processor.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.processor.is_byte(i)
                              else piece.replace("▁", " ").encode())

    def __call__(self, text: str) -> list[int]:
        return self.processor.encode(text)


class Aligner:
    """Aligns the tokens of a text; see the module."""

    def __init__(self, vocabulary_a: str, vocabulary_b: str):
        self.a, self.b = ByteTokens(vocabulary_a), PieceTokens(vocabulary_b)
        if len(self.a.bytes) > CODES or len(self.b.bytes) > CODES:
            raise ValueError("ids must fit in 16 bits")
        self.sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        # An id as text with what follows it: inside its side of a group, or last there.
        self.texts = [[np.array([f"{i}{mark}" for i in range(len(t.bytes))], object) for mark in (",", last)]
                      for t, last in ((self.a, "|"), (self.b, ";"))]

    def __call__(self, text: str) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, groups' digest, distinct pair codes, their numbers)."""
        raw = b" " + text.encode()
        found_a, found_b = self.a(text), self.b(text)
        for tokens, found in ((self.a, found_a), (self.b, found_b)):
            if b"".join(map(tokens.bytes.__getitem__, found)) != raw:
                return 0, 0, 0, "", np.empty(0, np.uint32), np.empty(0, np.uint32)
        a, b = np.array(found_a, np.int64), np.array(found_b, np.int64)
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        at = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[at] == end_a)     # the last token of each group
        last_b = at[last_a]
        codes, numbers = np.unique((b[last_b] * CODES + a[last_a]).astype(np.uint32), return_counts=True)
        return (len(a), len(b), len(last_a), self._digest(a, b, last_a, last_b), codes, numbers.astype(np.uint32))

    def _digest(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        # A group's A tokens come after all tokens of the groups before it, its B tokens after them.
        before_b = np.concatenate([[0], last_b[:-1] + 1])
        place_a = np.arange(len(a)) + before_b[np.searchsorted(last_a, np.arange(len(a)))]
        place_b = np.arange(len(b)) + (last_a + 1)[np.searchsorted(last_b, np.arange(len(b)))]
        out = np.empty(len(a) + len(b), object)
        (inside_a, end_a), (inside_b, end_b) = self.texts
        out[place_a], out[place_b] = inside_a[a], inside_b[b]
        out[place_a[last_a]], out[place_b[last_b]] = end_a[a[last_a]], end_b[b[last_b]]
        return hashlib.sha256("".join(out.tolist())[:-1].encode()).hexdigest()


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(*vocabularies: str) -> Aligner:
    if vocabularies not in _ALIGNERS:
        _ALIGNERS[vocabularies] = Aligner(*vocabularies)
    return _ALIGNERS[vocabularies]


def align_texts(texts: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """Stored alignment of every distinct text of a ``text`` column (see 1 and 2)."""
    distinct = (texts.filter(F.length("text") > 0).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
                .select(F.unhex(F.sha2("text", 256)).alias("text_key"), "copies", "text"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(vocabulary_a, vocabulary_b)
        for batch in batches:
            n = 1 + batch.column("text").nbytes // (4 << 20)     # results of few megabytes at a time
            step = -(-len(batch) // n)
            for at in range(0, len(batch), max(1, step)):
                part = batch.slice(at, step)
                got = list(zip(*[aligner(t) for t in part.column("text").to_pylist()], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("text_key"), part.column("copies"),
                     *[pa.array(x, pa.int64()) for x in got[:3]], pa.array(got[3], pa.string()),
                     *[pa.array([x.tobytes() for x in xs], pa.binary()) for xs in got[4:]]],
                    names=[c.split()[0] for c in ALIGNED.split(", ")])

    return stored(distinct.mapInArrow(align, ALIGNED), "aligned")


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, numbers) of every text of a batch."""
    for c, n in zip(batch.column("codes"), batch.column("numbers"), strict=True):
        yield np.frombuffer(c.as_py(), np.uint32), np.frombuffer(n.as_py(), np.uint32).astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(code, n, best): links of each id pair in the whole corpus; best: the highest of its B id."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, size = [], [], 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            found, place = np.unique(np.concatenate(codes), return_inverse=True)
            added = np.zeros(len(found), np.int64)
            np.add.at(added, place, np.concatenate(counts))
            return found, added

        def rows(found: np.ndarray, added: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(added)], names=["code", "n"])

        for batch in batches:
            for copies, (c, n) in zip(batch.column("copies").to_pylist(), _pairs(batch), strict=True):
                codes.append(c)
                counts.append(n * copies)
                size += len(c)
                if size >= 2 * ROOM:
                    found, added = total()
                    if len(found) >= ROOM:
                        yield rows(found, added)
                        found, added = found[:0], added[:0]
                    codes, counts, size = [found], [added], len(found)
        if codes:
            yield rows(*total())

    counts = (aligned.select("copies", "codes", "numbers").mapInArrow(count, "code long, n long")
              .groupBy("code").agg(F.sum("n").alias("n")))
    highest = F.max("n").over(Window.partitionBy(F.floor(F.col("code") / CODES)))
    return stored(counts.withColumn("best", F.col("n") == highest), "pair-counts")


def text_measures(aligned: DataFrame, pairs: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Every distinct text's measures from the counts of its pairs, block by block (see 4)."""
    blocks = max(1, -(-pairs.count() // block_pairs))
    sc = aligned.sparkSession.sparkContext
    parts = []
    for block in range(blocks):
        mine = pairs.filter(F.pmod(F.xxhash64("code"), F.lit(blocks)) == block).toArrow()
        order = np.argsort(mine["code"].to_numpy())
        sent = sc.broadcast((mine["code"].to_numpy()[order].astype(np.uint32), mine["n"].to_numpy()[order],
                             mine["best"].to_numpy()[order]))

        def measure(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known, n, best = sent.value
            for batch in batches:
                sums = []
                for codes, numbers in _pairs(batch):
                    at = np.searchsorted(known, codes)
                    at[at == len(known)] = 0
                    here = known[at] == codes if len(known) else np.zeros(len(codes), bool)
                    at, numbers = at[here], numbers[here]
                    sums.append((int(numbers.sum()), int(numbers[best[at]].sum()), int((numbers * n[at]).sum())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("text_key"), *[pa.array(x, pa.int64()) for x in zip(*sums, strict=True)]],
                    names=["text_key", "n_links", "n_best", "count_sum"])

        parts.append(aligned.select("text_key", "codes", "numbers").mapInArrow(
            measure, "text_key binary, n_links long, n_best long, count_sum long"))
    if blocks == 1:
        return parts[0]
    return reduce(DataFrame.unionByName, parts).groupBy("text_key").agg(
        *[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_a: str = VOCABULARY_A,
                     vocabulary_b: str = VOCABULARY_B, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row per document."""
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text"))
    aligned = align_texts(rows.select("text"), vocabulary_a, vocabulary_b)
    pairs = pair_counts(aligned)
    linked = text_measures(aligned, pairs, block_pairs)
    base = aligned.select("text_key", "copies", "n_a", "n_b", "n_groups", "groups_sha256")
    measures = stored(base.join(linked, "text_key"), "text-measures")

    keyed = rows.select(id_col, F.when(F.length("text") > 0, F.unhex(F.sha2("text", 256))).alias("key"))
    total = measures.agg(F.sum("copies")).first()[0] or 0
    often = F.col("copies") * 1000 > total            # at most a thousand texts
    columns = [*MEASURES, "groups_sha256"]
    hot = F.broadcast(measures.filter(often).select("text_key", *columns))
    in_hot = F.col("key") == F.col("text_key")
    first = keyed.join(hot, in_hot).select(id_col, *columns)
    rest = keyed.join(hot.select("text_key"), in_hot, "left_anti")
    second = rest.join(measures.filter(~often).select("text_key", *columns), in_hot, "left").select(
        id_col, *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in MEASURES],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return first.unionByName(second)
