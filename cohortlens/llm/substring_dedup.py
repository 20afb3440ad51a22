r"""Substring dedup: suffix automata of reference shards, matching statistics, span removal.

A window is ``window`` consecutive words of one document.  Every word is removed that
lies in a window whose word sequence also starts in a document with a smaller id;
windows are judged on the input.

1. Anchors (map).  Each window is named by the smallest hash of its ``GRAM``-word runs.
   Equal windows have equal anchors, and neighbouring windows mostly share theirs, so a
   document gives about one *run* of windows per twenty words.
2. Only anchors seen in two documents or more can hold a repeated window.  They are found
   by a grouped minimum and maximum of the ids, and joined back to the runs.
3. Reference shards.  Anchors are hashed to shards of about ``SHARD_ROWS`` runs, those of
   more runs have a shard of their own, of at most ``hot_rows`` runs; a run's words go to its anchor's shard, the only place where its windows can meet equal ones.  A
   shard's task streams the runs in the order of ids past a suffix automaton of what came
   before: matching statistics (the longest suffix that occurs in the reference) mark every
   window that occurs in an earlier document; the maximal spans are written out, and the
   run's new windows are added to the automaton.  The references grow with the corpus, so
   shards are dealt out instead of being sent to every task.
4. Very frequent anchors (over ``hot_rows`` runs: a passage in a third of all documents)
   are not streamed through one task: their windows are named by two independent 64-bit
   hashes of all their words and compared in a grouped minimum with map-side combining.
   Both ways give the same spans (a false match of 128 bits has a chance below 1e-18 among
   ten billion windows).
5. Overlapping spans are merged, joined back to the documents by row key (to all tasks if
   the counted spans are few) and cut out of whole texts.

Defined cases: null text has no words.  Rows with a null id neither serve as reference
nor lose words.  Repeated rows (and different texts under one id) never remove each
other's words, only those of larger ids.  Documents shorter than a window are unchanged.
An empty table gives an empty result.  Extra columns are carried; result columns replace
input columns of the same name.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, gram_hash, hash_words, key_list, lean, mix, row_key, space_words, stored

SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
GRAM = 8
#: Sets the second hash of a window apart from the first.
SECOND = np.uint64(0x5851F42D4C957F2D)
HOT_ROWS = 4096
SHARD_ROWS = 1000


def anchor_runs(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each run of windows with the same anchor."""
    if len(h) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    g = gram_hash(h, GRAM)
    # Sliding minimum over the window's grams, from two overlapping powers of two.
    width, span, low = window - GRAM + 1, 1, g
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:len(g) - width + 1], low[width - span:])
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    last = np.append(first[1:], len(low)) - 1
    return low[first], first, last


def find_anchors(rows: DataFrame, window: int) -> DataFrame:
    """id, key and the document's runs: anchors, lo, hi (arrays)."""
    kind = rows.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, len(big), 500):
                batch = big.slice(start, 500)
                words = [space_words(t) for t in batch.column("text").to_pylist()]
                flat, at, runs = hash_words([w for ws in words for w in ws]), 0, []
                for ws in words:
                    runs.append(anchor_runs(flat[at:at + len(ws)], window))
                    at += len(ws)
                some = [i for i, r in enumerate(runs) if len(r[0])]
                take = batch.take(pa.array(some, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [take.column("id"), take.column("key"),
                     pa.array([runs[i][0].view(np.int64) for i in some], pa.list_(pa.int64())),
                     pa.array([runs[i][1] for i in some], pa.list_(pa.int32())),
                     pa.array([runs[i][2] for i in some], pa.list_(pa.int32()))], ["id", "key", "anchor", "lo", "hi"])

    return rows.mapInArrow(lean(find), f"id {kind}, key long, anchor array<long>, lo array<int>, hi array<int>")


class SuffixAutomaton:
    """Generalised suffix automaton over words; strings are added one after another.

    Kept in flat arrays: most states have one transition, which lies in two of them; the
    further transitions of the others are entries of one dictionary.
    """

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.link, self.size = array("i", [-1]), array("i", [0])
        self.more: dict[int, int] = {}
        self.others: dict[int, list[int]] = {}

    def _get(self, state: int, w: int) -> int | None:
        return self.to[state] if self.word[state] == w else self.more.get(state << 32 | w)

    def _put(self, state: int, w: int, target: int) -> None:
        first = self.word[state]
        if first == w or first < 0:
            self.word[state], self.to[state] = w, target
            return
        key = state << 32 | w
        if key not in self.more:
            self.others.setdefault(state, []).append(w)
        self.more[key] = target

    def _state(self, size: int, link: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The part of state ``q`` that ``p`` reaches by ``w``, as a state of its own."""
        clone = self._state(self.size[p] + 1, self.link[q])
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        for x in self.others.get(q, ()):
            self._put(clone, x, self.more[q << 32 | x])
        self.link[q] = clone
        while p >= 0 and self._get(p, w) == q:
            self._put(p, w, clone)
            p = self.link[p]
        return clone

    def add(self, words: list) -> None:
        get, put, link, size, ids = self._get, self._put, self.link, self.size, self.ids
        last = 0
        for word in words:
            w = ids.setdefault(word, len(ids))
            q = get(last, w)
            if q is not None:        # known so far: no new state but for a part of ``q``
                last = q if size[q] == size[last] + 1 else self._split(last, w, q)
                continue
            new, p = self._state(size[last] + 1, 0), last
            while p >= 0 and get(p, w) is None:
                put(p, w, new)
                p = link[p]
            if p >= 0:
                q = get(p, w)
                link[new] = q if size[q] == size[p] + 1 else self._split(p, w, q)
            last = new

    def ends(self, words: list, least: int) -> list[int]:
        """Positions at which a match of ``least`` words or more ends (matching statistics)."""
        get, link, size = self._get, self.link, self.size
        state, n, out = 0, 0, []
        for i, word in enumerate(words):
            w = self.ids.get(word)
            if w is None:
                state, n = 0, 0
                continue
            to = get(state, w)
            while to is None and state:
                state = link[state]
                n = size[state]
                to = get(state, w)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
                if n >= least:
                    out.append(i)
        return out


def spans(starts: list[int], width: int) -> list[tuple[int, int]]:
    """Maximal spans [a, b) covered by windows at the (sorted) starts."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + width)
        else:
            out.append((s, s + width))
    return out


class Shard:
    """Streams (id, words) in the order of ids; returns the spans found in smaller ids."""

    def __init__(self, window: int):
        self.window, self.automaton = window, SuffixAutomaton()
        self.seen: set[str] = set()
        self.id, self.waiting = None, []

    def match(self, doc_id, text: str) -> list[tuple[int, int]]:
        if doc_id != self.id:
            for new, parts in self.waiting:
                self.seen.add(new)
                for part in parts:
                    self.automaton.add(part)
            self.id, self.waiting = doc_id, []
        words = text.split(" ")
        if text in self.seen:
            return [(0, len(words))]
        w = self.window
        known = [e - w + 1 for e in self.automaton.ends(words, w)]
        old = set(known)
        new = [s for s in range(len(words) - w + 1) if s not in old]
        self.waiting.append((text, [words[a:b] for a, b in spans(new, w)]))
        return spans(known, w)


def cut_runs(docs: DataFrame, window: int, hot: bool) -> DataFrame:
    """Runs with their words (shard, id, key, lo, text), or with the two window hashes (id, key, lo, hash, hash2) of hot anchors."""
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, len(big), 200):
                batch = big.slice(start, 200)
                row, shard, los, out = [], [], [], []
                for i, (text, runs) in enumerate(zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True)):
                    words = space_words(text)
                    h = hash_words(words) if hot else None
                    done = set()
                    for r in runs:
                        lo, hi = r["lo"], r["hi"]
                        if hot:
                            part = h[lo:hi + window]
                            row += [i] * (hi + 1 - lo)
                            los += range(lo, hi + 1)
                            out.append(np.stack([gram_hash(part, window), gram_hash(mix(part + SECOND), window)], axis=1))
                        elif (lo, hi) not in done:
                            done.add((lo, hi))
                            row.append(i)
                            los.append(lo)
                            shard.append(r["shard"])
                            out.append(b" ".join(words[lo:hi + window]).decode("utf-8", "surrogatepass"))
                take = batch.take(pa.array(row, pa.int32()))
                columns = [take.column("id"), take.column("key"), pa.array(los, pa.int32())]
                if hot:
                    names = np.concatenate([np.empty((0, 2), np.uint64), *out]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(names[:, 0]), pa.array(names[:, 1])],
                                                     ["id", "key", "lo", "hash", "hash2"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *columns, pa.array(out, pa.string())],
                                                     ["shard", "id", "key", "lo", "text"])

    return docs.mapInArrow(lean(cut), f"id {kind}, key long, lo int, hash long, hash2 long" if hot
                           else f"shard long, id {kind}, key long, lo int, text string")


def stream_shards(runs: DataFrame, window: int) -> DataFrame:
    """key, lo, hi: removed word spans [lo, hi)."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for s, i, key, lo, text in zip(*[batch.column(c).to_pylist() for c in ("shard", "id", "key", "lo", "text")], strict=True):
                if s != at:
                    at, shard = s, Shard(window)
                out += [(key, lo + a, lo + b) for a, b in shard.match(i, text)]
            k, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["key", "lo", "hi"])

    return (runs.repartition("shard").sortWithinPartitions("shard", "id", "key", "lo")
            .mapInArrow(lean(stream), "key long, lo int, hi int"))


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, window: int, hot_rows: int) -> DataFrame:
    """key, spans (array of lo, hi): what to remove, by row key."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).withColumn("key", row_key("id", "text"))
    anchors = stored(find_anchors(rows, window), "anchors")
    each = anchors.select("id", "key", F.explode(F.arrays_zip("anchor", "lo", "hi")).alias("r")).select(
        "id", "key", F.col("r.anchor").alias("anchor"), F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))
    shared = (each.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("m"))
              .filter("a < b").select("anchor", "m"))
    shared = stored(shared, "shared-anchors")
    light = F.col("m") <= SHARD_ROWS
    shards = max(1, (shared.agg(F.sum(F.when(light, F.col("m")))).first()[0] or 0) // SHARD_ROWS)
    shard = F.when(light, F.pmod("anchor", F.lit(shards))).otherwise(F.col("anchor"))
    found = (each.select("key", "anchor", "lo", "hi").join(shared, "anchor")
             .select("key", F.struct("lo", "hi", shard.alias("shard"), (F.col("m") > hot_rows).alias("hot")).alias("r")))
    # A group is one document's runs.
    runs = stored(found.groupBy("key").agg(F.collect_list("r").alias("runs")), "runs")
    # Documents without a shared anchor (most) need not be moved.
    held = rows.join(key_list(runs.select("key"), "run-keys"), "key", "left_semi").join(runs, "key")
    cold = held.withColumn("runs", F.filter("runs", lambda r: ~r["hot"]))
    spans_ = stream_shards(cut_runs(cold, window, hot=False), window)
    if shared.filter(F.col("m") > hot_rows).limit(1).count():
        hot = cut_runs(held.withColumn("runs", F.filter("runs", lambda r: r["hot"])).filter(F.size("runs") > 0), window, hot=True)
        hot = stored(hot, "hot-windows")
        first = (hot.groupBy("hash", "hash2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
                 .filter("first < last").drop("last"))
        more = hot.join(first, ["hash", "hash2"]).filter("first < id").select("key", "lo", (F.col("lo") + window).alias("hi"))
        spans_ = spans_.unionAll(more)
    grouped = spans_.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    return key_list(merged_spans(grouped), "spans", F.size("spans"))


def merged_spans(grouped: DataFrame) -> DataFrame:
    """key, spans: overlapping and touching spans of the sorted arrays joined."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for runs in batch.column("spans").to_pylist():
                spans: list[dict] = []
                for r in runs:
                    if spans and r["lo"] <= spans[-1]["hi"]:
                        spans[-1]["hi"] = max(spans[-1]["hi"], r["hi"])
                    else:
                        spans.append(r)
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, SPANS)], ["key", "spans"])

    return grouped.mapInArrow(lean(merge), "key long, spans array<struct<lo:int,hi:int>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """``docs`` with n_words, n_removed, removed_spans ([lo, hi) in words) and kept_text (kept
    words joined by a space); the text column itself is unchanged."""
    names = ["n_words", "n_removed", "removed_spans", "kept_text"]
    # Few documents' spans go to all tasks, and no text is moved; many are joined by a shuffle.
    found = repeated_spans(docs, id_col, text_col, window, hot_rows)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    key, df, text = fresh(docs, "key"), docs, text_col
    if docs.schema[text_col].dataType.simpleString() != "string":
        text = fresh(docs, "text")
        df = docs.withColumn(text, F.col(text_col).cast("string"))
    df = df.withColumn(key, row_key(id_col, text))
    spans_key, spans_col = fresh(df, "span_key"), fresh(df, "spans")
    df = df.join(found.withColumnsRenamed({"key": spans_key, "spans": spans_col}), F.col(key) == F.col(spans_key), "left")
    df = df.drop(spans_key, key)
    carried = docs.schema.fields
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in carried)
    schema += "n_words long, n_removed long, removed_spans array<struct<lo:int,hi:int>>, kept_text string"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, len(big), 500):
                batch = big.slice(start, 500)
                total, gone, cuts, texts = [], [], [], []
                for t, runs in zip(batch.column(text), batch.column(spans_col), strict=True):
                    words = space_words(t.as_py())
                    cut = runs.as_py() or []
                    at, kept = 0, []
                    for r in cut:
                        kept += words[at:r["lo"]]
                        at = r["hi"]
                    kept += words[at:]
                    total.append(len(words))
                    gone.append(len(words) - len(kept))
                    cuts.append(cut)
                    texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f.name) for f in carried]
                    + [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, SPANS), pa.array(texts, pa.string())],
                    [f.name for f in carried] + names)

    return df.mapInArrow(lean(remove), schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``docs`` with the repeated spans cut out of the texts; other texts stay as they are, white
    space included.  ``n_chars`` follows the text if the table has it."""
    names = docs.columns
    cut = remove_repeats(docs, id_col, text_col, window)
    cut = cut.withColumn(text_col, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(text_col)))
    if "n_chars" in names and docs.schema["n_chars"].dataType.simpleString() in ("bigint", "int"):
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length(text_col).cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(*[F.col(f"`{c}`") for c in names])
