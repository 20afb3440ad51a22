import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from llm_data import edge_rows, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import alignment as A
from cohortlens.llm.common import read_table
from cohortlens.llm.packing import _byte_names

TOK_A = Tokenizer.from_file(public_tokenizers.path(A.VOCABULARY_A))
TOK_A.encode_special_tokens = True
TOK_B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(A.VOCABULARY_B))
BYTE = {c: b for b, c in _byte_names().items()}


def tokens(text):
    """[(id, bytes)] of both sides by the tokenizers themselves."""
    e = TOK_A.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(BYTE[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
    b = []
    for i in TOK_B.encode(text):
        p = TOK_B.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if TOK_B.is_byte(i) else p.replace("▁", " ").encode()))
    return a, b


def align(text):
    """(n_a, n_b, groups, links) by walking both sides byte by byte."""
    if not text:
        return 0, 0, [], []
    a, b = tokens(text)
    raw = b" " + text.encode()
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return 0, 0, [], []
    ends_a, ends_b, at = {}, {}, 0
    for i, x in a:
        at += len(x)
        ends_a[at] = i
    at = 0
    for i, x in b:
        at += len(x)
        ends_b[at] = i
    groups, ga, gb = [], [], []
    for end in range(1, len(raw) + 1):
        ga += [ends_a[end]] if end in ends_a else []
        gb += [ends_b[end]] if end in ends_b else []
        if end in ends_a and end in ends_b:
            groups.append((ga, gb))
            ga, gb = [], []
    return len(a), len(b), groups, [(x[-1], y[-1]) for x, y in groups]


def brute(rows):
    done = [(i, align(t)) for i, t in rows]
    counts = Counter(link for _, (*_, links) in done for link in links)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, (na, nb, groups, links) in done:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, na, nb, len(groups), len(links), sum(counts[k] == best[k[1]] for k in links),
                    sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def run(docs, **kw):
    got = A.align_tokenizers(docs, **kw)
    assert got.columns == ["doc_id", *A.MEASURES, "groups_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


SPECIAL = ["<|endoftext|> and <s> and </s>", " two  spaces\t\ttabs\r\n\n ", "▁ underline", "ünïcödé ﬁ ½ ² １", "á é",
           "zero​width ﻿ mark", "　wide space", "<0x41> <unk> ⁇", "𝒳 emoji 👩‍👩‍👧 漢字", "\x00\x01 control", "don't we'll I'M",
           "1234567 12,5%", " ", "\n"]


def test_equals_brute_force_with_edge_rows(spark):
    rows = edge_rows() + [(100 + n, t, "en", "src0") for n, t in enumerate(SPECIAL)]
    want = brute([r[:2] for r in rows])
    docs = frame(spark, rows)
    assert run(docs) == want
    assert run(docs, block_pairs=50) == want            # the pair table in many blocks
    assert sum(r[3] == 0 for r in want) >= 2            # null and empty texts


def test_hot_text_and_clashing_columns(spark):
    rows = [(n, "the same text over and over") for n in range(400)] + [(1_000 + n, f"text number {n}") for n in range(30)]
    docs = frame(spark, rows).withColumns({c: F.lit("x") for c in ("text_key", "copies", "codes", "n_a", "groups_sha256")})
    assert run(docs) == brute(rows)


def test_empty_table_and_texts_without_tokens_only(spark):
    docs = frame(spark, edge_rows())
    assert run(docs.limit(0)) == []
    assert run(docs.filter("text is null or text = ''")) == [(2, *[0] * 6, ""), (3, *[0] * 6, "")]


def test_documents_of_the_smallest_table(spark):
    from conftest import SMOKE
    docs = read_table(spark, SMOKE, "documents").select("doc_id", "text")
    assert run(docs) == brute([tuple(r) for r in docs.collect()])
