r"""License scans with template markup compiled to token automata.

A template is license wording with markup, in the style of license-list matching
guidelines:

* ``<<beginOptional>> ... <<endOptional>>``: the wording may be left out (nests);
* ``<<var;name=...;max=N>>``: replaceable, any 0 to N words;
* everything else is mandatory and must match word for word.

``compile_template`` turns a template into a token automaton: numbered positions,
each consuming one given word or (in replaceable regions) any word, with the
positions that can be skipped folded into the follow sets.  A text is accepted if
some run of its consecutive words leads the automaton from start to end, i.e. all
mandatory wording matches exactly.  Position sets are Python integers, so a step
is a few bit operations; scanning starts only at words that can open a template.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z, over whole
texts.  Base phrases are counted beside the templates.  The scan is a map over
documents: no shuffle, and memory of one document and the fixed automata.

``score`` is 1 for an accepted template, else the largest share of a template's
mandatory words matched in a row from its start (0 without any).

Defined cases: null text is an empty text: 0 words, null first and last word, empty
labels, score 0.  Repeated rows get equal results.  Extra columns are carried;
result columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Base phrases and their labels; fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: The two conditions that both BSD licenses have, and their disclaimer.
BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: <<var;name=bullet;max=1>> Redistributions of source code must retain the "
    "<<beginOptional>>above <<endOptional>>copyright notice, this list of conditions and the following disclaimer. "
    "<<var;name=bullet;max=1>> Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. ")
BSD_WARRANTY = (
    "This software is provided by <<var;name=holders;max=12>> \"as is\" and any express or implied warranties, including, "
    "but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. "
    "In no event shall <<var;name=holders;max=12>> be liable for any direct, indirect, incidental, special, exemplary, or "
    "consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, "
    "data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, "
    "strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, "
    "even if advised of the possibility of such damage")

#: License notices with markup; wording of the licenses, fixed values.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0<<beginOptional>> (the \"License\"); you may not use "
                  "this file except in compliance with the License<<endOptional>>",
    "gpl-3.0": "licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License"
               "<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, "
               "<<beginOptional>>either <<endOptional>>version 3<<beginOptional>> of the License<<endOptional>>",
    "gpl-2.0": "licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License"
               "<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, "
               "<<beginOptional>>either <<endOptional>>version 2<<beginOptional>> of the License<<endOptional>>",
    "mit-notice": "<<beginOptional>>Licensed <<endOptional>><<beginOptional>>Released <<endOptional>>under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name=work;max=6>> "
                "and associated documentation files (the \"<<var;name=short;max=3>>\"), to deal in "
                "<<var;name=short;max=4>> without restriction, including without limitation the rights to use, copy, "
                "modify, merge, publish, distribute, sublicense, and/or sell copies of <<var;name=short;max=4>>, and to "
                "permit persons to whom <<var;name=short;max=4>> <<var;name=is;max=1>> furnished to do so, subject to the "
                "following conditions: The above copyright notice and this permission notice<<beginOptional>> (including "
                "the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of "
                "<<var;name=short;max=4>>. <<var;name=short;max=4>> <<var;name=is;max=1>> provided \"as is\", without "
                "warranty of any kind, express or implied, including but not limited to the warranties of "
                "merchantability, fitness for a particular purpose and noninfringement. In no event shall "
                "<<var;name=holders;max=12>> be liable for any claim, damages or other liability, whether in an action of "
                "contract, tort or otherwise, arising from, out of or in connection with <<var;name=short;max=4>> or the "
                "use or other dealings in <<var;name=short;max=4>>",
    "bsd-2-clause": BSD_CONDITIONS + BSD_WARRANTY,
    "bsd-3-clause": BSD_CONDITIONS + "<<var;name=bullet;max=1>> Neither the name<<beginOptional>>s<<endOptional>> of "
                    "<<var;name=holders;max=15>> nor the names of <<var;name=its;max=3>> contributors may be used to endorse "
                    "or promote products derived from this software without specific prior written permission. " + BSD_WARRANTY,
    "cc-by-4.0": "Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>Creative Commons <<endOptional>>CC BY 4.0",
    "cc-by-sa-4.0": "Licensed under <<beginOptional>>a <<endOptional>>CC BY-SA 4.0",
    "cc-by-nc-4.0": "Licensed under <<beginOptional>>a <<endOptional>>CC BY-NC 4.0",
    "cc-by-nd-4.0": "Licensed under <<beginOptional>>a <<endOptional>>CC BY-ND 4.0",
}

MARK = re.compile(r"<<(beginOptional|endOptional|var[^>]*)>>")


def scan_words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


@dataclass(frozen=True)
class Automaton:
    """``start``: positions that may come first; ``follow[i]``: positions after ``i``;
    ``takes``: word -> positions that consume it; ``any_word``: positions that take any;
    ``ends``: positions after which the template may end; ``rank[i]``: mandatory words up to ``i``."""
    start: int
    follow: tuple[int, ...]
    takes: Mapping[bytes, int]
    any_word: int
    ends: int
    rank: tuple[int, ...]
    mandatory: int

    def run(self, words: list[bytes], at: int) -> tuple[bool, float]:
        """(accepted, share of mandatory words matched) from word ``at`` on."""
        state, best = self.start, 0
        for word in words[at:at + len(self.follow)]:
            state &= self.takes.get(word, 0) | self.any_word
            if not state:
                break
            if state & self.ends:
                return True, 1.0
            after, s = 0, state
            while s:
                i = (s & -s).bit_length() - 1
                best = max(best, self.rank[i])
                after |= self.follow[i]
                s &= s - 1
            state = after
        return False, min(best, self.mandatory - 1) / max(1, self.mandatory)


def compile_template(template: str) -> Automaton:
    """Positions and follow sets of a template (Glushkov construction)."""
    positions: list[bytes | None] = []   # None: any word
    rank: list[int] = []
    follow: list[int] = []
    mandatory, depth = 0, 0
    start, live, live_at_start = 0, 0, True   # live: positions that may precede the next one
    saved: list[tuple[int, bool]] = []

    def add(word: bytes | None, skippable: bool) -> None:
        nonlocal start, live, live_at_start
        i = len(positions)
        positions.append(word)
        rank.append(mandatory)
        follow.append(0)
        bit = 1 << i
        s = live
        while s:
            follow[(s & -s).bit_length() - 1] |= bit
            s &= s - 1
        if live_at_start:
            start |= bit
        if skippable:
            live |= bit
        else:
            live, live_at_start = bit, False

    at = 0
    for m in [*MARK.finditer(template), None]:
        for word in scan_words(template[at:m.start() if m else None]):
            if not depth:
                mandatory += 1
            add(word, False)
        if m is None:
            break
        at = m.end()
        if m[1] == "beginOptional":
            saved.append((live, live_at_start))
            depth += 1
        elif m[1] == "endOptional":
            before, before_start = saved.pop()
            live, live_at_start = live | before, live_at_start or before_start
            depth -= 1
        else:
            found = re.search(r"max=(\d+)", m[1])
            for _ in range(int(found[1]) if found else 10):
                add(None, True)
    if saved:
        raise ValueError("an optional region is not closed")
    takes: dict[bytes, int] = {}
    for i, word in enumerate(positions):
        if word is not None:
            takes[word] = takes.get(word, 0) | 1 << i
    any_word = sum(1 << i for i, word in enumerate(positions) if word is None)
    return Automaton(start, tuple(follow), takes, any_word, live, tuple(rank), mandatory)


class Scanner:
    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, str]):
        self.phrases = [(scan_words(p), label) for p, label in phrases.items()]
        self.automata = {name: compile_template(t) for name, t in templates.items()}
        self.by_first: dict[bytes, tuple[list, list]] = {}
        for words, label in self.phrases:
            self.by_first.setdefault(words[0], ([], []))[0].append((words, label))
        for name, a in self.automata.items():
            if a.start & a.any_word:
                raise ValueError(f"{name} may start with any word")
            for word, mask in a.takes.items():
                if mask & a.start:
                    self.by_first.setdefault(word, ([], []))[1].append((name, a))

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = scan_words(text)
        places, base, labels, score = [], set(), set(), 0.0
        first = self.by_first
        for at in [i for i, w in enumerate(words) if w in first]:
            phrases, automata = first[words[at]]
            for phrase, label in phrases:
                if words[at:at + len(phrase)] == phrase:
                    places.append(at)
                    base.add(label)
            for name, automaton in automata:
                accepted, share = automaton.run(words, at)
                score = max(score, share)
                if accepted:
                    labels.add(name)
        return (len(words), len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted(base)), ",".join(sorted(base | labels)), score)


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, text_col: str = "text", phrases: Mapping[str, str] = PHRASES,
                  templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """``docs`` (less the text column) with the columns of ``RESULT``."""
    names = [f.split()[0] for f in RESULT.split(", ")]
    carried = [f for f in docs.schema.fields if f.name != text_col and f.name.lower() not in names]
    whole = fresh(docs, "text")
    rows = docs.select(*[F.col(f"`{f.name}`") for f in carried], F.col(text_col).cast("string").alias(whole))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in carried) + RESULT
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            got = [scanner.scan(t.as_py()) for t in batch.column(whole)]
            columns = list(zip(*got, strict=True)) if got else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in carried] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                [f.name for f in carried] + names)

    return rows.mapInArrow(scan, schema)
