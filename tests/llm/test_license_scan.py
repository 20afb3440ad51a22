import re

import pytest
from llm_data import edge_rows, frame

from cohortlens.llm import license_scan as L


def brute(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    at = [(i, label) for p, label in L.PHRASES.items() for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split()]
    return (len(ws), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))


def test_base_phrases_against_brute_force(spark):
    texts = ["MIT License, mit-license; the M I T license", "GNU General\nPublic License and gnu general public licenses", "cc by cc by-sa CC BY 4.0",
             "apache apache license", "\u00c9mit license \u212a mit license", "gnu general public license" * 3]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + edge_rows()
    by_id = {}
    for r in L.scan_licenses(frame(spark, rows)).collect():
        by_id.setdefault(r.doc_id, []).append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append(brute(t))
    key = lambda x: [str(v) for v in x]
    assert {i: sorted(v, key=key) for i, v in by_id.items()} == {i: sorted(v, key=key) for i, v in want.items()}


@pytest.mark.parametrize("text, accepted", [
    ("grant to anyone the right", True), ("grant to Alice and Bob the right", True), ("grant to the right", True),
    ("grant freely to anyone the right", True), ("grant freely freely to anyone the right", False),
    ("grant to one two three four the right", False), ("grant to anyone the wrong", False), ("to anyone the right", False)])
def test_optional_and_replaceable_regions(text, accepted):
    a = L.compile_template("grant <<beginOptional>>freely <<endOptional>>to <<var;name=who;max=3>> the right")
    words = L.scan_words(text)
    found = any(a.run(words, i)[0] for i in range(len(words)) if a.takes.get(words[i], 0) & a.start)
    assert found == accepted


def test_nested_optional_regions_and_errors():
    a = L.compile_template("a <<beginOptional>>b <<beginOptional>>c <<endOptional>>d <<endOptional>>e")
    ok = lambda t: a.run(L.scan_words(t), 0)[0]
    assert ok("a e") and ok("a b d e") and ok("a b c d e") and not ok("a c d e") and not ok("a b c e")
    assert a.mandatory == 2
    with pytest.raises(ValueError):
        L.compile_template("a <<beginOptional>>b")


def test_notices_get_labels_and_mandatory_wording_must_match(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 3.0.", "Released under the MIT License.",
             "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3."]
    got = {r.doc_id: (r.labels, r.score) for r in L.scan_licenses(frame(spark, list(enumerate(texts)))).collect()}
    assert got[0] == ("apache,apache-2.0", 1.0)
    assert got[1][0] == "apache" and 0.5 < got[1][1] < 1
    assert got[2][0] == "mit,mit-notice" and got[3][0] == "cc-by,cc-by-nc-4.0" and got[4][0] == "gpl,gpl-3.0"


def test_empty_table_and_clashing_columns(spark):
    df = frame(spark, [(1, "mit license")]).selectExpr("*", "9 AS n_words", "'z' AS Labels")
    r = L.scan_licenses(df).first()
    assert r.n_words == 2 and r.labels == "mit" and r.lang == "en"
    assert L.scan_licenses(df.limit(0)).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_HEAD = """Copyright (c) 2020, A. N. Other. Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


@pytest.mark.parametrize("text, label", [
    (MIT, "mit-text"), (MIT.replace("COPYRIGHT HOLDERS", "OWNERS"), "mit-text"), (MIT.replace("substantial", "minor"), ""),
    (MIT.replace("WITHOUT WARRANTY", "WITH WARRANTY"), ""), (MIT[:MIT.index("including")], ""),
    (BSD_HEAD + BSD_TAIL, "bsd-2-clause"), (BSD_HEAD + BSD_NAMES + BSD_TAIL, "bsd-3-clause"),
    (BSD_HEAD + "3. All advertising materials must display an acknowledgement. " + BSD_NAMES.replace("3.", "4.") + BSD_TAIL, ""),
    (BSD_HEAD + BSD_TAIL.replace("NEGLIGENCE", "MISTAKES"), ""), (BSD_HEAD, "")])
def test_whole_wording_of_mit_and_bsd(text, label):
    got = L.Scanner(L.PHRASES, L.TEMPLATES).scan("Preamble. " + text + " int main")
    assert got[5] == label and (got[6] == 1) == bool(label)
