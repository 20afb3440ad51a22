import json
import pathlib
import subprocess
import sys

import corpus_pipeline
from pyspark.sql import functions as F
from test_decontaminate import lcs
from test_near_dedup import brute as near
from test_packing import ids_of
from test_substring_dedup import brute as cut

from cohortlens.llm import decontaminate as D

ROOT = pathlib.Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = kept
        kept = stage(spark, kept, SF)
        if name != "packing":
            assert kept.columns == columns, name
            kept = kept.cache()
    rows = {n: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()] for n, df in out.items()}
    # Language: the prose stays.
    assert len(rows["near_dedup"]) >= 0.98 * len(rows["language_id"])
    # Near duplicates: one of each group.
    want = {i for i, _, c in near(rows["near_dedup"], 5, 80, 100) if i == c}
    assert {i for i, _ in rows["substring_dedup"]} == want and len(rows["substring_dedup"]) == len(want)
    # Repeated passages: removed words.
    import hashlib
    h = {i: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for i, t in rows["decontamination"]}
    assert {i: x for i, _, _, x in cut(rows["substring_dedup"], 50)} == h
    # Leaks: no document that is left holds an item, and no other document went.
    items = [D.item_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    def leaks(text):
        ws = D.item_words(text)
        return any(lcs(x, ws[s:s + 2 * len(x)]) >= 0.75 * len(x) for x in items if sum(w in set(ws) for w in x) >= 0.75 * len(x)
                   for s in range(0, max(1, len(ws) - len(x)), max(1, len(x) // 2)))
    assert {i for i, _ in rows["packing"]} == {i for i, t in rows["decontamination"] if not leaks(t)}
    # Packing: every token once.
    got = {r.doc_id: r.n for r in kept.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == {i: len(ids_of(t)) for i, t in rows["packing"]}


def test_run_equals_the_stages_one_by_one(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "source", "window", "ids_crc32"]
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


def test_empty_documents_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_queries_register_and_nothing_else_imports_the_subpackage():
    import __spark_entry__ as E
    names = set(E.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    lib = ROOT / "cohortlens"
    assert not [p for p in lib.rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]


def test_entry_imports_without_the_subpackage():
    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith('cohortlens.llm') or name == 'corpus_pipeline':\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import json, __spark_entry__ as E\n"
            "print(json.dumps(sorted(E.queries())))")
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    names = json.loads(said.strip().splitlines()[-1])
    assert names and not [n for n in names if n == "pipeline" or n[:3] in ("op1", "op2")]
