import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from newsloom.llm import bpe, jaccard, near_dup, queries

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns and docs.count() <= left, name
        assert docs.filter("n_chars <> length(text)").count() == 0
        left = docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    library = Tokenizer.from_str(bpe.vocabulary_text())
    rows = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert len(rows) == len(texts) and 50 < len(rows) < 200
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(ids)
    assert sorted(r.ids_sha256 for r in cp.run(spark, SF).collect()) == sorted(r.ids_sha256 for r in rows)


def test_edges_go_through(spark, documents, tmp_path):
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    text = " ".join(f"word{i} other{i}" for i in range(60))
    docs = documents((1, text), (1, text), (2, text), (None, text.replace("word1 ", "word2 ")), (3, None), (4, "")).selectExpr("*", "1 as key", "'x' as _row")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert [r.doc_id for r in cp.run(spark, f"file://{tmp_path}").collect()][:1] == [1]
    docs.filter("false").write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
    assert cp.run(spark, f"file://{tmp_path}").count() == 0


def test_near_duplicates_go_by_both_links(spark, documents):
    """Copies with other spacing and order of words (equal fingerprints) and near copies that are far apart in bits."""
    base = [f"w{i}" for i in range(200)]
    near = base[:100] + ["other"] + base[101:]
    same_bits = ["a", "b", "c"] * 40, ["a", "b", "c"] * 40 + ["a"]
    docs = documents((1, " ".join(base)), (2, " ".join(near)), (3, " ".join(same_bits[0])), (4, " ".join(same_bits[1])), (5, "short one"))
    fps = near_dup.fingerprints([r.text for r in docs.orderBy("doc_id").collect()])
    assert np.bitwise_count(fps[0] ^ fps[1]) > 2
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, docs, SF).collect()) == [1, 3, 5]
    # one changed word of seven is under 0.8, yet all shingles' majority agrees in 62 bits or more: the trie's link alone
    found = _pair_within_two_bits()
    docs = documents((1, found[0]), (2, found[1]))
    assert jaccard.drop_near_duplicates(docs).count() == 2
    assert [r.doc_id for r in cp.near_duplicates(spark, docs, SF).collect()] == [1]


def _pair_within_two_bits():
    """Two texts with unlike sets of 5-word shingles whose frequent 3-word shingles decide all bits."""
    for n in range(1000):
        often = f"x{n} y{n} z{n} " * 200
        a, b = (often + " ".join(f"{c}{i}" for i in range(12)) for c in "ab")
        one, two = near_dup.fingerprints([a, b])
        if np.bitwise_count(one ^ two) <= 2:
            return a, b


def test_every_operator_has_a_query():
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted(f"op{n}" for n in range(1, 14))


def test_nothing_else_needs_the_subpackage(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("newsloom.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "dashboard" in e.queries() and not [n for n in e.queries() if n == "pipeline" or n.startswith("op1")]
"""
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, timeout=120)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, SF)
    table = {"op3": None, "op10": "pages", "op12": None, "op13": None}.get(name.split("_")[0], "documents")
    if table:
        assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
