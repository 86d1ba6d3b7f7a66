import random

import pytest

import corpus_pipeline as cp
from newsloom.llm import jaccard


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("options", [{}, {"often": 2, "block_bytes": 1500}])
def test_stage_against_brute_force(spark, documents, options):
    """Near copies of one changed word in 60 are far over 2 bits apart as a rule;
    every component of similarity 4/5 keeps its smallest id."""
    r = random.Random(4)
    texts, words = [], [f"w{i}" for i in range(300)]
    passage = " ".join(r.choice(words) for _ in range(20))
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randrange(3, 150))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(8)):
            copy = list(base)
            for _ in range(r.randrange(1, 5)):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
            base = r.choice([base, copy])  # chains
    texts += [f"{passage} {t}" for t in texts[:30]] + [texts[3].upper(), "", None, " \t", texts[5]]
    sets = [grams(t) for t in texts]
    near = {(a, b) for a in range(len(texts)) for b in range(a) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(near) > 40
    name = list(range(len(texts)))
    while any(name[a] != name[b] for a, b in near):
        for a, b in near:
            name[a] = name[b] = min(name[a], name[b])
    docs = documents(*enumerate(texts))
    wide = docs.selectExpr("*", "1 as tid", "2 as block", "3 as name")
    got = jaccard.drop_near_duplicates(wide, **options) if options else cp.near_duplicates(spark, wide, "")
    assert sorted(x.doc_id for x in got.collect()) == sorted(set(name))
    assert got.columns == wide.columns


def test_first_hashes_last():
    import numpy as np
    found = np.arange(10, dtype=np.uint64)
    assert jaccard.prefix(found, np.array([0, 2, 99], np.uint64)).tolist() == [1, 3, 4, 5, 6]
    assert jaccard.prefix(found[:0], found).tolist() == []


def test_null_ids_and_empty_table(documents):
    docs = documents((None, "some words here"), (4, "Some words here"), (4, "Some words here"), (5, None))
    assert sorted(r.doc_id for r in jaccard.drop_near_duplicates(docs).collect()) == [4, 5]
    assert jaccard.drop_near_duplicates(docs.filter("false")).count() == 0


def test_copies_and_very_long_text(documents):
    long = " ".join(f"w{i % 977} v{i % 1009}" for i in range(150_000))
    rows = [(i, f"the same words of a large group of copies {i % 2}") for i in range(60)] + [(100, long), (101, long + " end"), (102, long[:1000])]
    assert sorted(r.doc_id for r in jaccard.drop_near_duplicates(documents(*rows)).collect()) == [0, 1, 100, 102]
