import random

import numpy as np
import xxhash

from newsloom.llm import near_dup as nd


def fingerprint(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_against_brute_force(monkeypatch):
    r = random.Random(1)
    words = ["Alpha", "beta", "éa", "Ö", "x", "y,"]
    texts = [None, "", " \t", "One", "two words"] + [" ".join(r.choice(words) for _ in range(r.randrange(60))) for _ in range(60)]
    want = [fingerprint(t) for t in texts]
    assert nd.fingerprints(texts).tolist() == want
    monkeypatch.setattr(nd, "PIECE", 7)  # texts longer than a piece
    assert nd.fingerprints(texts).tolist() == want


def test_trie_join_against_all_pairs(monkeypatch):
    r = random.Random(2)
    values = {r.getrandbits(64) for _ in range(600)}
    for v in list(values)[:150]:
        values |= {v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(4)}
    values |= {0, 1, 2, 3, (1 << 64) - 1}
    v = np.sort(np.array(list(values), dtype=np.uint64))
    i, j = np.where(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= 2, 1))
    want = {(int(v[a]), int(v[b])) for a, b in zip(i, j)}
    for chunk in (1 << 17, 16):
        monkeypatch.setattr(nd, "CHUNK", chunk)
        a, b, diff = nd.trie_join(v, v, 0, 0)
        assert len(a) == len(want) and set(zip(a.tolist(), b.tolist())) == want
        assert (np.bitwise_count(a ^ b) == diff).all()


def test_links_over_many_prefixes(spark):
    r = random.Random(3)
    values = {r.getrandbits(64) for _ in range(300)}
    for v in list(values)[:100]:
        values |= {v ^ (1 << r.randrange(64)), v ^ (1 << 63) ^ (1 << r.randrange(64))}
    v = np.array(list(values), dtype=np.uint64)
    i, j = np.where(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= 2, 1))
    want = {frozenset((int(v.view(np.int64)[a]), int(v.view(np.int64)[b]))) for a, b in zip(i, j)}
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    for leaf in (1 << 12, 16):
        got = nd.links(df, leaf=leaf).collect()
        assert len(got) == len(want) and {frozenset((x.src, x.dst)) for x in got} == want


def test_components_ties_nulls_and_repeats(documents):
    text = "a b c d e f g h i j k l m n o p"
    docs = documents((5, text), (2, text), (2, text), (None, text), (9, None), (8, ""), (7, "quite another text of some words"))
    rows = nd.with_components(docs).collect()
    assert len(rows) == 7
    assert {r.component_id for r in rows if r.doc_id in (5, 2, None)} == {2}
    assert {(r.doc_id, r.component_id, r.fp) for r in rows if r.doc_id in (8, 9)} == {(8, 8, 0), (9, 8, 0)}
    kept = nd.drop_near_duplicates(docs.selectExpr("*", "1 as fp", "2 as component"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 8]
    assert kept.columns == [*docs.columns, "fp", "component"]


def test_chains_of_links_reach_the_smallest_id(documents, monkeypatch):
    """Fingerprints given by hand: 1-2-3 in a chain, 4 apart."""
    marks = {"w3": 0b0, "w2": 0b11, "w1": 0b1111, "w4": 0b11111111 << 20}
    monkeypatch.setattr(nd, "fingerprint_table", lambda docs, doc_id, text: docs.selectExpr(
        "xxhash64(doc_id) as key", "doc_id", "case text " + " ".join(f"when '{k}' then {v}L" for k, v in marks.items()) + " end as fp"))
    rows = nd.with_components(documents((30, "w3"), (20, "w2"), (10, "w1"), (40, "w4"))).collect()
    assert {r.doc_id: (r.component_id, r.n_links) for r in rows} == {30: (10, 1), 20: (10, 2), 10: (10, 1), 40: (40, 0)}


def test_empty_table(documents):
    docs = documents((1, "x")).filter("false")
    assert nd.with_components(docs).count() == 0 and nd.drop_near_duplicates(docs).count() == 0
