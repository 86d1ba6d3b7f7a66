import math
import random

import numpy as np

from newsloom.llm import ranked
from newsloom.llm.common import plain_words

ITEM = "item_id long, text string"


def brute(docs, items, k):
    words = [(i, plain_words(t)) for i, t in docs if t is not None and plain_words(t)]
    n, length = len(words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, w in words:
            m = 50 + (50 * len(w) * n) // length
            score = 0
            for t in set(plain_words(text)) & set(w):
                tf = w.count(t)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i, score))
        out += [(item, r + 1, x[3], x[4]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=50, **options):
    rows = ranked.rank(docs, spark.createDataFrame(items, ITEM), k, **options)
    return sorted((tuple(r) for r in rows.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def _rows(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "naïve", "x"]
    pick = lambda m: " ".join(words[min(int(rng.expovariate(0.1)), len(words) - 1)] for _ in range(m))
    docs = [(rng.randrange(200), pick(rng.randrange(60)).title()) for _ in range(n)]
    return docs, [(i, pick(rng.randrange(1, 12))) for i in range(12)]


def test_equals_brute_force(spark, documents):
    docs, items = _rows(1)
    docs += [(300, None), (301, ""), (302, "--- ."), (None, docs[0][1]), (None, docs[0][1]), docs[3], docs[3]]
    items += [(20, None), (21, ""), (22, "no such terms"), (3, "w1 w1 w2"), (23, "W0")]
    for k in (1, 3, 50):
        assert found(spark, documents(*docs), items, k) == brute(docs, items, k)


def test_small_blocks_and_groups_of_queries_change_nothing(spark, documents):
    docs, items = _rows(2)
    want = brute(docs, items, 5)
    assert found(spark, documents(*docs), items, 5, block_docs=7) == want
    assert found(spark, documents(*docs), items, 5, block_postings=20, max_bytes=60) == want


def test_empty_tables_and_extra_columns(spark, documents):
    docs, items = _rows(3, 20)
    assert found(spark, documents(), items) == []
    assert found(spark, documents(*docs), []) == []
    df = spark.createDataFrame([(1, "a b", 5, 7)], "doc_id long, text string, rank int, query int")
    assert found(spark, df, [(1, "a")]) == brute([(1, "a b")], [(1, "a")], 50)


def test_very_long_text(spark, documents):
    docs = [(1, "needle " + "hay " * 400_000), (2, "needle"), (3, "hay hay other"), (4, "words")]
    items = [(1, "needle hay"), (2, "other")]
    assert found(spark, documents(*docs), items) == brute(docs, items, 50)


def test_pair_bounds_hold_and_read_fewer_postings():
    # terms that are strong alone and never meet: single maxima add up, pairs show that they cannot
    n = 4000
    rng = np.random.default_rng(4)
    lists = [(np.arange(0, n, 4), np.full(n // 4, 100)), (np.arange(1, n, 4), np.full(n // 4, 99)),
             (np.arange(2, n, 4), np.full(n // 4, 98)), (np.arange(3, n, 4), rng.integers(40, 97, n // 4))]
    single = [100, 99, 98, 96]
    with_pairs = ranked.bounds(single, [0, 0, 0])
    without = [sum(single[j:]) for j in range(5)]
    assert with_pairs == [198, 195, 98, 96, 0] and all(a <= b for a, b in zip(with_pairs, without))
    acc = np.zeros(n, dtype=np.int64)
    out, read = [], []
    for bound in (with_pairs, without):
        visited = []
        docs, scores = ranked.best(lists, bound, 10, 1, acc, visited)
        keep = np.lexsort((docs, -scores))[:10]
        out.append((docs[keep].tolist(), scores[keep].tolist()))
        read.append(sum(visited))
    assert out[0] == out[1] == (list(range(0, 40, 4)), [100] * 10)
    assert read[0] < read[1] and not acc.any()


def test_bounds_are_never_below_a_score():
    rng = np.random.default_rng(6)
    for _ in range(200):
        table = rng.integers(0, 50, (30, 6)) * (rng.random((30, 6)) < 0.5)
        single = table.max(axis=0).tolist()
        joint = [int(max([r[j] + r[j + 1] for r in table if r[j] and r[j + 1]] or [0])) for j in range(5)]
        bound = ranked.bounds(single, joint)
        for j in range(7):
            assert bound[j] >= table[:, j:].sum(axis=1).max(initial=0)
            assert bound[j] <= sum(single[j:])
