import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import lm


def brute(rows, order, prior):
    texts = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    c, n = Counter(), 0
    for i, t in texts:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            s = [None, *t]
            n += len(t)
            for k in range(1, order + 1):
                c.update(tuple(s[j:j + k]) for j in range(len(s) - k + 1))
    v = sum(len(g) == 1 and g != (None,) for g in c)

    def p(w, h):
        return (c[h + (w,)] + prior * p(w, h[1:])) / (c[h] + prior) if h else (c[(w,)] + 1) / (n + v + 1)

    out = []
    for i, t in texts:
        s = [None, *t]
        score = sum(math.log10(p(s[j], tuple(s[max(0, j - order + 1):j]))) for j in range(1, len(s)))
        base = sum(math.log10((c[(w,)] + 1) / (n + v + 1)) for w in t)
        out.append((str(i), zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(t), sum(c[(w,)] > 0 for w in t), n, base, score))
    return sorted(out)


def rows(n=50):
    r = random.Random(4)
    made = [(i, " ".join(r.choice(["The", "cat", "sat", "on", "a", "mat", f"w{r.randrange(200)}"]) for _ in range(r.randrange(30)))) for i in range(n)]
    return made + [(90, None), (91, ""), (92, " \n"), (None, "the cat"), (3, made[3][1])]


@pytest.mark.parametrize("order,prior,block,part", [(1, 1.0, 1000, 10**6), (2, 256.0, 40, 100), (3, 2.0, 10**6, 300)])
def test_against_brute_force(documents, order, prior, block, part):
    docs = documents(*rows()).selectExpr("*", "1 as score", "2 as block")
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                 for r in lm.score(docs, order, prior, block_tokens=block, part_grams=part).collect())
    for a, b in zip(got, brute(rows(), order, prior), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-9)


def test_held_out_text_is_likelier_than_by_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n, base, score = lm.score(docs).filter("held_out").selectExpr("sum(n_tokens)", "sum(base_score)", "sum(score)").first()
    assert score / n > base / n + 0.1


def test_packing():
    r = np.random.default_rng(1)
    for n in (0, 1, 1000):
        a = np.sort(r.integers(0, 1 << 63, n, dtype=np.uint64))
        assert (lm._unzip_sorted(lm._zip_sorted(a)) == a).all()
        b = r.integers(0, 1 << 31, n).astype(np.uint32)
        assert (lm._unzip(lm._zip(b), np.uint32) == b).all()


def test_empty_table(documents):
    assert lm.score(documents((1, "x")).filter("false")).count() == 0
