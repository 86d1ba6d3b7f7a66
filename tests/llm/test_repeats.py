import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import repeats


def brute(rows, length):
    """(doc_id, n_bytes, removed spans, kept digest) by looking at every string."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first[b[k:k + length]] = min(first.get(b[k:k + length], repeats.NO_ID), repeats.NO_ID if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < (repeats.NO_ID if i is None else i):
                gone[k:k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, length, **options):
    rows = repeats.find(df, length, **options)
    size = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0), lambda s, x: s + x)
    return sorted((tuple(r) for r in rows.select("doc_id", "n_bytes", size, F.size("starts"), F.sha2("kept", 256)).collect()), key=str)


def _texts(seed):
    rng = random.Random(seed)
    words = ["aa", "bé", "c", "dd d", "e\n", "ffff", "ж"]
    passages = ["".join(rng.choice(words) for _ in range(30)) for _ in range(6)]
    out = []
    for i in range(60):
        parts = [rng.choice(passages)[rng.randrange(9):] if rng.random() < 0.5 else "".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(5))]
        out.append((rng.randrange(50), "".join(parts)))
    return out


def test_equals_brute_force(documents):
    rows = _texts(1) + [(70, None), (71, ""), (None, _texts(1)[5][1]), (None, None), (3, "a" * 400), (4, "a" * 399), (5, "ab" * 300), (6, "x" + "ab" * 120)]
    for length in (16, 24, 50):
        assert found(documents(*rows), length) == brute(rows, length)


def test_small_blocks_and_crowded_anchors_change_nothing(documents):
    rows = _texts(2)
    rows += [(100 + i, f"{i * 7919:07d} a passage that very many of the texts have in common, word for word {i * 104729:09d}") for i in range(80)]
    want = brute(rows, 50)
    assert found(documents(*rows), 50) == want
    assert found(documents(*rows), 50, block_bytes=200) == want
    assert found(documents(*rows), 50, crowd=3, block_bytes=3000) == want


def test_empty_table_extra_columns_and_repeated_rows(spark, documents):
    assert found(documents(), 50) == []
    text = "one and the same row, twice in the table, loses nothing to itself at all"
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, text + " more", "y")], "doc_id long, text string, name string")
    out = {(r["doc_id"], r["text"], r["name"]) for r in repeats.apply(df).collect()}
    assert out == {(1, text, "x"), (2, " more", "y")}
    assert repeats.apply(df).count() == 3


def test_apply_keeps_whole_characters(documents):
    same = "é" * 40
    rows = {r["doc_id"]: r["text"] for r in repeats.apply(documents((1, "a" + same), (2, "ü" + same + "z"), (3, None))).collect()}
    assert rows == {1: "a" + same, 2: "üz", 3: None}


def test_very_long_text(documents):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghij ") for _ in range(1_500_000))
    rows = [(1, long[700_000:700_300]), (2, long), (3, "short")]
    got = {r[0]: r[1:4] for r in found(documents(*rows), 50)}
    assert got == {1: (300, 0, 0), 2: (1_500_000, 300, 1), 3: (5, 0, 0)}


def test_suffix_order_and_nearest_smaller():
    rng = np.random.default_rng(5)
    flat = rng.integers(97, 99, 300).astype(np.uint8)
    length = 20
    places = np.arange(300 - length + 1)
    order, common = repeats.suffix_order(flat, places, length)
    texts = [flat[p:p + length].tobytes() for p in places]
    assert order.tolist() == sorted(range(len(texts)), key=lambda i: (texts[i], i))

    def match(a, b):
        return next((k for k in range(length) if a[k] != b[k]), length)

    assert common[1:].tolist() == [match(texts[a], texts[b]) for a, b in zip(order[:-1], order[1:])]
    owners = rng.integers(0, 9, len(places))
    least = 7
    want = [max([match(texts[i], texts[j]) for j in range(len(texts)) if owners[j] < owners[i]] or [0]) for i in range(len(texts))]
    got = repeats.longest_previous(flat, places, owners, length)  # below `length` it is 0
    assert got.tolist() == [w if w >= length else 0 for w in want]
    values = owners[order]
    back = repeats.previous_smaller(values, common, least)
    for i in range(len(values)):
        j = next((j for j in range(i - 1, -1, -1) if values[j] < values[i]), None)
        m = 0 if j is None else match(texts[order[i]], texts[order[j]])
        assert back[i] == (m if m >= least else 0)
