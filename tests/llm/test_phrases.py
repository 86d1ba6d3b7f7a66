import random
import re
from collections import Counter

import numpy as np

from newsloom.llm import phrases
from newsloom.llm.lm import _zip

DOC = "doc_id long, text string, lang string"


def brute(rows, longest=4, least=30, top=2000, absorb=80):
    counts, words = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang in rows:
        lang = lang or "und"
        words[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            counts.update((lang, tuple(w[i:i + n])) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    often = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in often.items():
        score, k = min((2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = [b for (other, q), b in often.items() if other == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not any(100 * b >= absorb * a for b in inside):
            out.append((lang, -score, -a, " ".join(p).encode(), a, counts[lang, p[:k]], counts[lang, p[k:]], words[lang], score))
    out.sort()
    rank = Counter()
    result = []
    for lang, _, _, p, *rest in out:
        rank[lang] += 1
        if rank[lang] <= top:
            result.append((lang, rank[lang], p.decode(), *rest))
    return sorted(result)


def found(df, **options):
    rows = phrases.mine(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    return sorted(tuple(r) for r in rows)


def _rows(seed, n=120):
    rng = random.Random(seed)
    words = ["New", "york", "times", "é", "der", "ß", "of", "the", "x-y", "7", "日本"]
    marks = [" ", " ", "  ", "\t", ", ", ".", "\n", "? ", " \r\n", "\x0b"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(60)))
        out.append((i, text + "New york times of the" * (i % 3), rng.choice(["en", "de", None])))
    return out


def test_equals_brute_force(spark):
    rows = _rows(1) + [(500, None, "en"), (501, "", "fr"), (502, "New York, Times", "en"), (None, "x y", None)]
    df = spark.createDataFrame(rows + rows[:3], DOC)
    for options in ({"least": 30}, {"least": 5, "absorb": 60}, {"least": 2, "top": 7}, {"least": 3, "longest": 2}):
        assert found(df, **options) == brute(rows + rows[:3], **options)


def test_small_blocks_change_nothing(spark):
    rows = _rows(2)
    assert found(spark.createDataFrame(rows, DOC), least=4, block_words=50) == brute(rows, least=4)


def test_empty_table_and_extra_columns(spark):
    assert found(spark.createDataFrame([], DOC)) == []
    rows = [(i, "a b c", "en") for i in range(30)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], DOC + ", n long, phrase string")
    assert found(df) == brute(rows) == [("en", 1, "a b c", 30, 30, 30, 90, 1000000)]


def test_very_long_text(spark):
    rows = [(1, "one two three, " * 100_000, "en"), (2, "one two", "en")]
    assert found(spark.createDataFrame(rows, DOC)) == brute(rows)


def test_scores_do_not_overflow(spark):
    """A count whose product with 2 000 000 passes 64 bits."""
    a = 7 * 10 ** 12
    row = spark.createDataFrame([(a, a, a + 1)], "a long, l long, r long").selectExpr(
        "cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0))) s").first()
    assert row["s"] == 2000000 * a // (2 * a + 1)


def test_colliding_fingerprints_are_told_apart_by_text(monkeypatch):
    exact = phrases.Grams.fingerprints
    monkeypatch.setattr(phrases.Grams, "fingerprints", lambda self, places, n: exact(self, places, n) & np.uint64(3))
    seen = {b".": 0, b"a": 1, b"b": 2, b"c": 3}
    tokens = np.array([1, 2, 3, 1, 2, 0, 2, 2, 0, 3, 1, 0, 1, 2, 0], dtype=np.uint32)
    batch = phrases._block(5, {"en": 0, "de": 1}, [(0, tokens[:9]), (1, tokens[9:])], seen)
    row = batch.to_pylist()[0]
    every = [{"order": n, "part": 0, "values": _zip(np.ones(len(v), dtype=np.uint8))} for n, v, _ in phrases._named(row, range(1, 3))]
    row["answers"] = every
    grams = phrases.Grams(row)
    got = Counter()
    for n in (1, 2):
        for lang, phrase, count in phrases._strings(grams, n, grams.frequent_pairs()):
            got[lang, phrase] += count
    assert got == {("en", "a"): 2, ("en", "b"): 4, ("en", "c"): 1, ("en", "a b"): 2, ("en", "b c"): 1, ("en", "c a"): 1, ("en", "b b"): 1,
                   ("de", "a"): 2, ("de", "b"): 1, ("de", "c"): 1, ("de", "c a"): 1, ("de", "a b"): 1}


def test_fingerprint_depends_on_words_and_language_only():
    seen = {b".": 0, b"p": 1, b"q": 2}
    row = phrases._block(1, {"x": 0}, [(0, np.array([1, 2, 1, 2, 0, 1, 2, 0], dtype=np.uint32))], seen).to_pylist()[0]
    grams = phrases.Grams(row)
    values = grams.fingerprints(grams.places(2), 2)
    assert grams.places(2).tolist() == [0, 1, 2, 5] and values[0] == values[2] == values[3] != values[1]


def test_a_phrase_is_one_row_however_many_blocks_hold_it(spark):
    """Rows before the sums grow with the phrases, not with phrases and blocks; sizes
    that are counted by text give the same."""
    rows = _rows(4)
    df = spark.createDataFrame(rows, DOC).repartition(3)
    blocks = phrases.store_blocks(phrases.word_blocks(df, 40), 8).select("block", "langs", "lang_of", "sizes", "tokens", "words")
    assert blocks.count() > 20
    told = phrases.reached(blocks, lambda row: phrases._named(row, range(1, 3)), 2, (5,), True)
    named = phrases.named_phrases(blocks.join(told, "block"), range(1, 3)).collect()
    texts = [(r["lang"], r["phrase"]) for r in named if r["phrase"] is not None]
    assert texts and len(texts) == len(set(texts))
    both = [sorted(tuple(r) for r in phrases.frequent(df, least=5, block_words=40, by_text=x)[0].collect()) for x in ((), (1, 2, 3, 4))]
    assert both[0] == both[1] and {(r[0], r[1]) for r in both[0] if r[2] < 3} == set(texts)


def test_second_hashes_show_colliding_fingerprints(monkeypatch):
    seen = {b".": 0, b"a": 1, b"b": 2, b"c": 3}
    tokens = np.array([1, 2, 3, 1, 2, 0, 2, 2, 0], dtype=np.uint32)
    exact = phrases.Grams.fingerprints
    for mask, clean in ((2 ** 64 - 1, True), (1, False)):
        monkeypatch.setattr(phrases.Grams, "fingerprints", lambda self, places, n: exact(self, places, n) & np.uint64(mask))
        row = phrases._block(5, {"en": 0}, [(0, tokens)], seen).to_pylist()[0]
        row["answers"] = [{"order": o, "part": 0, "values": _zip(x)} for n, v, c in phrases._named(row, range(1, 3))
                          for o, x in ((n, np.ones(len(v), dtype=np.uint8)), (~n, c.astype(np.uint64)))]
        grams = phrases.Grams(row)
        rows, left = phrases._elected(grams, 1, grams.frequent_pairs())
        assert (left == 0) == clean
        if clean:
            assert sorted(rows) == [("en", "a", 2), ("en", "b", 4), ("en", "c", 1)]
