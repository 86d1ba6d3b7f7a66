import random
import re

from newsloom.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(10, len(b))
            for i in range(len(b) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j:j + n] == b[i:i + n]:
                        hit |= set(range(j, j + n))
                        if item is not None:
                            found.add(str(item))
        out[doc_id] = (len(w), hit, sorted(found))
    return out


def data():
    r = random.Random(6)
    pool = ["Alpha", "beta", "éa", "x1", "and", "of"]
    text = lambda n: " ".join(r.choice(pool) for _ in range(n))
    items = [(i, text(r.randrange(1, 30))) for i in range(6)] + [(7, "short one"), (8, ""), (9, None), (None, "no id here"), (7, "short two"), (10, "short one")]
    docs = [(i, text(r.randrange(40))) for i in range(20)]
    docs += [(50 + i, f"{text(5)}, {t.upper() if t else ''}! {text(4)}") for i, (_, t) in enumerate(items)] + [(90, None), (91, "")]
    return docs, items


def check(spark, documents, **options):
    docs, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    rows = dc.find(documents(*docs), bench, **options).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, {p for a, b in zip(r.starts, r.ends) for p in range(a, b)}, list(r.items)) == want[r.doc_id]


def test_against_brute_force(spark, documents):
    check(spark, documents)


def test_items_in_several_blocks(spark, documents):
    check(spark, documents, max_windows=60)


def test_apply_leaves_no_window(spark, documents):
    item = "one two three four five six seven eight nine ten eleven"
    rest = " ".join(f"w{i}" for i in range(30))
    # the cut brings "one .. five" and "six .. ten" together again
    nested = f"{rest} one two three four five {item} six seven eight nine ten {rest}"
    docs = documents((1, f"{rest}, {item}. {rest}"), (2, item), (3, nested), (4, rest), (5, None), (6, "")).selectExpr("*", "3 as left", "4 as hit")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = dc.apply(docs, bench)
    rows = {r.doc_id: r for r in out.collect()}
    assert set(rows) == {1, 3, 4, 5, 6} and out.columns == docs.columns
    assert rows[1].text == f"{rest}, . {rest}" and rows[1].n_chars == len(rows[1].text) and rows[4].text == rest
    assert all(r.starts == [] for r in dc.find(out, bench).collect())


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = documents((1, "some words"))
    assert [list(r.items) for r in dc.find(docs, bench).collect()] == [[]]
    assert dc.apply(docs, bench).collect() == docs.collect()
    assert dc.find(docs.filter("false"), bench).count() == 0


def test_apply_does_not_depend_on_the_blocks(spark, documents):
    """Overlapping items, a document that two blocks hit, and a join made by cuts."""
    w = [f"a{i}" for i in range(20)]
    one, two, far = " ".join(w[:10]), " ".join(w[5:15]), " ".join(w[10:20]).replace("a", "b")
    rest = " ".join(f"z{i}" for i in range(40))
    bench = spark.createDataFrame([(1, one), (2, two), (3, far)], "item_id long, text string")
    assert sum(bool(x.by_length) for x in dc.blocks(bench, max_windows=1)) == 3
    docs = documents(
        (1, f"{rest}. {' '.join(w[:15])}; {rest}"), (2, f"{one} {far} z1 z2 z3 z4 z5"), (3, f"{one} " * 4 + f"{far} " * 3 + " ".join(rest.split()[:35])),
        (4, f"{rest} b10 b11 {one} b12 {' '.join(far.split()[3:])} {rest}"), (5, rest), (6, None), (7, ""))
    many, single = (sorted(map(tuple, dc.apply(docs, bench, max_windows=m).collect())) for m in (1, dc.MAX_WINDOWS))
    assert many == single and [r[0] for r in single] == [1, 4, 5, 6, 7]
    assert {r[0]: r[1] for r in single}[1] == f"{rest}. ; {rest}" and "b10" not in single[1][1]
