import random

import numpy as np
import pytest

from newsloom.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, a, edits, letters=b"abcd "):
    b = bytearray(a)
    for _ in range(edits):
        p, kind = r.randrange(len(b)), r.randrange(3)
        if kind == 0:
            b.insert(p, r.choice(letters))
        elif kind == 1:
            b[p] = r.choice(letters)
        else:
            del b[p]
    return bytes(b)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_verification_and_keys_against_brute_force(tau):
    r = random.Random(tau)
    pairs = []
    for _ in range(1500):
        a = bytes(r.choice(b"ab c") for _ in range(r.randrange(tau + 4, 40)))
        b = edited(r, a, r.randrange(4))
        pairs.append((a, b) if len(a) <= len(b) else (b, a))
    pairs = [p for p in pairs if len(p[0]) > tau]
    want = np.array([distance(a, b) <= tau for a, b in pairs])
    assert (ld.within([a for a, _ in pairs], [b for _, b in pairs], tau) == want).all()
    for (a, b), near in zip(pairs, want):
        if near:  # complete: the longer line probes an index key of the shorter
            assert set(ld.line_keys(a, tau)[0]) & set(ld.line_keys(b, tau)[1])


def test_no_pairs():
    assert ld.within([], [], 2).tolist() == []
    assert ld.within([b""], [b""], 2).tolist() == [True]


@pytest.mark.parametrize("crowd", [4, 2048])
def test_links_and_removed_lines_against_brute_force(documents, crowd):
    """A small `crowd` cuts the keys into blocks; the links stay the same."""
    r = random.Random(9)
    base = [bytes(r.choice(b"abcdefgh ") for _ in range(r.randrange(20, 60))).strip() for _ in range(12)]
    rows = []
    for i in range(40):
        lines = [edited(r, r.choice(base), r.randrange(3)).decode() for _ in range(r.randrange(5))]
        rows.append((i, "\n".join(["short", *lines])))
    rows += [(40, None), (41, ""), (None, rows[3][1]), (3, rows[3][1])]
    docs = documents(*rows)
    lines = sorted({ld.normalised(x.encode()) for _, t in rows for x in (t or "").split("\n")})
    lines = [x for x in lines if len(x) >= 10]
    want = {frozenset((ld.line_id(a), ld.line_id(b))) for i, a in enumerate(lines) for b in lines[i + 1:] if distance(a, b) <= 2}
    got = ld.line_links(docs, min_bytes=10, crowd=crowd).collect()
    assert len(got) == len(want) and {frozenset(x) for x in got} == want
    # classes by repeated joining, the first line of each stays
    parent = {ld.line_id(x): ld.line_id(x) for x in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in map(tuple, want):
        parent[root(a)] = root(b)
    kept, removed = {}, {}
    for i, text in sorted({(r[0], r[1]) for r in rows}, key=lambda x: (x[0] is None, x[0])):
        for n, x in enumerate((text or "").split("\n")):
            x = ld.normalised(x.encode())
            if len(x) >= 10:
                c = root(ld.line_id(x))
                if c in kept:
                    removed.setdefault(i, []).append((n, kept[c]))
                kept.setdefault(c, i)
    found = ld.duplicate_lines(docs, min_bytes=10, crowd=crowd).collect()
    assert len(found) == len(rows)
    for row in found:
        assert [tuple(x) for x in row.removed] == removed.get(row.doc_id, [])


def test_apply_keeps_columns_and_drops_emptied_documents(spark, documents):
    line = "this line stands in three of the documents here"
    docs = documents((1, f"{line}\nown words of one"), (2, f"{line.upper()}  "), (3, f"x\n{line}\ny"), (4, None), (5, "")).selectExpr(
        "*", "7 as key", "'k' as _key")
    rows = {r.doc_id: r for r in ld.apply(docs, min_bytes=20).collect()}
    assert set(rows) == {1, 3, 4, 5}
    assert rows[3].text == "x\ny" and rows[3].n_chars == 3 and rows[3].key == 7 and rows[3]._key == "k"
    assert rows[1].text.startswith(line) and rows[4].text is None
    assert ld.apply(docs, min_bytes=20).columns == docs.columns


def test_empty_table(documents):
    docs = documents((1, "x")).filter("false")
    assert ld.duplicate_lines(docs).count() == 0
    assert ld.apply(docs).count() == 0


def test_equal_short_lines_are_removed(documents):
    """Lines below LINK_BYTES are never linked, but equal ones are one line."""
    docs = documents((1, "Read  more\nyes\n\nfirst"), (2, "read more\nyet\n\nsecond"), (3, "x\nYES\n \nx"))
    rows = {r.doc_id: [tuple(x) for x in r.removed] for r in ld.duplicate_lines(docs).collect()}
    assert rows == {1: [], 2: [(0, 1)], 3: [(1, 1), (3, 3)]}
    assert {r.doc_id: r.text for r in ld.apply(docs).collect()} == {1: docs.first().text, 2: "yet\n\nsecond", 3: "x\n "}


def test_keys_of_lines_without_a_partner_do_not_become_rows(spark):
    """Lines stay packed: of many lines, one of them in several blocks, only the two
    that may be linked leave their blocks, with the keys that they share."""
    r = random.Random(3)
    lines = ["".join(r.choice("abcdefghij") for _ in range(50)) for _ in range(60)]
    near = lines[7][:20] + "#" + lines[7][20:]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*lines, near, *lines[:9]])], "doc_id long, text string").repartition(5)
    blocks = ld.line_blocks(docs, 40, block_lines=4).localCheckpoint()
    assert blocks.count() > 10
    rows = ld.shared_keys(blocks).collect()
    assert {bytes(x.bytes) for x in rows} == {lines[7].encode(), near.encode()}
    keys = [set(x["keys"]) for x in rows]
    assert len(rows) == 2 and keys[0] & keys[1] and all(len(k) < 15 for k in keys)
