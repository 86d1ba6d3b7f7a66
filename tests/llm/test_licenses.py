import random

from newsloom.llm import licenses as lic


def test_blocks_against_brute_force():
    r = random.Random(8)
    pool = [f"w{i}".encode() for i in range(14)]
    templates = [(f"t{i}", " ".join(w.decode() for w in r.sample(pool, r.randrange(1, 8)))) for i in range(12)]
    for threshold in (0.5, 0.8, 1.0):
        index = lic.Index(templates, {w: r.randrange(5) for w in pool}, threshold)
        for _ in range(300):
            block = [r.choice(pool + [b"other"]) for _ in range(r.randrange(12))]
            want = []
            for t, (_, text) in enumerate(templates):
                s = set(text.encode().split())
                share = len(s & set(block)) / len(s)
                if share >= threshold - 1e-12:
                    want.append((t, share))
            assert index.blocks(block) == want


def test_places_labels_and_edges(documents):
    docs = documents((1, "Under the MIT-License under\nthe mit license, cc by NC"), (2, None), (3, ""), (4, "all RIGHTS reserved."),
                     (5, "This work is licensed\nunder the GNU General Public License, version 3"), (4, "all RIGHTS reserved."), (None, "Released under the MIT license"))
    rows = lic.scan(docs.selectExpr("*", "0 as places", "1 as n_words")).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 7
    assert list(by[1].places) == [0, 4, 8] and list(by[1].place_labels) == ["mit", "mit", "cc-by-nc"] and by[1].n_words == 11
    assert by[2].n_words == 0 and list(by[2].places) == [] and list(by[3].block_labels) == []
    assert list(by[4].block_labels) == ["all-rights-reserved"] and list(by[4].block_shares) == [1.0]
    assert by[5].block_lines == [1] and by[5].block_labels == ["gpl-3"] and by[5].block_shares == [8 / 12] if by[5].block_labels else True
    assert "mit" in by[None].block_labels
    assert lic.scan(docs, templates=[]).filter("size(block_labels) > 0").count() == 0
    assert lic.scan(docs.filter("false")).count() == 0
