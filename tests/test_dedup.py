import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from newsloom import views as v
from newsloom.operators import dedup
from newsloom.operators.components import connected_components


def brute_components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_edges(values, threshold):
    def near(a, b):
        x = (a ^ b) & (2 ** 64 - 1)
        return bin(x).count("1") <= threshold and any((x >> 16 * s) & 0xFFFF == 0 for s in range(4))

    return [(a, b) for i, a in enumerate(values) for b in values[i + 1:] if near(a, b)]


def signed(x):
    return x - 2 ** 64 if x >= 2 ** 63 else x


def families(seed, n_families=12, size=12, flips=3):
    rng = random.Random(seed)
    values = {0}
    for _ in range(n_families):
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(rng.randint(0, flips)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    return sorted(signed(x) for x in values)


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    real = [(a, b) for a, b in edges if a != b]
    want = brute_components({x for e in real for x in e}, real)
    assert got == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pairs_are_complete_for_small_and_large_thresholds(spark):
    values = families(2)
    df = spark.createDataFrame([(x,) for x in values], "fp long")
    for threshold in (3, 4, 10):
        got = [tuple(sorted((r["fp_a"], r["fp_b"]))) for r in dedup.fingerprint_pairs(df, threshold).collect()]
        assert sorted(got) == sorted(tuple(sorted(p)) for p in brute_edges(values, threshold))
        assert len(got) == len(set(got))


def test_crowded_places_are_cut_and_nothing_is_lost(spark):
    """One segment value that all share, cut into parts; places and runs of every size."""
    rng = random.Random(5)
    values = sorted({signed(x & 2 ** 64 - 1 & ~0xFFFF | 77) for x in families(9, 6, 40, 4)} | {signed(rng.getrandbits(64)) for _ in range(200)})
    df = spark.createDataFrame([(x, 1 + i % 3) for i, x in enumerate(values)], "fp long, n long")
    edges, n = brute_edges(values, 4), {x: 1 + i % 3 for i, x in enumerate(values)}
    counts = {0: sum(k * (k - 1) // 2 for k in n.values())}
    for a, b in edges:
        d = bin((a ^ b) & (2 ** 64 - 1)).count("1")
        counts[d] = counts.get(d, 0) + n[a] * n[b]
    want = brute_components(values, edges)
    for crowd in (1 << 14, 30):
        pairs = [(r["fp_a"], r["fp_b"]) for r in dedup.fingerprint_pairs(df, 4, crowd).collect()]
        assert sorted(pairs) == sorted(tuple(sorted(p)) for p in edges)
        assert {r["distance"]: r["article_pairs"] for r in dedup.pair_counts(df, 4, crowd).collect()} == counts
        got = {r["fp"]: r["root"] for r in dedup.fingerprint_components(df, 4, crowd).collect()}
        assert {x: got.get(x, x) for x in values} == want


def test_long_and_short_runs_meet_alike(monkeypatch):
    values = families(9, 6, 40, 4)
    table = pa.table({"place": [s << 16 | (x >> 16 * s & 0xFFFF) for x in values for s in range(4)], "low": [0] * 4 * len(values),
                      "high": [0] * 4 * len(values), "part": [0] * 4 * len(values), "fp": [x for x in values for _ in range(4)]})
    want = sorted(tuple(sorted(p)) for p in brute_edges(values, 4))
    for long, meet in ((512, 1 << 20), (4, 1 << 20), (4, 9), (512, 9)):
        monkeypatch.setattr(dedup, "LONG", long)
        monkeypatch.setattr(dedup, "MEET", meet)
        m = dedup._Meeting(table, 4)
        fp = m.fp.view("i8").tolist()
        assert sorted(tuple(sorted((fp[a], fp[b]))) for i, j, _ in m.pairs() for a, b in zip(i, j)) == want


def test_counts_leave_a_task_as_counts(spark):
    """A family of near copies makes more pairs than rows; only sums are rows."""
    values = sorted({signed(1 << a | 1 << b | 1 << c) for a in range(17, 64) for b in range(a) for c in (0, 1, 2)})
    df = spark.createDataFrame([(x, 1) for x in values], "fp long, n long")
    plan = dedup.pair_counts(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert "fp_a" not in plan and "Join" not in plan.split("mapInArrow")[0].split("MapInArrow")[0]
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") <= 1
    assert sum(r["article_pairs"] for r in dedup.pair_counts(df, 4).collect()) == len(brute_edges(values, 4))


def test_long_texts_are_summed_in_pieces(monkeypatch):
    rng = random.Random(3)
    rows = [[f"w{rng.randrange(50)}" for _ in range(n)] for n in (0, 3, 900, 1, 0, 40, 0)] + [None]
    whole = dedup.majority_bits(pa.array(rows, pa.list_(pa.string()))).tolist()
    for piece in (1, 7, 64):
        monkeypatch.setattr(dedup, "PIECE", piece)
        assert dedup.majority_bits(pa.array(rows, pa.list_(pa.string()))).tolist() == whole
    assert whole[0] == whole[4] == whole[7] == 0 != whole[1]


def test_components_of_families_for_every_threshold(spark):
    for seed, threshold in ((3, 4), (4, 3), (6, 2), (7, 6), (8, 10)):
        values = families(seed, 6, 8, 3 if threshold > 3 else 2)
        df = spark.createDataFrame([(x,) for x in values], "fp long")
        want = brute_components(values, brute_edges(values, threshold))
        got = {r["fp"]: r["root"] for r in dedup.fingerprint_components(df, threshold).collect()}
        assert {x: got.get(x, x) for x in values} == want, (seed, threshold)


def test_fingerprint_formula(spark, sf):
    rows = v.corpus(spark, sf).select("id", "title", "content", "summary")
    got = {r["id"]: r["fp"] for r in dedup.fingerprints(rows, "full").collect()}
    for r in rows.collect()[:40]:
        votes = [0] * 64
        for token in re.findall(r"[^\W_]{2,}", r["title"] + " " + r["content"]):
            h = int(hashlib.md5(token.encode()).hexdigest(), 16)
            for i in range(64):
                votes[i] += 1 if h >> i & 1 else -1
        assert signed(sum(1 << i for i in range(64) if votes[i] > 0)) == got[r["id"]]


def test_no_words_give_zero_and_equal_bags_are_equal(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "one two two"), (3, "two one two")], "id long, text string")
    got = {r["id"]: r["fp"] for r in dedup.fingerprint(df, F.col("text")).collect()}
    assert got[1] == 0 and got[2] == got[3] != 0


def test_zero_never_matches_a_stored_fingerprint(spark):
    fresh = spark.createDataFrame([(1, 0), (2, 7), (3, 1 << 40)], "id long, fp long")
    stored = spark.createDataFrame([(0,), (7 | 1 << 60 | 1 << 20 | 1 << 35,)], "fp long")
    assert [r["id"] for r in dedup.matches_stored(fresh, stored).collect()] == [2]


def test_three_stages(spark, articles):
    same = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    df = articles(
        {"title": same, "content": "short", "url": "http://x/1"},
        {"title": same, "content": "the longer one", "url": "http://x/2"},
        {"title": "quite other words here now", "url": "http://x/3"},
        {"title": "completely different story told again", "url": "http://x/3"},
        {"title": "lonely item without any link", "url": ""},
    )
    lonely = dedup.fingerprints(df, "lead").filter("id = 5").select("fp")
    got = {r["id"]: r["stage"] for r in dedup.dedup_stages(df, lonely, "lead").collect()}
    assert got == {1: "near", 2: None, 3: None, 4: "url", 5: "cross"}
    kept = [r["id"] for r in dedup.deduplicate(df, rule="lead").collect()]
    assert kept == [2, 3, 4, 5]


def test_expired_and_foreign_fingerprints_do_not_count(spark):
    rows = [("a", 1, "lead", "2024-01-30 12:00:00"), ("b", 2, "lead", "2024-01-29 12:00:00"), ("c", 3, "full", "2024-01-30 12:00:00")]
    table = spark.createDataFrame(rows, "article_id string, fp long, text_rule string, at string").withColumn(
        "computed_at", F.col("at").cast("timestamp"))
    got = dedup.valid_fingerprints(table, "2024-01-31 00:00:00", "lead")
    assert [r["article_id"] for r in got.collect()] == ["a"]


def test_duplicates_of_lists_every_partner(spark, articles):
    same = "alpha beta gamma delta epsilon zeta eta theta"
    df = articles(*[{"title": same} for _ in range(4)], {"title": "nothing in common at all here"})
    members, pairs = dedup.duplicate_groups(df)
    assert pairs.agg(F.sum("article_pairs")).first()[0] == 6
    got = dedup.duplicates_of(members, pairs, spark.createDataFrame([(2,), (5,)], "id long"))
    assert sorted((r["id"], r["other"]) for r in got.collect()) == [(2, 1), (2, 3), (2, 4)]
