import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions import text as t
from newsloom.operators.components import join
from newsloom.operators import clusters, entities, keywords, sentiment as se, summary


def docs(spark, *texts):
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, content string")


def overlay_of(spark, *texts, base=0.0):
    df = docs(spark, *texts).withColumn("base_score", F.lit(base))
    return [r["overlay"] for r in se.finance_overlay(df, "content").orderBy("id").collect()]


def test_overlay_examples(spark):
    buy, sell, miss = overlay_of(spark, "公司宣布回购10亿股份", "大股东减持套现5亿", "业绩不及预期")
    assert buy["sentiment_score"] == pytest.approx(0.28) and buy["finance_hits"] == ["+0.7:回购(x1.0)"]
    assert sell["sentiment_score"] == pytest.approx(-0.4)  # both hits, clipped to -1
    assert [h.split(":")[1].split("(")[0] for h in miss["finance_hits"]] == ["不及预期"]


def test_overlay_negation_and_modifier(spark):
    not_buy, near, strong, far = overlay_of(spark, "公司并非回购", "不回购", "利润大幅下滑", "没有" + "甲" * 12 + "回购")
    assert not_buy["finance_hits"] == ["-0.7:回购(否定反转)(x1.0)"]
    assert near["finance_hits"][0].startswith("-0.7")
    assert strong["finance_hits"] == ["-0.8:下滑(x1.5)"] or strong["finance_hits"] == ["-0.7:下滑(x1.5)"]
    assert far["finance_hits"] == ["+0.7:回购(x1.0)"]


def greedy(text, words):
    taken, hits = set(), []
    for word, weight in sorted(words, key=lambda x: -len(x[0])):
        for pos in range(len(text)):
            span = set(range(pos, pos + len(word)))
            if text.startswith(word, pos) and not span & taken:
                taken |= span
                hits.append((word, pos))
    return hits


def test_overlay_matching_against_brute_force(spark):
    rng = random.Random(5)
    words = [("aba", 0.5), ("ab", 0.2), ("ba", 0.3), ("bab", 0.4), ("aa", 0.1)]
    texts = ["".join(rng.choice("abc") for _ in range(40)) for _ in range(50)]
    df = docs(spark, *texts).withColumn("h", se.lexicon_hits("content", words, [], {}, ()))
    for r in df.collect():
        assert Counter(h["word"] for h in r["h"]) == Counter(w for w, _ in greedy(r["content"], words))


def test_overlay_effects_against_brute_force(spark):
    rng = random.Random(8)
    words, bad = [("up", 0.5), ("upper", 0.7), ("per", 0.2)], [("down", 0.6), ("own", 0.1)]
    scales, turns = {"very": 1.5, "very much": 2.0}, ("not ", "no ")
    pieces = ["up", "upper", "per", "down", "own", "very ", "much ", "not ", "no ", "x", " ", "-", "é", "\ue001", "日"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(80)] + ["up" * 3000]
    df = docs(spark, *texts).withColumn("h", se.lexicon_hits("content", words, bad, scales, turns, "-"))
    for r in df.collect():
        want = []
        for side in (words, bad):
            order = sorted(side, key=lambda x: -len(x[0]))
            found = sorted((order.index((w, dict(side)[w])), at, w) for w, at in greedy(r["content"], side))
            for _, at, w in found:
                near, wide = r["content"][max(at - 10, 0):at], r["content"][max(at - 20, 0):at]
                turned = near[-1:] == "-" or "not " in near or "no " in near
                scale = 2.0 if "very much" in wide else 1.5 if "very" in wide else 1.0
                effect = -dict(side)[w] if turned else dict(side)[w]
                want.append((w, effect * scale, turned, scale))
        assert [tuple(h) for h in r["h"]] == want


def test_term_vectors_against_counting(spark):
    rng = random.Random(6)
    lists = [[rng.choice(["b", "a", "é", "zz", "日"]) for _ in range(n)] for n in (0, 1, 2, 7, 300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id long, w array<string>")
    for r in df.select("id", t.term_vector(F.col("w")).alias("v"), t.position_vector(F.col("w")).alias("p")).collect():
        words = lists[r["id"]]
        assert {x["token"]: (x["tf"], x["pos"]) for x in r["v"]} == {w: (words.count(w), words.index(w)) for w in set(words)}
        assert {x["token"]: x["positions"] for x in r["p"]} == {w: [i for i, x in enumerate(words) if x == w] for w in set(words)}


def test_no_text_is_shuffled_for_words(spark):
    df = docs(spark, "one two two", "two three")
    for made in (t.term_table(df, t.tokens("content")), keywords.keyword_rows(df, "content", 2), keywords.keywords(df, "content"),
                 summary.summary_rank(df, "content"), se.finance_overlay(df.withColumn("base_score", F.lit(0.0)), "content")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "InPandas" not in plan


def test_running_sums(spark):
    from newsloom.functions import expr as e
    lists = [[], [5], list(range(200)), [1] * 64, [2] * 65]
    df = spark.createDataFrame([(x,) for x in lists], "v array<int>").select("v", e.running_sums(F.col("v")).alias("s"))
    for r in df.collect():
        assert r["s"] == [sum(r["v"][:i + 1]) for i in range(len(r["v"]))]


def test_sentence_ranks_against_the_formula(spark):
    rng = random.Random(7)
    texts = [". ".join(" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(rng.randrange(1, 6))) for _ in range(n)) for n in (1, 4, 9)]
    df = docs(spark, *texts).select("id", summary.sentence_ranks(summary.sentences("content")).alias("r"))
    for r in df.collect():
        words = [set(x.split()) for x in texts[r["id"]].split(". ")]
        holders = {w: [i for i, x in enumerate(words) if w in x] for x in words for w in x}
        ranks = [1.0] * len(words)
        for _ in range(10):
            share = {w: sum(ranks[i] / len(words[i]) for i in at) / len(at) for w, at in holders.items() if len(at) > 1}
            ranks = [0.15 + 0.85 * sum(share.get(w, 0) for w in x) for x in words]
        assert r["r"] == pytest.approx(ranks)


def test_base_score(spark):
    df = docs(spark, "经济增长", "经济不增长", "非常乐观", "风险", "天气", "增长" * 12)
    rows = [r["s"] for r in df.select("id", se.base_score(t.all_tokens("content")).alias("s")).orderBy("id").collect()]
    assert [r["sentiment_score"] for r in rows] == [
        round(math.tanh(0.2), 4), round(math.tanh(-0.2), 4), round(math.tanh(0.4), 4), round(math.tanh(-0.2), 4), 0.0, 1.0]
    assert rows[0]["positive_words"] == ["增长"] and rows[3]["sentiment_label"] == "negative"


def test_blank_text_is_neutral(spark):
    row = se.sentiment(docs(spark, "  "), "content").first()["sentiment"]
    assert (row["sentiment_score"], row["sentiment_label"], row["finance_hits"]) == (0.0, "neutral", [])


def test_naive_bayes_against_formula(spark):
    train = spark.createDataFrame([(1, "good good fine", True), (2, "bad awful", False), (3, "good bad", True)],
                                  "id long, content string, positive boolean")
    model = se.nb_train(train, "content")
    got = se.nb_sentiment(model, docs(spark, "good awful", "new"), "content").orderBy("id").collect()
    pos, neg = Counter("good good fine good bad".split()), Counter("bad awful".split())
    size = len({*pos, *neg})

    def score(words):
        odds = math.log(3) - math.log(2)
        for w in words:
            if w in {*pos, *neg}:
                odds += math.log((pos[w] + 1) / (5 + size)) - math.log((neg[w] + 1) / (2 + size))
        return round(2 / (1 + math.exp(-odds)) - 1, 4)

    assert [r["sentiment_score"] for r in got] == [score(["good", "awful"]), score(["new"])]


def test_keywords_ties_follow_the_text(spark):
    df = docs(spark, "beta alpha beta gamma alpha 2024 delta", "")
    rows = {r["id"]: r["keywords"] for r in keywords.keywords(df, "content", 3).collect()}
    assert rows == {0: ["beta", "alpha", "gamma"], 1: []}
    top = keywords.corpus_keywords(docs(spark, "bb aa", "aa cc bb"), "content", 2).collect()
    assert [r["token"] for r in top] == ["bb", "aa"]


def test_hot_topics_need_ten_articles(spark, articles):
    rows = [{"title": "old words", "content": "zz", "published_at": f"2024-01-0{i + 1}T00:00:00"} for i in range(4)]
    assert keywords.hot_topics(articles(*rows)).count() == 0
    many = [{"title": "old", "content": "fades", "published_at": f"2024-01-01T0{i}:00:00"} for i in range(5)] + [
        {"title": "new", "content": "rises", "published_at": f"2024-01-02T0{i}:00:00"} for i in range(5)]
    got = {r["keyword"]: (r["current_count"], r["prev_count"], r["trend"]) for r in keywords.hot_topics(articles(*many)).collect()}
    assert got == {"new": (5, 0, "rising"), "rises": (5, 0, "rising"), "old": (0, 5, "falling"), "fades": (0, 5, "falling")}


def brute_clusters(texts, threshold):
    bags = [Counter(w for w in x.split() if len(w) > 1) for x in texts]
    n, df = len(bags), Counter(w for b in bags for w in b)
    idf = {w: math.log((n + 1) / (df[w] + 1)) + 1 for w in df}
    vec = [{w: c * idf[w] for w, c in b.items()} for b in bags]
    norm = [math.sqrt(sum(x * x for x in u.values())) for u in vec]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            dot = sum(vec[i][w] * vec[j][w] for w in vec[i].keys() & vec[j].keys())
            if norm[i] and norm[j] and dot / (norm[i] * norm[j]) >= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(n)]
    return {i: r for i, r in enumerate(roots) if roots.count(r) > 1}


@pytest.mark.parametrize("threshold, crowd", [(0.25, 5000), (0.4, 3), (0.7, 10), (0.3, 1)])
def test_clusters_against_all_pairs(spark, articles, threshold, crowd):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]  # few common, many rare words
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 14))) for _ in range(90)] + ["same text here"] * 5
    df = articles(*[{"title": "", "content": x} for x in texts])
    members, _ = clusters.cluster_members(df, threshold, None, crowd=crowd)
    got = {r["id"] - 1: r["cluster"] - 1 for r in members.collect()}
    assert got == brute_clusters(texts, threshold)


def test_blocks_multiply_few_pairs_in_full(monkeypatch):
    rng = np.random.default_rng(3)
    words, n = 1500, 500
    weight = 1 / np.arange(4, words + 4)
    full = np.zeros((2 * n, words))
    for k in range(2 * n):
        mine = np.roll(weight, 40 * (k % 3))  # three kinds of texts
        drawn, count = np.unique(rng.choice(words, rng.integers(5, 400), p=mine / mine.sum()), return_counts=True)
        full[k, drawn] = count
    full[n:n + 60] = full[:60]
    full[n:n + 60, 700] += 1
    idf = np.log((2 * n + 1) / ((full > 0).sum(0) + 1)) + 1
    norms = np.sqrt(((full * idf) ** 2).sum(1))

    def block(at):
        tf = full[at]
        tokens = np.flatnonzero((tf > 0).any(0))
        row, column = np.nonzero(tf)
        return {"ids": np.arange(at.start, at.stop), "sizes": np.bincount(row, minlength=len(tf)), "tokens": tokens, "idf": idf[tokens],
                "codes": np.searchsorted(tokens, column), "tfs": tf[row, column], "norms": norms[at], "roots": np.arange(len(tf))}

    def parts(links):
        label = np.arange(len(links))
        join(label, *np.nonzero(links))
        return [np.flatnonzero(label == x).tolist() for x in np.unique(label)]

    def found(label):
        return sorted(np.flatnonzero(label == x).tolist() for x in np.unique(label))

    made, shares = [], []
    products = clusters._products
    monkeypatch.setattr(clusters, "_products", lambda strip, other, i, j: made.append(len(i)) or products(strip, other, i, j))
    unit = full * idf / norms[:, None]
    for threshold in (0.35, 0.5, 0.8):
        links = unit @ unit.T >= threshold
        one, two = block(slice(0, n)), block(slice(n, 2 * n))
        assert found(clusters._Meeting(one, None, threshold).joined()) == sorted(parts(links[:n, :n]))
        links[:n, :n], links[n:, n:] = False, False
        made.clear()
        assert found(clusters._Meeting(one, two, threshold).joined()) == sorted(parts(links))
        shares.append(sum(made) / (n * n))
    # few pairs are left by the bounds where few are similar
    assert 0 < shares[2] < 0.2, shares


def test_pairs_at_the_threshold(spark, articles):
    # equal frequencies and weights: two of four words shared are a cosine of one half
    texts = ["aa bb cc dd", "cc dd ee ff", "gg hh ii jj", "gg ii aa ee", "ff bb jj hh"]
    members, _ = clusters.cluster_members(articles(*[{"title": "", "content": x} for x in texts]), 0.5 - 1e-7)
    assert sorted((r["id"], r["cluster"]) for r in members.collect()) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)]
    members, _ = clusters.cluster_members(articles(*[{"title": "", "content": x} for x in texts]), 0.5 + 1e-7)
    assert members.count() == 0


def test_near_copies_make_linearly_many_pairs(spark, articles, monkeypatch):
    rng = random.Random(12)
    base = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(250):
        words = list(base)
        words[rng.randrange(40)] = f"other{i}"
        rows.append({"title": "", "content": " ".join(words)})
    rows += [{"title": "", "content": f"lonely{i} text{i} of{i} its{i} own{i}"} for i in range(20)]
    made = []
    exact = clusters._exact
    monkeypatch.setattr(clusters, "_exact", lambda vectors, pairs, threshold: made.append(pairs.count()) or exact(vectors, pairs, threshold))
    members, _ = clusters.cluster_members(articles(*rows), 0.4)
    got = [(r["id"], r["cluster"]) for r in members.collect()]
    assert sorted(i for i, _ in got) == list(range(1, 251)) and {c for _, c in got} == {1}
    assert sum(made) <= 3 * 250


def test_texts_that_only_share_words_make_no_pairs(spark, articles, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(150)]
    rows = [{"title": "", "content": " ".join(rng.choices(vocabulary, k=60))} for _ in range(120)]
    rows += [{"title": "", "content": rows[0]["content"] + " own"}]
    made = []
    exact = clusters._exact
    monkeypatch.setattr(clusters, "_exact", lambda vectors, pairs, threshold: made.append(pairs.count()) or exact(vectors, pairs, threshold))
    members, _ = clusters.cluster_members(articles(*rows), 0.7, crowd=50)
    assert sorted((r["id"], r["cluster"]) for r in members.collect()) == [(1, 1), (121, 1)]
    assert sum(made) <= 10


def test_lexicon_hits_of_a_long_text(spark):
    rules = {"positive": [("gain", 0.5)], "negative": [("loss", -0.5)], "modifiers": {"very": 2.0}, "negations": ("not ",), "close_negation": "-"}
    pieces, expected, text = ["very gain ", "not loss é ", "x" * 30 + " gain ", "-gain ", "\n\U0001f600 very not loss "], [], ""
    rng = random.Random(4)
    for _ in range(60000):
        text += rng.choice(pieces)
    for word, weight in (("gain", 0.5), ("loss", -0.5)):
        at = text.find(word)
        while at >= 0:
            near, wide = text[max(at - 10, 0):at], text[max(at - 20, 0):at]
            turned = "not " in near or near.endswith("-")
            expected.append((word, (-weight if turned else weight) * (2.0 if "very" in wide else 1.0), turned))
            at = text.find(word, at + 1)
    started = time.time()
    hits = docs(spark, text).select(se.lexicon_hits("content", **rules).alias("h")).first()["h"]
    # with every place counted from the start of the text this took minutes
    assert time.time() - started < 25
    assert [(h["word"], h["effect"], h["negated"]) for h in hits] == expected


def test_cluster_report(spark, articles):
    df = articles({"title": "long title of one", "content": "market rises today again"}, {"title": "one", "content": "market rises today again"},
                  {"title": "other", "content": "weather stays calm tomorrow"}, {"title": "zz", "content": "nothing shared whatsoever"})
    found, members = clusters.cluster_articles(df, 0.4)
    row = found.first()
    assert found.count() == 1 and row["label"] == "one" and row["size"] == 2 and "market" in row["keywords"]
    assert sorted(r["id"] for r in members.collect()) == [1, 2]


def test_summaries(spark):
    long = "第一句讲市场上涨" * 3 + "。第二句讲政策。第三句。第四句" + "很长" * 10 + "。"
    got = docs(spark, "short", long, "").select("id", summary.summary_lead("content", 2).alias("s")).orderBy("id").collect()
    assert got[0]["s"] == "short" and got[2]["s"] == "" and got[1]["s"].count("。") == 2
    text = "apple banana cherry. apple banana plum. zebra quartz. apple banana cherry plum."
    ranked = summary.summary_rank(docs(spark, text), "content", 2, joiner=" | ").first()["summary"]
    assert "zebra" not in ranked and ranked.count("|") == 1


def test_entities(spark):
    df = docs(spark, "比亚迪与华为合作，央行关注 GDP 和 CPI，ABC 上涨，中信证券在北京")
    row = df.select(entities.entities("content", places=["北京"]).alias("x")).first()["x"]
    assert {"比亚迪", "华为", "中信证券"} <= set(row["companies"])
    assert row["organizations"] == ["央行"] and row["places"] == ["北京"]
    assert set(row["indicators"]) == {"GDP", "CPI", "ABC"}


def test_fixed_lists_have_their_sizes():
    assert len(fv.SOURCES) == 24 and sum(s[2] == "fast" for s in fv.SOURCES) == 14
    assert len(fv.COMPANIES) == 48 and len(fv.ORGANIZATIONS) == 11 and len(fv.INDICATORS) == 12
    assert len(fv.KEYWORD_STOP_WORDS) == 55 and len(fv.REPORT_POSITIVE) == 30 and len(fv.REPORT_NEGATIVE) == 24


def plans_of_stored(monkeypatch, module):
    """Optimised plans of what the module stores from now on."""
    plans, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    return plans


def test_near_spellings_name_their_postings_before_they_are_built(spark, monkeypatch):
    from newsloom.operators import search
    rows = [(i, f"a{i}", "t", x, "", "s", "c", "2024-01-01") for i, x in enumerate(["naton one", "nation two", "motion"])]
    index = search.build_index(spark.createDataFrame(rows, "id long, article_id string, title string, content string, summary string, source string, category string, published_at string"))
    plans = plans_of_stored(monkeypatch, search)
    found = search.search(index, ["nation"], fuzzy=1)
    assert sorted(r["id"] for r in found.collect()) == [0, 1]
    built = next(p for p in plans if "collect_list" in p)
    assert "token IN (" in built or "token = " in built
    assert built.index("RepartitionByExpression") < max(built.rfind("token IN ("), built.rfind("token = "))


def test_bayes_splits_labelled_texts_only(spark, monkeypatch):
    from newsloom.operators import sentiment
    texts = spark.createDataFrame([(1, "good good day"), (2, "bad day"), (3, "good")], "id long, content string")
    labels = spark.createDataFrame([(1, True), (2, False)], "id long, positive boolean")
    plans = plans_of_stored(monkeypatch, sentiment)
    model = sentiment.nb_train(texts.join(labels, "id"), "content")
    got = {r["id"]: r["sentiment_label"] for r in sentiment.nb_sentiment(model, texts, "content").collect()}
    assert got == {1: "positive", 2: "negative", 3: "positive"}
    assert len(plans) == 2 and "regexp_extract_all" not in plans[0][plans[0].index("Join"):]


def test_words_are_the_same_with_ascii_first(spark):
    df = spark.createDataFrame([("Größe x2 über沪深300涨停abc １２ a b1 ﬁn 𝟙𝟚 é",)], "s string")
    slow = t._pattern(t.DICTIONARY, r"[\p{L}\p{Nd}&&[^\p{IsHan}]]{2,}")
    row = df.select(t.tokens("s").alias("a"), F.regexp_extract_all("s", F.lit(slow), F.lit(0)).alias("b")).first()
    assert row["a"] == row["b"] and "über" in row["a"]
    assert t.WORD.startswith("[A-Za-z0-9")  # a Latin letter is not looked up by script
