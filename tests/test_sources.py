import json
import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from newsloom.operators import graph as gr, search as se
from newsloom.sources import feeds

NOW = "2024-01-31 00:00:00"


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


BODY = "央行宣布降息，市场普遍认为这将推动经济复苏并提振投资者信心，股市全线上涨，成交额明显放大。"


def landed(spark, *payloads):
    texts = [p if isinstance(p, str) else json.dumps(p, ensure_ascii=False) for p in payloads]
    return spark.createDataFrame(list(enumerate(texts)), "batch long, payload string")


def rows(df):
    return [r.asDict() for r in df.orderBy("pos").collect()]


def test_jinshi(spark):
    items = [{"id": 1, "title": "<b>题</b>", "content": BODY, "time": "2024-01-05 08:00:00"}, {"id": 2, "summary": BODY, "link": "http://l"},
             {"id": 3, "title": "短", "content": "太短"}, {"id": 4, "title": "符号", "content": "!" * 50}]
    a, b = rows(feeds.normalize_feed(landed(spark, {"data": items}), "jinshi", NOW))
    assert (a["title"], a["url"], a["category"], a["published_at"]) == ("题", "https://www.jinshi.cn/news/1", "宏观经济", "2024-01-05 08:00:00")
    assert b["url"] == "http://l" and b["title"] == BODY and b["tags"] == ["宏观经济"]


def test_wallstreetcn_limit(spark):
    items = [{"id": i, "content": "<p>" + BODY + "</p>", "created_at": 1704067200 + i} for i in range(5)]
    got = rows(feeds.wallstreetcn(landed(spark, {"data": {"items": items}}), NOW, 3))
    assert len(got) == 3 and got[1]["published_at"] == "2024-01-01T00:00:01" and got[0]["title"].startswith("<p>央行")


def test_ths_36kr(spark):
    got = rows(feeds.ths(landed(spark, {"data": {"list": [{"pid": 7, "title": "题", "content": BODY, "ctime": "x"}, {"pid": 8, "content": BODY}]}}), NOW))
    assert [r["url"] for r in got] == ["https://news.10jqka.com.cn/detail/pid/7"]
    got = rows(feeds.kr36(landed(spark, {"data": {"items": [{"id": 5, "title": "题", "description": BODY, "published_at": "2024-01-05 08:00:00.1"}]}}), NOW))
    assert (got[0]["url"], got[0]["published_at"]) == ("https://www.36kr.com/newsflashes/5", "2024-01-05 08:00:00")


def test_cls_blocks_and_script(spark):
    html = f'<div class="x telegraph-content">{BODY}<a href="/d/1">l</a></div><div class="feed-content">{BODY}</div><div class="item-content">短</div>'
    script = '<script>var telegraph = [{"id": 9, "content": "' + BODY + '"}];</script>'
    got = rows(feeds.cls(landed(spark, html, script), NOW))
    assert [r["url"] for r in got] == ["/d/1", "https://www.cls.cn/telegraph", "https://www.cls.cn/detail/9"]


def test_announcements(spark):
    item = {"art_code": "AN1", "title": "t", "title_ch": "公告题", "codes": [{"stock_code": "600519"}, {"stock_code": ""}, {"stock_code": "000001"}]}
    got = rows(feeds.eastmoney_ann(landed(spark, {"data": {"list": [item, {"art_code": "AN2", "title": "无码"}]}}), NOW))
    assert got[0]["tags"] == ["600519,000001", "公告"] and got[1]["tags"] == ["公告"] and got[0]["category"] == "公司财报"
    assert got[0]["url"].endswith("/AN1.html") and got[0]["title"] == "公告题"


def test_xueqiu_nested_json(spark):
    def item(i, **d):
        return {"id": i, "data": json.dumps({"id": i, "text": BODY, **d}, ensure_ascii=False)}

    first = {"list": [item(1, target="http://t/1", created_at=1704067200000), item(2, title="题"), {"id": 3, "data": "{broken"}]}
    got = rows(feeds.xueqiu(landed(spark, first, {"list": [item(1), item(4)]}), NOW))
    assert [r["url"] for r in got] == ["http://t/1", "https://xueqiu.com/2/", "https://xueqiu.com/4/"]
    assert got[0]["published_at"] == "2024-01-01T00:00:00" and got[1]["title"] == "题"


def test_rss_short_entries_take_the_page(spark):
    long = BODY * 12
    xml = (f"<rss><channel><item><title>长</title><link>http://a</link><description>{long}</description>"
           f"<pubDate>Mon, 01 Jan 2024 10:00:00 +0800</pubDate><author>作者</author></item>"
           f"<item><title>短</title><link>http://b</link><description>short</description></item>"
           f"<item><title>无页</title><link>http://c</link><description>short</description></item></channel></rss>")
    bodies = spark.createDataFrame([("http://b", BODY)], "url string, body string")
    a, b = rows(feeds.rss(landed(spark, xml), "财新", NOW, bodies))
    assert (a["author"], a["published_at"], b["content"], b["title"]) == ("作者", "2024-01-01T02:00:00", BODY, "短")


def test_rss_under_a_limit_takes_whole_entries_first(spark):
    item = "<item><title>{0}</title><link>http://{0}</link><description>{1}</description></item>"
    xml = "<rss><channel>" + "".join(item.format(t, c) for t, c in (("a", "short"), ("b", BODY * 12), ("c", "short"), ("d", BODY * 12))) + "</channel></rss>"
    bodies = spark.createDataFrame([("http://a", BODY), ("http://c", BODY)], "url string, body string")
    got = lambda n: sorted(r["title"] for r in feeds.rss(landed(spark, xml), "s", NOW, bodies, n).collect())
    assert got(1) == ["b"] and got(3) == ["a", "b", "d"] and got(None) == ["a", "b", "c", "d"]


def test_atom_and_rdf(spark):
    long = BODY * 12
    atom = (f'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>甲</title><link rel="self" href="http://self"/><link href="http://a"/>'
            f"<content type=\"html\">{long}</content><published>2024-01-01T10:00:00+08:00</published><author><name>名</name></author></entry></feed>")
    rdf = (f'<rdf:RDF xmlns:rdf="r" xmlns:dc="d" xmlns:content="c"><channel><title>x</title></channel><item><title>乙</title><link>http://b</link>'
           f"<content:encoded>{long}</content:encoded><dc:date>2024-01-02T00:00:00Z</dc:date><dc:creator>人</dc:creator></item></rdf:RDF>")
    for xml, want in ((atom, ("甲", "http://a", "名", "2024-01-01T02:00:00")), (rdf, ("乙", "http://b", "人", "2024-01-02T00:00:00"))):
        r, = feeds.rss(landed(spark, xml), "s", NOW).collect()
        assert (r["title"], r["url"], r["author"], r["published_at"]) == want and r["content"] == long


def test_links(spark):
    html = ('<a href="/a/1.html">first story here</a><a class="x" href="/a/1.html">again the story</a><a href="/b/2">other rule</a>'
            '<a href="http://g/a/3"><b>third</b> story</a><a href="/a/4">abc</a><a href="/a/5">fifth story</a>')
    df = spark.createDataFrame([(1, "https://h/list/x.html", html)], "page_id long, url string, html string")
    got = feeds.extract_links(df, feeds.fv.LINK_RULES["eastmoney_web"], 2).orderBy("pos").collect()
    assert [(r["text"], r["url"]) for r in got] == [("first story here", "https://h/a/1.html"), ("third story", "http://g/a/3")]


def test_all_link_rules_parse(spark):
    df = spark.createDataFrame([(1, "https://h/", '<a href="/12345">long enough</a>')], "page_id long, url string, html string")
    counts = {name: feeds.extract_links(df, rule).count() for name, rule in feeds.fv.LINK_RULES.items()}
    assert counts["baidu_finance"] == 1 and counts["yicai"] == 0


def test_every_source_resolves_and_three_kinds_meet(spark):
    from newsloom import fixed_values as fv
    assert {k for k, _, _ in fv.SOURCES} <= set(feeds.SOURCES)
    page = '<a href="https://www.yicai.com/news/1.html">a story on a list page</a><a href="https://www.yicai.com/news/2.html">no body for it</a>'
    html = spark.createDataFrame([(page, "https://www.yicai.com/")], "payload string, url string")
    bodies = spark.createDataFrame([("https://www.yicai.com/news/1.html", BODY)], "url string, body string")
    xml = f"<rss><channel><item><title>feed</title><link>http://f</link><description>{BODY * 12}</description></item></channel></rss>"
    flash = landed(spark, {"data": [{"id": 1, "title": "flash", "content": BODY, "time": "2024-01-01 00:00:00"}]})
    parts = [feeds.normalize_feed(x, k, NOW, None, bodies) for k, x in (("yicai", html), ("rss_huxiu", landed(spark, xml)), ("jinshi", flash))]
    got = {r["source"]: r["title"] for p in parts for r in p.collect()}
    assert got == {"第一财经": "a story on a list page", "虎嗅": "feed", "金十数据": "flash"}


def test_collect(spark, articles):
    base = articles(*[{"url": f"u{i % 18}" if i != 3 else "", "content": "x" * i, "source": "s"} for i in range(40)])
    landing = base.withColumns({"pos": F.col("id"), "source_key": F.lit("k"), "tier": F.lit("slow")})
    got = feeds.collect_feeds(landing, 20).collect()
    assert len(got) == 7 and got[0]["content"] == "x" * 7  # 8 per slow source, one of them without a URL


def test_stock_rows(spark):
    df = spark.createDataFrame([(1, "题", BODY, "http://a", "来源", "2024-01-05 08:00:00", "600519"), (2, "题", BODY, "http://a", "来源", "", "000001")],
                               "pos long, `新闻标题` string, `新闻内容` string, `新闻链接` string, `文章来源` string, `发布时间` string, code string")
    assert [r["tags"] for r in feeds.stock_rows_many(df, NOW).collect()] == [["600519", "财经"]]
    assert feeds.stock_rows(df, "600519", NOW).first()["summary"] == "题"


def test_stock_rows_many_follows_its_sql(spark):
    import duckdb
    from newsloom.plans import ingest_queries as q
    from newsloom.plans.catalog import ORACLES

    rows = [(0, "", "a"), (1, "", "b"), (2, None, "c"), (3, None, "d"), (10, "ten", "e"), (20, None, "f"), (7, "same", None), (17, "same", "g"),
            (5, "\nbody", "h"), (6, " ", "i")]
    sf = folder()
    spark.createDataFrame([(i, x, "en", s) for i, x, s in rows], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(
        f"{sf}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet/*.parquet'")
    want = db.execute(f"select pos, url, tags from ({ORACLES['stock_rows_many']})").fetchall()
    got = [tuple(r) for r in q.stock_rows_many(spark, sf).select("pos", "url", "tags").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == 6
    a = spark.createDataFrame([(1, "", "", "http://a", "", "", "x"), (2, "t", "", "http://a", "", "", "x"), (3, "t", "", None, "", "", "x"), (4, "t", "", "", "", "", "x")],
                              "pos long, `新闻标题` string, `新闻内容` string, `新闻链接` string, `文章来源` string, `发布时间` string, code string")
    # the source still takes no row without title and text, and its URL counts as seen
    assert sorted(r["pos"] for r in feeds.stock_rows_many(a, NOW).collect()) == [3, 4]


def graph_of(spark, *responses):
    df = spark.createDataFrame([(i, f"a{i}", f"t{i}", "s", "2024-01-30T00:00:00", f"h{i}", e, r) for i, (e, r) in enumerate(responses)],
                               "id long, article_id string, title string, source string, published_at string, content_hash string, entities_text string, relations_text string")
    return df, gr.build_graph(df)


def test_names(spark):
    cases = {"比亚迪公司": "比亚迪", "比亚迪（深圳）": "比亚迪", "某某有限公司": "某某有限", "公司": "公司", "华为科技": "华为"}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r["n"]: r["x"] for r in df.select("n", gr.normalize_entity("n").alias("x")).collect()} == cases


def test_nodes_merge_over_articles(spark):
    _, g = graph_of(spark, *[("比亚迪\n他的\n特", "")] * 4, ("比亚迪公司", ""))
    node = g.nodes.first()
    assert g.nodes.count() == 1 and (node["name"], node["ref_count"]) == ("比亚迪", 5) and node["ref_articles"][-1] == "a4"


def test_relations(spark):
    listed = json.dumps([{"source": "甲乙", "target": "外人", "relation": "控股"}, {"source": "甲乙", "target": "甲乙"}, {"source": "甲乙", "target": "丙丁"}], ensure_ascii=False)
    _, g = graph_of(spark, ("甲乙\n丙丁", listed), ("甲乙", listed), ("\n".join(f"名字{i}" for i in range(8)), "not json"))
    edges = {(r["src"], r["dst"]): r["relation"] for r in g.edges.collect()}
    assert edges[("甲乙", "外人")] == "控股" and edges[("甲乙", "丙丁")] == "RELATED" and ("甲乙", "甲乙") not in edges
    assert edges[("名字0", "名字7")] == "提及关系" and len(edges) == 2 + 15
    assert g.nodes.filter("name = '外人'").first()["type"] is None
    stats = gr.graph_statistics(g).first()
    assert (stats["nodes"], stats["edges"]) == (11, 17)


def test_changed_article_replaces_its_facts(spark):
    df, g = graph_of(spark, ("甲乙\n丙丁", ""), ("丙丁", ""), ("戊己", ""))
    batch = df.withColumn("content_hash", F.when(F.col("id") == 0, "new").otherwise(F.col("content_hash"))).withColumn(
        "entities_text", F.when(F.col("id") == 0, "庚辛").otherwise(F.col("entities_text")))
    after, done = gr.incremental_graph(g, batch)
    assert [(r["id"], r["state"]) for r in done.collect()] == [(0, "changed")]
    assert {r["name"]: r["ref_count"] for r in after.nodes.collect()} == {"丙丁": 1, "戊己": 1, "庚辛": 1}
    again, none = gr.incremental_graph(after, batch)
    assert none.count() == 0 and gr.incremental_graph(g, batch, budget=1)[1].count() == 0


def test_timeline(spark, articles):
    _, g = graph_of(spark, ("甲乙", ""), ("甲乙", ""))
    a = articles({"i": 0, "summary": "s0", "published_at": "2024-01-30T00:00:00"}, {"i": 1, "summary": "", "published_at": "2024-01-29 00:00:00"})
    row = gr.entity_timeline(g, a, "甲乙公司", NOW).first()
    assert row["article_count"] == 2 and row["lines"].split("\n")[0] == "- [2024-01-29] title 1: content 1"
    one = gr.entity_timeline(g, a.filter("id = 0"), "甲乙", NOW).first()
    assert (one["article_count"], one["summary"], one["lines"]) == (1, "s0", "")
    assert gr.entity_timeline(g, a, "没人", NOW).first()["article_count"] == 0


def test_search(spark, articles):
    df = articles({"title": "alpha beta", "content": "gamma"}, {"title": "delta", "content": "alpha gamma", "source": "虎嗅"},
                  {"title": "other", "content": "Alpha only"})
    index = se.build_index(df)
    hits = se.search(index, ["ALPHA", "gamma"]).collect()
    assert [r["id"] for r in hits] == [1, 2] and hits[0]["total"] == 2
    assert [r["id"] for r in se.search(index, ["alpah"], fuzzy=2).collect()] != []
    assert [r["id"] for r in se.search_news(index, df, ["alpha", "gamma"], exclude=["虎嗅"]).collect()] == [1]
    back = se.search_news(index, df, ["pha on"]).collect()
    assert [(r["id"], r["fallback"]) for r in back] == [(3, True)]
    newer = se.update_index(index, df.filter("id = 3").withColumn("content", F.lit("beta")), 1)
    assert se.search(newer, ["alpha"]).count() == 2 and se.index_health(newer).first()["deleted"] == 1
    assert se.search(se.compact(se.delete_from_index(newer, df.filter("id = 1"))), ["beta"]).first()["id"] == 3
    assert se.index_lag(df, se.build_index(df.filter("id = 1"))).first()["lag"] == 2


def test_compaction_makes_the_postings_once(spark, articles):
    df = articles(*[{"title": f"alpha w{i}", "content": "beta " * (i + 1)} for i in range(4)])
    small = se.compact(se.delete_from_index(se.build_index(df), df.filter("id in (2, 4)"))).postings
    left = {(r["term"], r["field"]): (r["n"], r["max_tf"], r["min_len"], r["ids"], r["tf"]) for r in small.collect()}
    assert left["beta", "content"] == (2, 3, 1, [1, 3], [1, 3]) and ("w1", "title") not in left
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1


def _corpus(seed, n=70):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "news", "bank", "oil", "rate"]
    say = lambda m: " ".join(words[min(int(rng.expovariate(0.5)), 7)] for _ in range(m))
    return [{"title": say(3), "content": say(rng.randrange(1, 25)), "summary": say(2), "i": 1 + i * 331} for i in range(n)]


def _fits(row, q):
    texts = [row[f].split() for f in ("title", "content", "summary")]
    has = lambda w: any(w in x for x in texts)
    near = lambda p: any(x[i:i + len(p)] == p for x in texts for i in range(len(x)))
    return (all(map(has, q.every)) and (not q.some or any(map(has, q.some))) and not any(map(has, q.none)) and all(map(near, q.phrases)))


def _score(rows, row, words):
    total = 0.0
    for f, boost in se.SEARCH_BOOSTS.items():
        average = sum(len(r[f].split()) for r in rows) / len(rows)
        mine = row[f].split()
        for w in words:
            df = sum(w in r[f].split() for r in rows)
            if w in mine:
                tf = mine.count(w)
                total += boost * (math.log(len(rows) / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(mine) / average))
    return total


@pytest.mark.parametrize("query", [
    se.Query(every=["Alpha", "beta"]), se.Query(some=["oil", "rate"]), se.Query(every=["alpha"], none=["beta", "news"]),
    se.Query(phrases=[["alpha", "beta"]]), se.Query(every=["news"], some=["oil", "gamma"], none=["rate"], phrases=[["alpha", "alpha"], ["beta"]]),
    se.Query(none=["alpha"]), se.Query(phrases=[["beta", "alpha", "beta"]])])
def test_structured_queries_against_brute_force(spark, articles, query):
    rows = _corpus(3)
    index = se.build_index(articles(*rows))
    fitting = [r for r in rows if _fits(r, query)] if query.scored() else []
    want = sorted(((-round(_score(rows, r, query.scored()), 9), r["i"]) for r in fitting))
    for probed in (1, 16):  # few blocks probed: most are ruled out by their bounds or scored after all
        got = se.search(index, query, 1, 5, probed=probed).collect()
        assert [r["id"] for r in got] == [i for _, i in want[:5]]
        assert all(r["total"] == len(fitting) for r in got)
        assert [round(r["score"], 6) for r in got] == [round(-s, 6) for s, _ in want[:5]]
    every = se.rank_documents(index, query).count()
    assert every == len(fitting)


def test_blocks_are_ruled_out_by_their_bounds(spark, articles):
    rows = [{"i": 1 + 2000 * k, "title": "", "content": ("word " * (20 if k == 3 else 1)) + "filler " * 30, "summary": ""} for k in range(12)]
    index = se.build_index(articles(*rows))
    hits = se._hits(index, ["word"], None, 0)
    weights = se._weights(index, hits)
    bounds = {r["block"]: r["bound"] for r in se.block_bounds(hits, weights).collect()}
    scores = {r["id"] // se.BLOCK: r["score"] for r in se.rank_documents(index, ["word"]).collect()}
    assert len(bounds) == 12 and all(bounds[b] >= scores[b] - 1e-9 for b in scores)
    best = (1 + 2000 * 3) // se.BLOCK
    assert all(b < scores[best] for block, b in bounds.items() if block != best)
    assert [r["id"] for r in se.search(index, ["word"], 1, 1, probed=1).collect()] == [6001]


def test_near_spellings_share_a_variant(spark, articles):
    rng = random.Random(9)
    vocabulary = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 7))) for _ in range(200)})
    index = se.build_index(articles({"content": " ".join(vocabulary), "title": "", "summary": "", "source": "", "category": ""}))
    asked = ["abca", "bb", "CCAB", "aaaaaa"]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = [last := i + 1] + [last := min(row[j] + (x != y), row[j + 1] + 1, last + 1) for j, y in enumerate(b)]
        return row[-1]

    want = {(w, q.lower()) for q in asked for w in vocabulary if edits(w, q.lower()) <= 1}
    assert {tuple(r) for r in se.fuzzy_terms(index, asked).collect()} == want
    path = folder()
    se.save_index(index, path)
    assert {tuple(r) for r in se.fuzzy_terms(se.load_index(spark, path), asked).collect()} == want


def test_near_spellings_count_bytes(spark, articles):
    """The SQL's edit distance is over UTF-8: a letter outside ASCII takes two edits."""
    index = se.build_index(articles({"content": "under unde underö undör unter", "title": "", "summary": "", "source": "", "category": ""}))
    assert {r["term"] for r in se.fuzzy_terms(index, ["under"]).collect()} == {"under", "unde", "unter"}
    assert {r["term"] for r in se.fuzzy_terms(index, ["underü"]).collect()} == {"underö"}
    assert {r["term"] for r in se.fuzzy_terms(index, ["under"], 2).collect()} == {"under", "unde", "underö", "undör", "unter"}


def test_context_for_a_question(spark, articles):
    _, g = graph_of(spark, ("\n".join(f"名字{i}" for i in range(8)), ""))
    a = articles({"i": 1, "title": "关于名字0", "summary": "s", "published_at": "2024-01-30T00:00:00"},
                 {"i": 2, "title": "名字0旧闻", "published_at": "2024-01-01T00:00:00"}, {"i": 3, "title": "无关"})
    named = gr.relevant_entities(g, "名字0 怎么样")
    assert [r["name"] for r in named.collect()] == ["名字0"]
    text = gr.collect_context(g, a, named, NOW, "2024-01-20", "2024-01-31").first()["context"]
    first, second = text.split("\n\n新闻标题: ")
    assert first.startswith("实体 '名字0' 的相关信息:\n  - 和 '名字5' 的关系: 提及关系\n") and second.startswith("关于名字0\n新闻摘要: s")


def test_roll_entries_take_page_bodies(spark):
    items = [{"title": "题", "url": "http://b"}, {"title": "", "url": "http://b"}, {"title": "无页", "url": "http://c"}]
    bodies = spark.createDataFrame([("http://b", BODY)], "url string, body string")
    got = rows(feeds.sina_roll(landed(spark, {"result": {"data": items}}), bodies, NOW))
    assert [(r["title"], r["content"], r["source"]) for r in got] == [("题", BODY, "新浪财经")]


def test_graph_is_saved_and_loaded(spark):
    _, g = graph_of(spark, ("甲乙公司\n丙丁集团", ""), ("甲乙", ""))
    path = folder()
    gr.save_graph(g, path)
    again = gr.load_graph(spark, path)
    for part in gr.PARTS:
        assert sorted(map(str, getattr(again, part).collect())) == sorted(map(str, getattr(g, part).collect()))
    assert gr.graph_statistics(again).first() == gr.graph_statistics(g).first()


def test_plugged_in_source(spark):
    feeds.add_source("mine", lambda frame, now: frame.select(F.col("payload").alias("title"), F.lit(now).alias("published_at")))
    try:
        got = feeds.normalize_feed(landed(spark, "one", "two"), "mine", NOW).collect()
        assert sorted((r["title"], r["published_at"]) for r in got) == [("one", NOW), ("two", NOW)]
    finally:
        feeds.SOURCES.pop("mine")


def test_lists_are_split(spark):
    from newsloom.operators import listing
    df = spark.createDataFrame([("a,b", "x"), ("", "y,z"), (None, "")], "tags string, keywords string")
    got = [tuple(r) for r in listing.split_lists(df, "tags", "keywords").collect()]
    assert got == [(["a", "b"], ["x"]), ([], ["y", "z"]), ([], [])]


def test_upserts_number_names_and_compare_digests(spark, monkeypatch):
    from newsloom.operators import ranking
    from newsloom.sources import store
    a = spark.range(6).select("id", F.concat(F.lit("a"), "id").alias("article_id"), F.lit(0.5).alias("hotness_score"),
                              *[(F.array(F.lit("x")) if c == "tags" else F.lit(0) if c.endswith("_count") else F.lit("x")).alias(c) for c in store.WRITTEN])
    target = a.filter("id < 4").withColumn("id", F.when(F.col("id") != 3, F.col("id") + 10)).withColumn(
        "summary", F.when(F.col("article_id") != "a2", F.col("summary")))
    batch = a.drop("id", "hotness_score").withColumn("id", F.lit(None).cast("bigint")).withColumn("hotness_score", F.lit(0.0)).withColumn(
        "title", F.when(F.col("article_id") == "a1", "y").otherwise(F.col("title"))).withColumn(
        "summary", F.when(F.col("article_id").isin("a2", "a3"), "").otherwise(F.col("summary"))).withColumn("pos", F.lit(1))
    stored, cut = [], ranking.cut
    monkeypatch.setattr(ranking, "cut", lambda df: stored.append(df.columns) or cut(df))
    out = {r["article_id"]: (r["id"], r["hotness_score"], r["action"]) for r in store.upsert_articles(target, batch, NOW).collect()}
    # a null differs from an empty text; a known row without an id gets one
    assert out == {"a0": (10, 0.5, None), "a1": (11, 0.5, "update"), "a2": (12, 0.5, "update"), "a3": (13, 0.5, "update"),
                   "a4": (14, 0.0, "insert"), "a5": (15, 0.0, "insert")}
    assert stored == [["article_id", "_part", "_pos"]]
    plan = store.classify_batch(target, batch).select("action")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan.splitlines()[0]  # digests are made below the join


def test_search_of_a_fresh_index_builds_its_own_terms_only(spark, articles):
    """A fresh index is narrowed to the words of the query before words are placed;
    hits are those of the whole index."""
    rows = [{"title": f"alpha {w}", "content": f"{w} beta alpha gamma {w}", "summary": "gamma beta" if n % 2 else ""}
            for n, w in enumerate(["one", "two", "beta", "delta", "gamma", "six"])]
    index = se.build_index(articles(*rows))
    whole = se.Index(index.postings, index.docs, index.variants)
    for asked in (se.Query(every=["alpha"], some=["beta", "one"], none=["delta"]), se.Query(phrases=[["beta", "alpha"]]), ["gamma"], ["nowhere"]):
        got, want = ([tuple(r) for r in se.search(x, asked, 1, 4).collect()] for x in (index, whole))
        assert got == want
        query = se.as_query(asked)
        terms = {r["term"] for r in se._narrowed(index, asked, None, 0).postings.collect()}
        assert terms <= {*query.scored(), *query.none}
