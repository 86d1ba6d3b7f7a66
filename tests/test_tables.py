import math
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsloom.operators import hotness as hot, listing, metrics, stats, translate as tr
from newsloom.operators.ranking import global_rank
from newsloom.plans import dashboard
from newsloom.sources import store, validate

NOW = "2024-01-31 00:00:00"


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def events(spark, *rows):
    return spark.createDataFrame(rows, "event_type string, article_id string, client_id string, payload string, t string").withColumn(
        "created_at", F.col("t").try_cast("timestamp"))


def test_hotness(spark):
    assert hot.hotness(events(spark), NOW).count() == 0
    ev = events(spark, ("article_click", "a", "u", None, "2024-01-30 23:00:00"), ("article_click", "a", "u", None, "2024-01-30 20:00:00"),
                ("article_view", "b", "u", '{"duration_ms": 20000}', "2024-01-30 23:00:00"), ("search_click", "b", "w", "{}", "2024-01-30 23:00:00"),
                ("search_query", "c", "u", None, "2024-01-30 23:00:00"), ("article_click", None, "u", None, "2024-01-30 23:00:00"),
                ("article_click", "d", "u", None, "2024-01-29 23:00:00"), ("article_click", "e", "u", None, "bad"))
    got = {r["article_id"]: r["score"] for r in hot.hotness(ev, NOW).collect()}
    d = math.exp(-1 / 24)
    assert got == {"a": round(d, 4), "b": round(4 * d, 4), "c": 0.0, "e": round(math.exp(-1), 4)}
    assert hot.article_hotness(ev, "a", NOW).first()["score"] == round(d + math.exp(-4 / 24), 4)
    assert hot.article_hotness(ev, "none", NOW).first()["score"] == 0.0
    assert hot.purge_events(ev, NOW).count() == 7


def test_keyword_filter_falls_back(spark, articles):
    df = articles({"title": "Apple"}, {"title": "pear"}, {"title": "plum"})
    assert [r["title"] for r in listing.filter_keyword(df, "aPPle", 5).collect()] == ["Apple"]
    assert listing.filter_keyword(df, "zzz", 2).count() == 2


def test_like_takes_wildcards_literally(spark, articles):
    df = articles({"title": "50% off"}, {"title": "500 off"})
    assert [r["title"] for r in listing.search_like(df, "0% O").collect()] == ["50% off"]


def test_last_day_is_included_in_both_forms(spark, articles):
    df = articles({"published_at": "2024-01-02T23:59:58"}, {"published_at": "2024-01-02 10:00:00"}, {"published_at": "2024-01-03T00:00:00"})
    assert listing.by_date_range(df, "2024-01-02", "2024-01-02").count() == 2


def test_urls(spark, articles):
    df = articles({"url": ""}, {"url": ""}, {"url": "u"}, {"url": "u"})
    assert sorted(r["id"] for r in listing.first_per_url(df).collect()) == [1, 2, 3]


def test_global_rank_with_one_hot_key(spark):
    df = spark.range(5000).select((F.col("id") % 7 > 4).cast("int").alias("k"), "id")
    got = [r["rank"] for r in global_rank(df, ["k", "id"]).orderBy("k", "id").collect()]
    assert got == list(range(1, 5001))


def test_pages(spark, articles):
    df = articles(*[{"source": "虎嗅" if i % 2 else "x", "published_at": f"2024-01-{i + 1:02d}T00:00:00"} for i in range(30)])
    got = listing.materialize_pages(df, "2024-01-31 00:00:00")
    assert got.filter("listing = 'media' and page_size = 12 and page = 2").count() == 3
    assert got.filter("listing = 'latest'").agg(F.max("total")).first()[0] == 30


def test_dashboard_of_nothing(spark, articles):
    from newsloom.schemas import ANALYSIS_SCHEMA
    empty = spark.createDataFrame([], ANALYSIS_SCHEMA)
    rows = dashboard.dashboard_rows(articles({"published_at": "2020-01-01T00:00:00"}), empty, NOW).collect()
    assert [(r["section"], r["n"]) for r in rows] == [("overall", 0)]


def test_breakdown_names_missing_keys(spark):
    df = spark.createDataFrame([(None, "", 0.5, "positive")], "source string, category string, sentiment_score double, sentiment_label string")
    assert {(r["dimension"], r["key"]) for r in stats.sentiment_breakdown(df).collect()} == {("source", "未知"), ("category", "未分类")}


def test_event_checks(spark):
    ev = events(spark, ("article_click", "a", "u", '{"x": 1}', NOW), ("buy", "a", "u", None, NOW), ("article_view", "a" * 65, "u", None, NOW),
                ("article_view", "a", "u", "{broken", NOW), ("article_view", "a", "u", '"' + "x" * 2000 + '"', NOW))
    got = {r["outcome"]: r["n"] for r in validate.reject_counts(ev).collect()}
    assert got == {"accepted": 1, "type": 1, "article_id": 1, "payload": 1, "payload_length": 1}


def test_messages(spark):
    df = spark.createDataFrame([("匿名用户 123456", " <b>hi</b>\n  there "), ("匿名用户 12345", "x"), ("匿名用户 123456", "<p></p>"),
                                ("匿名用户 123456", "x" * 2001)], "anonymous_id string, content string")
    assert [r["content"] for r in validate.clean_messages(df).collect()] == ["hi there"]


def test_upsert_keeps_id_and_hotness(spark, articles):
    target = articles({"hotness_score": 3.0}, {})
    batch = articles({"title": "new title"}, {"i": 2}, {"i": 9, "article_id": "fresh"}, {"i": 1, "title": "newest title"}).withColumn(
        "pos", F.monotonically_increasing_id())
    batch = batch.withColumn("pos", F.when(F.col("title") == "newest title", 99).otherwise(F.col("pos") % 8))
    got = {r["article_id"]: r for r in store.upsert_articles(target, batch, NOW).collect()}
    assert (got["a1"]["id"], got["a1"]["title"], got["a1"]["hotness_score"], got["a1"]["action"]) == (1, "newest title", 3.0, "update")
    assert got["a2"]["action"] is None and got["fresh"]["action"] == "insert" and got["fresh"]["id"] > 2


def test_versions_and_copies(spark, articles):
    root = folder()
    assert store.read_table(spark, root + "/a/news") is None
    store.write_table(articles({}, {}), root + "/a/news")
    store.write_table(articles({}, {}, {}), root + "/a/news")
    store.write_table(articles({"title": "kept"}), root + "/b/news")
    store.copy_tables(spark, root + "/a", root + "/b", {"news": "article_id"})
    a, b = store.read_table(spark, root + "/a/news"), store.read_table(spark, root + "/b/news")
    assert b.count() == 3 and b.filter("title = 'kept'").count() == 1
    row = store.reconcile(a, b, "article_id", ["title"]).first()
    assert (row["only_source"], row["different"], row["equal"]) == (0, 1, False)


def test_dual_write(spark, articles):
    wrote, warned = [], []

    def fail(df):
        raise ValueError("down")

    assert store.dual_write(articles({}), lambda d: wrote.append(d.count()), fail, warned.append) is False
    assert wrote == [1] and "down" in warned[0]
    with pytest.raises(ValueError):
        store.dual_write(articles({}), fail, lambda d: wrote.append(0))
    assert wrote == [1]


def test_parameterised_query(spark, articles):
    got = store.query(spark, "select title from {a} where id = :n", {"n": 2}, a=articles({}, {}))
    assert [r["title"] for r in got.collect()] == ["title 2"]


def test_translation(spark):
    texts = spark.createDataFrame([("经济增长",), ("经济增长",), ("plain text",), (" ",)], "text string")
    work = tr.translation_worklist(texts, "en")
    assert [r["text"] for r in work.collect()] == ["经济增长"]
    cache = work.select("key", F.lit("growth").alias("translated"))
    assert tr.translation_worklist(texts, "en", cache).count() == 0
    df = spark.createDataFrame([("经济增长", "市场上涨"), ("plain text", "more text")], "title string, summary string")
    rows = tr.apply_translations(df, cache, "en", ["title", "summary"], "title").orderBy("title").collect()
    assert (rows[0]["title_translated"], rows[0]["was_translated"]) == ("plain text", False)
    assert (rows[1]["title_translated"], rows[1]["summary_translated"]) == ("growth", "[Translate required] 市场上涨")


def samples(spark, values):
    df = spark.createDataFrame([(i * 60, float(x)) for i, x in enumerate(values)], "t long, value double")
    return df.select(F.timestamp_seconds(F.col("t") + 1704067200).alias("ts"), "value")


def test_alert_needs_the_whole_hold_time(spark):
    assert metrics.lag_alerts(samples(spark, [200] * 5), 100, 5).count() == 0
    assert metrics.lag_alerts(samples(spark, [200] * 7), 100, 5).count() == 2
    assert metrics.lag_alerts(samples(spark, [200] * 4 + [0] + [200] * 5), 100, 5).count() == 0
    assert metrics.down_alerts(samples(spark, [1, 0, 0, 1])).count() == 1


def test_crawl_failure_alert(spark):
    rows = [(i * 10, "bad", i % 2 == 0) for i in range(600)] + [(i * 10, "good", i % 50 != 0) for i in range(600)]
    log = spark.createDataFrame(rows, "t long, source string, ok boolean").select(
        F.timestamp_seconds(F.col("t") + 1704067200).alias("ts"), "source", "ok")
    assert {r["source"] for r in metrics.crawl_failure_alerts(log).select("source").distinct().collect()} == {"bad"}


def test_a_stop_before_the_switch_keeps_the_old_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    store.write_table(spark.range(3), path)
    monkeypatch.setattr(store, "_pointers", lambda *a: (_ for _ in ()).throw(RuntimeError("stop")))
    try:
        store.write_table(spark.range(5), path)
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert store.read_table(spark, path).count() == 3
    store.write_table(spark.range(7), path)
    assert store.read_table(spark, path).count() == 7 and len(list((tmp_path / "t").glob("_at-*"))) == 1


def bucket_files(path):
    return {p.relative_to(path).as_posix() for p in Path(path).rglob("*.parquet")}


def test_bucketed_upsert_rewrites_touched_buckets_only(spark, articles):
    path = folder() + "/articles"
    batch = lambda *rows: articles(*rows).withColumn("pos", F.col("id"))
    first = store.upsert_buckets(path, batch(*[{} for _ in range(40)]), NOW, count=8)
    assert first.filter("action = 'insert'").count() == 40
    before, held = bucket_files(path), store.manifest(spark, path)
    assert len(held["parts"]) == 8 and held["top"] == 40
    # the same rows again write nothing, not even a manifest
    assert store.upsert_buckets(path, batch({}, {}, {}), NOW).count() == 0
    assert store.manifest(spark, path) == held
    out = {r["article_id"]: (r["action"], r["id"]) for r in store.upsert_buckets(
        path, batch({"title": "changed"}, {}, {"i": 3, "article_id": "fresh"}), NOW).collect()}
    assert out == {"a1": ("update", 1), "fresh": ("insert", 41)}
    new = store.manifest(spark, path)
    moved = [b for b in held["parts"] if held["parts"][b] != new["parts"][b]]
    assert 1 <= len(moved) <= 2 and new["top"] == 41
    untouched = {f for f in before if f.split("_bucket=")[1].split("/")[0] not in moved}
    assert untouched < bucket_files(path)
    rows = {r["article_id"]: r for r in store.read_buckets(spark, path).collect()}
    assert len(rows) == 41 and rows["a1"]["title"] == "changed" and rows["a2"]["title"] == "title 2"
    assert store.vacuum(spark, path) == len(moved)
    assert untouched < bucket_files(path) and store.read_buckets(spark, path).count() == 41
    assert store.read_buckets(spark, path, [int(moved[0])]).count() < 41


def test_a_stop_before_the_switch_keeps_the_old_version(spark, articles, monkeypatch):
    path = folder() + "/articles"
    store.upsert_buckets(path, articles({}, {}).withColumn("pos", F.col("id")), NOW, count=2)
    held = store.manifest(spark, path)

    def stop(*args):
        raise RuntimeError("stopped")

    monkeypatch.setattr(store, "_switch", stop)
    with pytest.raises(RuntimeError):
        store.upsert_buckets(path, articles({"title": "lost"}).withColumn("pos", F.col("id")), NOW)
    monkeypatch.undo()
    assert store.manifest(spark, path) == held
    assert {r["title"] for r in store.read_buckets(spark, path).collect()} == {"title 1", "title 2"}
    store.vacuum(spark, path)  # what the stopped write left goes
    assert store.read_buckets(spark, path).count() == 2 and len({f.split("/")[0] for f in bucket_files(path)}) == 1


def test_exact_quantiles_against_sorting(spark):
    import random
    rng = random.Random(4)
    groups = {"a": [rng.gauss(50, 20) for _ in range(3001)], "b": [7.0] * 50, "c": [1.0], "d": [rng.randrange(5) for _ in range(400)],
              "e": [0.001 * i * i for i in range(2000)] + [1e9]}
    df = spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs] + [("a", None)], "k string, v double")
    for q in (0.01, 0.5, 0.95, 1.0):
        for cells, rounds in ((4, 1), (16, 2), (1024, 2)):
            got = {r["k"]: r["quantile"] for r in metrics.exact_quantile(df, ["k"], "v", q, cells, rounds).collect()}
            assert got == {k: sorted(map(float, xs))[max(math.ceil(len(xs) * q), 1) - 1] for k, xs in groups.items()}


def test_sketches_merge_within_their_error(spark):
    log = spark.range(20000).select(F.lit("GET").alias("method"), F.when(F.col("id") % 3 == 0, "/a").otherwise("/b").alias("path"),
                                    ((F.col("id") * 7919) % 20000).cast("double").alias("duration_ms"),
                                    F.timestamp_seconds(F.col("id") * 11).alias("ts"))
    sketches = metrics.latency_sketches(log)
    assert sketches.count() > 100
    for q in (0.1, 0.5, 0.95, 0.99):
        for r in metrics.sketched_quantile(sketches, q, "path").collect():
            values = log.filter(F.col("path") == r["path"])
            rank = values.filter(F.col("duration_ms") <= r["latency"]).count() / r["n"]
            assert r["n"] == values.count() and abs(rank - q) < 0.01
    merged = metrics.sketched_quantile(sketches, 0.5).first()
    assert merged["n"] == 20000 and abs(merged["latency"] - 10000) < 250


def test_unions_take_sides_with_unlike_partitions(spark):
    """The graph update over 256 410 documents failed on a union whose sides the run time had split unlike."""
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
