import datetime
import random
import tempfile

from pyspark.sql import functions as F

from newsloom import views as v
from newsloom.operators import dedup
from newsloom.streaming import articles as sa, dedup as sd, hotness as sh
from newsloom.plans.runs import Run
from newsloom.sources import store

START = 1704067200


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def at(df, column="t"):
    return df.withColumn("ts", F.timestamp_millis(F.lit(START * 1000) + (F.col(column) * 1000).cast("bigint")))


def stream_of(spark, df, name):
    path = folder()
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def run_to_table(spark, out, name, mode="append"):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder()).trigger(
        availableNow=True).start()
    try:
        assert q.awaitTermination(120), "the stream did not finish"
    finally:
        q.stop()
    return spark.table(name)


def test_hotness_stream_equals_batch(spark, sf):
    events = v.event_log(spark, sf).drop("event_id")
    late = events.agg(F.max("created_at")).first()[0]
    table = run_to_table(spark, sh.windowed_hotness(stream_of(spark, events.orderBy("created_at"), "events")), "hot")
    want = sh.windowed_hotness(events)
    closed = table.agg(F.max("window_end")).first()[0]
    assert closed is not None and closed <= late
    a = {tuple(r) for r in table.collect()}
    b = {tuple(r) for r in want.filter(F.col("window_end") <= F.lit(closed)).collect()}
    assert a == b and a


def test_stream_unique_urls(spark, articles):
    df = articles({"url": "u"}, {"url": "u"}, {"url": ""}, {"url": ""}).withColumn("arrived", F.lit("2024-01-01").cast("timestamp"))
    table = run_to_table(spark, sd.stream_unique_urls(stream_of(spark, df, "urls")), "uniq")
    assert table.filter("url = 'u'").count() == 1 and table.filter("url = ''").count() == 2


# --- near repeats as keyed state ------------------------------------------------

WORDS = ["market", "bank", "growth", "rate", "oil", "trade", "chip", "steel", "grain", "bond", "yen", "gold", "coal", "rail", "port"]


def arriving(spark, seed, n=60, days=3):
    """Articles of a few families over some days, near copies and exact ones."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(n):
        words = rng.choice(texts).split()
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "other"
        body = "" if i % 17 == 5 else " ".join(words)
        rows.append((f"a{i:03d}", "", body, "", float(rng.randrange(days * 86400))))
    df = spark.createDataFrame(rows, "article_id string, title string, content string, summary string, t double")
    return at(df).withColumnRenamed("ts", "arrived").drop("t")


def near_stream(spark, batches, checkpoint, source, name):
    """Feed batches one trigger each; a query is started anew for every one."""
    rows = []
    for n, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(source)
        out = sd.stream_near_repeats(spark.readStream.schema(batch.schema).parquet(source), late="2 hours")
        q = out.writeStream.format("parquet").option("path", checkpoint + "/out").option("checkpointLocation", checkpoint + "/at").trigger(
            availableNow=True).start()
        assert q.awaitTermination(300)
    return {(r["article_id"], r["repeat"]) for r in spark.read.parquet(checkpoint + "/out").collect()}


def test_near_repeats_batch_against_brute_force(spark):
    df = arriving(spark, 1)
    prints = {r["article_id"]: (r["arrived"], r["fp"]) for r in df.select("article_id", "arrived", dedup.fingerprint_of(dedup.TEXT_RULES["full"]()).alias("fp")).collect()}
    want = set()
    for one, (when, fp) in prints.items():
        earlier = [(w, o) for o, (w, f) in prints.items() if (w, o) < (when, one) and (when - w).total_seconds() <= 86400
                   and fp and f and bin((fp ^ f) & (2 ** 64 - 1)).count("1") <= 3]
        want.add((one, bool(earlier)))
    got = {(r["article_id"], r["repeat"]) for r in sd.near_repeats(df).collect()}
    assert got == want and 5 < sum(r for _, r in got) < len(got) - 5


def test_near_repeat_stream_with_restarts_late_rows_and_expiry(spark):
    df = arriving(spark, 2, days=9).orderBy("arrived").cache()
    rows = df.collect()
    schema = df.schema
    frame = lambda part: spark.createDataFrame(part, schema)
    # neighbours within the allowed lateness change places; every batch is a query of its own
    shuffled = list(rows)
    for i in range(0, len(rows) - 1, 2):
        if (rows[i + 1]["arrived"] - rows[i]["arrived"]).total_seconds() < 7000:
            shuffled[i], shuffled[i + 1] = shuffled[i + 1], shuffled[i]
    last = rows[-1]["arrived"]
    end = [("zz1", "", "", "", last + datetime.timedelta(days=2)), ("zz2", "", "", "", last + datetime.timedelta(days=4))]
    # far too late: its copy has been decided long ago, and it is dropped
    late = [("late", "", rows[3]["content"], "", rows[3]["arrived"])]
    folder_ = folder()
    got = near_stream(spark, [frame(shuffled[:25]), frame(shuffled[25:50]), frame(late + shuffled[50:]), frame(end[:1]), frame(end[1:])],
                      folder_, folder() + "/in", "near")
    got = {x for x in got if not x[0].startswith("zz")}
    want = {(r["article_id"], r["repeat"]) for r in sd.near_repeats(df).collect()}
    assert got == want
    expired = {(r["article_id"], r["repeat"]) for r in sd.near_repeats(df, hours=10 ** 6).collect()}
    assert len(expired ^ want) > 0  # some copies are kept only because the earlier one had expired


def test_decisions_of_one_key():
    import numpy as np
    none = np.zeros(0, dtype=np.int64)
    hits, fps, seen = sd.decide(none, none, [(10, "a", 0b1111), (20, "b", 0b1110), (25, "c", 0), (31, "d", 0b1111), (50, "e", -1), (200, "f", 0b1111)], 1, 100)
    assert hits == [False, True, False, True, False, False]
    assert dict(zip(fps.tolist(), seen.tolist())) == {0b1111: 200, 0b1110: 20, -1: 50}


def test_article_stream(spark, articles):
    path, root = folder(), folder()
    first = articles({"title": "alpha beta gamma delta", "content": "经济增长，公司宣布回购股份"}, {"title": "other news item today"})
    again = articles({"i": 1, "title": "alpha beta gamma delta", "content": "经济增长，公司宣布回购股份"},
                     {"i": 3, "title": "alpha beta gamma delta", "content": "经济增长，公司宣布回购股份", "url": "", "article_id": "copy"},
                     {"i": 4, "title": "third story is fresh", "url": ""})
    first.coalesce(1).write.parquet(path + "/in/1")
    reports = []
    for n, frame in enumerate((first, again)):
        frame.coalesce(1).write.mode("append").parquet(path + "/feed")
        stream = spark.readStream.schema(frame.schema).parquet(path + "/feed")
        q = sa.stream_articles(stream, Run(root, buckets=4), path + "/checkpoint", lambda: "2024-01-02 00:00:00", report=lambda i, c: reports.append(c))
        assert q.awaitTermination(300)
    assert reports[0] == {"collected": 2, "kept": 2, "written": 2, "analysed": 2}
    # the repeated article is unchanged; the copy without a URL was seen before
    assert reports[1]["collected"] == 3 and reports[1]["written"] == 1
    table = Run(root).articles(spark)
    assert table.count() == 3 and table.select("id").distinct().count() == 3
    done = {r["article_id"]: r["sentiment_label"] for r in store.read_table(spark, root + "/analysis").collect()}
    assert len(done) == 3 and done["a1"] == "positive"
    run = Run(root)
    assert run.load_index(spark).docs.filter("live").count() == 3
    report = run.daily(spark, "2024-01-03 00:00:00")
    assert report["lag"].first()["lag"] == 0 and report["analysed"].first()["n"] == 0


def test_windows_are_summed_side_by_side(spark):
    from datetime import datetime, timedelta
    from math import exp
    from newsloom.streaming import hotness as h
    start = datetime(2024, 1, 1, 22, 30)
    events = [("r", "a", "article_click", start), ("r", "a", "article_click", start + timedelta(hours=3)),
              ("s", "a", "search_click", start + timedelta(hours=30)), ("s", "b", "search_query", start)]
    df = spark.createDataFrame([(*x, None) for x in events],
                               "client_id string, article_id string, event_type string, created_at timestamp, payload string")
    out = h.windowed_hotness(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [window_end" in line for line in plan.splitlines())  # no row a window is shuffled
    want = {}
    for k in range(1, 80):
        end = datetime(2024, 1, 1, 22) + timedelta(hours=k)
        newest = {}
        for c, a, kind, at in events:
            if end - timedelta(hours=24) <= at < end:
                newest[c, a, kind] = max(at, newest.get((c, a, kind), at))
        for (_, a, kind), at in newest.items():
            weight = {"article_click": 1.0, "search_click": 2.0, "search_query": 0.0}[kind]
            want[end, a] = want.get((end, a), 0.0) + weight * exp(-(end - at).total_seconds() / 3600 / 24)
    got = {(r["window_end"], r["article_id"]): r["score"] for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-4 for x in want)
