from pyspark.sql import functions as F

from newsloom.functions import expr as e, text as t

NOW = "2024-01-31 00:00:00"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_dates_in_both_forms_are_equal(spark):
    a = one(spark, e.parse_time(F.lit("2024-01-01T10:00:00")))
    b = one(spark, e.parse_time(F.lit("2024-01-01 10:00:00")))
    assert a == b and a is not None
    assert one(spark, e.parse_time(F.lit("yesterday"))) is None


def test_normalize_pubdate(spark):
    cases = {
        "": "2024-01-31T00:00:00",
        "2024-01-05T08:00:00.123456+08:00": "2024-01-05T08:00:00.12345",
        "1704067200": "2024-01-01T00:00:00",
        "Mon, 01 Jan 2024 10:00:00 +0800": "2024-01-01T10:00:00+08:00",
        "Mon, 01 Jan 2024 10:00:00 GMT": "2024-01-01T10:00:00+00:00",
        "2024/01/05 08:09:10": "2024-01-05T08:09:10",
        "01/05/2024 08:09:10": "2024-01-05T08:09:10",
        "1999-01-05 01:02:03": "1999-01-05T01:02:03",
        "soon": "2024-01-31T00:00:00",
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r["raw"]: r["x"] for r in df.select("raw", e.normalize_pubdate("raw", NOW).alias("x")).collect()}
    assert got == cases


def test_in_list(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert df.filter(e.in_list("s", [])).count() == 0
    assert df.filter(e.in_list("s", ["a"])).count() == 1
    assert df.filter(e.in_list("s", ["a", "b", "c"])).count() == 2
    assert df.filter(e.in_list("s", ["a"], negate=True)).count() == 2


def test_split_list(spark):
    df = spark.createDataFrame([("a,b",), ("",), (None,)], "s string")
    assert [r["x"] for r in df.select(e.split_list("s").alias("x")).collect()] == [["a", "b"], [], []]


def test_classify_takes_the_first_group(spark):
    df = spark.createDataFrame([("央行降息", ""), ("沪指大涨", ""), ("天气", ""), ("fed 会议", "")], "t string, c string")
    assert [r["x"] for r in df.select(e.classify("t", "c").alias("x")).collect()] == ["宏观经济", "股市动态", "综合财经", "外汇交易"]


def test_language(spark):
    df = spark.createDataFrame([("经济增长",), ("plain words",), ("",), ("12 34 !!",)], "s string")
    assert [r["x"] for r in df.select(e.detect_language("s").alias("x")).collect()] == ["zh", "en", "unknown", "unknown"]


def test_valid_text(spark):
    df = spark.createDataFrame([("a" * 30,), ("a" * 29,), ("a" * 20 + "!" * 20,), ("经" * 40,)], "s string")
    assert [r["x"] for r in df.select(e.valid_text("s").alias("x")).collect()] == [True, False, False, True]


def test_absolute_url(spark):
    rows = [("http://h/a/b.html", "c.html", "http://h/a/c.html"), ("http://h/a/b?x=1", "/c", "http://h/c"),
            ("https://h", "c", "https://h/c"), ("https://h/a", "//g/x", "https://g/x"), ("http://h/a", "http://g/", "http://g/")]
    df = spark.createDataFrame(rows, "base string, href string, want string")
    assert df.select(e.absolute_url("base", "href").alias("x"), "want").filter("x <> want").count() == 0


def test_quality_parts(spark):
    df = spark.createDataFrame([("标题", "涨 3.5% 到 120\n" + "很长的一行" * 10, "财联社", "2024-01-30T23:30:00"),
                                ("t", "c", "x", "bad")], "title string, content string, source string, published_at string")
    a, b = [r["q"] for r in df.select(e.quality_parts("title", "content", "source", "published_at", NOW).alias("q")).collect()]
    assert (a["trust"], a["timeliness"], a["structure"], a["length"]) == (25, 15, 1, 5)
    assert a["density"] == 20 and a["total"] == 66 and a["label"] == "medium"
    assert (b["trust"], b["timeliness"], b["label"]) == (10, 5, "low")


def test_tokens_keep_dictionary_terms_whole(spark):
    got = one(spark, t.tokens(F.lit("央行加息，市场不及预期 GDP 3 a ok")))
    assert "央行" in got and "不及预期" in got and "GDP" in got and "ok" in got and "a" not in got
    assert one(spark, t.all_tokens(F.lit("不上涨"))) == ["不", "上涨"]


def test_valid_text_counts_without_an_array_and_derives_the_text_once(spark):
    rows = [("<b>" + "𝟙é中a1" * 8 + "</b>",), ("é?中a1" * 8,), (None,)]
    df = spark.createDataFrame(rows, "s string").select(e.strip_tags("s").alias("c"))
    kept = df.filter(e.valid_text("c"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("<[^>]+>") == 2  # in the filter and in the projection
    assert [r["c"] for r in kept.collect()] == ["𝟙é中a1" * 8]
    assert [r["n"] for r in df.select(e.count_chars("c", r"\p{Nd}").alias("n")).collect()] == [16, 8, 0]
