"""Landed feed payloads to articles.

Every source is a function from a frame of landed payloads (payload, pos, and
what the source needs) to article rows. JSON is read with `from_json` and
explicit schemas, feeds in XML with `from_xml`; per-source limits keep the
first entries of each payload in their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsloom import fixed_values as fv
from newsloom.functions import expr as e
from newsloom.operators.ranking import keep_first, page

ARTICLE_COLUMNS = [
    "article_id", "title", "content", "summary", "url", "source", "category", "published_at",
    "author", "read_count", "comment_count", "tags", "created_at",
]


# --- building article rows ---------------------------------------------------

def make_articles(df: DataFrame, title, content, url, source, published_at, now, keep=("pos",),
                  category: Column | None = None, tags: Column | None = None, author: Column | None = None,
                  summary: Column | None = None) -> DataFrame:
    """Article rows from parts; category, tags, author and summary default to
    what the text gives."""
    stamp = e.iso(e.as_time(now))
    raw = df.select(*[c for c in keep if c in df.columns], e.text_or_empty(title).alias("_t"),
                    e.text_or_empty(content).alias("_c"), e.text_or_empty(url).alias("url"),
                    e.col(source).alias("source"), e.first_filled(published_at, stamp).alias("published_at"),
                    *[v.alias(n) for n, v in (("_cat", category), ("_tags", tags), ("_auth", author), ("_sum", summary))
                      if v is not None])
    kind = F.col("_cat") if category is not None else e.classify("_t", "_c")
    named = raw.withColumn("category", kind)
    return named.select(
        *[c for c in keep if c in df.columns],
        e.article_key("url", "_t").alias("article_id"),
        e.head("_t", 200).alias("title"), F.col("_c").alias("content"),
        (F.col("_sum") if summary is not None else F.when(F.col("_c") != "", e.head("_c", 300)).otherwise(
            e.head("_t", 300))).alias("summary"),
        "url", "source", "category", "published_at",
        (F.coalesce("_auth", F.lit("")) if author is not None else F.lit("")).alias("author"),
        F.lit(0).alias("read_count"), F.lit(0).alias("comment_count"),
        (F.col("_tags") if tags is not None else F.array("category")).alias("tags"),
        stamp.alias("created_at"))


def cut_content(articles: DataFrame, chars: int | None) -> DataFrame:
    """Articles with at most `chars` characters of content, for stores that want
    a bound; nothing is cut without one."""
    return articles if chars is None else articles.withColumn("content", e.head("content", chars))


def _items(landed: DataFrame, schema: str, path: str) -> DataFrame:
    """One row per entry of the list at `path` in each payload; `pos` orders
    entries over payloads, `item` holds one entry."""
    doc = F.from_json("payload", schema)
    base = landed.select(F.col("batch") if "batch" in landed.columns else F.lit(0).alias("batch"), doc.alias("doc"))
    return base.select("batch", F.posexplode(F.col(f"doc.{path}")).alias("at", "item")).withColumn(
        "pos", F.struct("batch", "at"))


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    """The first `limit` rows of every landed payload."""
    return df if limit is None else keep_first(df.withColumn("_b", F.col("pos.batch")), ["_b"], [F.asc("pos")], limit).drop("_b")


def _epoch_or_now(value: Column, now) -> Column:
    return F.coalesce(e.iso(F.timestamp_seconds(value.try_cast("bigint"))), e.iso(e.as_time(now)))


# --- JSON sources ------------------------------------------------------------

def jinshi(landed: DataFrame, now, limit: int | None = None) -> DataFrame:
    rows = _items(landed, "data array<struct<id:string,title:string,summary:string,content:string,link:string,time:string>>", "data")
    i = lambda f: F.col(f"item.{f}")
    rows = rows.select("pos", e.strip_tags(e.first_filled(i("title"), i("summary"))).alias("t"),
                       e.strip_tags(e.first_filled(i("content"), i("summary"))).alias("c"),
                       e.first_filled(i("link"), F.concat(F.lit("https://www.jinshi.cn/news/"), e.text_or_empty(i("id")))).alias("u"),
                       e.normalize_pubdate(i("time"), now).alias("p"))
    good = rows.filter((F.col("t") != "") & e.valid_text("c", 30, 0.7))
    return make_articles(_first(good, limit), e.head("t", 200), "c", "u", F.lit("金十数据"), "p", now)


def wallstreetcn(landed: DataFrame, now, limit: int | None = None) -> DataFrame:
    rows = _items(landed, "data struct<items:array<struct<id:string,title:string,content:string,created_at:string>>>", "data.items")
    i = lambda f: F.col(f"item.{f}")
    rows = rows.select("pos", e.first_filled(i("title"), e.head(i("content"), 50)).alias("t"), e.strip_tags(i("content")).alias("c"),
                       F.concat(F.lit("https://wallstreetcn.com/live/"), e.text_or_empty(i("id"))).alias("u"),
                       _epoch_or_now(i("created_at"), now).alias("p"))
    good = rows.filter(F.length("c") >= 20)
    return make_articles(_first(good, limit), e.head("t", 200), "c", "u", F.lit("华尔街见闻"), "p", now)


def ths(landed: DataFrame, now, limit: int | None = None) -> DataFrame:
    rows = _items(landed, "data struct<list:array<struct<pid:string,title:string,content:string,ctime:string>>>", "data.list")
    i = lambda f: F.col(f"item.{f}")
    rows = rows.select("pos", e.text_or_empty(i("title")).alias("t"), e.strip_tags(i("content")).alias("c"),
                       F.concat(F.lit("https://news.10jqka.com.cn/detail/pid/"), e.text_or_empty(i("pid"))).alias("u"),
                       i("ctime").alias("p"))
    good = rows.filter((F.col("t") != "") & (F.length("c") >= 20))
    return make_articles(_first(good, limit), e.head("t", 200), "c", "u", F.lit("同花顺API"), "p", now)


def cls(landed: DataFrame, now, limit: int | None = None) -> DataFrame:
    """Telegraph blocks of an HTML page; where a page has none, the JSON list
    inside one of its scripts."""
    batch = F.col("batch") if "batch" in landed.columns else F.lit(0).alias("batch")
    block = r"(?is)<div[^>]*class=[\"'][^\"']*(?:telegraph-content|item-content|feed-content)[^\"']*[\"'][^>]*>(.*?)</div>"
    blocks = F.regexp_extract_all("payload", F.lit(block), 1)
    script = F.regexp_extract("payload", r"(?is)<script[^>]*>(?=[^<]*telegraph)[^<\[]*(\[.*?\])[^<]*</script>", 1)
    listed = F.coalesce(F.from_json(script, "array<struct<id:string,content:string>>"),
                        F.array().cast("array<struct<id:string,content:string>>"))
    squash = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, e.TAG, ""), r"\s+", " "))
    from_html = F.filter(F.transform(blocks, lambda b: F.struct(
        squash(b).alias("c"), F.coalesce(
            F.nullif(F.regexp_extract(b, r"(?i)<a[^>]*href=[\"']([^\"']+)[\"']", 1), F.lit("")),
            F.lit("https://www.cls.cn/telegraph")).alias("u"))), lambda x: F.length(x["c"]) >= 20)
    from_script = F.filter(F.transform(listed, lambda x: F.struct(
        e.strip_tags(x["content"]).alias("c"),
        F.concat(F.lit("https://www.cls.cn/detail/"), e.text_or_empty(x["id"])).alias("u"))), lambda x: F.length(x["c"]) >= 20)
    html = F.size("h") > 0
    rows = landed.select(batch, from_html.alias("h"), from_script.alias("s")).select(
        "batch", html.alias("from_html"), F.posexplode(F.when(html, F.col("h")).otherwise(F.col("s"))).alias("at", "x")
    ).select(F.struct("batch", "at").alias("pos"), "from_html", "x.c", "x.u")
    distinct = keep_first(rows, [F.col("pos.batch"), F.md5("c"), F.when(~F.col("from_html"), F.col("pos"))], [F.asc("pos")])
    kept = _first(distinct, limit)
    return make_articles(kept, e.head("c", 200), "c", "u", F.lit("财联社"), F.lit(""), now)


def eastmoney_ann(landed: DataFrame, now, limit: int | None = None) -> DataFrame:
    rows = _items(landed, "data struct<list:array<struct<art_code:string,title:string,title_ch:string,display_time:string,codes:array<struct<stock_code:string>>>>>", "data.list")
    i = lambda f: F.col(f"item.{f}")
    codes = F.array_join(F.filter(F.transform(F.coalesce(i("codes"), F.array().cast("array<struct<stock_code:string>>")),
                                              lambda c: c["stock_code"]), lambda c: e.text_or_empty(c) != ""), ",")
    rows = _first(rows, limit).select(
        "pos", e.first_filled(i("title_ch"), i("title")).alias("t"), codes.alias("codes"),
        F.concat(F.lit("https://data.eastmoney.com/noticedetail/"), e.text_or_empty(i("art_code")), F.lit(".html")).alias("u"),
        e.normalize_pubdate(i("display_time"), now).alias("p")).filter("t <> ''")
    tags = F.when(F.col("codes") != "", F.array(F.col("codes"), F.lit("公告"))).otherwise(F.array(F.lit("公告")))
    return make_articles(rows, e.head("t", 200), F.lit(""), "u", F.lit("东方财富公告"), "p", now,
                         category=F.lit("公司财报"), tags=tags)


def kr36(landed: DataFrame, now, limit: int | None = None) -> DataFrame:
    rows = _items(landed, "data struct<items:array<struct<id:string,title:string,description:string,content:string,news_url:string,published_at:string>>>", "data.items")
    i = lambda f: F.col(f"item.{f}")
    rows = rows.select("pos", e.text_or_empty(i("title")).alias("t"),
                       e.strip_tags(e.first_filled(i("description"), i("content"))).alias("c"),
                       e.first_filled(i("news_url"), F.concat(F.lit("https://www.36kr.com/newsflashes/"), e.text_or_empty(i("id")))).alias("u"),
                       e.normalize_pubdate(e.head(i("published_at"), 19), now).alias("p"))
    return make_articles(_first(rows.filter(F.length("c") >= 20), limit), e.head("t", 200), "c", "u", F.lit("36氪"), "p", now)


def xueqiu(landed: DataFrame, now, limit: int | None = None) -> DataFrame:
    """Discussion lists; each entry holds a JSON text of its own. An id seen in
    an earlier category is not taken again."""
    rows = _items(landed, "list array<struct<id:string,data:string>>", "list")
    inner = F.from_json("item.data", "id string, title string, text string, description string, target string, created_at string")
    rows = rows.withColumn("d", inner).filter("d is not null")
    d = lambda f: F.col(f"d.{f}")
    rows = rows.select("pos", e.strip_tags(e.first_filled(d("text"), d("description"))).alias("c"),
                       e.first_filled(d("id"), F.col("item.id")).alias("aid"), e.text_or_empty(d("title")).alias("t"),
                       e.text_or_empty(d("target")).alias("target"), e.head(d("created_at"), 10).alias("at"))
    seen = keep_first(rows.filter(F.length("c") >= 30), ["aid"], [F.asc("pos")])
    kept = page(seen, [F.asc("pos")], limit)
    url = F.when(F.col("target").startswith("http"), F.col("target")).otherwise(
        F.concat(F.lit("https://xueqiu.com/"), F.col("aid"), F.lit("/")))
    return make_articles(kept, e.head(e.first_filled("t", e.head("c", 100)), 200), "c", url, F.lit("雪球"),
                         e.normalize_pubdate("at", now), now)


def sina_roll(landed: DataFrame, bodies: DataFrame, now, limit: int | None = None) -> DataFrame:
    """Roll entries with a title and a link, joined to extracted page bodies
    (url, body); entries without a usable body drop out."""
    rows = _items(landed, "result struct<data:array<struct<title:string,url:string,ctime:string>>>", "result.data")
    rows = rows.select("pos", F.col("item.title").alias("t"), F.col("item.url").alias("u")).filter(
        (e.text_or_empty("t") != "") & (e.text_or_empty("u") != ""))
    return attach_bodies(_first(rows, limit), bodies, F.lit("新浪财经"), now)


def attach_bodies(links: DataFrame, bodies: DataFrame, source, now) -> DataFrame:
    """Articles from links (pos, t, u) and page bodies (url, body)."""
    joined = links.join(bodies.select(F.col("url").alias("u"), "body"), "u").filter(e.valid_text("body", 30, 0.7))
    return make_articles(joined, e.head("t", 200), "body", "u", source, F.lit(""), now)


# --- XML feeds ---------------------------------------------------------------

# RSS keeps its items in the channel, RDF beside it, Atom has entries; prefixes
# are dropped, so `date` is dc:date and `encoded` is content:encoded
_LINK = "array<struct<_VALUE:string,_href:string,_rel:string>>"
_ENTRY = (f"array<struct<title:string,link:{_LINK},description:string,summary:string,encoded:string,content:string,"
          "pubDate:string,published:string,updated:string,date:string,creator:string,author:struct<_VALUE:string,name:string>>>")
FEED_SCHEMA = f"channel struct<item:{_ENTRY}>, item {_ENTRY}, entry {_ENTRY}"


def feed_time(value, now) -> Column:
    """Publish time of a feed entry as ISO text in UTC; a time without a zone is
    UTC already."""
    kept = e.normalize_pubdate(value, now)
    zoned = kept.rlike(r"([+-]\d{2}:?\d{2}|Z)$")
    return F.when(zoned, F.coalesce(e.iso(kept.try_cast("timestamp")), kept)).otherwise(kept)


def rss(landed: DataFrame, source: str, now, bodies: DataFrame | None = None, limit: int | None = None,
        short: int = 500) -> DataFrame:
    """Feed entries. A text under `short` characters with a link is replaced by
    the body of the linked page where one was extracted, else it drops out.
    Under a limit whole entries come first and extracted ones fill up."""
    doc = F.from_xml("payload", FEED_SCHEMA, {"ignoreNamespace": "true"})
    batch = F.col("batch") if "batch" in landed.columns else F.lit(0).alias("batch")
    none = F.array().cast(_ENTRY)
    entries = F.concat(*[F.coalesce(F.col(f"doc.{c}"), none) for c in ("channel.item", "item", "entry")])
    rows = landed.select(batch, doc.alias("doc")).select("batch", F.posexplode(entries).alias("at", "item")).withColumn(
        "pos", F.struct("batch", "at"))
    i = lambda f: F.col(f"item.{f}")
    links = F.filter(F.coalesce(i("link"), F.array().cast(_LINK)), lambda x: e.first_filled(x["_rel"], F.lit("alternate")) == "alternate")
    link = e.first_filled(F.trim(F.get(links, 0)["_VALUE"]), F.get(links, 0)["_href"])
    rows = rows.select("pos", e.text_or_empty(i("title")).alias("t"), link.alias("u"),
                       e.strip_tags(e.first_filled(i("summary"), i("description"), i("encoded"), i("content"))).alias("c"),
                       feed_time(e.first_filled(i("pubDate"), i("published"), i("updated"), i("date")), now).alias("p"),
                       e.first_filled(F.trim(i("author._VALUE")), i("author.name"), i("creator")).alias("author")).filter("t <> '' or c <> ''")
    is_short = (F.col("u") != "") & (F.length("c") < short)
    whole = rows.filter(~is_short & (F.col("c") != "")).withColumn("fetched", F.lit(0))
    kept = whole
    if bodies is not None:
        found = rows.filter(is_short).join(bodies.select(F.col("url").alias("u"), "body"), "u").filter(
            e.valid_text("body", 30, 0.7)).withColumns({"c": F.col("body"), "author": F.lit(""), "fetched": F.lit(1)})
        kept = whole.unionByName(found.select(*whole.columns))
    if limit is not None:
        kept = keep_first(kept.withColumn("_b", F.col("pos.batch")), ["_b"], [F.asc("fetched"), F.asc("pos")], limit)
    return make_articles(kept, e.head(e.first_filled("t", e.head("c", 100)), 200), "c", "u", F.lit(source), "p", now,
                         author=F.col("author"))


# --- tables of stock news ----------------------------------------------------

def stock_rows(df: DataFrame, code: str, now) -> DataFrame:
    """News of one stock from the provider's table."""
    c, t = e.text_or_empty("新闻内容"), e.text_or_empty("新闻标题")
    return make_articles(
        df, e.head(e.first_filled(t, e.head(c, 100)), 200), c, e.text_or_empty("新闻链接"),
        e.first_filled("文章来源", F.lit("东方财富")), e.normalize_pubdate("发布时间", now), now, keep=("pos",),
        category=e.classify(t, c), tags=F.array(F.lit(code), F.lit("个股")),
        summary=e.head(e.first_filled(t, e.head(c, 200)), 300))


def stock_rows_many(df: DataFrame, now, limit: int | None = None, empty: bool = False) -> DataFrame:
    """News of several stocks (column `code`), each URL once; a missing URL is another
    one than an empty one. Rows without title and text go unless `empty`."""
    c, t = e.text_or_empty("新闻内容"), e.text_or_empty("新闻标题")
    # told before the shuffle, which then carries only the columns asked for
    rows = keep_first(df.withColumn("_told", (c != "") | (t != "")), ["新闻链接"], [F.asc("pos")])
    rows = rows if empty else rows.filter("_told")
    rows = rows if limit is None else page(rows, [F.asc("pos")], limit)
    return make_articles(rows, e.head(e.first_filled(t, e.head(c, 100)), 200), c, e.text_or_empty("新闻链接"),
                         e.first_filled("文章来源", F.lit("东方财富")), e.normalize_pubdate("发布时间", now), now,
                         tags=F.array(F.col("code"), F.lit("财经")))


# --- list pages --------------------------------------------------------------

ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def extract_links(pages: DataFrame, rule: str, limit: int | None = 50, min_text: int = 5) -> DataFrame:
    """(page_id, pos, href, text, url): per list page the first `limit`
    distinct links with a text of some length that pass `rule`, a SQL
    predicate over href and text."""
    anchors = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), 1).alias("href"),
                           F.regexp_extract_all("html", F.lit(ANCHOR), 2).alias("text"))
    rows = pages.select("page_id", F.col("url").alias("base"), F.posexplode(anchors).alias("at", "x")).select(
        "page_id", "base", "at", "x.href", F.trim(F.regexp_replace("x.text", e.TAG, "")).alias("text"))
    good = rows.filter((F.length("text") >= min_text) & F.expr(rule))
    once = keep_first(good, ["page_id", "href"], [F.asc("at")])
    rn = F.row_number().over(Window.partitionBy("page_id").orderBy("at"))
    kept = once.withColumn("pos", rn)
    kept = kept if limit is None else kept.filter(F.col("pos") <= limit)
    return kept.select("page_id", "pos", "href", "text", e.absolute_url("base", "href").alias("url"))


def social_text_filter(df: DataFrame, now, limit: int | None = 15) -> DataFrame:
    """Posts (pos, title, content, url): link text over 10 characters, each
    30-character beginning once, a body of some length in Han script."""
    title = F.substring(F.trim(e.text_or_empty("title")), 1, 80)
    rows = df.withColumn("t", title).filter(F.length(F.trim(e.text_or_empty("title"))) > 10)
    rows = keep_first(rows, [e.head("t", 30)], [F.asc("pos")])
    good = rows.filter((F.length("content") >= 100) & (e.count_chars("content", e.HAN) > 50))
    return make_articles(page(good, [F.asc("pos")], limit), "t", "content", "url", F.lit("微信公众号"), F.lit(""), now)


# --- registry and collection -------------------------------------------------

def web_pages(landed: DataFrame, key: str, now, bodies: DataFrame, limit: int | None = None) -> DataFrame:
    """Articles of a source that is read from list pages (payload, url): the
    links its rule takes, joined to the bodies of the pages they lead to."""
    batch = F.col("batch") if "batch" in landed.columns else F.lit(0)
    links = extract_links(landed.select(batch.alias("page_id"), "url", F.col("payload").alias("html")), fv.LINK_RULES[key], None)
    rows = links.select(F.struct(F.col("page_id").alias("batch"), F.col("pos").alias("at")).alias("pos"),
                        F.col("text").alias("t"), F.col("url").alias("u"))
    found = rows.join(bodies.select(F.col("url").alias("u"), "body"), "u").filter(e.valid_text("body", 30, 0.7))
    return make_articles(_first(found, limit), e.head("t", 200), "body", "u", F.lit(fv.WEB_NAMES[key]), F.lit(""), now)


# every source is a function (landed, now, limit, bodies); bodies (url, body) are
# the texts of linked pages, which some sources need
SOURCES: dict[str, Callable[..., DataFrame]] = {
    key: (lambda read: lambda landed, now, limit, bodies: read(landed, now, limit))(read)
    for key, read in {"jinshi": jinshi, "wallstreetcn": wallstreetcn, "ths_api": ths, "cls_api": cls, "eastmoney_api": eastmoney_ann,
                      "36kr": kr36, "xueqiu": xueqiu, "akshare": stock_rows_many, "wechat_sogou": social_text_filter}.items()}
SOURCES |= {key: (lambda name: lambda landed, now, limit, bodies: rss(landed, name, now, bodies, limit))(name)
            for key, name in fv.RSS_NAMES.items()}
SOURCES |= {key: (lambda key: lambda landed, now, limit, bodies: web_pages(landed, key, now, bodies, limit))(key) for key in fv.WEB_NAMES}


def add_source(name: str, read: Callable[..., DataFrame]) -> None:
    """Plug in a source: a function (landed payloads, now) -> article rows."""
    SOURCES[name] = lambda landed, now, limit, bodies: read(landed, now)


def normalize_feed(landed: DataFrame, name: str, now, limit: int | None = None, bodies: DataFrame | None = None) -> DataFrame:
    return SOURCES[name](landed, now, limit, bodies)


def source_dim(spark: SparkSession, sources=fv.SOURCES) -> DataFrame:
    """(key, name, tier) of the known sources, a fixed table of a few rows."""
    return spark.createDataFrame(list(sources), "key string, name string, tier string")


def with_tier(df: DataFrame, dim: DataFrame, key: str = "source_key") -> DataFrame:
    """Add the tier of each source; the dimension has one row per source."""
    return df.join(F.broadcast(dim.select(F.col("key").alias(key), "tier")), key)


def source_cap(tier, limit: int) -> Column:
    return F.when(e.col(tier) == "fast", max(limit // 4, 15)).otherwise(max(limit // 6, 8))


def collect_feeds(landed: DataFrame, limit: int = 50, trusted=fv.QUALITY_SOURCES, order=("source_key", "pos"),
                  keep_without_url: bool = False) -> DataFrame:
    """One collection run over the union of all sources' article rows
    (source_key, tier, pos, …): a cap per source by tier, each URL once, best
    quality first, `limit` rows."""
    widest = max(limit // 4, 15)
    rn = F.row_number().over(Window.partitionBy("source_key").orderBy("pos"))
    # the constant bound lets Spark cut every source before the shuffle
    capped = landed.withColumn("_rn", rn).filter(F.col("_rn") <= widest).filter(
        F.col("_rn") <= source_cap("tier", limit)).drop("_rn")
    if not keep_without_url:
        capped = capped.filter(e.text_or_empty("url") != "")
    own = F.when(e.text_or_empty("url") == "", F.struct(*order))
    once = keep_first(capped, ["url", own], [F.asc(c) for c in order])
    scored = once.withColumn("quality", e.length_quality("title", "content", "source", trusted))
    return page(scored, [F.desc("quality"), *[F.asc(c) for c in order]], limit)
