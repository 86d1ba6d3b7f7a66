"""Projections, filters, orderings and pages over the article table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom import fixed_values as fv, schemas
from newsloom.functions import expr as e
from newsloom.operators.ranking import global_rank, keep_first, page, with_total

def newest() -> list[Column]:
    """Newest first, ties by id."""
    return [F.desc("published_at"), F.asc("id")]


def light(a: DataFrame) -> DataFrame:
    return a.select(*[c for c in schemas.LIGHT_COLUMNS if c in a.columns])


def full(a: DataFrame) -> DataFrame:
    return a.select(*[c for c in schemas.FULL_COLUMNS if c in a.columns])


def split_lists(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: e.split_list(c) for c in columns})


# --- filters -----------------------------------------------------------------

def exclude_sources(a: DataFrame, sources=fv.EXCLUDED_SOURCES) -> DataFrame:
    return a.filter(e.in_list("source", sources, negate=True)) if sources else a


def by_sources(a: DataFrame, sources, limit=20, offset=0) -> DataFrame:
    hits = a.filter(e.in_list("source", sources))
    return with_total(page(light(hits), newest(), limit, offset), hits)


def by_category(a: DataFrame, category: str, exclude=None, limit=20, offset=0) -> DataFrame:
    hits = exclude_sources(a.filter(F.col("category") == category), exclude)
    return with_total(page(light(hits), newest(), limit, offset), hits)


def by_date_range(a: DataFrame, start: str, end: str) -> DataFrame:
    """Published within the two days, both included whole; newest first. ISO
    text orders like time, so the bounds stay comparisons on the stored
    column and reach the scan."""
    day_after = F.date_format(F.date_add(F.to_date(F.lit(end)), 1), "yyyy-MM-dd")
    return light(a.filter((F.col("published_at") >= start) & (F.col("published_at") < day_after))).orderBy(*newest())


def within_range(a: DataFrame, range_name: str, now: str) -> DataFrame:
    """Articles since the first day of a named range."""
    first = F.date_format(e.time_boundary(range_name, now), "yyyy-MM-dd")
    return a.filter(F.col("published_at") >= first)


def search_like(a: DataFrame, keyword: str, sources=None, limit=20, offset=0) -> DataFrame:
    hits = a.filter(e.like_any_field(keyword, "title", "content", "summary"))
    if sources is not None:
        hits = hits.filter(e.in_list("source", sources))
    return with_total(page(light(hits), newest(), limit, offset), hits)


def get_by_id(df: DataFrame, article_id: str) -> DataFrame:
    return df.filter(F.col("article_id") == article_id)


def get_by_ids(a: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `a` for a frame of (pos, article_id), in the given order;
    missing ids drop out."""
    return a.join(ids, "article_id").orderBy("pos")


def ids_frame(spark, ids: list[str]) -> DataFrame:
    listed = F.array(*[F.lit(i) for i in ids]) if ids else F.array().cast("array<string>")
    return spark.range(1).select(F.posexplode(listed).alias("pos", "article_id"))


def recent_ids(a: DataFrame, n: int = 500) -> DataFrame:
    return a.select("id", "article_id").orderBy(F.desc("id")).limit(n)


def _or_head(a: DataFrame, hit: Column, order: list, limit: int) -> DataFrame:
    """The first rows that pass; if none passes, the first rows of all. One
    top-k puts passing rows first; the window then sees at most `limit` rows."""
    chosen = page(a.withColumn("_hit", F.coalesce(hit, F.lit(False))), [F.desc("_hit"), *order], limit)
    any_hit = F.max("_hit").over(Window.partitionBy(F.lit(1)))
    return (
        chosen.withColumn("_any", any_hit)
        .filter(F.col("_hit") | ~F.col("_any"))
        .withColumn("matched", F.col("_hit"))
        .drop("_hit", "_any")
    )


def filter_keyword(a: DataFrame, keyword: str, limit=50, order=None) -> DataFrame:
    return _or_head(a, e.like_any_field(keyword, "title", "content", "summary"), order or newest(), limit)


def _tag_contains(text: str) -> Column:
    return F.coalesce(F.exists("tags", lambda t: F.contains(t, F.lit(text))), F.lit(False))


def filter_category(a: DataFrame, category: str, limit=50, order=None) -> DataFrame:
    hit = (
        F.contains(e.text_or_empty("category"), F.lit(category))
        | _tag_contains(category)
        | F.contains(e.text_or_empty("title"), F.lit(category))
    )
    return _or_head(a, hit, order or newest(), limit)


def filter_stock(a: DataFrame, code: str, limit=30, order=None) -> DataFrame:
    hit = (
        F.contains(e.text_or_empty("title"), F.lit(code))
        | F.contains(e.text_or_empty("content"), F.lit(code))
        | _tag_contains(code)
    )
    return _or_head(a, hit, order or newest(), limit)


def filter_time_range(a: DataFrame, start: str, end: str, limit=50, order=None) -> DataFrame:
    at = e.parse_time("published_at")
    hits = a.filter(at.between(e.as_time(start), e.as_time(end)))
    return page(hits, order or newest(), limit)


def within_days(a: DataFrame, now: str, days: int) -> DataFrame:
    """Published at most `days` before `now`; unreadable dates drop out."""
    return a.filter(e.parse_time("published_at") >= e.as_time(now) - F.make_interval(days=F.lit(days)))


def recent_events(ev: DataFrame, now: str, hours: int = 24) -> DataFrame:
    since = e.as_time(now) - F.make_interval(hours=F.lit(hours))
    return ev.filter(F.col("created_at") >= since).orderBy(F.desc("created_at"))


# --- orderings ---------------------------------------------------------------

def latest(a: DataFrame, now: str, limit=100, offset=0, exclude=None) -> DataFrame:
    rows = exclude_sources(a, exclude)
    scored = rows.select(
        *[c for c in schemas.LIGHT_COLUMNS if c in rows.columns],
        e.latest_score("published_at", "hotness_score", "tags", now).alias("score"),
    )
    return with_total(page(scored, [F.desc("score"), F.asc("id")], limit, offset), rows)


def sort_by_quality(a: DataFrame, limit: int | None = None, trusted=fv.QUALITY_SOURCES) -> DataFrame:
    scored = a.withColumn("quality", e.length_quality("title", "content", "source", trusted))
    return page(scored, [F.desc("quality"), F.asc("id")], limit)


def first_per_url(a: DataFrame, order="id") -> DataFrame:
    """First row of every URL; rows without one are all kept."""
    own = F.when(F.col("url") == "", F.col("id"))
    return keep_first(a, ["url", own], [F.asc(order)])


def keep_min_id(a: DataFrame) -> DataFrame:
    """Smallest id per URL, or per title where the URL is missing."""
    return keep_first(a, [F.coalesce(F.nullif("url", F.lit("")), F.col("title"))], [F.asc("id")])


def message_page(messages: DataFrame, limit=20, offset=0) -> DataFrame:
    return with_total(page(messages, [F.desc("created_at"), F.desc("id")], limit, offset), messages)


def per_group_head(df: DataFrame, keys: list, order: list, k: int) -> DataFrame:
    """At most k rows of each key in the given order (list caps)."""
    return keep_first(df, keys, order, k)


def materialize_pages(a: DataFrame, now: str, media_sources=fv.MEDIA_SOURCES, pages=3, sizes=(12, 24),
                      exclude=None) -> DataFrame:
    """First pages of the latest list (by its score) and of the media list (by
    time) for every page size: (listing, page_size, page, pos, article…, total)."""
    reach = pages * max(sizes)
    parts = []
    listings = {"latest": exclude_sources(a, exclude), "media": a.filter(e.in_list("source", media_sources))}
    scored = e.latest_score("published_at", "hotness_score", "tags", now)
    orders = {"latest": [F.desc("_score"), F.asc("id")], "media": newest()}
    for name, rows in listings.items():
        rows = rows.withColumn("_score", scored)
        top = page(rows.select(*light(rows).columns, "_score"), orders[name], reach)
        # the frame is already cut to a few pages, so this window is bounded
        ranked = top.withColumn("rn", F.row_number().over(Window.orderBy(*orders[name]))).drop("_score")
        parts.append(with_total(ranked, rows).withColumn("listing", F.lit(name)))
    both = parts[0].unionByName(parts[1])
    sized = both.withColumn("page_size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    return (
        sized.withColumn("page", F.floor((F.col("rn") - 1) / F.col("page_size")) + 1)
        .withColumn("pos", (F.col("rn") - 1) % F.col("page_size") + 1)
        .filter(F.col("page") <= pages)
        .drop("rn")
    )


def numbered(a: DataFrame, order: list) -> DataFrame:
    """Every row with its position in a total order, computed in parallel."""
    return global_rank(a, order, "position")
