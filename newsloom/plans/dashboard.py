"""The dashboard: one joined frame feeding every panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.functions import expr as e
from newsloom.operators import listing, stats


def dashboard(a: DataFrame, an: DataFrame, now: str, range_name: str = "week",
              exclude=None) -> dict[str, DataFrame]:
    """Panels as separate frames, for a caller that caches the joined frame."""
    rows = listing.exclude_sources(listing.within_range(a, range_name, now), exclude)
    slim = rows.select("id", "article_id", "source", "category", "published_at")
    joined = stats.with_analysis(slim, an)
    return {
        "joined": joined,
        "category": stats.category_stats(joined),
        "keyword": stats.top_keywords(joined),
        "day": stats.daily_trend(joined),
        "overall": stats.overall_sentiment(joined),
    }


def dashboard_rows(a: DataFrame, an: DataFrame, now: str, range_name: str = "week",
                   exclude=None) -> DataFrame:
    """All panels as one frame (section, key, n, avg_sentiment, label counts).

    The join runs once: category, day and overall are grouping sets of one
    aggregate, and the keyword panel reads the analysis table only.
    """
    rows = listing.exclude_sources(listing.within_range(a, range_name, now), exclude)
    slim = rows.select("article_id", "category", "published_at")
    joined = stats.with_analysis(slim, an).select(
        e.first_filled("category", F.lit("未分类")).alias("category"),
        F.substring("published_at", 1, 10).alias("day"), "sentiment_score", "sentiment_label")
    g_cat, g_day = F.grouping("category"), F.grouping("day")
    sets = joined.groupingSets([["category"], ["day"], []], "category", "day").agg(
        g_cat.alias("gc"), g_day.alias("gd"), F.count(F.lit(1)).alias("n"),
        F.round(F.avg("sentiment_score"), 4).alias("avg_sentiment"),
        *[F.count_if(F.col("sentiment_label") == x).alias(x) for x in ("positive", "negative", "neutral")])
    # an empty range still has an overall row; this second step sees one row per
    # category and day
    seed = a.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("day"),
        F.lit(1).cast("byte").alias("gc"), F.lit(1).cast("byte").alias("gd"), F.lit(0).cast("bigint").alias("n"),
        F.lit(None).cast("double").alias("avg_sentiment"),
        *[F.lit(0).cast("bigint").alias(x) for x in ("positive", "negative", "neutral")])
    sets = sets.unionByName(seed).groupBy("gc", "gd", "category", "day").agg(
        *[F.max(x).alias(x) for x in ("n", "positive", "negative", "neutral")],
        F.coalesce(F.max("avg_sentiment"), F.lit(0.0)).alias("avg_sentiment"))
    section = F.when(F.col("gc") == 0, "category").when(F.col("gd") == 0, "day").otherwise("overall")
    key = (
        F.when(F.col("gc") == 0, F.col("category")).when(F.col("gd") == 0, F.col("day"))
        .otherwise(e.sentiment_label(F.col("avg_sentiment"), 0.15)))
    detailed = F.col("section") != "category"
    panels = sets.select(section.alias("section"), key.alias("key"), "n", "avg_sentiment", *[
        F.col(x) for x in ("positive", "negative", "neutral")]).filter("key <> ''")
    panels = panels.withColumns({x: F.when(detailed, F.col(x)) for x in ("positive", "negative", "neutral")})
    words = stats.top_keywords(an.join(rows.select("article_id"), "article_id", "left_semi"))
    none = F.lit(None).cast("bigint")
    return panels.unionByName(words.select(
        F.lit("keyword").alias("section"), F.col("keyword").alias("key"), "n",
        F.lit(None).cast("double").alias("avg_sentiment"),
        none.alias("positive"), none.alias("negative"), none.alias("neutral")))
