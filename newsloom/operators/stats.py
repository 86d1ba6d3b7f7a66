"""Dashboard and table statistics. All are two-step hash aggregates, so a hot
category, source or day is reduced before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.functions import expr as e
from newsloom.operators.ranking import attach

def _labels(label="sentiment_label"):
    return [F.count_if(F.col(label) == name).alias(name) for name in ("positive", "negative", "neutral")]


def with_analysis(a: DataFrame, an: DataFrame) -> DataFrame:
    """Articles with their stored analysis; a missing one counts as neutral."""
    scores = an.select("article_id", "sentiment_score", "sentiment_label", "keywords")
    return a.join(scores, "article_id", "left").withColumns({
        "sentiment_score": F.coalesce("sentiment_score", F.lit(0.0)),
        "sentiment_label": F.coalesce("sentiment_label", F.lit("neutral")),
        "keywords": F.coalesce("keywords", F.array().cast("array<string>")),
    })


def unanalysed(a: DataFrame, an: DataFrame) -> DataFrame:
    return a.join(an.select("article_id"), "article_id", "left_anti")


def category_stats(joined: DataFrame) -> DataFrame:
    return joined.groupBy(e.first_filled("category", F.lit("未分类")).alias("category")).agg(
        F.count("*").alias("n"), F.round(F.avg("sentiment_score"), 4).alias("avg_sentiment")
    ).orderBy(F.desc("n"), "category")


def category_counts(a: DataFrame) -> DataFrame:
    return a.filter(e.text_or_empty("category") != "").groupBy("category").agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def top_keywords(joined: DataFrame, k: int = 15) -> DataFrame:
    return joined.select(F.explode("keywords").alias("keyword")).groupBy("keyword").agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(k)


def daily_trend(joined: DataFrame) -> DataFrame:
    return joined.withColumn("day", F.substring("published_at", 1, 10)).filter("day <> ''").groupBy("day").agg(
        F.count("*").alias("n"), F.round(F.avg("sentiment_score"), 4).alias("avg_sentiment"), *_labels()
    ).orderBy("day")


def overall_sentiment(joined: DataFrame) -> DataFrame:
    row = joined.agg(
        F.count("*").alias("total"),
        F.coalesce(F.round(F.avg("sentiment_score"), 4), F.lit(0.0)).alias("score"), *_labels())
    return row.withColumn("label", e.sentiment_label(F.col("score"), 0.15)).withColumn(
        "confidence", F.round(F.abs("score"), 4))


def sentiment_aggregate(an: DataFrame, a: DataFrame) -> DataFrame:
    """Home page numbers: analysed articles by label, and all articles."""
    scores = an.agg(
        F.count("*").alias("analysed"),
        F.coalesce(F.round(F.avg("sentiment_score"), 4), F.lit(0.0)).alias("avg_score"), *_labels())
    return attach(scores, a.agg(F.count("*").alias("total_news")))


def sentiment_summary(scored: DataFrame) -> DataFrame:
    """Totals of a frame of (sentiment_score, sentiment_label)."""
    row = scored.agg(
        F.count("*").alias("total"), *_labels(),
        F.coalesce(F.round(F.avg("sentiment_score"), 4), F.lit(0.0)).alias("average"))
    return row.withColumn("distribution", F.create_map(
        F.lit("positive"), F.col("positive"), F.lit("negative"), F.col("negative"),
        F.lit("neutral"), F.col("neutral")))


def sentiment_breakdown(scored: DataFrame, companies: str | None = None, most: int | None = None) -> DataFrame:
    """Score by source and by category in one pass, and by company when the
    frame carries the array column `companies` (its first `most` if given)."""
    base = scored.select(
        e.first_filled("source", F.lit("未知")).alias("source"),
        e.first_filled("category", F.lit("未分类")).alias("category"),
        "sentiment_score", "sentiment_label")
    grouped = base.groupingSets([["source"], ["category"]], "source", "category").agg(
        F.grouping("source").alias("g"), F.round(F.avg("sentiment_score"), 4).alias("avg_score"),
        *_labels(), F.count("*").alias("n"))
    out = grouped.select(
        F.when(F.col("g") == 0, "source").otherwise("category").alias("dimension"),
        F.when(F.col("g") == 0, F.col("source")).otherwise(F.col("category")).alias("key"),
        "avg_score", "positive", "negative", "neutral", "n")
    if companies:
        by_company = scored.select(
            F.explode(companies if most is None else F.slice(companies, 1, most)).alias("key"), "sentiment_score"
        ).groupBy("key").agg(F.round(F.avg("sentiment_score"), 4).alias("avg_score"), F.count("*").alias("n"))
        nothing = F.lit(None).cast("bigint")
        out = out.unionByName(by_company.select(
            F.lit("entity").alias("dimension"), "key", "avg_score", nothing.alias("positive"),
            nothing.alias("negative"), nothing.alias("neutral"), "n"))
    return out.orderBy("dimension", F.desc("n"), "key")


def freshness(a: DataFrame) -> DataFrame:
    return a.agg(F.count("*").alias("total"), F.coalesce(F.max("published_at"), F.lit("")).alias("latest_at"))


def store_status(a: DataFrame, an: DataFrame) -> DataFrame:
    return attach(a.agg(
        F.count("*").alias("articles"), F.max("created_at").alias("last_created"),
        F.max("published_at").alias("last_published")), an.agg(F.count("*").alias("analysed")))


def duplicate_urls(a: DataFrame, k: int | None = 10) -> DataFrame:
    groups = a.filter(e.text_or_empty("url") != "").groupBy("url").agg(
        F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "url")
    return groups if k is None else groups.limit(k)


def crawl_counts(batch: DataFrame) -> DataFrame:
    return batch.groupBy("source").agg(F.count("*").alias("n"))


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def dedup_stats(stages: DataFrame) -> DataFrame:
    """From a frame with one row per article and the column `stage` (the step
    that removed it, null if kept): removed per step and the ratio removed."""
    return stages.agg(
        F.count("*").alias("total"), F.count_if(F.col("stage").isNull()).alias("kept"),
        *[F.count_if(F.col("stage") == s).alias(f"removed_{s}") for s in ("near", "url", "cross")]
    ).withColumn("ratio", F.when(F.col("total") == 0, 0.0).otherwise(
        F.round(1 - F.col("kept") / F.col("total"), 4)))


def economic_trend(scored: DataFrame, keywords: str = "keywords", k: int = 10) -> DataFrame:
    """Mean score and label of all articles, and the words that lead most
    articles' own keyword lists (an array column, five per article)."""
    head = scored.agg(
        F.count("*").alias("total"),
        F.coalesce(F.round(F.avg("sentiment_score"), 4), F.lit(0.0)).alias("average"),
        F.count_if(F.col("sentiment_label") == "positive").alias("positive"),
        F.count_if(F.col("sentiment_label") == "negative").alias("negative"))
    words = scored.select(F.col("id"), F.posexplode(F.slice(keywords, 1, 5)).alias("pos", "word")).groupBy("word").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("seen")
    ).orderBy(F.desc("n"), "seen").limit(k)
    top = words.agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "seen", "word"))),
        lambda x: x["word"]).alias("dominant_keywords"))
    return attach(head, top).withColumn("trend", e.sentiment_label(F.col("average"), 0.15))
