"""Reader activity: time-decayed score per article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions import expr as e


def event_points(event_type: Column, duration_ms: Column, hours: Column) -> Column:
    decay = F.greatest(F.lit(0.1), F.exp(-F.coalesce(hours, F.lit(24.0)) / 24))
    weight = (
        F.when(event_type == "article_click", 1.0)
        .when(event_type == "article_view", F.least(F.coalesce(duration_ms, F.lit(0.0)) / 10000, F.lit(3.0)))
        .when(event_type == "search_click", 2.0)
        .otherwise(0.0)
    )
    return weight * decay


def hotness(ev: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Score of every article with events in the last `hours`. A reader counts
    once per article and kind of event, with the newest one. Two hash
    aggregates: the first is keyed by reader, so a hot article is already
    spread and reduced when the second one sums it."""
    now_at = e.as_time(now)
    recent = ev.filter(
        (F.col("created_at").isNull() | (F.col("created_at") >= now_at - F.make_interval(hours=F.lit(hours))))
        & (e.text_or_empty("article_id") != ""))
    duration = F.get_json_object("payload", "$.duration_ms").try_cast("double")
    # an event without a readable time only counts if the reader has no other
    order = F.coalesce("created_at", F.timestamp_seconds(F.lit(0)))
    newest = recent.groupBy("client_id", "article_id", "event_type").agg(
        F.max("created_at").alias("at"), F.max_by(duration, order).alias("duration"))
    points = event_points(F.col("event_type"), F.col("duration"), e.hours_between(now_at, F.col("at")))
    return newest.groupBy("article_id").agg(F.round(F.sum(points), 4).alias("score"))


def article_hotness(ev: DataFrame, article_id: str, now: str) -> DataFrame:
    """Score of one article over all given events, every event counted."""
    duration = F.get_json_object("payload", "$.duration_ms").try_cast("double")
    points = event_points(
        F.col("event_type"), duration, e.hours_between(e.as_time(now), F.col("created_at")))
    return ev.filter(F.col("article_id") == article_id).agg(
        F.round(F.coalesce(F.sum(points), F.lit(0.0)), 4).alias("score"))


def apply_hotness(a: DataFrame, scores: DataFrame) -> DataFrame:
    """All scores back to 0, then the new ones."""
    return a.drop("hotness_score").join(
        scores.select("article_id", F.col("score").alias("hotness_score")), "article_id", "left"
    ).withColumn("hotness_score", F.coalesce("hotness_score", F.lit(0.0)))


def purge_events(ev: DataFrame, now: str, days: int = 7) -> DataFrame:
    return ev.filter(F.col("created_at") >= e.as_time(now) - F.make_interval(days=F.lit(days)))
