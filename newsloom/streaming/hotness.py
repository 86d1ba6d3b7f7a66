"""Reader activity on a stream: the last 24 hours, re-evaluated every hour.

Events are first reduced to panes: of each (hour, reader, article, kind) the
newest event. A window is 24 panes, and its newest event of a reader, article
and kind is that of the last pane that has one. So in a batch a pane stands for
the windows from its own end up to the next pane of the same reader, article and
kind, 24 at most: the panes are spread over windows after each has been decided,
and no event is ever compared once a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.functions import expr as e
from newsloom.operators.hotness import event_points

READER = ["client_id", "article_id", "event_type"]
SPAN = 24           # windows that are summed side by side


def panes(ev: DataFrame, slide: int = 1, late: str = "1 hour") -> DataFrame:
    """(pane, client_id, article_id, event_type, at, duration): the newest event
    of every pane. One aggregate that is combined before its shuffle."""
    known = ev.filter(e.text_or_empty("article_id") != "")
    if ev.isStreaming:
        known = known.withWatermark("created_at", late)
    duration = F.get_json_object("payload", "$.duration_ms").try_cast("double")
    return known.groupBy(F.window("created_at", f"{slide} hour").alias("pane"), *READER).agg(
        F.max("created_at").alias("at"), F.max_by(duration, "created_at").alias("duration"))


def _points(end: Column) -> Column:
    return event_points(F.col("event_type"), F.col("duration"), e.hours_between(end, F.col("at")))


def windowed_hotness(ev: DataFrame, hours: int = 24, slide: int = 1, late: str = "1 hour") -> DataFrame:
    """(window_end, article_id, score) for events (created_at, client_id,
    article_id, event_type, payload). A reader counts once per window, article
    and kind of event, with the newest one; decay runs to the window's end. A
    stream in append mode gives the same rows as a batch, window by window."""
    rows = panes(ev, slide, late)
    if ev.isStreaming:
        newest = rows.groupBy(F.window(F.window_time("pane"), f"{hours} hours", f"{slide} hour").alias("window"), *READER).agg(
            F.max("at").alias("at"), F.max_by("duration", "at").alias("duration"))
        scored = newest.groupBy("window", "article_id").agg(F.round(F.sum(_points(F.col("window.end"))), 4).alias("score"))
        return scored.select(F.col("window.end").alias("window_end"), "article_id", "score")
    return _spread(rows, hours, slide)


def _spread(rows: DataFrame, hours: int, slide: int) -> DataFrame:
    """Scores from panes. Neighbouring windows of an article are the columns of one
    row, SPAN of them: what is shuffled are rows an article and span, with a sum a
    window, and not a row for each window of each event."""
    step, span = slide * 3600, slide * 3600 * SPAN
    first = F.unix_seconds("pane.end")
    following = F.lead(first).over(Window.partitionBy(*READER).orderBy("pane.end"))
    last = F.least(first + (hours * 3600 - step), F.coalesce(following - step, F.lit(2 ** 62)))
    at = F.floor(F.col("first") / span), F.floor(F.col("last") / span)
    placed = rows.select("article_id", "event_type", "duration", "at", first.alias("first"), last.alias("last")).select(
        "*", F.explode(F.sequence(*at)).alias("span"))

    def score(k: int) -> Column:
        end = F.col("span") * span + k * step
        return F.sum(F.when(end.between(F.col("first"), F.col("last")), _points(F.timestamp_seconds(end))))

    sums = placed.groupBy("article_id", "span").agg(*[score(k).alias(f"_s{k}") for k in range(SPAN)])
    windows = F.array(*[F.struct((F.col("span") * span + k * step).alias("end"), F.col(f"_s{k}").alias("score")) for k in range(SPAN)])
    return sums.select("article_id", F.explode(windows).alias("w")).filter("w.score is not null").select(
        F.timestamp_seconds("w.end").alias("window_end"), "article_id", F.round("w.score", 4).alias("score"))
