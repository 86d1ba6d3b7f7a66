"""Validation of posted events and messages; the same code runs on a batch or
a streaming frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom import fixed_values as fv
from newsloom.functions import expr as e


def check_events(raw: DataFrame, types=fv.EVENT_TYPES) -> DataFrame:
    """Add `reject`: the first broken rule, or null for an accepted event."""
    kind, payload = e.text_or_empty("event_type"), F.col("payload")
    # a JSON number, string, list, object or literal; anything else has no type
    is_json = F.try_parse_json(payload).isNotNull()
    reason = (
        F.when(~F.length(kind).between(1, 50), "type_length")
        .when(~kind.isin(types), "type")
        .when(F.length(e.text_or_empty("article_id")) > 64, "article_id")
        .when(F.length(e.text_or_empty("client_id")) > 64, "client_id")
        .when(F.length(e.text_or_empty("payload")) > 2000, "payload_length")
        .when(payload.isNotNull() & (payload != "") & ~is_json, "payload")
    )
    return raw.withColumn("reject", reason)


def ingest_events(raw: DataFrame, now=None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). Events without a time get `now`."""
    checked = check_events(raw)
    stamp = F.current_timestamp() if now is None else e.as_time(now)
    if "created_at" in raw.columns:
        stamp = F.coalesce("created_at", stamp)
    accepted = checked.filter(F.col("reject").isNull()).drop("reject").withColumn("created_at", stamp)
    return accepted, checked.filter(F.col("reject").isNotNull())


def reject_counts(raw: DataFrame) -> DataFrame:
    return check_events(raw).groupBy(F.coalesce("reject", F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"))


def clean_messages(raw: DataFrame) -> DataFrame:
    """Messages with a guest id, stripped of tags and of runs of blanks, of
    1 to 2000 characters."""
    body = F.trim(F.regexp_replace(e.strip_tags("content"), r"\s+", " "))
    return raw.filter(F.col("anonymous_id").rlike(r"^匿名用户 [0-9]{6}$")).withColumn("content", body).filter(
        F.length("content").between(1, 2000))
