"""Column layouts of the stored tables and the defaults for absent columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_LIST = T.ArrayType(_S)


def _struct(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


ARTICLE_SCHEMA = _struct(
    ("id", _L), ("article_id", _S), ("title", _S), ("content", _S), ("summary", _S), ("url", _S),
    ("source", _S), ("category", _S), ("published_at", _S), ("author", _S), ("read_count", _I),
    ("comment_count", _I), ("tags", _LIST), ("hotness_score", _D), ("created_at", _S), ("updated_at", _S),
)
ANALYSIS_SCHEMA = _struct(
    ("article_id", _S), ("model_used", _S), ("sentiment_score", _D), ("sentiment_label", _S),
    ("keywords", _LIST), ("summary", _S), ("analysis_type", _S), ("result", _S), ("created_at", _S),
)
EVENT_SCHEMA = _struct(
    ("event_type", _S), ("article_id", _S), ("client_id", _S), ("payload", _S), ("created_at", T.TimestampType()),
)
MESSAGE_SCHEMA = _struct(("id", _L), ("anonymous_id", _S), ("content", _S), ("created_at", _S))
NODE_SCHEMA = _struct(
    ("name", _S), ("norm", _S), ("type", _S), ("article_id", _S), ("title", _S), ("source", _S),
    ("created_at", _S), ("ref_articles", _LIST), ("ref_count", _I), ("content_hash", _S),
)
EDGE_SCHEMA = _struct(
    ("src", _S), ("dst", _S), ("relation", _S), ("description", _S), ("article_id", _S), ("created_at", _S),
)

LIGHT_COLUMNS = [
    "id", "article_id", "title", "summary", "url", "source", "category", "published_at",
    "author", "read_count", "comment_count", "tags", "created_at", "updated_at",
]
FULL_COLUMNS = LIGHT_COLUMNS + ["content", "hotness_score"]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project `df` on `schema`: cast known columns, default the absent ones
    ('' / 0 / empty list), drop the extra ones."""
    columns = []
    for field in schema.fields:
        if isinstance(field.dataType, T.ArrayType):
            default = F.array().cast(field.dataType)
        elif isinstance(field.dataType, T.StringType):
            default = F.lit("")
        elif isinstance(field.dataType, (T.TimestampType, T.LongType)):
            default = F.lit(None).cast(field.dataType)
        else:
            default = F.lit(0).cast(field.dataType)
        if field.name in df.columns:
            value = F.col(field.name).cast(field.dataType)
            columns.append(F.coalesce(value, default).alias(field.name))
        else:
            columns.append(default.alias(field.name))
    return df.select(*columns)
