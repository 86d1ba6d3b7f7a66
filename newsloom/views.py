"""Canonical views: the news tables derived from the given parquet tables.

Each view reads only the columns it needs and is a plain projection, so
filters and column pruning still reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.functions.expr import md5_id

NOW = "2024-01-31 00:00:00"

# A small sentiment list of words that occur in the test prose (term, weight).
LATIN_LEXICON = [
    ("the", 0.2), ("with", 0.5), ("this", 0.4), ("que", 0.3), ("und", 0.4), ("for", 0.3), ("les", 0.2),
    ("of", -0.2), ("was", -0.5), ("that", -0.3), ("des", -0.3), ("der", -0.2), ("from", -0.4), ("den", -0.5),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a small input (one file, one row group) as many partitions as
    there are cores before heavy text work. A large scan already has more
    splits than cores and is left alone, so it is never shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def doc_key(doc_id) -> F.Column:
    return md5_id(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article view for jobs that work through every text."""
    return _articles(spread(table(spark, sf_dir, "documents"), "doc_id"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(table(spark, sf_dir, "documents"))


def _articles(docs: DataFrame) -> DataFrame:
    hours = F.make_dt_interval(F.lit(0), (F.col("doc_id") % 720).cast("int"), F.lit(0), F.lit(0))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return docs.select(
        F.col("doc_id").alias("id"),
        doc_key("doc_id").alias("article_id"),
        F.substring(F.substring_index("text", "\n", 1), 1, 200).alias("title"),
        F.col("text").alias("content"),
        F.substring("text", 1, 300).alias("summary"),
        F.when(F.col("doc_id") % 10 == 0, "")
        .otherwise(F.concat(F.lit("http://example.test/"), F.md5("text"))).alias("url"),
        "source",
        F.col("lang").alias("category"),
        F.array("lang").alias("tags"),
        F.date_format(start + hours, "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"),
        F.lit("").alias("author"),
        F.lit(0).alias("read_count"),
        F.lit(0).alias("comment_count"),
        F.lit(0.0).alias("hotness_score"),
        F.lit("2024-01-31T00:00:00").alias("created_at"),
        F.lit("2024-01-31T00:00:00").alias("updated_at"),
    )


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    label = F.when(toxic, "negative").when(good, "positive").otherwise("neutral")
    return labels.select(
        doc_key("doc_id").alias("article_id"),
        F.lit("labels").alias("model_used"),
        ((F.col("quality") - F.col("toxic")) * 0.5).cast("double").alias("sentiment_score"),
        label.alias("sentiment_label"),
        F.array(label, F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("keywords"),
        F.lit("").alias("summary"),
        F.lit("sentiment").alias("analysis_type"),
        F.lit("").alias("result"),
        F.lit("2024-01-31T00:00:00").alias("created_at"),
    )


EVENT_NAMES = {"click": "article_click", "view": "article_view", "purchase": "search_click", "signup": "search_query"}


def document_count(spark: SparkSession, sf_dir: str) -> Column:
    """Row count as a scalar subquery, read from the parquet footers."""
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n")).scalar()


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for pair in EVENT_NAMES.items() for x in pair]), F.col("event_type")),
        F.col("event_type"),
    )
    millis = F.get_json_object("props", "$.k").cast("int") * 1000
    return events.select(
        "event_id",
        kind.alias("event_type"),
        doc_key(F.col("event_id") % document_count(spark, sf_dir)).alias("article_id"),
        F.col("user_id").cast("string").alias("client_id"),
        F.concat(F.lit('{"duration_ms": '), millis.cast("string"), F.lit("}")).alias("payload"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("client"),
        F.lit("GET").alias("method"),
        F.concat(F.lit("/api/"), F.col("event_type")).alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("value").alias("duration_ms"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("source"),
        (F.col("value") >= 1).alias("ok"),
        F.when(F.col("value") < 0.5, "timeout").when(F.col("value") < 1, "http").alias("error_type"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls: one per conversation turn."""
    return table(spark, sf_dir, "conversations").select(
        F.col("role").alias("operation"),
        F.concat(F.lit("model-"), (F.col("conv_id") % 3).cast("string")).alias("model"),
    )


def guest_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        number.alias("id"),
        F.concat(F.lit("匿名用户 "), F.lpad((F.col("conv_id") % 1000000).cast("string"), 6, "0")).alias("anonymous_id"),
        F.col("text").alias("content"),
        F.date_format(F.timestamp_seconds(number + F.lit(1704067200)), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def entity_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed extraction responses: one line per capitalised word of an
    article, in reading order, as the entity graph's input."""
    names = F.array_distinct(F.regexp_extract_all("content", F.lit("([A-Z][a-z]{3,})"), 1))
    return articles(spark, sf_dir).select(
        "id", "article_id", "title", "source", "published_at",
        F.array_join(names, "\n").alias("entities_text"),
        F.lit("").alias("relations_text"),
    )


# --- the same views as DuckDB SQL --------------------------------------------

SQL_ARTICLES = """
articles as (
  select doc_id id, substr(md5(cast(doc_id as varchar)),1,16) article_id,
    substr(split_part(text, chr(10), 1),1,200) title, text content, substr(text,1,300) summary,
    case when doc_id % 10 = 0 then '' else 'http://example.test/' || md5(text) end url,
    source, lang category, [lang] tags,
    strftime(timestamp '2024-01-01' + to_hours(cast(doc_id % 720 as int)), '%Y-%m-%dT%H:%M:%S') published_at,
    timestamp '2024-01-01' + to_hours(cast(doc_id % 720 as int)) published_ts
  from documents)"""
SQL_ANALYSIS = """
analysis as (
  select substr(md5(cast(doc_id as varchar)),1,16) article_id, (quality - toxic) * 0.5::double sentiment_score,
    case when toxic = 1 then 'negative' when quality = 1 then 'positive' else 'neutral' end sentiment_label,
    'q' || cast(quality as varchar) kw2
  from labels)"""
SQL_EVENTS = """
event_log as (
  select event_id,
    case event_type when 'click' then 'article_click' when 'view' then 'article_view'
      when 'purchase' then 'search_click' when 'signup' then 'search_query' else event_type end event_type,
    substr(md5(cast(event_id % (select count(*) from documents) as varchar)),1,16) article_id,
    cast(user_id as varchar) client_id,
    cast(json_extract_string(props, '$.k') as int) * 1000 duration_ms,
    ts created_at
  from events)"""
SQL_ACCESS = """
access_log as (
  select event_id, cast(user_id as varchar) client, 'GET' "method", '/api/' || event_type path,
    case when event_type = 'error' then 500 else 200 end status, value duration_ms, ts from events)"""
SQL_CRAWL = """
crawl_log as (
  select event_id, event_type source, value >= 1 ok,
    case when value < 0.5 then 'timeout' when value < 1 then 'http' end error_type, ts from events)"""


def with_views(*views: str) -> str:
    return "with recursive " + ",".join(views) + " "
