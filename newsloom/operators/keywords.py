"""Keywords of documents and of the whole corpus, and rising topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import fixed_values as fv
from newsloom.functions import expr as e, text as t
from newsloom.operators.ranking import attach, global_rank


def keyword_tokens(text, stop_words=fv.KEYWORD_STOP_WORDS) -> Column:
    return t.kept_tokens(t.tokens(text), stop_words)


def top_words(text, k: int | None = 10, stop_words=fv.KEYWORD_STOP_WORDS) -> Column:
    """Array of (token, tf): the k most frequent words of a text, ties in reading
    order; None gives all. Everything happens inside the row."""
    vector = t.term_vector(keyword_tokens(text, stop_words))
    ranked = F.sort_array(F.transform(vector, lambda x: F.struct((-x["tf"]).alias("less"), x["pos"].alias("pos"), x["token"].alias("token"))))
    best = ranked if k is None else F.slice(ranked, 1, k)
    return F.transform(best, lambda x: F.struct(x["token"].alias("token"), (-x["less"]).alias("tf")))


def keyword_rows(df: DataFrame, text, k: int | None = 10, key: str = "id", stop_words=fv.KEYWORD_STOP_WORDS) -> DataFrame:
    """(key, token, tf, rank): the k most frequent words of each document,
    ties in reading order."""
    rows = df.select(key, F.posexplode(top_words(text, k, stop_words)).alias("_at", "_t"))
    return rows.select(key, "_t.token", "_t.tf", (F.col("_at") + 1).alias("rank"))


def keywords(df: DataFrame, text, k: int | None = 10, key: str = "id", stop_words=fv.KEYWORD_STOP_WORDS) -> DataFrame:
    """(key, keywords): the same as a list."""
    return df.select(key, keyword_list(text, k, stop_words).alias("keywords"))


def keyword_list(text, k: int | None = 10, stop_words=fv.KEYWORD_STOP_WORDS) -> Column:
    return F.transform(top_words(text, k, stop_words), lambda x: x["token"])


def corpus_terms(terms: DataFrame, key: str = "id", *group: str) -> DataFrame:
    """Sum a term table over documents: n, documents, and where first seen.
    All buffers are primitive, so both steps are hash aggregates."""
    return terms.groupBy(*group, "token").agg(
        F.sum("tf").alias("n"), F.count("*").alias("docs"),
        F.min(key).alias("first_doc"), F.min_by("pos", key).alias("first_pos"))


def corpus_keywords(df: DataFrame, text, k: int = 20, key: str = "id",
                    stop_words=fv.KEYWORD_STOP_WORDS) -> DataFrame:
    terms = t.term_table(df, keyword_tokens(text, stop_words), key)
    return corpus_terms(terms, key).orderBy(F.desc("n"), "first_doc", "first_pos").limit(k).select("token", "n")


def hot_topics(a: DataFrame, k: int = 10, chars: int | None = None, first_words: int | None = None,
               stop_words=fv.TOPIC_STOP_WORDS) -> DataFrame:
    """Words of the newer half of the articles against the older half. All words
    are candidates, or the `first_words` distinct ones met first in each half.

    Only ids and times are ranked; the last article of the newer half is the border,
    and every text tells by itself on which side it is."""
    ranked = global_rank(a.select("id", "published_at"), [F.desc("published_at"), F.asc("id")])
    size = ranked.agg(F.count("*").alias("_n"))
    border = attach(ranked, size).filter((F.col("_n") >= 10) & (F.col("rank") == F.floor(F.col("_n") / 2))).select(
        F.struct("published_at", "id").alias("b")).scalar()
    vector = t.term_vector(t.kept_tokens(t.tokens(t.article_text(chars)), stop_words))
    newer = (F.col("published_at") > F.col("_b.published_at")) | (
        (F.col("published_at") == F.col("_b.published_at")) & (F.col("id") <= F.col("_b.id")))
    terms = a.withColumn("_b", border).filter(F.col("_b").isNotNull()).select(
        F.coalesce(newer, F.lit(False)).alias("newer"), (-F.unix_micros(e.parse_time("published_at"))).alias("age"), "id",
        F.explode(vector).alias("t")).select("newer", "age", "id", "t.*")
    counts = terms.groupBy("newer", "token").agg(F.sum("tf").alias("n"), *(
        [] if first_words is None else [F.min(F.struct("age", "id", "pos")).alias("seen")]))
    if first_words is not None:
        first = [counts.filter(side).orderBy("seen").limit(first_words).select("token") for side in (F.col("newer"), ~F.col("newer"))]
        counts = counts.join(first[0].union(first[1]).distinct(), "token", "left_semi")
    both = counts.groupBy("token").agg(
        F.coalesce(F.sum(F.when(F.col("newer"), F.col("n"))), F.lit(0)).alias("current_count"),
        F.coalesce(F.sum(F.when(~F.col("newer"), F.col("n"))), F.lit(0)).alias("prev_count"))
    cur, prev = F.col("current_count"), F.col("prev_count")
    trend = F.when(cur > prev * 1.5, "rising").when(cur < prev * 0.5, "falling").otherwise("stable")
    return both.filter((cur >= 3) | (prev >= 3)).select(
        F.col("token").alias("keyword"), "current_count", "prev_count", trend.alias("trend")
    ).orderBy((cur - prev).desc(), "keyword").limit(k)
