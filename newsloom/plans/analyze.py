"""Article analysis: the full record of one text, and the batch that analyses
what has no stored result yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import fixed_values as fv
from newsloom.functions import expr as e, text as t
from newsloom.operators import keywords as kw, sentiment as se, summary
from newsloom.operators.stats import unanalysed

MODEL = "dictionary+finance"


def analyze(df: DataFrame, text, k: int = 10, sentences: int = 3, stop: str = "。",
            stop_words=fv.KEYWORD_STOP_WORDS, sentiment_args: dict | None = None) -> DataFrame:
    """Add `analysis`: word and character counts, sentiment, keywords and
    summary. An empty text has zero counts and no sentiment."""
    body = e.text_or_empty(text)
    words = F.size(F.filter(F.split(body, r"\s+"), lambda w: w != ""))
    scored = se.sentiment(df.withColumn("_body", body), "_body", name="_s", **(sentiment_args or {}))
    record = F.struct(
        words.alias("word_count"), F.length("_body").alias("char_count"),
        F.when(F.col("_body") != "", F.col("_s")).alias("sentiment"),
        kw.keyword_list("_body", k, stop_words).alias("keywords"), summary.summary_lead("_body", sentences, stop).alias("summary"))
    return scored.withColumn("analysis", record).drop("_body", "_s")


def analyze_articles(a: DataFrame, **options) -> DataFrame:
    """Articles with `analysis` and its score, label and summary as columns."""
    out = analyze(a, e.first_filled("content", "summary"), **options)
    return out.withColumns({"sentiment_score": F.col("analysis.sentiment.sentiment_score"),
                            "sentiment_label": F.col("analysis.sentiment.sentiment_label"),
                            "auto_summary": F.col("analysis.summary")})


def batch_analyze(a: DataFrame, an: DataFrame, now, lead: int | None = None, k: int = 8, sentences: int = 3,
                  stop: str = "。", stop_words=fv.KEYWORD_STOP_WORDS, sentiment_args: dict | None = None,
                  model: str = MODEL) -> DataFrame:
    """Analysis rows for the articles that have none. Sentiment reads the title
    and the beginning of the text (`lead` characters, None for all of it);
    keywords and summary read the whole text."""
    todo = unanalysed(a.select("id", "article_id", "title", "content", "summary"), an)
    scored = se.sentiment(todo.withColumn("_text", t.article_text(lead)), "_text", name="s", **(sentiment_args or {}))
    whole = e.first_filled("content", "summary")
    rows = scored.withColumns({"keywords": kw.keyword_list(whole, k, stop_words), "summary": summary.summary_lead(whole, sentences, stop)})
    result = F.to_json(F.struct("s.*", "keywords", "summary"))
    return rows.select(
        "article_id", F.lit(model).alias("model_used"), F.col("s.sentiment_score").alias("sentiment_score"),
        F.col("s.sentiment_label").alias("sentiment_label"), "keywords", "summary",
        F.lit("sentiment").alias("analysis_type"), result.alias("result"), e.iso(e.as_time(now)).alias("created_at"))


def analysis_text(column: str = "analysis") -> Column:
    return F.to_json(column)
