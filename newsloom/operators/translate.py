"""Translation bookkeeping: what still needs translating, and attaching the
results. The translation service itself is outside; its results are a table
(key, translated)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import fixed_values as fv
from newsloom.functions import expr as e
from newsloom.operators.ranking import keep_first

PAID_CHARS, FREE_CHARS = 2000, 500


def cache_key(text, source_lang: str, target: str) -> Column:
    return e.md5_id(F.concat(e.text_or_empty(text), F.lit(f":{source_lang}:{target}")))


def translation_worklist(texts: DataFrame, target: str, cache: DataFrame | None = None, source_lang: str = "auto",
                         paid: bool = True) -> DataFrame:
    """(key, text, from_lang, to_lang, payload): every distinct text once that
    is not blank, not in the target language and not in the cache. `payload` is
    what the service accepts per call."""
    rows = texts.select("text").filter((F.trim(e.text_or_empty("text")) != "") & e.needs_translation("text", target))
    if source_lang == target:
        rows = rows.filter(F.lit(False))
    keyed = keep_first(rows.withColumn("key", cache_key("text", source_lang, target)), ["key"], [F.asc("key")])
    if cache is not None:
        keyed = keyed.join(cache.select("key"), "key", "left_anti")
    return keyed.select("key", "text", F.lit(source_lang).alias("from_lang"), F.lit(target).alias("to_lang"),
                        e.head("text", PAID_CHARS if paid else FREE_CHARS).alias("payload"))


def apply_translations(df: DataFrame, cache: DataFrame, target: str, columns: list[str], detect_on: str,
                       source_lang: str = "auto") -> DataFrame:
    """Add `<column>_translated` for every column, `source_lang` and
    `was_translated`. A text without a cached result carries a mark and its
    first 200 characters."""
    out = df.withColumn("source_lang", e.detect_language(detect_on))
    foreign = F.col("source_lang") != target
    for c in columns:
        found = cache.select(F.col("key").alias("_k"), F.col("translated").alias("_t"))
        marked = F.concat(F.lit(fv.TRANSLATE_MARK), e.head(c, 200))
        value = F.when(~foreign, F.col(c)).when(F.trim(e.text_or_empty(c)) == "", "").otherwise(F.coalesce("_t", marked))
        out = out.withColumn("_k", cache_key(c, source_lang, target)).join(found, "_k", "left").withColumn(
            f"{c}_translated", value).drop("_k", "_t")
    return out.withColumn("was_translated", foreign)


def supported_languages(spark, languages=fv.SUPPORTED_LANGUAGES) -> DataFrame:
    return spark.createDataFrame(list(languages.items()), "code string, name string")
