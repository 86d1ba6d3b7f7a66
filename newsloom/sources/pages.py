"""Rules for the text of article pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def drop_adjacent_repeats(df: DataFrame, text: str, key: str = "id", out: str = "body") -> DataFrame:
    """Paragraphs of a text without neighbours equal to the one before them,
    joined by blank lines; works in the row."""
    parts = F.filter(F.transform(F.split(text, r"\n+"), lambda p: F.trim(p)), lambda p: p != "")
    kept = F.filter("_p", lambda p, i: (i == 0) | (p != F.element_at("_p", F.when(i == 0, 1).otherwise(i))))
    return df.withColumn("_p", parts).withColumn(out, F.array_join(kept, "\n\n")).drop("_p")
