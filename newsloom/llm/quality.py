"""Quality rules with cross-document line frequency.

Every line is normalised (A-Z lower-cased, white space runs to one space) and
hashed. Per host the distinct documents of a line are counted; copies of one
text on a host are one document, so a group of copies does not make its own
lines look like boilerplate. A line that stands in more than `min_docs`
documents and in more than `max_share` of its host's documents is over the
limit. Its occurrences are removed, and a document of which less than
`min_left` of the words remain is rejected as depleted.

The text is scanned once; what later steps need (counts and line hashes) is
stored, and only that is shuffled.

Defined results: a null text has no words; it fails the base rules. A null host
is a host of its own. Repeated rows get equal results. A 64-bit collision
counts two lines as one. A very long text is measured by one task. `docs` may have
any other columns; `apply` keeps them. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import LOWER, lists, map_rows, row_key, text_bytes
from newsloom.session import cut

MIN_WORDS, MAX_REPEATED = 50, 0.5
MIN_DOCS, MAX_SHARE, MIN_LEFT = 20, 0.1, 0.3

_SPACE = b" \t\n\r\x0b\x0c"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"

SCHEMA = ("key long, doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, "
          "n_dup_lines long, n_repeat_words long, lines array<bigint>, line_words array<int>")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    n = len(seen)
    pairs = ids[:-1] * n + ids[1:]
    if n > 1_000_000:  # the product of three numbers would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    grams = pairs[:-1] * n + ids[2:]
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    equal = ranked[1:] == ranked[:-1]
    if not equal.any():
        return 0
    twice = np.zeros(len(grams), dtype=bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    inside = np.zeros(len(words), dtype=bool)
    for k in range(3):
        inside[k:len(grams) + k] |= twice
    return int(inside.sum())


def line_hash(line: bytes) -> int:
    """Signed 64-bit hash of a normalised line."""
    value = xxhash.xxh64_intdigest(b" ".join(line.translate(LOWER).split()))
    return value - (1 << 64) if value >> 63 else value


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row a document: the base counts, and hash and word count of each line
    that has a word."""

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                "n_repeat_words", "lines", "line_words")}
        for value in batch.column(3).to_pylist():
            raw = text_bytes(value)
            words = raw.split()
            lines = [x for x in raw.split(b"\n") if x.strip()]
            digest = xxhash.xxh64_intdigest(raw)
            out["text_hash"].append(digest - (1 << 64) if digest >> 63 else digest)
            out["n_words"].append(len(words))
            out["word_chars"].append(len(raw.translate(None, _SPACE + _CONTINUATION)))
            out["n_symbols"].append(len(raw) - len(raw.translate(None, _SYMBOLS)))
            out["n_dup_lines"].append(len(lines) - len(set(lines)))
            out["n_repeat_words"].append(repeated_words(words))
            out["lines"].append([line_hash(x) for x in lines])
            out["line_words"].append([len(x.split()) for x in lines])
        return {"key": batch.column(0), "doc_id": batch.column(1), "host": batch.column(2),
                **{k: pa.array(v, pa.int64()) for k, v in out.items() if not k.startswith("line")},
                "lines": lists(out["lines"], pa.int64()), "line_words": lists(out["line_words"], pa.int32())}

    rows = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("")).alias("host"),
                       F.col(text).alias("text"))
    return map_rows(rows, make, SCHEMA)


def lines_over_limit(measured: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line) of the lines that stand in too many distinct documents."""
    texts = _one_of_each_text(measured)
    counts = texts.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(
        F.count("*").alias("n_docs")).filter(F.col("n_docs") > min_docs)
    totals = texts.groupBy("host").agg(F.count("*").alias("host_docs"))
    return counts.join(totals, "host").filter(F.col("n_docs") > max_share * F.col("host_docs")).select("host", "line")


def _one_of_each_text(measured: DataFrame) -> DataFrame:
    return measured.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"), F.first("line_words").alias("line_words"))


def judge(measured: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """`measured` with removed_words, removed_lines (their hashes), base_failed and
    kept. `measured` is read several times: pass a stored table."""
    over = lines_over_limit(measured, min_docs, max_share)
    lines = _one_of_each_text(measured).select(
        "host", "text_hash", F.explode(F.arrays_zip(F.col("lines").alias("line"), F.col("line_words").alias("words"))).alias("x")
    ).select("host", "text_hash", F.col("x.line").alias("line"), F.col("x.words").alias("words"))
    removed = lines.join(over, ["host", "line"]).groupBy("host", "text_hash").agg(
        F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    rows = measured.join(removed, ["host", "text_hash"], "left").withColumn(
        "removed_words", F.coalesce("removed_words", F.lit(0)))
    return rows.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & ~((F.col("removed_words") > 0) & (left < min_left * F.col("n_words"))))


def apply(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", length: str = "n_chars", **limits) -> DataFrame:
    """The kept documents without the lines over the limit, in the columns of
    `docs`; `length` is counted anew where a line went."""
    measured = cut(measure(docs, doc_id, text, host))
    kept = judge(measured, **limits).filter("kept").select("key", "removed_lines").dropDuplicates(["key"])
    joined = docs.select(row_key(doc_id, text).alias("_key"), F.struct("*").alias("_row")).join(
        kept.withColumnRenamed("key", "_key"), "_key")
    names = docs.columns

    @F.pandas_udf("string")
    def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return texts.combine(gone, _without_lines)

    cleaned = F.when(F.col("removed_lines").isNotNull(), without(F.col(f"_row.{text}"), F.col("removed_lines")))
    new = F.coalesce(cleaned, F.col("_text"))
    rows = joined.withColumn("_text", F.col(f"_row.{text}")).withColumn("_text", new)
    return rows.select(*[
        F.col("_text").alias(c) if c == text
        else F.when(F.col("removed_lines").isNotNull(), F.length("_text")).otherwise(F.col("_row")[c]).cast(docs.schema[c].dataType).alias(c) if c == length
        else F.col("_row")[c].alias(c) for c in names])


def _without_lines(text: str | None, gone) -> str | None:
    if text is None or gone is None:
        return text
    drop = set(gone.tolist() if hasattr(gone, "tolist") else gone)
    return b"\n".join(x for x in text_bytes(text).split(b"\n") if not x.strip() or line_hash(x) not in drop).decode("utf-8", "surrogatepass")
