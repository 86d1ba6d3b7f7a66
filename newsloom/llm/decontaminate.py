"""Benchmark decontamination by a broadcast set of test n-grams.

Words are lower-cased letters, digits and non-ASCII characters. A window is
`size` consecutive words of a test item; a shorter item is one window. The
windows, as hashes of word numbers, go to every task. A task numbers the words
of its texts by the test vocabulary, rolls a hash over each stretch of known
words, looks it up and verifies every hit against the window's words.

The set has a bound: test items are taken in blocks of at most `max_windows`
windows (estimated from their bytes, from above). More than one block means
more passes over the documents, each holding one block; a text is cut only when
every block has looked at it, so the result does not depend on the blocks.

Defined results: a null text has no words. An item without words has no window.
Items with one id are one item; an item without an id hits but is not listed.
Repeated rows get equal results. A very long text is looked through by one task.
`docs` may have any other columns; `apply` keeps them. Empty tables: no documents
give no rows, no items give no hits.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import PLAIN, lists, map_rows, plain_words, row_key, starts_of, text_bytes
from newsloom.session import cut

SIZE, MAX_WINDOWS = 10, 2_000_000
MIN_LEFT = 0.5          # less of a document's words than this left: it goes
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOUND = "key long, doc_id long, n_words long, starts array<bigint>, ends array<bigint>, items array<string>"


class Windows:
    """The windows of some test items, by length."""

    def __init__(self, items: list[tuple], size: int = SIZE):
        self.vocabulary: dict[bytes, int] = {}
        self.by_length: dict[int, dict[tuple, set]] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in plain_words(text)]
            n = min(size, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                owners = self.by_length.setdefault(n, {}).setdefault(tuple(ids[i:i + n]), set())
                if item_id is not None:
                    owners.add(str(item_id))
        self.hashes = {n: np.sort(_hash(np.array(list(w), dtype=np.uint64))) for n, w in self.by_length.items()}

    def find(self, words: list[list[bytes]]) -> tuple[list, list]:
        """Per text: merged (start, end) word spans, and the items found."""
        get = self.vocabulary.get
        ids = [np.fromiter((get(w, 0) for w in one), dtype=np.int64, count=len(one)) for one in words]
        sizes = np.array([len(x) + 1 for x in ids], dtype=np.int64)  # a 0 ends each text
        flat = np.zeros(int(sizes.sum()), dtype=np.int64)
        starts = starts_of(sizes)
        for at, x in zip(starts, ids):
            flat[at:at + len(x)] = x
        known = starts_of((flat > 0).astype(np.int64))
        spans: list[list] = [[] for _ in words]
        items: list[set] = [set() for _ in words]
        for n, hashes in self.hashes.items():
            if len(flat) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            value = np.zeros(len(at), dtype=np.uint64)
            for k in range(n):
                value = value * _BASE + flat[at + k].astype(np.uint64)
            near = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            at = at[hashes[near] == value]
            windows = self.by_length[n]
            for i, text in zip(at.tolist(), (np.searchsorted(starts, at, side="right") - 1).tolist()):
                owners = windows.get(tuple(flat[i:i + n].tolist()))
                if owners is not None:
                    first = i - int(starts[text])
                    spans[text].append((first, first + n))
                    items[text] |= owners
        return [merge(s) for s in spans], [sorted(x) for x in items]


def _hash(rows: np.ndarray) -> np.ndarray:
    value = np.zeros(len(rows), dtype=np.uint64)
    for k in range(rows.shape[1]):
        value = value * _BASE + rows[:, k]
    return value


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def block_count(benchmark: DataFrame, text: str = "text", max_windows: int = MAX_WINDOWS) -> int:
    most = benchmark.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0  # a window takes two bytes at least
    return max(1, math.ceil(most / 2 / max_windows))


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = SIZE, max_windows: int = MAX_WINDOWS):
    """The test items in blocks of bounded size, one at a time on the driver."""
    count = block_count(benchmark, text, max_windows)
    for b in range(count):
        mine = benchmark if count == 1 else benchmark.filter(F.pmod(F.xxhash64(item_id, text), F.lit(count)) == b)
        yield Windows([tuple(r) for r in mine.select(item_id, text).collect()], size)


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(key, doc_id, n_words, starts, ends, items) for every row of `docs`: the
    hit words as merged spans, and the items whose windows occur."""
    found = None
    for windows in blocks(benchmark, max_windows=max_windows):
        if found is None:
            rows = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
            found = _scan(rows, windows, False)
        else:  # another block: continue from what the blocks before it found
            found = _scan(cut(found), windows, True)
    return found.drop("text")


def _scan(rows: DataFrame, windows: Windows, more: bool) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(windows)

    def make(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text")
        words = [plain_words(t) for t in texts.to_pylist()]
        spans, items = sent.value.find(words)
        if more:
            old = [batch.column(c).to_pylist() for c in ("starts", "ends", "items")]
            spans = [merge([*s, *zip(a, b)]) for s, a, b in zip(spans, old[0], old[1])]
            items = [sorted({*x, *y}) for x, y in zip(items, old[2])]
        return {"key": batch.column("key"), "doc_id": batch.column("doc_id"), "text": texts,
                "n_words": pa.array([len(w) for w in words], pa.int64()),
                "starts": lists([[a for a, _ in s] for s in spans], pa.int64()),
                "ends": lists([[b for _, b in s] for s in spans], pa.int64()), "items": lists(items, pa.string())}

    return map_rows(rows, make, _FOUND + ", text string")


def cut_spans(text: str, spans: list) -> tuple[str, int, int]:
    """The text without the words of the spans, and its words before and after."""
    raw = text_bytes(text)
    at = [m.span() for m in _WORD.finditer(raw.translate(PLAIN))]
    parts, last = [], 0
    for a, b in spans:
        parts.append(raw[last:at[a][0]])
        last = at[b - 1][1]
    return b"".join([*parts, raw[last:]]).decode("utf-8", "surrogatepass"), len(at), len(at) - sum(b - a for a, b in spans)


def remove_spans(text: str, windows: Windows) -> tuple[str, float]:
    """The text without its hit words, and the share of words left. A cut can
    bring words together that form another window, so it repeats to the end."""
    before, left = None, None
    while True:
        spans = windows.find([plain_words(text)])[0][0]
        if not spans:
            return text, (left / before if before else 1.0)
        text, n, left = cut_spans(text, spans)
        before = n if before is None else before


def apply(docs: DataFrame, benchmark: DataFrame, text: str = "text", length: str = "n_chars", min_left: float = MIN_LEFT, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """`docs` without hit words; documents that lose more than half go."""
    names = docs.columns
    if block_count(benchmark, max_windows=max_windows) == 1:
        sent = docs.sparkSession.sparkContext.broadcast(next(blocks(benchmark, max_windows=max_windows)))

        @F.pandas_udf("text string, left double, hit boolean")
        def cleaned(texts: pd.Series) -> pd.DataFrame:
            out = []
            found = sent.value.find([plain_words(t) for t in texts])[0]
            for t, spans in zip(texts, found):
                out.append((*remove_spans(t, sent.value), True) if spans else (t, 1.0, False))
            return pd.DataFrame(out, columns=["text", "left", "hit"])

        # else the filter below would have it run a second time
        cleaned = cleaned.asNondeterministic()
        rows = docs.select(F.struct("*").alias("_row"), cleaned(F.col(text)).alias("_new"))
    else:
        rows = _rounds(docs, benchmark, text, max_windows)
    return rows.filter(F.col("_new.left") >= min_left).select(*[
        F.col("_new.text").alias(c) if c == text
        else F.when(F.col("_new.hit"), F.length("_new.text")).otherwise(F.col("_row")[c]).cast(docs.schema[c].dataType).alias(c) if c == length
        else F.col("_row")[c].alias(c) for c in names])


def _rounds(docs: DataFrame, benchmark: DataFrame, text: str, max_windows: int) -> DataFrame:
    """(_row, _new) as one block gives them. In a round all blocks find their spans
    in the same text, then it is cut once; texts that were cut have another round."""
    none = F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")
    open_rows = docs.select(F.struct("*").alias("_row"), F.struct(F.col(text).alias("text"), F.lit(1.0).alias("left"), F.lit(False).alias("hit")).alias("_new"),
                            F.lit(0).cast("long").alias("_before"))
    ended = []

    @F.pandas_udf("text string, left double, before long")
    def shorter(texts: pd.Series, spans: pd.Series, before: pd.Series) -> pd.DataFrame:
        out = []
        for t, s, b in zip(texts, spans, before):
            t, n, left = cut_spans(t, [(x["a"], x["b"]) for x in s])
            out.append((t, left / (b or n), b or n))
        return pd.DataFrame(out, columns=["text", "left", "before"])

    shorter = shorter.asNondeterministic()
    while True:
        found = open_rows.withColumn("_spans", none)
        for windows in blocks(benchmark, max_windows=max_windows):
            if windows.by_length:
                found = cut(found.withColumn("_spans", _more_spans(docs, windows)(F.col("_new.text"), F.col("_spans"))))
        ended.append(found.filter(F.size("_spans") == 0).select("_row", "_new"))
        hit = found.filter(F.size("_spans") > 0).select("_row", "_before", shorter(F.col("_new.text"), F.col("_spans"), F.col("_before")).alias("_cut"))
        open_rows = cut(hit.select("_row", F.struct(F.col("_cut.text").alias("text"), F.col("_cut.left").alias("left"), F.lit(True).alias("hit")).alias("_new"),
                                   F.col("_cut.before").alias("_before")))
        if open_rows.isEmpty():
            return functools.reduce(DataFrame.unionByName, ended)


def _more_spans(docs: DataFrame, windows: Windows):
    sent = docs.sparkSession.sparkContext.broadcast(windows)

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def more(texts: pd.Series, spans: pd.Series) -> pd.Series:
        found = sent.value.find([plain_words(t) for t in texts])[0]
        return pd.Series([[{"a": a, "b": b} for a, b in merge([*new, *((x["a"], x["b"]) for x in old)])] for new, old in zip(found, spans)], dtype=object)

    return more
