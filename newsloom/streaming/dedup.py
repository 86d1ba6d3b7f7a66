"""Repeats on a stream of articles.

Near repeats as keyed state. An article is a near repeat when one that arrived up
to `hours` before it, whether itself a repeat or not, has a fingerprint within
`threshold` bits; fingerprint 0 never matches. Arrival order is (time, id).

Each article goes to the candidate keys of its fingerprint: an equal 16-bit segment
with an equal block of the other bits. That is complete for up to three bits, and a
segment that very many articles share is split over its blocks. A key's state holds
the distinct fingerprints with their last arrival, so copies take one entry, and
the articles that wait for the watermark: late events may still come before them,
and a decision is made once, in arrival order. Timers of the event time make the
decisions and let fingerprints go after `hours`; a key without any has no state.
The answers of an article's keys meet in one windowed aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from newsloom.functions import expr as e
from newsloom.operators import dedup
from newsloom.session import cut
from newsloom.sources import store


def stream_unique_urls(articles: DataFrame, at: str = "arrived", hours: int = 24) -> DataFrame:
    """First article of every URL within the last hours; articles without a
    URL are keyed by their id and so all pass."""
    keyed = articles.withColumn("_key", e.first_filled("url", F.col("article_id")))
    return keyed.withWatermark(at, f"{hours} hours").dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def drop_seen(batch: DataFrame, table: str, now, rule: str = "full", hours: int = 24) -> DataFrame:
    """Rows of a micro-batch that are not near duplicates of a fingerprint of
    the last hours. The seen fingerprints live in a stored table, so the state
    of a crowded segment is spread over files instead of one task's memory."""
    spark = batch.sparkSession
    known = store.read_table(spark, table)
    if known is None:
        return batch
    return dedup.drop_stored(batch, dedup.valid_fingerprints(known, now, rule, hours), rule)


def remember(batch: DataFrame, table: str, now, rule: str = "full", hours: int = 24) -> None:
    """Add a batch's fingerprints and let expired ones go."""
    fresh = dedup.store_fingerprints(batch, now, rule)
    known = store.read_table(batch.sparkSession, table)
    kept = fresh if known is None else dedup.valid_fingerprints(known, now, rule, hours).unionByName(fresh)
    store.write_table(kept, table)


# --- near repeats as keyed state ------------------------------------------------

_STATE = "fp array<bigint>, seen array<bigint>, wait_fp array<bigint>, wait_at array<bigint>, wait_id array<string>"
_ANSWER = "article_id string, arrived timestamp, hit boolean"
HOUR = 3_600_000_000  # microseconds


def decide(fps: np.ndarray, seen: np.ndarray, arriving: list[tuple[int, str, int]], threshold: int, reach: int) -> tuple[list[bool], np.ndarray, np.ndarray]:
    """Whether each arriving (at, id, fp), in order, is within `threshold` bits of
    one seen up to `reach` before it; and the fingerprints seen after them."""
    hits = []
    for at, _, fp in arriving:
        if fp == 0:  # no words
            hits.append(False)
            continue
        value = np.int64(fp)
        live = seen >= at - reach
        hits.append(bool((np.bitwise_count((fps[live] ^ value).view(np.uint64)) <= threshold).any()))
        same = np.flatnonzero(fps == value)
        if len(same):
            seen = seen.copy()
            seen[same] = at
        else:
            fps, seen = np.append(fps, value), np.append(seen, np.int64(at))
    return hits, fps, seen


class NearRepeats(StatefulProcessor):
    """State of one candidate key."""

    def __init__(self, threshold: int, hours: int):
        self.threshold, self.reach = threshold, hours * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("near", _STATE)

    def _load(self) -> list[list]:
        return [list(x) for x in self.state.get()] if self.state.exists() else [[], [], [], [], []]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._load()
        for batch in rows:
            held[2] += batch["fp"].tolist()
            held[3] += batch["at"].tolist()
            held[4] += batch["article_id"].tolist()
        self.state.update(tuple(held))
        self._remind(held)
        yield from ()

    def _remind(self, held: list[list]) -> None:
        """A timer for the earliest thing to do; timers fire once the watermark
        passes them, at whole milliseconds."""
        due = [at // 1000 + 1 for at in held[3]] or [(at + self.reach) // 1000 + 1 for at in held[1]]
        if due:
            self.handle.registerTimer(min(due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._load()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ready = [at < now for at in held[3]]
        arriving = sorted((at, one, fp) for fp, at, one, ok in zip(held[2], held[3], held[4], ready) if ok)
        hits, fps, seen = decide(np.array(held[0], dtype=np.int64), np.array(held[1], dtype=np.int64), arriving, self.threshold, self.reach)
        # whatever still arrives does so at the watermark or later
        keep = seen >= now - self.reach
        held = [fps[keep].tolist(), seen[keep].tolist(), *([x for x, ok in zip(c, ready) if not ok] for c in held[2:])]
        if held[0] or held[2]:
            self.state.update(tuple(held))
            self._remind(held)
        else:
            self.state.clear()
        if arriving:
            yield pd.DataFrame({"article_id": [x[1] for x in arriving], "arrived": pd.to_datetime([x[0] for x in arriving], unit="us"), "hit": hits})

    def close(self) -> None:
        pass


def _candidates(articles: DataFrame, rule: str, threshold: int, at: str) -> DataFrame:
    """(article_id, fp, at in microseconds, arrived, k, v): a row for each key."""
    return _prints(articles, rule, at).withColumn("at", F.unix_micros("arrived")).withColumn("key", F.explode(dedup.candidate_keys("fp", threshold))).select(
        "article_id", "fp", "at", "arrived", "key.k", "key.v")


def _prints(articles: DataFrame, rule: str, at: str) -> DataFrame:
    return articles.select("article_id", F.col(at).alias("arrived"), dedup.fingerprint_of(dedup.TEXT_RULES[rule]()).alias("fp"))


def stream_near_repeats(articles: DataFrame, at: str = "arrived", hours: int = 24, late: str = "1 hour", rule: str = "full",
                        threshold: int = dedup.CROSS_THRESHOLD) -> DataFrame:
    """(article_id, arrived, repeat) for every article of a stream, once the
    watermark has passed it. Articles that come more than `late` behind the latest
    are dropped; `near_repeats` gives the same rows for a batch."""
    keyed = _candidates(articles.withWatermark(at, late), rule, threshold, at)
    answers = keyed.groupBy("k", "v").transformWithStateInPandas(
        NearRepeats(threshold, hours), outputStructType=_ANSWER, outputMode="Append", timeMode="EventTime", eventTimeColumnName="arrived")
    return answers.groupBy("arrived", "article_id").agg(F.max("hit").alias("repeat")).select("article_id", "arrived", "repeat")


def near_repeats(articles: DataFrame, at: str = "arrived", hours: int = 24, rule: str = "full",
                 threshold: int = dedup.CROSS_THRESHOLD) -> DataFrame:
    """(article_id, arrived, repeat): the same decisions over a table. Pairs are
    made of distinct fingerprints only; the articles of a pair's two sides are put
    in arrival order, where each looks at the last one of the other side."""
    prints = cut(_prints(articles, rule, at))
    known = prints.filter("fp <> 0").select("fp").distinct()
    pairs = dedup.fingerprint_pairs(known, threshold).select("fp_a", "fp_b")
    both = pairs.union(pairs.select("fp_b", "fp_a")).toDF("mine", "other")
    order = Window.partitionBy("mine", "other").orderBy("arrived", "article_id").rowsBetween(Window.unboundedPreceding, -1)
    sides = both.join(prints.withColumnRenamed("fp", "mine"), "mine").withColumn("is_mine", F.lit(True)).unionByName(
        both.join(prints.withColumnRenamed("fp", "other"), "other").withColumn("is_mine", F.lit(False)).select("mine", "other", "article_id", "arrived", "is_mine"))
    across = sides.withColumn("last", F.max(F.when(~F.col("is_mine"), F.col("arrived"))).over(order)).filter("is_mine")
    copies = Window.partitionBy("fp").orderBy("arrived", "article_id").rowsBetween(Window.unboundedPreceding, -1)
    same = prints.filter("fp <> 0").withColumn("last", F.max("arrived").over(copies))
    found = across.select("article_id", "arrived", "last").unionByName(same.select("article_id", "arrived", "last"))
    near = found.filter(F.col("last") >= F.col("arrived") - F.make_interval(hours=F.lit(hours))).select("article_id", "arrived").distinct()
    return prints.select("article_id", "arrived").join(near.withColumn("hit", F.lit(True)), ["article_id", "arrived"], "left").select(
        "article_id", "arrived", F.coalesce("hit", F.lit(False)).alias("repeat"))
