"""Near duplicates by 64-bit similarity fingerprints.

Two texts are near duplicates when their fingerprints agree on at least one of
four 16-bit segments and differ in at most `threshold` bits. Work is done on
*distinct* fingerprints, so any number of exact copies costs one row; members
are joined back at the end.

Pairs. A fingerprint goes to its four segments, and where a segment's value is the
same the fingerprints meet as arrays: a pair costs an exclusive or and a count of
bits, about a nanosecond, and is not a row. What leaves a task is what is asked for:
numbers of pairs, the matched ones, a tree of each component, or the pairs. A value
that very many share is cut into parts that meet pairwise.

A stream has keys instead (`candidate_keys`). With segment s equal, at most
`threshold` of the other 48 bits differ, so cutting those into threshold + 1 blocks
leaves one block equal. Segment and block together form a key of about 26 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from newsloom.functions import expr as e, text as t
from newsloom.operators.components import connected_components, forest
from newsloom.operators.ranking import keep_first
from newsloom.session import cut

BITS, SEGMENTS, WIDTH = 64, 4, 16
MATCH_THRESHOLD = 4
CROSS_THRESHOLD = 3
CROWD = 1 << 14     # fingerprints of a place that one task gets
PIECE = 1 << 16     # words whose bits are summed at once
MEET = 1 << 20      # pairs that a task looks at at once
LONG = 1 << 9       # a fingerprint that meets so many is compared with them alone


# --- fingerprints ------------------------------------------------------------

def lead_text() -> Column:
    """Title and the first 200 characters of the summary."""
    return F.concat(e.text_or_empty("title"), F.lit(" "), F.substring(e.text_or_empty("summary"), 1, 200))


TEXT_RULES = {"lead": lead_text, "full": t.article_text}


def fingerprint_of(text: Column) -> Column:
    """The fingerprint of a text as a signed long: per bit the majority over the
    md5 of all words; no words give 0. Each row is counted by itself, so a stream
    can carry it and nothing is shuffled."""
    return _majority(t.tokens(text))


@F.arrow_udf(LongType())
def _majority(words: pa.Array) -> pa.Array:
    """Fingerprints of rows of words: bits are looked up by distinct word and summed
    over the rows, some rows at a time; a longer row in pieces."""
    return pa.array(majority_bits(words).view(np.int64))


def majority_bits(words: pa.Array) -> np.ndarray:
    coded = words.flatten().dictionary_encode()
    hashes = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[8:], "big") for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    bits = np.unpackbits(hashes.byteswap().view(np.uint8).reshape(-1, 8), axis=1)
    code = coded.indices.to_numpy(zero_copy_only=False)
    sizes = np.asarray(words.value_lengths().fill_null(0), dtype=np.int64)
    counts = np.zeros((len(sizes), BITS), dtype=np.int64)
    ends = np.cumsum(sizes)
    for at in range(0, len(code), PIECE):
        stop = min(at + PIECE, len(code))
        rows = np.arange(np.searchsorted(ends, at, side="right"), np.searchsorted(ends, stop - 1, side="right") + 1)
        rows = rows[sizes[rows] > 0]
        begin = np.maximum(ends[rows] - sizes[rows], at) - at
        counts[rows] += np.add.reduceat(bits[code[at:stop]], begin, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > sizes[:, None], axis=1).reshape(-1).view(np.uint64).byteswap()


def fingerprint(df: DataFrame, text: Column, *keys: str) -> DataFrame:
    """(key, fp) for every row."""
    return df.select(*(keys or ["id"]), fingerprint_of(text).alias("fp"))


def fingerprints(a: DataFrame, rule: str = "full", *keys: str) -> DataFrame:
    return fingerprint(a, TEXT_RULES[rule](), *keys)


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("bigint")


def segment(fp, i: int) -> Column:
    return F.shiftrightunsigned(e.col(fp), i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))


def distance(a, b) -> Column:
    return F.bit_count(e.col(a).bitwiseXOR(e.col(b)))


# --- candidate keys ----------------------------------------------------------

def _key_bits(threshold: int) -> list[tuple[int, list[int]]]:
    """(key mask, free bits) of every key, in a fixed order."""
    out = []
    for s in range(SEGMENTS):
        inside = list(range(s * WIDTH, (s + 1) * WIDTH))
        rest = [b for b in range(BITS) if b not in inside]
        blocks = threshold + 1
        for i in range(blocks):
            block = rest[len(rest) * i // blocks:len(rest) * (i + 1) // blocks]
            free = [b for b in rest if b not in block]
            out.append((sum(1 << b for b in inside + block), free))
    return out


def candidate_keys(fp, threshold: int) -> Column:
    """Array of the keys (k, v) of a fingerprint."""
    return F.array(*[F.struct(F.lit(k).alias("k"), e.col(fp).bitwiseAND(_long(mask)).alias("v"))
                     for k, (mask, _) in enumerate(_key_bits(threshold))])


# --- pairs -------------------------------------------------------------------

def _placed(fps: DataFrame, *more: str) -> DataFrame:
    """(place, fp, *more): one row per fingerprint and segment; the place is the
    segment's number and value."""
    places = F.array(*[segment("fp", i) + (i << WIDTH) for i in range(SEGMENTS)])
    return fps.select(F.explode(places).alias("place"), "fp", *more)


def _dealt(placed: DataFrame, *more: str, crowd: int | None = None) -> DataFrame:
    """(place, low, high, part, fp, *more): a place that holds more than `crowd`
    fingerprints is cut into parts that meet pairwise, so no task gets a whole
    crowded place. low = high = part where it is one part."""
    crowd = crowd or CROWD
    crowded = placed.groupBy("place").agg(F.count("*").alias("_n")).filter(F.col("_n") > crowd).select(
        "place", F.ceil(F.col("_n") / crowd).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    part = F.pmod(F.xxhash64("fp"), parts).cast("int")
    met = placed.join(crowded, "place", "left").select("place", "fp", *more, part.alias("part"), F.explode(
        F.sequence(F.lit(0), parts - 1)).alias("other"))
    return met.select("place", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "fp", *more)


class _Meeting:
    """The fingerprints of some places, and the near pairs among them."""

    def __init__(self, table: pa.Table, threshold: int):
        one = lambda c: table.column(c).to_numpy()
        place, low, high, part = (one(c).astype(np.int64) for c in ("place", "low", "high", "part"))
        order = np.lexsort((part, high, low, place))
        self.fp = one("fp")[order].view(np.uint64)
        self.order, self.threshold = order, threshold
        self.segment = (place[order] >> WIDTH).astype(np.int64)
        key = np.stack([place, low, high])[:, order]
        fresh = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if len(order) else np.zeros(0, np.int64)
        size = np.diff(np.append(fresh, len(order)))
        first = part[order] == low[order]
        mine = np.add.reduceat(first, fresh) if len(fresh) else size
        # each fingerprint meets those behind it, or all of the other part
        at = np.arange(len(order))
        group = np.repeat(np.arange(len(fresh)), size)
        end = (fresh + size)[group]
        one_part = (low == high)[order]
        border = (fresh + mine)[group]
        self.begin = np.where(one_part, at + 1, np.maximum(border, at + 1))
        self.end = np.where(one_part | first, end, self.begin)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, distance), some at a time. A pair that shares several segments
        comes out of the first."""
        shift = np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(WIDTH)
        for i, j in self._near():
            differing = self.fp[i] ^ self.fp[j]
            equal = ((differing[:, None] >> shift) & np.uint64((1 << WIDTH) - 1)) == 0
            once = equal.argmax(axis=1) == self.segment[i]
            yield i[once], j[once], np.bitwise_count(differing[once]).astype(np.int64)

    def _near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        wide = np.maximum(self.end - self.begin, 0)
        short = np.flatnonzero((wide > 0) & (wide < LONG))
        upto = np.cumsum(wide[short])
        row = 0
        while row < len(short):
            stop = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + MEET, side="right")))
            rows, n = short[row:stop], wide[short[row:stop]]
            i = np.repeat(rows, n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + self.begin[i]
            near = np.bitwise_count(self.fp[i] ^ self.fp[j]) <= self.threshold
            yield i[near], j[near]
            row = stop
        found, n = [], 0  # many to meet: one fingerprint against all of them
        for i in np.flatnonzero(wide >= LONG):
            j = np.flatnonzero(np.bitwise_count(self.fp[self.begin[i]:self.end[i]] ^ self.fp[i]) <= self.threshold) + self.begin[i]
            found.append((np.full(len(j), i), j))
            n += len(j)
            if n >= MEET:
                yield tuple(np.concatenate(x) for x in zip(*found))
                found, n = [], 0
        if n:
            yield tuple(np.concatenate(x) for x in zip(*found))


def _met(fps: DataFrame, threshold: int, make, schema: str, *more: str, crowd: int | None = None) -> DataFrame:
    """`make` of the meetings of each shuffle partition: (columns of `more` in
    order of the meeting, meeting) to lists of columns."""
    names = [x.split()[0] for x in schema.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held)
            meeting = _Meeting(table, threshold)
            for columns in make([table.column(c).to_numpy()[meeting.order] for c in more], meeting):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    dealt = _dealt(_placed(fps, *more), *more, crowd=crowd)
    # few bytes but much work per row: keep all shuffle partitions
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "place", "low", "high").mapInArrow(walk, schema)


def fingerprint_pairs(fps: DataFrame, threshold: int = MATCH_THRESHOLD, crowd: int | None = None) -> DataFrame:
    """(fp_a, fp_b, distance) of distinct fingerprints, each pair once."""

    def make(_, meeting: _Meeting):
        for i, j, distance in meeting.pairs():
            a, b = meeting.fp[i].view(np.int64), meeting.fp[j].view(np.int64)
            yield np.minimum(a, b), np.maximum(a, b), distance.astype(np.int32)

    return _met(fps.select("fp"), threshold, make, "fp_a long, fp_b long, distance int", crowd=crowd)


def pair_counts(sizes: DataFrame, threshold: int = MATCH_THRESHOLD, crowd: int | None = None) -> DataFrame:
    """(distance, article_pairs) of fingerprints with the number n of their
    articles. Pairs are counted where they meet and none leaves its task."""

    def make(columns, meeting: _Meeting):
        n, total = columns[0].astype(np.int64), np.zeros(BITS + 1, dtype=np.int64)
        for i, j, distance in meeting.pairs():
            np.add.at(total, distance, n[i] * n[j])
        found = np.flatnonzero(total)
        yield found.astype(np.int32), total[found]

    across = _met(sizes.select("fp", "n"), threshold, make, "distance int, article_pairs long", "n", crowd=crowd)
    inside = sizes.filter("n > 1").select(F.lit(0).alias("distance"), F.expr("n * (n - 1) div 2").alias("article_pairs"))
    return across.unionByName(inside).groupBy("distance").agg(F.sum("article_pairs").alias("article_pairs"))


def fingerprint_components(fps: DataFrame, threshold: int = MATCH_THRESHOLD, crowd: int | None = None) -> DataFrame:
    """(fp, root) for the distinct fingerprints that have a near duplicate. A task
    joins the pairs it meets and sends a tree of each component, not the pairs."""

    def make(_, meeting: _Meeting):
        fp, at = np.unique(meeting.fp.view(np.int64), return_inverse=True)
        a, b = forest(len(fp), ((at[i], at[j]) for i, j, _ in meeting.pairs()))
        yield fp[a], fp[b]

    links = _met(fps.select("fp"), threshold, make, "src long, dst long", crowd=crowd)
    return connected_components(links).select(F.col("node").alias("fp"), F.col("component").alias("root"))


# --- clusters and stages -----------------------------------------------------

def with_clusters(a: DataFrame, threshold: int = MATCH_THRESHOLD, rule: str = "full",
                  prints: DataFrame | None = None) -> DataFrame:
    """Add `fp` and `root` (the cluster's name) to every row."""
    prints = cut(fingerprints(a, rule)) if prints is None else prints
    roots = fingerprint_components(prints.select("fp").distinct(), threshold)
    named = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return a.join(named, "id")


def near_dup_clusters(a: DataFrame, threshold: int = MATCH_THRESHOLD, rule: str = "full") -> DataFrame:
    """(id, article_id, cluster, representative): a cluster carries its first
    row's id; its longest text, ties to the earliest, represents it."""
    slim = a.select("id", "article_id", "title", "summary", "content")
    members = with_clusters(slim, threshold, rule).select(
        "id", "article_id", "root", F.length(e.text_or_empty("content")).alias("len"))
    members = cut(members)
    first = members.groupBy("root").agg(F.min("id").alias("cluster"))
    best = keep_first(members, ["root"], [F.desc("len"), F.asc("id")]).select(F.col("id").alias("best"))
    return (
        members.join(first, "root")
        .join(best, F.col("id") == F.col("best"), "left")
        .select("id", "article_id", "cluster", F.col("best").isNotNull().alias("representative"))
    )


def deduplicate(a: DataFrame, threshold: int = MATCH_THRESHOLD, rule: str = "full") -> DataFrame:
    """One row per cluster, in the order of the clusters' first rows."""
    kept = near_dup_clusters(a, threshold, rule).filter("representative").select("id", "cluster")
    return a.join(kept, "id").orderBy("cluster").drop("cluster")


def duplicate_groups(a: DataFrame, threshold: int = MATCH_THRESHOLD, rule: str = "full") -> tuple[DataFrame, DataFrame]:
    """All duplicate pairs with their distance, in a form that stays small when
    one text has many copies: `members` (fp, id, article_id) and `pairs`
    (fp_a, fp_b, distance, articles_a, articles_b, article_pairs), where
    fp_a = fp_b stands for all pairs inside a group of equal fingerprints."""
    members = cut(fingerprints(a, rule, "id", "article_id"))
    sizes = members.groupBy("fp").agg(F.count("*").alias("n"))
    pairs = fingerprint_pairs(sizes.select("fp"), threshold)
    n_a, n_b = sizes.select(F.col("fp").alias("fp_a"), F.col("n").alias("articles_a")), sizes.select(
        F.col("fp").alias("fp_b"), F.col("n").alias("articles_b"))
    across = pairs.join(n_a, "fp_a").join(n_b, "fp_b").withColumn(
        "article_pairs", F.col("articles_a") * F.col("articles_b"))
    inside = sizes.filter("n > 1").select(
        F.col("fp").alias("fp_a"), F.col("fp").alias("fp_b"), F.lit(0).alias("distance"),
        F.col("n").alias("articles_a"), F.col("n").alias("articles_b"),
        F.expr("n * (n - 1) div 2").alias("article_pairs"))
    return members, across.select(*inside.columns).union(inside)


def duplicates_of(members: DataFrame, pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """All duplicates of the listed articles: (id, other, distance). Only the
    listed side is expanded."""
    mine = members.join(ids.select("id"), "id").select("id", F.col("fp").alias("fp_a"))
    links = pairs.select("fp_a", "fp_b", "distance").union(
        pairs.filter("fp_a <> fp_b").select(F.col("fp_b"), F.col("fp_a"), "distance"))
    others = members.select(F.col("id").alias("other"), F.col("fp").alias("fp_b"))
    return mine.join(links, "fp_a").join(others, "fp_b").filter("id <> other").select("id", "other", "distance")


def matches_stored(prints: DataFrame, stored: DataFrame, threshold: int = CROSS_THRESHOLD) -> DataFrame:
    """Rows of `prints` (key, fp) with a stored fingerprint within `threshold`
    bits; fingerprint 0 never matches. Complete for thresholds up to 3, where
    four segments must leave one equal."""
    live = lambda df, side: df.filter("fp <> 0").select("fp", F.lit(side).alias("side")).distinct()
    both = live(prints, 1).union(live(stored, 2)).groupBy("fp").agg(F.sum("side").alias("sides"))

    def make(columns, meeting: _Meeting):
        fresh, known = columns[0] & 1 > 0, columns[0] & 2 > 0
        hit = known & fresh
        for i, j, _ in meeting.pairs():
            hit[i[fresh[i] & known[j]]] = True
            hit[j[fresh[j] & known[i]]] = True
        yield (np.unique(meeting.fp[hit].view(np.int64)),)

    hit = _met(both, threshold, make, "fp long", "sides").distinct()
    return prints.join(hit, "fp", "left_semi")


def drop_stored(batch: DataFrame, stored: DataFrame, rule: str = "full", threshold: int = CROSS_THRESHOLD) -> DataFrame:
    seen = matches_stored(fingerprints(batch, rule), stored, threshold).select("id")
    return batch.join(seen, "id", "left_anti")


def store_fingerprints(a: DataFrame, now, rule: str = "full") -> DataFrame:
    """Rows for the fingerprint table; readers keep those of the last 24 h."""
    return fingerprints(a, rule, "article_id").select(
        "article_id", "fp", F.lit(rule).alias("text_rule"), e.as_time(now).alias("computed_at"))


def valid_fingerprints(table: DataFrame, now, rule: str, hours: int = 24, recent: DataFrame | None = None) -> DataFrame:
    """Unexpired fingerprints made with `rule`; `recent` (article_id) limits
    them to the articles to compare with."""
    live = table.filter(
        (F.col("text_rule") == rule) & (F.col("computed_at") >= e.as_time(now) - F.make_interval(hours=F.lit(hours))))
    return live if recent is None else live.join(recent.select("article_id"), "article_id", "left_semi")


def dedup_stages(batch: DataFrame, stored: DataFrame, rule: str = "full",
                 threshold: int = MATCH_THRESHOLD, cross: int = CROSS_THRESHOLD) -> DataFrame:
    """(id, article_id, stage): the step that removes each row, null if it is
    kept. Steps: near duplicate in the batch, repeated URL, and, for rows
    without a URL, near duplicate of a stored fingerprint."""
    prints = cut(fingerprints(batch, rule))
    slim = batch.select("id", "article_id", "url", F.length(e.text_or_empty("content")).alias("len"))
    rows = with_clusters(slim, threshold, rule, prints=prints)
    rows = cut(rows)
    cluster = rows.groupBy("root").agg(F.min("id").alias("cluster"))
    best = keep_first(rows, ["root"], [F.desc("len"), F.asc("id")]).join(cluster, "root")
    unique = keep_first(best, ["url", F.when(e.text_or_empty("url") == "", F.col("id"))], [F.asc("cluster")])
    unique = cut(unique)
    old = matches_stored(unique.filter(e.text_or_empty("url") == "").select("id", "fp"), stored, cross)
    flags = (
        rows.select("id", "article_id")
        .join(best.select("id", F.lit(True).alias("is_best")), "id", "left")
        .join(unique.select("id", F.lit(True).alias("is_unique")), "id", "left")
        .join(old.select("id", F.lit(True).alias("is_old")), "id", "left")
    )
    stage = (
        F.when(F.col("is_best").isNull(), "near").when(F.col("is_unique").isNull(), "url")
        .when(F.col("is_old").isNotNull(), "cross"))
    return flags.select("id", "article_id", stage.alias("stage"))
