"""Line dedup by a segment-partition edit join.

A line is normalised (A-Z lower-cased, white space runs to one space). Equal
lines are one line before anything else, whatever their length. Two lines of
LINK_BYTES or more are linked when their edit distance in bytes is at most `tau`.

Join. A line of n bytes is cut into tau + 1 segments of even length. A partner
within tau edits holds one of them unchanged, so each line probes the index with
its substrings: for every partner length n, n - 1, ... n - tau and every
segment, those start positions that the edits allow (by the length difference
and by the edits that must lie on either side). Lines stay packed in blocks; only
the hashes of their keys are counted (`dealing`), and keys held by an index entry
and a probe of different lines go on. Pairs inside a key are verified by banded
bit-parallel edit distance, many pairs at a time, and only links leave the task.
Keys with many lines are cut into blocks of lines that meet pairwise in tasks of
their own.

Result. Linked lines form classes. Of a class the first line stays, by document
id, then line number; all its other lines are removed.

Defined results: a null text has no lines. Rows with a null id come after all
others. Rows that agree in id and text are one document. Lines without a word
take no part and stay. A given `min_bytes` is a floor for all of it: shorter
lines take no part, all others are also linked. Lines are named by 64-bit hashes.
A very long text is held by one task while it is split; a very long line is a line
like any other. `docs` may have any other columns; `apply` keeps them, also those
named like columns used here. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import LOWER, lists, map_rows, row_key, starts_of, text_bytes
from newsloom.llm.dealing import answer, parts_for, reached, store_blocks
from newsloom.llm.lm import _unzip, _unzip_sorted, _zip, _zip_sorted
from newsloom.operators.components import connected_components
from newsloom.session import cut

TAU, MIN_BYTES, LINK_BYTES = 2, 1, 40
CROWD = 2048            # lines of a key that one task compares with each other
PAIRS = 1 << 16         # pairs that are verified at once
BLOCK_LINES, BLOCK_BYTES = 1 << 16, 1 << 26  # of a block of packed lines
ENTRY = 1 << 20         # weight of an index entry; a probe weighs 1
_SHORT = np.uint64(0xFFFFFFFFFFFF0000)


def normalised(line: bytes) -> bytes:
    return b" ".join(line.translate(LOWER).split())


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def line_id(line: bytes) -> int:
    return _signed(xxhash.xxh64_intdigest(line))


# --- segments and probes -----------------------------------------------------------

def segments(n: int, tau: int) -> list[tuple[int, int]]:
    """(start, length) of the tau + 1 segments of a line of n bytes; the last ones
    are a byte longer where n does not divide."""
    short, longer = divmod(n, tau + 1)
    out, at = [], 0
    for i in range(tau + 1):
        size = short + (i >= tau + 1 - longer)
        out.append((at, size))
        at += size
    return out


def probes(n: int, tau: int) -> list[tuple[int, int, int, int]]:
    """(partner length, segment, start, length) of the substrings of a line of n
    bytes that a partner of at most its length may hold as a segment."""
    out = []
    for m in range(max(tau + 1, n - tau), n + 1):
        delta = n - m
        for i, (at, size) in enumerate(segments(m, tau)):
            # i edits at most lie left of segment i and tau - i right of it, for
            # else an earlier or a later segment would be unchanged
            low = max(0, at - i, at + delta - (tau - i))
            high = min(n - size, at + i, at + delta + (tau - i))
            out += [(m, i, p, size) for p in range(low, high + 1)]
    return out


def _key(m: int, i: int, part: bytes) -> int:
    return xxhash.xxh64_intdigest(part, seed=(m << 8 | i) & 0xFFFFFFFFFFFFFFFF)


_plans: dict = {}


def line_keys(line: bytes, tau: int) -> tuple[list[int], list[int]]:
    """Keys of the index entries and of the probes of a line."""
    n = len(line)
    plan = _plans.get((n, tau))
    if plan is None:
        plan = _plans[(n, tau)] = ([(n, i, p, s) for i, (p, s) in enumerate(segments(n, tau))], probes(n, tau))
        if len(_plans) > 100_000:
            _plans.clear()
    digest = xxhash.xxh64_intdigest
    return ([digest(line[p:p + s], m << 8 | i) for m, i, p, s in plan[0]], [digest(line[p:p + s], m << 8 | i) for m, i, p, s in plan[1]])


# --- verification -----------------------------------------------------------------

def within(a: list[bytes], b: list[bytes], tau: int) -> np.ndarray:
    """Which pairs have an edit distance of at most tau, for len(a[k]) <= len(b[k]).

    A column of the distance matrix is held as the vertical differences of the
    2 tau + 1 cells around the diagonal, one bit each, for all pairs at once. The
    score is that of the band's lowest cell while it goes down the diagonal, then
    that of the last row. On the way it exceeds the end's distance by 2 tau at
    most, so pairs above 3 tau are dropped."""
    n = len(a)
    la, lb = np.fromiter(map(len, a), np.int64, n), np.fromiter(map(len, b), np.int64, n)
    live = np.flatnonzero(lb - la <= tau)
    score = np.full(n, tau + 1, dtype=np.int64)
    score[live] = tau
    start_a, start_b = np.cumsum(la) - la, np.cumsum(lb) - lb
    flat_a = np.frombuffer(b"".join(a) + b"\0", dtype=np.uint8)
    flat_b = np.frombuffer(b"".join(b), dtype=np.uint8)
    width = 2 * tau + 1
    full, top = np.uint32((1 << width) - 1), np.uint32(1 << (width - 1))
    # before the first column the cells below the corner count up
    up = np.full(n, (((1 << (tau + 1)) - 1) << tau) & int(full), dtype=np.uint32)
    down = np.zeros(n, dtype=np.uint32)
    j = 0
    while True:
        live = live[lb[live] > j]
        if not len(live):
            return score <= tau
        char = flat_b[start_b[live] + j]
        match = np.zeros(len(live), dtype=np.uint32)
        for k in range(max(0, tau - j), width):
            row = j - tau + k
            same = (flat_a[np.minimum(start_a[live] + row, len(flat_a) - 1)] == char) & (row < la[live])
            match |= same.astype(np.uint32) << np.uint32(k)
        p, m = up[live], down[live]
        d0 = (((match & p) + p) ^ p) | match | m
        hp = m | (~(d0 | p) & full)
        hn = d0 & p
        shifted = d0 >> np.uint32(1)
        last = np.uint32(1) << np.clip(width - 2 - (j - (la[live] - tau)), 0, width - 1).astype(np.uint32)
        along = ((hp & last) != 0).astype(np.int64) - ((hn & last) != 0).astype(np.int64)
        score[live] += np.where(j + tau < la[live], ((d0 & top) == 0).astype(np.int64), along)
        up[live], down[live] = (hn | (~(shifted | hp) & full)) & full, hp & shifted
        j += 1
        if j % 8 == 0:
            live = live[score[live] <= 3 * tau]


# --- the join ------------------------------------------------------------------------

def occurrences(docs: DataFrame, min_bytes: int = MIN_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_id, n_lines, line_nos, lines): per document the lines that take
    part, with their numbers from 0."""

    def make(batch: pa.RecordBatch) -> dict:
        sizes, places, ids = [], [], []
        for value in batch.column(2).to_pylist():
            lines = text_bytes(value).split(b"\n") if value else []
            found = [(n, line_id(x)) for n, x in enumerate(map(normalised, lines)) if len(x) >= min_bytes]
            sizes.append(len(lines))
            places.append([n for n, _ in found])
            ids.append([x for _, x in found])
        return {"key": batch.column(0), "doc_id": batch.column(1), "n_lines": pa.array(sizes, pa.int64()),
                "line_nos": lists(places, pa.int32()), "lines": lists(ids, pa.int64())}

    rows = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(rows, make, "key long, doc_id long, n_lines long, line_nos array<int>, lines array<bigint>")


_PACKED = "block long, n long, ids binary, sizes binary, bytes binary"


def line_blocks(docs: DataFrame, min_bytes: int = LINK_BYTES, text: str = "text", block_lines: int = BLOCK_LINES) -> DataFrame:
    """The lines of at least `min_bytes`, packed; a block has a line once, in the
    order of its id as an unsigned number."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for line in map(normalised, text_bytes(value).split(b"\n")):
                    if len(line) >= min_bytes:
                        name = xxhash.xxh64_intdigest(line)
                        if name not in held:
                            held[name] = line
                            size += len(line)
                if len(held) >= block_lines or size >= BLOCK_BYTES:
                    yield _packed(number, held)
                    number, held, size = number + 1, {}, 0
        if held:
            yield _packed(number, held)

    return docs.select(F.col(text).alias("text")).mapInArrow(make, _PACKED)


def _packed(number: int, held: dict[int, bytes]) -> pa.RecordBatch:
    ids = sorted(held)
    lines = [held[x] for x in ids]
    row = [[number], [len(ids)], [_zip_sorted(np.array(ids, dtype=np.uint64))], [_zip(np.array([len(x) for x in lines], dtype=np.uint32))],
           [zstandard.ZstdCompressor(level=3).compress(b"".join(lines))]]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in _PACKED.split(", ")])


def _own(row: dict) -> tuple[np.ndarray, list[bytes]]:
    """(ids, lines) that this block was told to be the first to name."""
    mine = np.flatnonzero(answer(row["answers"], ~0, np.uint64) > 0)
    data = zstandard.ZstdDecompressor().decompress(row["bytes"])
    starts = starts_of(_unzip(row["sizes"], np.uint32))
    return _unzip_sorted(row["ids"])[mine], [data[a:b] for a, b in zip(starts[mine].tolist(), starts[mine + 1].tolist())]


def _keys(lines: list[bytes], tau: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place of the line, whether it is an index entry) of the keys of `lines`,
    sorted, once each; an index entry is a probe of its own line, too."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))]
    for a in range(0, len(lines), 4096):
        both = [line_keys(x, tau) for x in lines[a:a + 4096]]
        for part in (0, 1):
            sizes = np.fromiter((len(x[part]) for x in both), np.int64, len(both))
            key = np.fromiter((k for x in both for k in x[part]), np.uint64, int(sizes.sum()))
            out.append((key, np.repeat(np.arange(a, a + len(both)), sizes), np.full(len(key), not part)))
    key, line, entry = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((~entry, line, key))
    key, line, entry = key[order], line[order], entry[order]
    first = np.ones(len(key), dtype=bool)  # of a line's equal keys the index entry
    first[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    return key[first], line[first], entry[first]


def _asked(row: dict, tau: int) -> list:
    """The distinct keys of a block's own lines, without their last bits: a key can
    only link lines if it is an index entry of one and a key of another."""
    key, _, entry = _keys(_own(row)[1], tau)
    if not len(key):
        return []
    short = key & _SHORT
    first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
    weights = np.add.reduceat(np.where(entry, ENTRY, 1), first)
    return [(0, short[first], np.minimum(weights, 1 << 31))]


def shared_keys(blocks: DataFrame, tau: int = TAU) -> DataFrame:
    """(line, bytes, keys, entries): the different lines of `blocks` that have a key
    which may link them to others, with these keys and whether each is an index
    entry. Keys are named to the parts of their range without lines and texts, and
    only those that reach an index entry and another line come back as rows."""
    n = blocks.agg(F.sum("n")).first()[0] or 0
    first = cut(reached(blocks.select("block", "ids"), lambda row: [(0, x := _unzip_sorted(row["ids"]), np.ones(len(x)))], parts_for(n), (1,), elect=True))
    known = blocks.join(first, "block")
    told = reached(known, lambda row: _asked(row, tau), parts_for(n * len(sum(line_keys(bytes(LINK_BYTES), tau), []))), (ENTRY + 1,))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, lines = _own(row)
                key, line, entry = _keys(lines, tau)
                short = key & _SHORT
                keep = (answer(row["told"], 0) > 0)[np.cumsum(np.concatenate([[False], short[1:] != short[:-1]]))] if len(key) else entry
                order = np.argsort(line[keep], kind="stable")
                key, line, entry = (x[keep][order] for x in (key, line, entry))
                some, sizes = np.unique(line, return_counts=True)
                for a in range(0, len(some), 4096):
                    at = starts_of(sizes)[a:a + 4097]
                    offsets = pa.array((at - at[0]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[some[a:a + 4096]].view(np.int64)), pa.array([lines[x] for x in some[a:a + 4096]], pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(key[at[0]:at[-1]].view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array(entry[at[0]:at[-1]]))], names=["line", "bytes", "keys", "entries"])

    return known.join(told.withColumnRenamed("answers", "told"), "block").mapInArrow(
        rows, "line long, bytes binary, keys array<bigint>, entries array<boolean>")


def line_links(docs: DataFrame, tau: int = TAU, min_bytes: int = LINK_BYTES, crowd: int = CROWD, text: str = "text") -> DataFrame:
    """(src, dst) for every pair of different lines within tau edits, once each."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = cut(shared_keys(store_blocks(line_blocks(docs, min_bytes, text), parts), tau))
    # an index entry is a probe, too
    held = lines.select("line", F.explode(F.arrays_zip("keys", "entries")).alias("x"))
    shared = held.select(F.col("x.keys").alias("key"), "line", F.col("x.entries").alias("entry"))
    crowded = shared.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select(
        "key", F.ceil(F.col("n") / crowd).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = shared.join(crowded, "key", "left").select("key", "line", "entry", blocks.alias("blocks")).withColumn(
        "block", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
    meet = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("key", "line", "entry", "block", meet).select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "line", "entry")
    dealt = dealt.join(lines.select("line", "bytes"), "line").select("key", "low", "high", "block", "line", "entry", "bytes")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, group, name = _Pairs(tau), [], None
        for batch in batches:
            for key, low, high, block, line, entry, data in zip(*(c.to_pylist() for c in batch.columns)):
                if name != (key, low, high):
                    yield from pairs.add(group, name)
                    group, name = [], (key, low, high)
                group.append((block, line, entry, data))
        yield from pairs.add(group, name)
        yield pairs.flush()

    names = ["key", "low", "high"]
    found = dealt.repartition(*names).sortWithinPartitions(*names).mapInArrow(verify, "src long, dst long")
    return found.distinct()


class _Pairs:
    """Collects pairs of lines that share a key and verifies them many at a time."""

    def __init__(self, tau: int):
        self.tau, self.pairs = tau, {}

    def add(self, group: list, name: tuple | None) -> Iterator[pa.RecordBatch]:
        if len(group) > 1:
            entries = [(b, line, data) for b, line, entry, data in group if entry]
            across = name[1] != name[2]
            for b, line, _, data in group:
                for other_b, other, short in entries:
                    if other != line and not (across and b == other_b) and 0 <= len(data) - len(short) <= self.tau:
                        self.pairs[(line, other) if line < other else (other, line)] = (short, data)
                if len(self.pairs) >= PAIRS:
                    yield self.flush()

    def flush(self) -> pa.RecordBatch:
        near = within([a for a, _ in self.pairs.values()], [b for _, b in self.pairs.values()], self.tau)
        found = [p for p, yes in zip(self.pairs, near) if yes]
        self.pairs = {}
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())],
                                          names=["src", "dst"])


def duplicate_lines(docs: DataFrame, tau: int = TAU, min_bytes: int | None = None, crowd: int = CROWD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, doc_id, n_lines, n_links (other lines that its
    lines are linked to) and removed, an array of (line number, id of the
    document that keeps the class's line)."""
    found = cut(occurrences(docs, MIN_BYTES if min_bytes is None else min_bytes, doc_id, text))
    links = cut(line_links(docs, tau, LINK_BYTES if min_bytes is None else min_bytes, crowd, text))
    degree = links.select(F.explode(F.array("src", "dst")).alias("line")).groupBy("line").agg(F.count("*").alias("links"))
    stars = connected_components(links).select(F.col("node").alias("line"), "component")
    pairs = F.explode(F.arrays_zip(F.col("line_nos").alias("no"), F.col("lines").alias("line"))).alias("x")
    lines = found.select("key", "doc_id", pairs).select("key", "doc_id", F.col("x.no").alias("no"), F.col("x.line").alias("line"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "no")
    first = lines.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    classes = cut(first.join(stars, "line", "left").withColumn("component", F.coalesce("component", "line")))
    kept = classes.groupBy("component").agg(F.min("first").alias("kept"), F.sum("n").alias("n")).filter("n > 1")
    again = classes.join(kept.drop("n"), "component").select("line", "kept")
    same = (F.col("key") == F.col("kept.key")) & (F.col("no") == F.col("kept.no"))
    gone = lines.join(again, "line").filter(~same).groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct("no", F.col("kept.doc_id").alias("kept_in")))).alias("removed"))
    linked = lines.select("key", "line").join(degree, "line").distinct().groupBy("key").agg(F.sum("links").alias("n_links"))
    none = F.expr("cast(array() as array<struct<no:int,kept_in:bigint>>)")
    return found.select("key", "doc_id", "n_lines").join(gone, "key", "left").join(linked, "key", "left").select(
        "key", "doc_id", "n_lines", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("removed", none).alias("removed"))


def apply(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str = "n_chars", **options) -> DataFrame:
    """`docs` without the removed lines, in the columns of `docs`; `length` is
    counted anew where a line went. A document that had words and has none left
    held nothing of its own and goes."""
    removed = duplicate_lines(docs, doc_id=doc_id, text=text, **options).filter(F.size("removed") > 0).select(
        F.col("key").alias("_key"), F.col("removed.no").alias("_gone")).dropDuplicates(["_key"])
    joined = docs.select(row_key(doc_id, text).alias("_key"), F.struct("*").alias("_row")).join(removed, "_key", "left")

    @F.pandas_udf("string")
    def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return texts.combine(gone, _without)

    without = without.asNondeterministic()  # else the filter below would have it run a second time
    touched = F.col("_gone").isNotNull()
    rows = joined.withColumn("_text", without(F.col("_row")[text], F.col("_gone")))
    rows = rows.filter(~touched | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*[
        F.col("_text").alias(c) if c == text
        else F.when(touched, F.length("_text")).otherwise(F.col("_row")[c]).cast(docs.schema[c].dataType).alias(c) if c == length
        else F.col("_row")[c].alias(c) for c in docs.columns])


def _without(text: str | None, gone) -> str | None:
    if text is None or gone is None:
        return text
    drop = set(gone)
    return "\n".join(x for n, x in enumerate(text.split("\n")) if n not in drop)
