"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes when it lies in a string of `length` bytes that also starts in a
document with a smaller id; of a repeated passage the copy in the first document
stays. Strings are judged on the input texts and never cross documents.

Which strings can repeat. The anchor of a string is the least hash among the
GRAM-byte substrings in it, so equal strings have equal anchors. Texts are packed
into blocks, a block names its anchors once each and learns which of them other
documents have as well (`dealing`). Only there texts are looked at further: a run
of strings with one anchor is a segment of at most 64 strings.

Suffix order. A block sends its different segments to the parts of the anchors'
range, each with the smallest id that holds it. Equal segments are one there,
owned by the smallest id of all; any other holder loses the whole segment. The
different segments of an anchor are put into suffix order, with the lengths of
the common prefixes of neighbours; for each suffix the previous and the next one
of a smaller owner in this order give the longest earlier match, cut at `length`.
Where it reaches `length` the owner loses the string. Each block gets one answer
for each segment that it sent. Anchors with more than `crowd` segments would make
a part too large: their segments are taken apart into strings, which are dealt by
their own names. All that then meet are equal, so there is nothing to order.

Defined results: a null text is empty and loses nothing. A row without an id
counts as later than all others. Rows with one id take nothing from each other.
Texts shorter than `length` stay. A very long text is a block of its own.
`docs` may have any other columns. An empty table gives no rows. Anchors are
64-bit hashes that only choose where to look; segments are named by 128 bits.
What one task holds is a block, or a part of about as many anchors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import lists, row_name, starts_of, text_bytes
from newsloom.llm.dealing import answer, block_size, gathered, parts_for, reached, store_blocks
from newsloom.llm.lm import _borders, _unzip, _unzip_sorted, _zip, _zip_sorted
from newsloom.session import cut

LENGTH, GRAM = 50, 16
BLOCK_BYTES, MOST_BYTES = 8 << 20, 128 << 20
CHUNK = 1 << 18         # bytes whose hashes are held at once, except for a longer text
CROWD = 1 << 15         # segments of an anchor that may meet in one part
SORTED = 4 << 20        # bytes of segments that are sorted at once, about
RUN = 64                # strings of a segment, one bit each
NO_ID = (1 << 63) - 1
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


# --- anchors ------------------------------------------------------------------------

def gram_hashes(flat: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at every place."""
    h = flat.astype(np.uint64) + np.uint64(1)
    for step, factor in zip((1, 2, 4, 8), _FACTORS):
        h = h[:-step] * factor + h[step:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def runs(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """In pieces of many texts: anchor, text number, first place and number of
    strings of each run of neighbouring strings with one anchor."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    first = 0
    while first < len(texts):
        before = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
        flat = np.frombuffer(b"".join(texts[first:last]), dtype=np.uint8)
        if len(flat) >= length:
            least = sliding_least(gram_hashes(flat), length - GRAM + 1)
            start = starts_of(sizes[first:last])
            owner = np.repeat(np.arange(last - first), sizes[first:last])
            inside = owner[:len(least)] == owner[length - 1:]
            new = np.append(True, (least[1:] != least[:-1]) | (owner[1:len(least)] != owner[:len(least) - 1]))
            at = np.flatnonzero(new & inside)
            stop = np.append(np.flatnonzero(new)[1:], len(least))[np.cumsum(new)[at] - 1] if len(at) else at
            text = owner[at]
            stop = np.minimum(stop, start[text + 1] - length + 1)
            anchor = least[at] * _FACTORS[0]  # least hashes are small ones; their range is dealt evenly
            yield anchor ^ (anchor >> np.uint64(32)), text + first, at - start[text], stop - at
        first = last


# --- suffix order -------------------------------------------------------------------

def suffix_order(flat: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at `places`, cut at `length` bytes (equal ones by
    place), and the common prefix of each with the one before it in the order."""
    padded = np.append(flat, np.zeros(8, dtype=np.uint8))
    words = []
    for k in range(0, length, 8):
        word = np.zeros(len(places), dtype=np.uint64)
        for j in range(8):
            byte = padded[places + k + j].astype(np.uint64) if k + j < length else np.uint64(0)
            word = (word << np.uint64(8)) | byte
        words.append(word)
    order = np.lexsort(words[::-1])
    common = np.zeros(len(places), dtype=np.int64)
    equal = np.ones(max(len(places) - 1, 0), dtype=bool)
    for word in words:
        ranked = word[order]
        differ = ranked[1:] ^ ranked[:-1]
        # equal leading bytes of two words
        bytes_equal = np.full(len(differ), 8, dtype=np.int64)
        for j in range(8):
            bytes_equal = np.where((differ >> np.uint64(8 * j)) & np.uint64(255), 7 - j, bytes_equal)
        common[1:] += np.where(equal, bytes_equal, 0)
        equal &= differ == 0
    return order, np.minimum(common, length)


def previous_smaller(values: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each place the common prefix with the nearest earlier place of a smaller
    value, or 0 where it is below `least`. common[i] is that of i - 1 and i.

    A place looks at its neighbour first and, as long as that is not smaller, goes
    on to where the neighbour has got to; all places between are not smaller."""
    n = len(values)
    at, match = np.arange(n) - 1, common.copy()
    open_ = np.flatnonzero(match >= least)
    match[match < least] = 0
    at[match == 0] = -1
    while len(open_):
        open_ = open_[values[at[open_]] >= values[open_]]
        to = at[open_]
        match[open_] = np.minimum(match[open_], match[to])
        at[open_] = at[to]
        open_ = open_[at[open_] >= 0]
    return match


def longest_previous(flat: np.ndarray, places: np.ndarray, owners: np.ndarray, length: int) -> np.ndarray:
    """For the suffix at each place the length of its longest match, up to
    `length`, with a suffix of a smaller owner; shorter ones than `length` are 0."""
    order, common = suffix_order(flat, places, length)
    values = owners[order]
    back = previous_smaller(values, common, length)
    ahead = previous_smaller(values[::-1], np.append(0, common[1:][::-1]) if len(common) else common, length)[::-1]
    out = np.zeros(len(places), dtype=np.int64)
    out[order] = np.maximum(back, ahead)
    return out


def repeated_bits(segments: list[bytes], owners: np.ndarray, length: int) -> np.ndarray:
    """For each segment the strings (bit i: the one at place i) that a segment of a
    smaller owner holds as well."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    strings = sizes - length + 1
    number = np.repeat(np.arange(len(segments)), strings)
    nth = np.arange(len(number)) - np.repeat(starts_of(strings)[:-1], strings)
    flat = np.frombuffer(b"".join(segments), dtype=np.uint8)
    found = longest_previous(flat, starts_of(sizes)[number] + nth, owners[number], length) >= length
    bits = np.zeros(len(segments), dtype=np.uint64)
    np.bitwise_or.at(bits, number[found], np.uint64(1) << nth[found].astype(np.uint64))
    return bits


# --- blocks -------------------------------------------------------------------------

_BLOCK = "block long, names array<binary>, doc_ids array<bigint>, sizes array<int>, bytes binary"


def text_blocks(docs: DataFrame, block_bytes: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts packed into rows of about `block_bytes`."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((row[0], row[1], text_bytes(row[2])))
                held += len(rows[-1][2])
                if held >= block_bytes:
                    yield _block(number, rows)
                    number, held, rows = number + 1, 0, []
        if rows:
            yield _block(number, rows)

    rows = docs.select(row_name(doc_id, text).alias("name"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(make, _BLOCK)


def _block(number: int, rows: list[tuple]) -> pa.RecordBatch:
    names, ids, texts = zip(*rows)
    data = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
    return pa.RecordBatch.from_arrays([
        pa.array([number], pa.int64()), lists([list(names)], pa.binary()), lists([list(ids)], pa.int64()),
        lists([[len(t) for t in texts]], pa.int32()), pa.array([data], pa.binary())], names=["block", "names", "doc_ids", "sizes", "bytes"])


def _texts(row: dict) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(row["bytes"])
    starts = starts_of(np.array(row["sizes"], dtype=np.int64)).tolist()
    return [data[a:b] for a, b in zip(starts[:-1], starts[1:])]


def _anchors(row: dict, length: int) -> list:
    """The distinct anchors of a block. An anchor in one text weighs one, else as
    much as it has segments."""
    found = [(a, t) for a, t, _, _ in runs(_texts(row), length)]
    if not found:
        return []
    anchor, text = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(anchor, kind="stable")  # texts come in order
    anchor, text = anchor[order], text[order]
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, dtype=np.int64)
    last = np.append(first[1:], len(anchor)) - 1
    return [(0, anchor[first], np.where(text[first] == text[last], 1, last - first + 1))] if len(first) else []


class Entries:
    """Segments or single strings of a block's texts, and the different ones of
    them in the order in which they are sent."""

    def __init__(self, texts: list[bytes], ids: list, text: np.ndarray, at: np.ndarray, strings: np.ndarray, length: int, anchor: np.ndarray | None):
        self.texts, self.text, self.at, self.strings, self.length = texts, text, at, strings, length
        names = b"".join(xxhash.xxh3_128_digest(texts[t][a:b]) for t, a, b in zip(text.tolist(), at.tolist(), (at + strings + length - 1).tolist()))
        high, low = np.frombuffer(names, dtype=">u8").astype(np.uint64).reshape(-1, 2).T
        anchor = high if anchor is None else anchor
        self.owner = np.array([NO_ID if x is None else x for x in ids], dtype=np.int64)[text]
        order = np.lexsort((self.owner, low, high, anchor))
        a, h, w = anchor[order], high[order], low[order]
        new = np.append(True, (a[1:] != a[:-1]) | (h[1:] != h[:-1]) | (w[1:] != w[:-1]))[:len(order)]
        self.number = np.zeros(len(order), dtype=np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.first = order[new]
        self.columns = anchor[self.first], high[self.first], low[self.first], self.owner[self.first]

    def bytes_of(self, span: slice) -> list[bytes]:
        mine = self.first[span]
        stop = self.at[mine] + self.strings[mine] + self.length - 1
        return [self.texts[t][a:b] for t, a, b in zip(self.text[mine].tolist(), self.at[mine].tolist(), stop.tolist())]

    def lost(self, told: np.ndarray) -> np.ndarray:
        """For each occurrence the strings that go, from what was told of the
        different ones."""
        every = np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - self.strings).astype(np.uint64)
        return np.where(self.owner > self.owner[self.first][self.number], every, told[self.number] & every)


def entries(row: dict, length: int) -> tuple[list[bytes], Entries, Entries]:
    """The texts of a block, their segments whose anchor several documents have,
    and, one by one, the strings of those with crowded anchors."""
    texts, level = _texts(row), answer(row["answers"], 0)
    pieces = list(runs(texts, length))
    none = np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 3
    anchor, text, at, strings = (np.concatenate(x) for x in zip(*pieces)) if pieces else none
    level = level[np.searchsorted(np.unique(anchor), anchor)] if len(anchor) else level
    both = []
    for few, most in ((level == 1, RUN), (level == 2, 1)):
        size = strings[few]
        parts = -(-size // most)
        nth = np.arange(int(parts.sum())) - np.repeat(starts_of(parts)[:-1], parts)
        size = np.minimum(np.repeat(size, parts) - nth * most, most)
        both.append(Entries(texts, row["doc_ids"], np.repeat(text[few], parts), np.repeat(at[few], parts) + nth * most, size, length,
                            np.repeat(anchor[few], parts) if most == RUN else None))
    return texts, *both


_SENT = "order int, part int, block long, anchors binary, high binary, low binary, owners binary, sizes binary, bytes binary"


def losses(blocks: DataFrame, parts: int, length: int) -> DataFrame:
    """(block, answers): for each segment (order 0) or string (order 1) that the
    block sends, the bits of the strings that its smallest holder there loses."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                for order, found in enumerate(entries(row, length)[1:]):
                    borders = _borders(found.columns[0], parts)
                    full = np.flatnonzero(np.diff(borders))
                    out: list[list] = [[] for _ in range(6)]
                    for p in full:
                        span = slice(borders[p], borders[p + 1])
                        data = found.bytes_of(span) if order == 0 else []
                        anchors, *rest = (c[span] for c in found.columns)
                        sizes = np.fromiter(map(len, data), np.uint32, len(data))
                        packed = [_zip_sorted(anchors), *map(_zip, rest), _zip(sizes), zstandard.ZstdCompressor(level=3).compress(b"".join(data))]
                        for column, value in zip(out, packed):
                            column.append(value)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(full), order, dtype=np.int32)), pa.array(full.astype(np.int32)),
                        pa.array(np.full(len(full), row["block"], dtype=np.int64)), *(pa.array(c, pa.binary()) for c in out)],
                        names=[x.split()[0] for x in _SENT.split(", ")])

    def decide(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        columns = [[_unzip_sorted(x) for x in rows["anchors"]], *([_unzip(x, kind) for x in rows[c]] for c, kind in (("high", np.uint64), ("low", np.uint64), ("owners", np.int64)))]
        starts = starts_of(np.array([len(x) for x in columns[0]]))
        anchor, high, low, owner = map(np.concatenate, columns)
        order = np.lexsort((owner, low, high, anchor))
        a, h, w = anchor[order], high[order], low[order]
        other = a[1:] != a[:-1]
        new = np.append(True, other | (h[1:] != h[:-1]) | (w[1:] != w[:-1]))
        number = np.zeros(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        bits = np.zeros(len(first), dtype=np.uint64)
        if key[0] == 0:
            sizes = np.concatenate([_unzip(x, np.uint32) for x in rows["sizes"]]).astype(np.int64)
            data = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in rows["bytes"])
            place = starts_of(sizes)
            group = np.cumsum(np.append(True, other))[new]  # the anchor of each different segment
            several = np.flatnonzero(np.bincount(group)[group] > 1)  # a segment alone is nowhere else
            ends = np.append(np.flatnonzero(group[several][1:] != group[several][:-1]) + 1, len(several)) if len(several) else []
            begin, held = 0, np.cumsum(sizes[first[several]])
            for n, end in enumerate(ends):  # whole anchors, some megabytes at a time
                if n == len(ends) - 1 or held[ends[n + 1] - 1] - (held[begin - 1] if begin else 0) > SORTED:
                    some = several[begin:end]
                    mine = first[some]
                    bits[some] = repeated_bits([data[place[k]:place[k + 1]] for k in mine.tolist()], owner[mine], length)
                    begin = end
        told = np.where(owner > owner[first][number], np.uint64(0xFFFFFFFFFFFFFFFF), bits[number])
        answers = [_zip(told[x:y]) for x, y in zip(starts[:-1], starts[1:])]
        return pd.DataFrame({"order": key[0], "part": key[1], "block": rows["block"], "values": answers})

    return gathered(blocks.mapInArrow(send, _SENT).groupBy("order", "part").applyInPandas(decide, "order int, part int, block long, values binary"))


def find(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD, block_bytes: int | None = None) -> DataFrame:
    """(name, doc_id, n_bytes, starts, ends, kept) for every row of `docs`: the
    removed byte spans and the bytes left. `length` is at least GRAM."""
    if length < GRAM:
        raise ValueError(f"repeats of fewer than {GRAM} bytes are not looked for")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    per_anchor = (length - GRAM + 2) / 2
    anchors = int(total / per_anchor)
    if block_bytes is None:
        block_bytes = int(block_size(anchors, int(BLOCK_BYTES / per_anchor), int(MOST_BYTES / per_anchor)) * per_anchor)
    blocks = store_blocks(text_blocks(docs, block_bytes, doc_id, text), total // block_bytes)
    shared = reached(blocks.select("block", "sizes", "bytes"), lambda row: _anchors(row, length), parts_for(anchors), (2, crowd + 1))
    looked = cut(blocks.select("block", "doc_ids", "sizes").join(shared, "block").select("block", "doc_ids", "answers"))
    whole = blocks.select("block", "sizes", "bytes").join(looked, "block")
    told = losses(whole, parts_for(2 * anchors), length).withColumnRenamed("answers", "told")
    return blocks.join(looked.drop("doc_ids").join(told, "block", "left"), "block", "left").mapInArrow(lambda batches: _spans(batches, length), _FOUND)


_FOUND = "name binary, doc_id long, n_bytes long, starts array<int>, ends array<int>, kept binary"


def _spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            texts, *both = entries(row, length)
            lost = [(e.text, e.at, e.lost(answer(row["told"], order, np.uint64))) for order, e in enumerate(both) if len(e.text)]
            none = [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0, dtype=np.uint64)]
            text, at, bits = map(np.concatenate, zip(*lost)) if lost else none
            order = np.argsort(text, kind="stable")
            text, at, bits = text[order], at[order], bits[order]
            border = np.searchsorted(text, np.arange(len(texts) + 1))
            starts, ends, kept = [], [], []
            for k, data in enumerate(texts):
                a, b = removed(len(data), at[border[k]:border[k + 1]], bits[border[k]:border[k + 1]], length)
                starts.append(a.tolist())
                ends.append(b.tolist())
                kept.append(without(data, starts[-1], ends[-1]))
            yield pa.RecordBatch.from_arrays([
                pa.array(row["names"], pa.binary()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["sizes"], pa.int64()),
                lists(starts, pa.int32()), lists(ends, pa.int32()), pa.array(kept, pa.binary())], names=[x.split()[0] for x in _FOUND.split(", ")])


def removed(size: int, at: np.ndarray, bits: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal spans covered by the strings that `bits` names behind `at`."""
    if not bits.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    named = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    segment, nth = np.nonzero(named)
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, at[segment] + nth, 1)
    np.add.at(change, at[segment] + nth + length, -1)
    covered = np.append(np.append(False, np.cumsum(change)[:-1] > 0), False)
    edge = np.flatnonzero(covered[1:] != covered[:-1])
    return edge[::2], edge[1::2]


def without(data: bytes, starts: list[int], ends: list[int]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)])) if starts else data


def apply(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with the repeated passages cut out of `text`, all columns kept. A
    character goes only if all its bytes do. Texts that are touched nowhere keep
    their value, null included."""
    spans = find(docs, length, doc_id, text, **options).filter(F.size("starts") > 0).select(
        F.col("name").alias("_name"), F.col("starts").alias("_starts"), F.col("ends").alias("_ends")).dropDuplicates(["_name"])

    @F.pandas_udf("string")
    def shorter(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if a is None else _cut_text(t, a, b) for t, a, b in zip(texts, starts, ends)], dtype=object)

    joined = docs.select(F.struct("*").alias("_row"), row_name(doc_id, text).alias("_name")).join(spans, "_name", "left")
    return joined.select(*[shorter(F.col("_row")[c], F.col("_starts"), F.col("_ends")).alias(c) if c == text
                           else F.col("_row")[c].alias(c) for c in docs.columns])


def _cut_text(text: str, starts, ends) -> str:
    data = text_bytes(text)
    inner = [(_whole(data, a, 1), _whole(data, b, -1)) for a, b in zip(starts, ends)]
    inner = [(a, b) for a, b in inner if a < b]
    return without(data, [a for a, _ in inner], [b for _, b in inner]).decode("utf-8", "surrogatepass")


def _whole(data: bytes, at: int, step: int) -> int:
    """The next place in this direction where a character begins."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += step
    return at
