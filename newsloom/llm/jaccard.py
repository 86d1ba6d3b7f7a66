"""Near copies by the exact Jaccard similarity of their word shingles.

A text's set holds the 64-bit hashes of its runs of WORDS words (lower-cased A-Z;
a shorter text is one run). Two texts are linked when their sets have a Jaccard
similarity of at least 4/5. The trie of `near_dup` cannot carry such links: they
differ in up to 11 of 64 fingerprint bits, and its top would deal a fingerprint
to all prefixes within that many flips.

Join. All sets are put into one order: by hash, with frequent shingles last. Of n
shingles the first n / 5 + COMMON are the prefix; two sets of similarity 4/5 share
COMMON of each other's prefix (all of a smaller set), whatever the order is. Texts
are packed into blocks, and a block learns which of its prefix shingles other
texts have as well (`dealing`); only those become rows. A shingle in the prefixes
of more than `often` texts turns out to be frequent: it goes last for all texts
and the prefixes are asked for again, until none is left. Which shingles a sample
of the texts holds often is known before. Sizes and places in the prefixes bound
the overlap that a pair can reach.

Pairs are made in two passes. In the first each key ties its texts to its
smallest one, which is linear and joins families of near copies. In the second
the keys whose texts are still of several components make all their pairs across
components. A pair inside a component would add nothing, so the components are
those of all links. The sets of paired texts are made again from their blocks. Prefix shingles that no
other text has cannot be shared, and frequent ones go last, so a text with many
changes of its own meets few others, and a key's ties go to the holder with the
fewest: in a family of copies that is the one that the others were made of.

Defined results: texts of the same words are one; they are named by 128 bits. Null
and wordless texts have the empty set and are copies of each other. Rows without
an id come last, repeated rows are one document. A very long text is a block of
its own. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import lower_words, map_rows, row_name
from newsloom.llm.dealing import answer, block_size, parts_for, reached, store_blocks
from newsloom.llm.repeats import _texts, text_blocks
from newsloom.operators.components import connected_components
from newsloom.session import cut, discard

WORDS, COMMON = 5, 3
SAMPLE, OFTEN, LAST = 4096, 4, 1 << 16  # texts looked at for common shingles, how often is common, how many go last
FREQUENT = 1 << 12      # texts with a shingle in their prefix that make it go last
BLOCK_BYTES, MOST_BYTES = 4 << 20, 64 << 20
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(31)


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    digest = xxhash.xxh64_intdigest
    w = np.fromiter(map(digest, words), np.uint64, len(words))
    size = min(size, len(w))
    if not size:
        return w
    value = np.zeros(len(w) - size + 1, dtype=np.uint64)
    for k in range(size):
        value = value * _BASE + w[k:len(w) - size + 1 + k]
    value = (value ^ (value >> _SHIFT)) * _MIX
    return np.unique(value ^ (value >> _SHIFT))


def text_name(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _isin(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values a sorted table holds."""
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def prefix(found: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first n / 5 + COMMON hashes, those of the sorted array `last` at the end."""
    late = _isin(found, last)
    return np.concatenate([found[~late], found[late]])[:len(found) // 5 + COMMON]


# --- shared prefixes -------------------------------------------------------------------

def _sets(row: dict) -> dict[bytes, tuple[int, np.ndarray]]:
    """Name: (number in the block, shingles) of the different texts of a block."""
    out: dict = {}
    for n, words in enumerate(x for x in map(lower_words, _decoded(row))):
        name = text_name(words)
        if name not in out:
            out[name] = (n, shingles(words))
    return out


def _decoded(row: dict) -> list[str]:
    return [t.decode("utf-8", "surrogatepass") for t in _texts(row)]


def text_table(blocks: DataFrame) -> DataFrame:
    """(name, doc_id, tid) for every row; tid names the text's words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                names = [text_name(lower_words(t)) for t in _decoded(row)]
                yield pa.RecordBatch.from_arrays([pa.array(row["names"], pa.binary()), pa.array(row["doc_ids"], pa.int64()), pa.array(names, pa.binary())],
                                                 names=["name", "doc_id", "tid"])

    return blocks.mapInArrow(make, "name binary, doc_id long, tid binary")


def common_shingles(docs: DataFrame, n_docs: int, text: str = "text") -> np.ndarray:
    """What a sample of the texts holds often, at most LAST hashes. They decide the
    order only, so a sample costs time at worst."""
    some = docs.filter(F.pmod(F.xxhash64(text), F.lit(max(1, n_docs // SAMPLE))) == 0).select(F.col(text).alias("text")).distinct()

    def make(batch: pa.RecordBatch) -> dict:
        sets = [shingles(lower_words(t)) for t in batch.column(0).to_pylist()]
        return {"h": np.concatenate(sets).view(np.int64)}

    rows = map_rows(some, make, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    found = rows.orderBy(F.desc("n"), "h").limit(LAST).select("h").toPandas()["h"]
    return np.sort(found.to_numpy(dtype=np.int64).view(np.uint64))


class _Prefixes:
    """The prefixes of a block's texts, and the hashes that it asks about: those
    and the ones it was told before to put last."""

    def __init__(self, row: dict, last: np.ndarray):
        self.hot = np.sort(np.array(row.get("hot") or [], dtype=np.int64).view(np.uint64))
        later = np.union1d(last, self.hot)
        self.texts = _sets(row)
        self.prefixes = [prefix(found, later) for _, found in self.texts.values()]
        held = [found[_isin(found, self.hot)] for _, found in self.texts.values()]
        asked = [np.union1d(a, b) for a, b in zip(self.prefixes, held)]
        self.named, self.counts = np.unique(np.concatenate(asked) if asked else np.zeros(0, dtype=np.uint64), return_counts=True)


_SHARED = "key long, tid binary, n int, place int, alone int, block long, at int"


def shared_prefixes(blocks: DataFrame, last: np.ndarray, parts: int, often: int = FREQUENT) -> DataFrame:
    """(key, tid, n, place, alone, block, at): prefix shingles that several texts
    hold, and where the texts are; `alone` counts those that no other text has."""
    sent = blocks.sparkSession.sparkContext.broadcast(last)

    def asked(row: dict) -> list:
        mine = _Prefixes(row, sent.value)
        return [(0, mine.named, mine.counts)] if len(mine.named) else []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                mine, level = _Prefixes(row, sent.value), answer(row["answers"], 0)
                fresh = mine.named[(level == 2) & ~_isin(mine.named, np.union1d(mine.hot, sent.value))]
                several = mine.named[level > 0]
                keys, tids = [fresh], [None] * len(fresh)
                sizes, places, alone, at = ([np.zeros(len(fresh))] for _ in range(4))
                for (name, (n, found)), first in zip(mine.texts.items(), mine.prefixes):
                    place = np.flatnonzero(_isin(first, several))
                    own = len(first) - len(place)
                    if own * 5 > len(found):
                        continue  # no text can hold 4/5 of it
                    keys.append(first[place])
                    tids += [name] * len(place)
                    sizes.append(np.full(len(place), len(found)))
                    places.append(place)
                    alone.append(np.full(len(place), own))
                    at.append(np.full(len(place), n))
                key = np.concatenate(keys)
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), pa.array(tids, pa.binary()), *(pa.array(np.concatenate(c).astype(np.int32)) for c in (sizes, places, alone)),
                    pa.array(np.full(len(key), row["block"], dtype=np.int64)), pa.array(np.concatenate(at).astype(np.int32))],
                    names=[x.split()[0] for x in _SHARED.split(", ")])

    packed = blocks.select("block", "sizes", "bytes")
    hot = None
    while True:
        known = packed if hot is None else packed.join(hot, "block", "left")
        found = cut(known.join(reached(known, asked, parts, (2, often + 1)), "block").mapInArrow(rows, _SHARED))
        fresh = found.filter("tid is null").select("block", "key")
        if fresh.isEmpty():
            return found
        # rows without a text name shingles that have to go last, for those who hold them
        before = [] if hot is None else [hot.select("block", F.explode("hot").alias("key"))]
        every = functools.reduce(DataFrame.unionByName, [*before, fresh])
        hot = cut(every.groupBy("block").agg(F.collect_set("key").alias("hot")))


# --- pairs -----------------------------------------------------------------------------

def _possible(a: str, b: str) -> Column:
    """Whether sizes, places and what no other text has leave room for an overlap of 4/9 of both sizes,
    which is a similarity of 4/5."""
    n, m, i, j = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.place", f"{b}.place"))
    most = F.least(F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1), n - F.col(f"{a}.alone"), m - F.col(f"{b}.alone"))
    return (F.least(n, m) * 5 >= F.greatest(n, m) * 4) & (most * 9 >= (n + m) * 4)


def _pairs(found: DataFrame) -> DataFrame:
    """Pairs that share COMMON keys, or all of the smaller set."""
    needed = F.least("a.n", "b.n", F.lit(COMMON))
    return found.select(F.least("a.tid", "b.tid").alias("src"), F.greatest("a.tid", "b.tid").alias("dst"), needed.alias("needed")).groupBy(
        "src", "dst").agg(F.count("*").alias("n"), F.max("needed").alias("needed")).filter("n >= needed").select("src", "dst")


def verified(pairs: DataFrame, shared: DataFrame, blocks: DataFrame) -> DataFrame:
    """Those of the pairs whose sets have a similarity of at least 4/5."""
    involved = pairs.select(F.explode(F.array("src", "dst")).alias("tid")).distinct()
    places = shared.groupBy("tid").agg(F.min(F.struct("block", "at")).alias("p")).join(involved, "tid").groupBy("p.block").agg(
        F.collect_set("p.at").alias("wanted"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                texts = _texts(row)
                for n in row["wanted"]:
                    words = lower_words(texts[n].decode("utf-8", "surrogatepass"))
                    yield pa.RecordBatch.from_arrays([pa.array([text_name(words)], pa.binary()), pa.array([shingles(words).view(np.int64)], pa.list_(pa.int64()))],
                                                     names=["tid", "hashes"])

    sets = cut(blocks.select("block", "sizes", "bytes").join(places, "block").mapInArrow(make, "tid binary, hashes array<bigint>"))
    both = pairs.join(sets.select(F.col("tid").alias("src"), F.col("hashes").alias("x")), "src").join(
        sets.select(F.col("tid").alias("dst"), F.col("hashes").alias("y")), "dst")
    overlap = F.size(F.array_intersect("x", "y"))
    result = cut(both.filter(overlap * 9 >= (F.size("x") + F.size("y")) * 4).select("src", "dst"))
    discard(sets)
    return result


def links(docs: DataFrame, blocks: DataFrame, total: int, n_docs: int, text: str = "text", often: int = FREQUENT) -> DataFrame:
    """(src, dst): pairs of texts of similarity 4/5 or more, enough of them for all
    components. `total` is the number of bytes in `blocks`."""
    shared = shared_prefixes(blocks, common_shingles(docs, n_docs, text), parts_for(total // 25), often)
    least = shared.groupBy("key").agg(F.min(F.struct("alone", "tid", "n", "place")).alias("b")).select("key", "b.*")
    tied = cut(_pairs(shared.alias("a").join(least.alias("b"), "key").filter((F.col("a.tid") != F.col("b.tid")) & _possible("a", "b"))))
    first = verified(tied, shared, blocks)
    stars = connected_components(first).withColumnRenamed("node", "tid")
    named = shared.join(stars, "tid", "left").withColumn("component", F.coalesce("component", "tid"))
    open_keys = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    named = cut(named.join(open_keys, "key", "left_semi").select("key", "tid", "n", "place", "alone", "component").distinct())
    across = (F.col("a.tid") < F.col("b.tid")) & (F.col("a.component") != F.col("b.component")) & _possible("a", "b")
    rest = cut(_pairs(named.alias("a").join(named.alias("b"), "key").filter(across)).join(tied, ["src", "dst"], "left_anti"))
    discard(named)
    return first.unionByName(verified(rest, shared, blocks))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", often: int = FREQUENT, block_bytes: int | None = None) -> DataFrame:
    """One document of each component: the row with the smallest id (rows without
    an id come last). All columns of `docs` are kept as they are. What is looked up
    in the end are the rows that go, so the texts stay where they are."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    block_bytes = block_bytes or block_size(total, BLOCK_BYTES, MOST_BYTES, 1 << 12)
    blocks = store_blocks(text_blocks(docs, block_bytes, doc_id, text), total // block_bytes)
    rows = cut(text_table(blocks))
    pairs = cut(links(docs, blocks, total, rows.count(), text, often))
    stars = connected_components(pairs).withColumnRenamed("node", "tid")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name")
    texts = cut(rows.groupBy("tid").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(stars, "tid", "left").withColumn(
        "component", F.coalesce("component", "tid")))
    keep = texts.groupBy("component").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).filter("n > 1")
    losing = texts.join(keep.drop("n"), "component").select("tid", "keep")
    involved = cut(rows.join(losing, "tid").select(F.col("name").alias("_name"), (F.col("name") == F.col("keep.name")).alias("_stays")).distinct())
    whole = docs.select(F.struct("*").alias("_row"), row_name(doc_id, text).alias("_name"))
    alone = whole.join(involved, "_name", "left_anti")
    firsts = whole.join(involved.filter("_stays").select("_name"), "_name", "left_semi").dropDuplicates(["_name"])
    return alone.unionByName(firsts).select("_row.*")
