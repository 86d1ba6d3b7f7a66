"""SimHash near duplicates, found by a self-join of a binary trie.

A fingerprint has 64 bits; bit i is 1 if it is set in over half the hashes of
the text's 3-word shingles. Two fingerprints are linked when they differ in at
most `budget` bits. The distinct fingerprints are the leaves of a binary trie.
The join walks pairs of nodes of one depth together, adds a difference whenever
the two sides take different branches, and drops a pair that is over budget.

Spark walks the top `p` levels: every fingerprint goes to each pair of prefixes
that its own prefix forms within the budget (1 + p + p(p-1)/2 pairs for two
bits), and p grows with the logarithm of the number of fingerprints, so a pair
of subtrees stays small. Below, a task walks the two subtrees with arrays, depth
first in bounded pieces.

Defined results: a null or wordless text has fingerprint 0 and is linked like
any other. Rows with a null id are fingerprinted and linked; the smallest id
ignores them and is null only if a component has no id. Repeated rows each get
the row of their text. A very long text is hashed in one task, its bits are counted
in pieces. `docs` may have any other columns, also with the names used here. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import lower_words, map_rows, row_key, starts_of
from newsloom.operators.components import connected_components
from newsloom.session import cut

BITS, WORDS, SEED, BUDGET = 64, 3, 42, 2
LEAF = 1 << 12      # distinct fingerprints of a subtree that one task walks, about
CHUNK = 1 << 17     # node pairs that a task expands at once
SMALL = 16          # a node pair with so few leaf pairs is compared directly
PIECE = 1 << 16     # hashes whose bits are unpacked at once


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> list[int]:
    w = lower_words(text)
    if not w:
        return []
    grams = zip(*(w[i:] for i in range(words))) if len(w) >= words else [w]
    digest = xxhash.xxh64_intdigest
    return [digest(b" ".join(g), seed) for g in grams]


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text."""
    hashes = [shingle_hashes(t) for t in texts]
    counts = np.zeros((len(texts), BITS), dtype=np.int64)
    sizes = np.fromiter(map(len, hashes), dtype=np.int64, count=len(texts))
    flat = np.fromiter((h for one in hashes for h in one), dtype=np.uint64, count=int(sizes.sum()))
    starts = starts_of(sizes)
    at, owner = 0, 0
    while at < len(flat):  # whole texts, as many as fit; a longer one in pieces
        last = int(np.searchsorted(starts, at + PIECE, side="right")) - 1
        stop = int(starts[last]) if last > owner else min(at + PIECE, int(starts[owner + 1]))
        bits = np.unpackbits(flat[at:stop].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        if last > owner:
            rows = np.arange(owner, last)
            rows = rows[sizes[rows] > 0]
            begin = np.maximum(starts[rows], at) - at
            counts[rows] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
            owner = last
        else:
            counts[owner] += bits.sum(axis=0, dtype=np.int64)
            owner += stop == starts[owner + 1]
        at = stop
    set_bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1).reshape(-1).view(np.uint64).byteswap()


def trie_join(left: np.ndarray, right: np.ndarray, depth: int, spent: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs within the budget below two nodes of depth `depth` whose prefixes
    already differ in `spent` bits. `left` and `right` are sorted and distinct;
    the same object twice is a self-join that gives each pair once."""
    same = left is right
    found: list[tuple] = []
    stack = [(BITS - 1 - depth, *(np.array([x], dtype=np.int64) for x in (0, len(left), 0, len(right), spent)))]
    if not len(left) or not len(right):
        stack = []
    while stack:
        bit, la, ha, lb, hb, d = stack.pop()
        own = (la == lb) if same else np.zeros(len(la), dtype=bool)
        small = ((ha - la) * (hb - lb) <= SMALL) | (bit < 0)
        if small.any():
            found.append(_compare(left, right, la[small], ha[small], lb[small], hb[small], own[small], budget))
            la, ha, lb, hb, d, own = (x[~small] for x in (la, ha, lb, hb, d, own))
        if not len(la):
            continue
        ma, mb = _split(left, la, ha, bit), _split(right, lb, hb, bit)
        wide = d < budget
        parts = [(la, ma, lb, mb, d), (ma, ha, mb, hb, d),
                 tuple(x[wide] for x in (la, ma, mb, hb, d + 1)),
                 tuple(x[wide & ~own] for x in (ma, ha, lb, mb, d + 1))]
        la, ha, lb, hb, d = (np.concatenate(x) for x in zip(*parts))
        live = (ha > la) & (hb > lb)
        la, ha, lb, hb, d = (x[live] for x in (la, ha, lb, hb, d))
        for i in range(0, len(la), CHUNK):
            stack.append((bit - 1, *(x[i:i + CHUNK] for x in (la, ha, lb, hb, d))))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the branch for bit 1 begins inside [lo, hi)."""
    shift = np.uint64(bit)
    border = ((values[lo] >> shift) | np.uint64(1)) << shift
    return np.clip(np.searchsorted(values, border), lo, hi)


def _compare(left, right, la, ha, lb, hb, own, budget):
    wide = hb - lb
    sizes = (ha - la) * wide
    node = np.repeat(np.arange(len(la)), sizes)
    nth = np.arange(int(sizes.sum())) - np.repeat(starts_of(sizes)[:-1], sizes)
    i, j = la[node] + nth // wide[node], lb[node] + nth % wide[node]
    keep = ~own[node] | (i < j)
    i, j = i[keep], j[keep]
    diff = np.bitwise_count(left[i] ^ right[j]).astype(np.int64)
    near = diff <= budget
    return left[i[near]], right[j[near]], diff[near]


def links(values: DataFrame, column: str = "fp", budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """(src, dst, diff) for every pair of different values, each pair once.
    `values` has distinct signed 64-bit values; it is read twice."""
    n = values.count()
    depth = min(24, max(0, math.ceil(math.log2(max(1, n) / leaf))))
    flips = [0] + [1 << i for i in range(depth)] if budget else [0]
    if budget >= 2:
        flips += [(1 << i) | (1 << j) for i in range(depth) for j in range(i)]
    if budget > 2:
        raise ValueError("the top of the trie is walked for two differing bits at most")
    prefix = F.shiftrightunsigned(F.col(column), BITS - depth) if depth else F.lit(0).cast("long")
    flip = F.explode(F.array(*[F.lit(x).cast("long") for x in flips]))
    dealt = values.select(column, prefix.alias("own"), flip.alias("flip")).select(
        column, (F.col("own") > F.col("own").bitwiseXOR(F.col("flip"))).alias("upper"),
        (F.least("own", F.col("own").bitwiseXOR(F.col("flip"))) * (1 << 32)
         + F.greatest("own", F.col("own").bitwiseXOR(F.col("flip")))).alias("nodes"))

    def walk(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        low, high = key[0] >> 32, key[0] & 0xFFFFFFFF
        mine = np.sort(rows[column].to_numpy().astype(np.int64).view(np.uint64)[~rows["upper"].to_numpy()])
        other = mine if low == high else np.sort(
            rows[column].to_numpy().astype(np.int64).view(np.uint64)[rows["upper"].to_numpy()])
        a, b, diff = trie_join(mine, other, depth, int(low ^ high).bit_count(), budget)
        return pd.DataFrame({"src": a.view(np.int64), "dst": b.view(np.int64), "diff": diff})

    return dealt.groupBy("nodes").applyInPandas(walk, "src long, dst long, diff long")


def fingerprint_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_id, fp) for every row; fp is the fingerprint as a signed long."""

    def make(batch: pa.RecordBatch) -> dict:
        return {"key": batch.column(0), "doc_id": batch.column(1),
                "fp": fingerprints(batch.column(2).to_pylist()).view(np.int64)}

    rows = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(rows, make, "key long, doc_id long, fp long")


def with_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """(key, doc_id, fp, component, component_id, n_links) for every row of
    `docs`. component is the smallest fingerprint that its own is connected to,
    n_links the number of other fingerprints it is linked to directly."""
    fps = cut(fingerprint_table(docs, doc_id, text))
    groups = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    pairs = cut(links(groups, "fp", budget, leaf))
    degree = pairs.select(F.explode(F.array("src", "dst")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    stars = connected_components(pairs.select("src", "dst")).withColumnRenamed("node", "fp")
    members = stars.join(groups, "fp").join(degree, "fp")
    least = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = members.join(least, "component").select("fp", "component", "component_id", "n_links")
    # stored, so that both sides of the last join are plain scans and the skew join
    # can split the rows of a fingerprint that very many texts share
    classes = cut(groups.join(linked, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), F.when(F.col("n_links").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return fps.join(classes, "fp").select("key", "doc_id", "fp", "component", "component_id", "n_links")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """One document of each component: the row with the smallest id (rows
    without an id come last). All columns of `docs` are kept as they are."""
    classes = with_components(docs, doc_id, text, budget)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")
    keep = classes.groupBy("component").agg(first).select(F.col("first.key").alias("_key"))
    rows = docs.select(F.struct("*").alias("_row"), row_key(doc_id, text).alias("_key"))
    return rows.join(keep, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")
