"""Ranked lexical search by MaxScore with bounds on pairs of terms.

A document's score for a query sums over the query's terms
w * ((10^9 * tf) div (1000 * tf + 20 * m)), w = floor(1000 ln((2N + 2) / (2 df + 1))),
m = 50 + (50 n N) div L: N documents with a term, L their terms, n the
document's, df the documents holding the term, all in integers.

Index. Documents are packed into blocks that hold the postings of the terms that
some query asks for, so postings are never shuffled; N, L and df are summed over
the blocks. With them every posting gets its impact, every term its greatest
impact in the block, and every pair of terms that stand next to each other in a
query's order (greatest w first) the greatest sum of impacts that a document
holding both reaches: the maximum over the pair's intersection list.

Search. A block is searched term at a time. What terms j, j + 1, ... can still
add is bounded by the cheapest cover of them with single terms and pairs: a pair
costs the greatest of its two single maxima and its joint maximum, which is never
more than their sum. As long as that bound reaches the score of the k-th best
document, term j may bring in new documents; after that only documents already
met are looked up, and those that cannot reach the k-th score any more are let
go. The k-th score is that of all blocks the task has searched. Every block
sends its k best; the best k of all are taken by a ranked window, cut before its
shuffle.

Queries are taken in groups of at most `max_bytes` of text, so what is broadcast
has a bound; each group is a pass over the documents.

Defined results: a null text has no term, neither as a document nor as a query,
and gets no row. Equal scores go by ascending id, rows without an id last;
repeated rows are ranked each. Queries with one id are searched each. A very long
text is a row of postings like any other. `docs` may have any other columns.
Empty tables give no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from newsloom.llm.common import lists, plain_words, starts_of
from newsloom.session import cut

K = 50
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 15, 1 << 22
MAX_BYTES = 16 << 20        # text of the queries that are broadcast together

_BLOCK = "block long, doc_ids array<bigint>, n array<int>, terms array<int>, df array<int>, docs array<int>, tf array<int>"
_INDEX = _BLOCK.replace("tf array<int>", "impacts array<bigint>") + ", pair array<int>, shared array<int>, joint array<bigint>"


# --- queries --------------------------------------------------------------------------

class Queries:
    """Some queries as numbered distinct terms."""

    def __init__(self, rows: list[tuple]):
        self.numbers: dict[bytes, int] = {}
        self.ids, self.terms = [], []
        for item_id, text in rows:
            found = dict.fromkeys(plain_words(text))
            if found:
                self.ids.append(item_id)
                self.terms.append([self.numbers.setdefault(w, len(self.numbers)) for w in found])

    def order(self, weight: np.ndarray) -> None:
        """Each query's terms by falling weight, and the pairs of neighbours."""
        self.terms = [sorted((t for t in one if weight[t] > 0), key=lambda t: (-weight[t], t)) for one in self.terms]
        pairs: dict[tuple[int, int], int] = {}
        self.pairs = [[pairs.setdefault((min(a, b), max(a, b)), len(pairs)) for a, b in zip(one, one[1:])] for one in self.terms]
        self.pair_terms = list(pairs)


def query_groups(items: DataFrame, item_id: str, text: str, max_bytes: int) -> Iterator[Queries]:
    total = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    count = max(1, math.ceil(total / max_bytes))
    for g in range(count):
        mine = items if count == 1 else items.filter(F.pmod(F.xxhash64(item_id, text), F.lit(count)) == g)
        yield Queries([tuple(r) for r in mine.select(item_id, text).collect()])


# --- index -----------------------------------------------------------------------------

def posting_blocks(docs: DataFrame, queries: Queries, doc_id: str = "doc_id", text: str = "text",
                   block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """Documents with a term in blocks: their ids, numbers of terms, and the
    postings of the queries' terms, term by term."""
    sent = docs.sparkSession.sparkContext.broadcast(queries.numbers)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        number, ids, sizes, keys, held = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            for one, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = plain_words(value)
                if not words:
                    continue
                known = np.fromiter((x for x in map(get, words) if x is not None), np.int64)
                keys.append(known << 32 | len(ids))
                ids.append(one)
                sizes.append(len(words))
                held += len(known)
                if len(ids) >= block_docs or held >= block_postings:
                    yield _block(number, ids, sizes, keys)
                    number, ids, sizes, keys, held = number + 1, [], [], [], 0
        if ids:
            yield _block(number, ids, sizes, keys)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(make, _BLOCK)


def _block(number: int, ids: list, sizes: list, keys: list) -> pa.RecordBatch:
    places, tf = np.unique(np.concatenate(keys), return_counts=True)
    terms, df = np.unique(places >> 32, return_counts=True)
    row = [[number], [ids], [sizes], [terms], [df], [places & 0xFFFFFFFF], [tf]]
    kinds = [pa.int64(), pa.list_(pa.int64())] + [pa.list_(pa.int32())] * 5
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in _BLOCK.split(", ")])


def statistics(blocks: DataFrame, queries: Queries) -> tuple[int, int, np.ndarray]:
    """N, L and the weight of each of the queries' terms."""
    row = blocks.agg(F.sum(F.size("n")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x))).first()
    n, length = row[0] or 0, row[1] or 0
    each = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df"))
    df = {r[0]: r[1] for r in each.collect()}  # one row a query term at most
    weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(len(queries.numbers))]
    return n, length, np.array(weights, dtype=np.int64)


def impact_index(blocks: DataFrame, queries: Queries, n: int, length: int, weight: np.ndarray) -> DataFrame:
    """The blocks with impacts for frequencies, and of each pair that some query
    needs and the block holds: its number, the size of its intersection list and
    the greatest joint impact in it."""
    sent = blocks.sparkSession.sparkContext.broadcast((queries.pair_terms, weight))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair_terms, weights = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block = Postings(row, "tf")
                m = 50 + (50 * block.n * n) // length
                tf, docs = block.values, block.docs
                impacts = np.repeat(weights[block.terms], np.diff(block.starts)) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[docs]))
                block.values = impacts
                found = [(number, *block.meet(a, b)) for number, (a, b) in enumerate(pair_terms)]
                found = [x for x in found if x[1]]
                pair, shared, joint = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c) for c in ("block", "doc_ids", "n", "terms", "df", "docs")), lists([impacts], pa.int64()),
                     lists([list(pair)], pa.int32()), lists([list(shared)], pa.int32()), lists([list(joint)], pa.int64())],
                    names=[x.split()[0] for x in _INDEX.split(", ")])

    return blocks.mapInArrow(make, _INDEX)


class Postings:
    """A block's postings: documents ascending in each term's list."""

    def __init__(self, row: pa.RecordBatch, values: str):
        column = lambda c: row.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.n, self.terms, self.docs, self.values = (column(c) for c in ("n", "terms", "docs", values))
        self.starts = starts_of(column("df"))
        self.at = {t: k for k, t in enumerate(self.terms.tolist())}

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        k = self.at.get(term)
        span = slice(0, 0) if k is None else slice(self.starts[k], self.starts[k + 1])
        return self.docs[span], self.values[span]

    def meet(self, a: int, b: int) -> tuple[int, int]:
        """How many documents hold both terms, and their greatest joint impact."""
        if a not in self.at or b not in self.at:
            return 0, 0
        (x, u), (y, v) = self.list_of(a), self.list_of(b)
        if len(x) > len(y):
            x, u, y, v = y, v, x, u
        near = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = y[near] == x
        return int(both.sum()), int((u[both] + v[near[both]]).max(initial=0))


# --- search ----------------------------------------------------------------------------

def bounds(single: list[int], joint: list[int]) -> list[int]:
    """At j the most that terms j, j + 1, ... can add to one document. single[j] is
    the greatest impact of term j, joint[j] that of a document with j and j + 1."""
    out = [0] * (len(single) + 2)
    for j in range(len(single) - 1, -1, -1):
        out[j] = single[j] + out[j + 1]
        if j + 1 < len(single):
            pair = max(single[j], single[j + 1], joint[j])
            out[j] = min(out[j], pair + out[j + 2])
    return out[:len(single) + 1]


def best(postings: list[tuple[np.ndarray, np.ndarray]], bound: list[int], k: int, floor: int, acc: np.ndarray,
         visited: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of those that reach `floor` and the k-th best score of
    the block, ties included. `acc` is all zero before and after. `visited` gets
    the lengths of the lists that were read whole."""
    met: np.ndarray = np.zeros(0, dtype=np.int64)
    j = 0
    while j < len(postings) and bound[j] >= floor:  # terms that may bring in documents
        docs, values = postings[j]
        if len(docs):
            new = docs[(acc[docs] == 0) & (values > 0)]
            acc[docs] += values
            met = np.concatenate([met, new])
            if visited is not None:
                visited.append(len(docs))
            if len(met) >= k:
                floor = max(floor, int(np.partition(acc[met], len(met) - k)[len(met) - k]))
        j += 1
    rest = met
    while True:
        scores = acc[rest]
        if len(rest) >= k:
            floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        rest = rest[scores + bound[j] >= floor]
        if j == len(postings) or not len(rest):
            break
        docs, values = postings[j]
        if len(docs):
            near = np.minimum(np.searchsorted(docs, rest), len(docs) - 1)
            acc[rest] += np.where(docs[near] == rest, values[near], 0)
        j += 1
    scores = acc[rest]
    acc[met] = 0
    return rest, scores


def search(index: DataFrame, queries: Queries, k: int = K, id_type: str = "bigint") -> DataFrame:
    """(query, item_id, doc_id, score): the k best of every block, in which the
    best k of all are."""
    sent = index.sparkSession.sparkContext.broadcast((queries.ids, queries.terms, queries.pairs))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, pairs = sent.value
        names = pa.array(names)
        tops = [np.zeros(0, dtype=np.int64)] * len(terms)  # the k best scores so far
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block = Postings(row, "impacts")
                ids = row.column("doc_ids").flatten()
                later = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                greatest = dict(zip(block.terms.tolist(), np.maximum.reduceat(block.values, block.starts[:-1]).tolist())) if len(block.terms) else {}
                joints = dict(zip(row.column("pair").flatten().to_pylist(), row.column("joint").flatten().to_pylist()))
                acc = np.zeros(len(ids), dtype=np.int64)
                out = []
                for q, (mine, neighbours) in enumerate(zip(terms, pairs)):
                    single = [greatest.get(t, 0) for t in mine]
                    bound = bounds(single, [joints.get(p, 0) for p in neighbours])
                    floor = int(tops[q][0]) if len(tops[q]) == k else 1
                    docs, scores = best([block.list_of(t) for t in mine], bound, k, floor, acc)
                    keep = np.lexsort((later[docs], -scores))[:k]
                    docs, scores = docs[keep], scores[keep]
                    out.append((np.full(len(docs), q, dtype=np.int32), docs, scores))
                    tops[q] = np.sort(np.concatenate([tops[q], scores]))[-k:]
                if out:
                    q, docs, scores = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(q), names.take(pa.array(q)), ids.take(pa.array(docs)), pa.array(scores)],
                                                     names=["query", "item_id", "doc_id", "score"])

    return index.mapInArrow(make, f"query int, item_id {id_type}, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", max_bytes: int = MAX_BYTES, **sizes) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a
    score above 0."""
    parts = []
    for queries in query_groups(items, item_id, item_text, max_bytes):
        blocks = cut(posting_blocks(docs, queries, doc_id, text, **sizes))
        n, length, weight = statistics(blocks, queries)
        queries.order(weight)
        index = cut(impact_index(blocks, queries, n, length, weight))
        window = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = search(index, queries, k, items.schema[item_id].dataType.simpleString())
        parts.append(top.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    return functools.reduce(DataFrame.unionByName, parts)
