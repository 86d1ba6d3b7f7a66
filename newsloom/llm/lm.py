"""Language-model scores by a weighted backoff automaton.

The model is an n-gram model with a Dirichlet prior at every order:
P(w | h) = (c(h w) + prior * P(w | h')) / (c(h) + prior), h' one word shorter, and
P(w) = (c(w) + 1) / (N + V + 1). As an automaton, every n-gram seen in training
is a state with an arc from its context, weighted log10 P; a state's failure arc
leads to its suffix and weighs log10(prior / (c + prior)). A text is traversed
once from left to right: the state is the longest seen suffix so far, a token
takes the arc of the longest n-gram that continues it, and each failure arc on
the way adds its weight.

The counts are those of the whole training part and never meet in one place.
Texts are tokenised once into blocks of bounded size. A block sends the hashes
of its distinct n-grams, with their training counts, to parts of the hash range;
a part adds up the counts of all blocks and answers each block, which then has
the exact piece of the automaton that its texts pass through. A block names an
n-gram once however often it occurs, so no key is hot, and parts stay small
because their number grows with the tokens.

Defined results: a null text is empty and has the end token only. A null id
counts as empty text for the fold. Repeated rows count each and get equal
results. N-grams are 64-bit hashes. A text of more than BLOCK_TOKENS tokens makes its
block that much longer. `docs` may have any other columns. An empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import lower_words, starts_of
from newsloom.session import cut

ORDER, PRIOR = 2, 256.0
FOLDS, HELD_OUT = 7, 2
BLOCK_TOKENS, PART_GRAMS = 1_000_000, 2_000_000
_END, _START = xxhash.xxh64_intdigest(b""), xxhash.xxh64_intdigest(b" ")  # no word is empty or has a space
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fold(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode("ascii")) % FOLDS


# --- packed columns ---------------------------------------------------------------

def _zip(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    flat = np.ascontiguousarray(values)
    planes = flat.view(np.uint8).reshape(len(flat), flat.itemsize).T if len(flat) else flat.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unzip(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).reshape(-1).view(kind)


def _zip_sorted(values: np.ndarray) -> bytes:
    return _zip(np.diff(values, prepend=np.uint64(0)))


def _unzip_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unzip(data, np.uint64), dtype=np.uint64)


# --- blocks -----------------------------------------------------------------------

_BLOCK = "block long, doc_ids array<bigint>, sizes binary, tokens binary, words binary, n_tokens long, train_tokens long, train_docs long"


def token_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a block of texts: ids, numbers of tokens, tokens as numbers of the
    block's own words, and the words' hashes. Number 0 is the end token."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, sizes, tokens, seen, held = [], [], [], {b"": 0}, 0
            for one, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [seen.setdefault(w, len(seen)) for w in lower_words(value)]
                ids.append(one)
                sizes.append(len(found) + 1)
                tokens += [np.array(found, dtype=np.uint32), np.zeros(1, dtype=np.uint32)]
                held += len(found) + 1
                if held >= block_tokens:
                    yield _block(number, ids, sizes, tokens, seen)
                    number += 1
                    ids, sizes, tokens, seen, held = [], [], [], {b"": 0}, 0
            if ids:
                yield _block(number, ids, sizes, tokens, seen)
                number += 1

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(make, _BLOCK)


def _block(number: int, ids: list, sizes: list, tokens: list, seen: dict) -> pa.RecordBatch:
    words = np.fromiter((xxhash.xxh64_intdigest(w) for w in seen), dtype=np.uint64, count=len(seen))
    lengths = np.array(sizes, dtype=np.uint32)
    train = np.array([fold(x) != HELD_OUT for x in ids])
    row = [[number], [ids], [_zip(lengths)], [_zip(np.concatenate(tokens))], [_zip(words)], [int(lengths.sum())],
           [int(lengths[train].sum())], [int(train.sum())]]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in _BLOCK.split(", ")])


class Grams:
    """The n-grams of a block: for each order the sorted distinct hashes, which
    of them ends at each place, and how often it does so in training texts.
    Places are tokens, with a start mark before each text."""

    def __init__(self, ids: list, sizes: bytes, tokens: bytes, words: bytes, order: int):
        self.ids = ids
        self.sizes = _unzip(sizes, np.uint32).astype(np.int64) + 1
        self.starts = starts_of(self.sizes)
        n = int(self.starts[-1])
        self.token = np.ones(n, dtype=bool)
        self.token[self.starts[:-1]] = False
        one = np.full(n, _START, dtype=np.uint64)
        one[self.token] = _unzip(words, np.uint64)[_unzip(tokens, np.uint32)]
        train = np.repeat(np.array([fold(x) != HELD_OUT for x in ids], dtype=bool), self.sizes)
        offset = np.arange(n) - np.repeat(self.starts[:-1], self.sizes)
        self.hashes, self.at, self.counts, self.valid = [], [], [], []
        value = one
        for k in range(order):
            if k:
                value = _mixed(np.concatenate([value[:1], value[:-1]]), one)
            valid = offset >= k
            hashes, at = np.unique(value[valid], return_inverse=True)
            full = np.zeros(n, dtype=np.int64)
            full[valid] = at
            self.hashes.append(hashes)
            self.at.append(full)
            self.valid.append(valid)
            self.counts.append(np.bincount(at[train[valid]], minlength=len(hashes)).astype(np.uint32))


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (context * _MIX) ^ word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _borders(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where the parts of the hash range begin in sorted hashes."""
    part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def gram_counts(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """(order, part, block, counts, types): for each block the corpus counts of
    its n-grams in a part, in the order of their hashes. `types` is the number
    of the part's n-grams seen in training, in one row of the part."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row["doc_ids"], row["sizes"], row["tokens"], row["words"], order)
                for k in range(order):
                    borders = _borders(grams.hashes[k], parts)
                    full = np.flatnonzero(np.diff(borders))
                    pieces = [slice(borders[p], borders[p + 1]) for p in full]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(full), k, dtype=np.int32)), pa.array(full.astype(np.int32)),
                        pa.array(np.full(len(full), row["block"], dtype=np.int64)),
                        pa.array([_zip_sorted(grams.hashes[k][s]) for s in pieces], pa.binary()),
                        pa.array([_zip(grams.counts[k][s]) for s in pieces], pa.binary())], names=["order", "part", "block", "hashes", "counts"])

    def add(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        hashes = [_unzip_sorted(x) for x in rows["hashes"]]
        _, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([_unzip(x, np.uint32) for x in rows["counts"]])).astype(np.uint64)
        starts = starts_of(np.array([len(x) for x in hashes]))
        answers = [_zip(total[at[a:b]]) for a, b in zip(starts[:-1], starts[1:])]
        types = np.zeros(len(rows), dtype=np.int64)
        types[0] = int((total > 0).sum())
        return pd.DataFrame({"order": key[0], "part": key[1], "block": rows["block"], "counts": answers, "types": types})

    sent = blocks.select("block", "doc_ids", "sizes", "tokens", "words").mapInArrow(
        send, "order int, part int, block long, hashes binary, counts binary")
    return sent.groupBy("order", "part").applyInPandas(add, "order int, part int, block long, counts binary, types long")


# --- the automaton ------------------------------------------------------------------

class Automaton:
    """The part of the backoff automaton that a block's texts pass through."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, types: int, prior: float):
        self.grams, self.counts = grams, counts
        self.arcs = [np.log10((counts[0] + 1.0) / (tokens + types + 1.0))]
        self.fails = [np.log10(prior / (c + prior)) for c in counts[:-1]]
        for k in range(1, len(counts)):
            # any place of an n-gram shows its context and its suffix
            place = np.zeros(len(counts[k]), dtype=np.int64)
            valid = np.flatnonzero(grams.valid[k])
            place[grams.at[k][valid]] = valid
            context = counts[k - 1][grams.at[k - 1][place - 1]]
            suffix = self._weight(k - 1, place, k - 1)
            self.arcs.append(np.log10((counts[k] + prior * 10.0 ** suffix) / (context + prior)))

    def _weight(self, k: int, place: np.ndarray, state: int) -> np.ndarray:
        """Weight of the token at each place, read in the state of the `state`
        tokens before it: the arc of the longest seen n-gram, after failures."""
        at, counts = self.grams.at, self.counts
        out = np.zeros(len(place))
        open_ = np.ones(len(place), dtype=bool)
        for j in range(k, -1, -1):
            usable = open_ & self.grams.valid[j][place]
            seen = usable & (counts[j][at[j][place]] > 0) if j else open_
            out[seen] += self.arcs[j][at[j][place[seen]]]
            open_ &= ~seen
            fails = open_ & usable
            if j:
                out[fails] += self.fails[j - 1][at[j - 1][place[fails] - 1]]
        return out

    def traverse(self) -> np.ndarray:
        """log10 probability of each token, in order."""
        place = np.flatnonzero(self.grams.token)
        return self._weight(len(self.counts) - 1, place, len(self.counts) - 1)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, doc_id: str = "doc_id", text: str = "text",
          block_tokens: int = BLOCK_TOKENS, part_grams: int = PART_GRAMS) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (unigrams with one added) and score (the model's)."""
    blocks = cut(token_blocks(docs, doc_id, text, block_tokens))
    sums = blocks.agg(F.sum("n_tokens").alias("n"), F.sum("train_tokens").alias("train"), F.sum("train_docs").alias("docs")).first()
    train, train_docs = sums["train"] or 0, sums["docs"] or 0
    answers = cut(gram_counts(blocks, order, max(1, -(-(sums["n"] or 0) // part_grams))))
    types = answers.filter("order = 0").agg(F.sum("types")).first()[0] or 0
    types -= train_docs > 0  # the start mark is no token

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row["doc_ids"], row["sizes"], row["tokens"], row["words"], order)
                counts: list[list] = [[] for _ in range(order)]
                for answer in sorted(row["answers"], key=lambda a: (a["order"], a["part"])):
                    counts[answer["order"]].append(_unzip(answer["counts"], np.uint64))
                whole = [np.concatenate(c).astype(np.float64) if c else np.zeros(0) for c in counts]
                weights = Automaton(grams, whole, train, types, prior).traverse()
                own = whole[0][grams.at[0][grams.token]]
                first = starts_of(grams.sizes - 1)[:-1]
                base = np.log10((own + 1.0) / (train + types + 1.0))
                yield pa.RecordBatch.from_arrays([
                    pa.array(grams.ids, pa.int64()), pa.array([fold(x) == HELD_OUT for x in grams.ids]), pa.array(grams.sizes - 1),
                    pa.array(np.add.reduceat((own > 0).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)),
                    pa.array(np.add.reduceat(weights, first))], names=[x.split()[0] for x in _SCORED.split(", ")])

    gathered = answers.groupBy("block").agg(F.collect_list(F.struct("order", "part", "counts")).alias("answers"))
    scored = blocks.join(gathered, "block").select("doc_ids", "sizes", "tokens", "words", "answers").mapInArrow(traverse, _SCORED)
    return scored.withColumn("train_tokens", F.lit(train).cast("long"))
