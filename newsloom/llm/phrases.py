"""Phrase collocations, found by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), split at SEPARATORS into pieces and these into words.
Everything is per language. A phrase of 2 to `longest` words that occurs at least
`least` times is a candidate; cut after k words it scores 2000000 a / (l + r), a, l
and r being the occurrences of the phrase and of its two parts, and the lowest of
its cuts counts.

Fingerprints. Tasks pack texts into blocks of word numbers. With prefix
polynomials over the words' hashes, P[i] = sum of hash[j] B^j for j < i (mod 2^64),
the n-gram at i has the fingerprint (P[i + n] - P[i]) B^-i, mixed with the language:
one subtraction and one product for every place. A block names its distinct
fingerprints with their counts and learns which reach `least` in the whole table
(`dealing`): words and pairs of words first, then longer n-grams at the places
where all pairs do. The occurrence pointer of a fingerprint is the block and its
place in the block's sorted list, so it needs no bytes on the way, and the answer
returns along it.

Strings. Of the blocks that name a frequent fingerprint the first is told the total,
and it alone makes the n-gram a string; so a phrase is one row however many blocks
hold it, and rows grow with the phrases.

Verification. Every block sums a second hash of the words, of all occurrences of
frequent fingerprints of a size, and takes off what the n-grams that it made strings
would give. Over all blocks nothing is left if the occurrences of each fingerprint
are one n-gram. Otherwise that size is counted by text: every block compares its
occurrences word by word with the first one, different n-grams of one fingerprint
part there, and their strings are summed over the table.

Defined results: a null text has no words, a null language is `und`. Repeated rows
count each. Ties in score go by count, then by phrase in UTF-8 byte order. A very
long text makes its block longer. `docs` may have any other columns. An empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.llm.common import LOWER, join_counted, starts_of, text_bytes
from newsloom.llm.dealing import answer, block_size, parts_for, reached, store_blocks
from newsloom.llm.lm import _unzip, _zip
from newsloom.session import cut

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
LONGEST, LEAST, TOP, ABSORB = 4, 30, 2000, 80
BLOCK_WORDS, MOST_WORDS = 2_000_000, 32_000_000
#: A-Z to a-z, and every separator to a full stop.
_MARKED = bytes(0x2E if b in SEPARATORS else LOWER[b] for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)

_BLOCK = "block long, langs array<string>, lang_words array<bigint>, lang_of binary, sizes binary, tokens binary, words binary"


# --- blocks ---------------------------------------------------------------------------

def word_blocks(docs: DataFrame, block_words: int, lang: str = "lang", text: str = "text") -> DataFrame:
    """Texts as numbers of the block's own words; 0 ends a piece."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        seen: dict[bytes, int] = {b".": 0}
        langs: dict[str, int] = {}
        rows, held = [], 0
        for batch in batches:
            for one, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = [seen.setdefault(w, len(seen)) for w in text_bytes(value).translate(_MARKED).replace(b".", b" . ").split()]
                rows.append((langs.setdefault(one, len(langs)), np.array([*tokens, 0], dtype=np.uint32)))
                held += len(tokens) + 1
                if held >= block_words:
                    yield _block(number, langs, rows, seen)
                    number, seen, langs, rows, held = number + 1, {b".": 0}, {}, [], 0
        if rows:
            yield _block(number, langs, rows, seen)

    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).mapInArrow(make, _BLOCK)


def _block(number: int, langs: dict, rows: list[tuple], seen: dict) -> pa.RecordBatch:
    lang_of = np.array([x for x, _ in rows], dtype=np.uint32)
    counts = np.zeros(len(langs), dtype=np.int64)
    np.add.at(counts, lang_of, np.array([int((t > 0).sum()) for _, t in rows]))
    row = [[number], [list(langs)], [counts], [_zip(lang_of)], [_zip(np.array([len(t) for _, t in rows], dtype=np.uint32))],
           [_zip(np.concatenate([t for _, t in rows]))], [zstandard.ZstdCompressor(level=3).compress(b" ".join(seen))]]
    kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in _BLOCK.split(", ")])


class Grams:
    """The n-grams of a block: prefix polynomials, and where n words stand together."""

    def __init__(self, row: dict):
        self.tokens = _unzip(row["tokens"], np.uint32).astype(np.int64)
        self.words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b" ")
        self.langs = row["langs"]
        self.lang = np.repeat(_unzip(row["lang_of"], np.uint32), _unzip(row["sizes"], np.uint32)).astype(np.int64)
        self.answers = row.get("answers")
        n = len(self.tokens)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        self.salt = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 1) for x in self.langs], dtype=np.uint64)
        powers = np.cumprod(np.append(np.uint64(1), np.full(n - 1, _BASE, dtype=np.uint64)), dtype=np.uint64)
        self.back = np.cumprod(np.append(np.uint64(1), np.full(n - 1, _BACK, dtype=np.uint64)), dtype=np.uint64)
        self.prefix = np.append(np.uint64(0), np.cumsum(hashes[self.tokens] * powers, dtype=np.uint64))
        self.known = starts_of(self.tokens > 0)

    def places(self, n: int) -> np.ndarray:
        """Where n words of a piece begin."""
        return np.flatnonzero(self.known[n:] - self.known[:-n] == n) if len(self.tokens) >= n else np.zeros(0, dtype=np.int64)

    def fingerprints(self, places: np.ndarray, n: int) -> np.ndarray:
        value = (self.prefix[places + n] - self.prefix[places]) * self.back[places] ^ self.salt[self.lang[places]]
        value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return value ^ (value >> np.uint64(29))

    def open_places(self, n: int, pairs: np.ndarray | None) -> np.ndarray:
        """The places of n-grams that may be frequent: those of words and pairs, and
        of longer ones those where all pairs of neighbours are."""
        places = self.places(n)
        return places if n <= 2 else places[np.all([pairs[places + k] for k in range(n - 1)], axis=0)]

    def frequent_pairs(self) -> np.ndarray:
        """Per place whether the pair that begins there was told to be frequent."""
        out = np.zeros(len(self.tokens) + 1, dtype=bool)
        places = self.places(2)
        if len(places):
            _, at = np.unique(self.fingerprints(places, 2), return_inverse=True)
            out[places] = answer(self.answers, 2)[at] > 0
        return out


def _named(row: dict, orders: range) -> list:
    """The distinct fingerprints of a block and how often they occur."""
    grams = Grams(row)
    pairs = grams.frequent_pairs() if orders[0] > 2 else None
    out = []
    for n in orders:
        values, counts = np.unique(grams.fingerprints(grams.open_places(n, pairs), n), return_counts=True)
        if len(values):
            out.append((n, values, counts))
    return out


# --- counts by text -------------------------------------------------------------------

_GRAM = "lang string, phrase string, size int, n long"


def _strings(grams: Grams, n: int, pairs: np.ndarray) -> Iterator[tuple[str, str, int]]:
    """(language, phrase, occurrences) in a block of the n-grams whose fingerprint
    was told to be frequent, told apart by their words."""
    places = grams.open_places(n, pairs)
    if not len(places):
        return
    values, first, at = np.unique(grams.fingerprints(places, n), return_index=True, return_inverse=True)
    shown = places[first]
    keep = answer(grams.answers, n)[at] > 0
    places, at = places[keep], at[keep]
    same = grams.lang[places] == grams.lang[shown[at]]
    for k in range(n):
        same &= grams.tokens[places + k] == grams.tokens[shown[at] + k]
    counts = np.bincount(at[same], minlength=len(values))
    some = np.flatnonzero(counts)
    found = [(int(grams.lang[p]), tuple(grams.tokens[p:p + n].tolist()), c) for p, c in zip(shown[some].tolist(), counts[some].tolist())]
    collided = Counter((int(grams.lang[p]), tuple(grams.tokens[p:p + n].tolist())) for p in places[~same].tolist())
    for lang, words, count in [*found, *((*key, c) for key, c in collided.items())]:
        yield grams.langs[lang], b" ".join([grams.words[w] for w in words]).decode("utf-8", "surrogatepass"), count


def _witness(grams: Grams, places: np.ndarray, n: int) -> np.ndarray:
    """A second hash of the n-grams at `places`, from their words and language."""
    words = np.fromiter((xxhash.xxh64_intdigest(w, 2) for w in grams.words), np.uint64, len(grams.words))
    value = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 3) for x in grams.langs], dtype=np.uint64)[grams.lang[places]]
    for k in range(n):
        value = (value ^ words[grams.tokens[places + k]]) * np.uint64(0x94D049BB133111EB)
        value ^= value >> np.uint64(31)
    return value


def _elected(grams: Grams, n: int, pairs: np.ndarray) -> tuple[list[tuple[str, str, int]], int]:
    """(language, phrase, occurrences in the table) of the frequent n-grams that this
    block was told to name, and what is left of its second hashes, as a signed number."""
    places = grams.open_places(n, pairs)
    if not len(places):
        return [], 0
    _, first, at = np.unique(grams.fingerprints(places, n), return_index=True, return_inverse=True)
    total = answer(grams.answers, ~n, np.uint64)
    mine = np.flatnonzero(total)
    shown = places[first[mine]]
    seen = _witness(grams, places[answer(grams.answers, n)[at] > 0], n).sum(dtype=np.uint64)
    left = (int(seen) - int((_witness(grams, shown, n) * total[mine]).sum(dtype=np.uint64))) % (1 << 64)
    rows = [(grams.langs[grams.lang[p]], b" ".join([grams.words[w] for w in grams.tokens[p:p + n]]).decode("utf-8", "surrogatepass"), c)
            for p, c in zip(shown.tolist(), total[mine].tolist())]
    return rows, left - (1 << 64) if left >> 63 else left


def _rows(rows: list[tuple], n: int) -> pa.RecordBatch:
    columns = [list(x) for x in zip(*rows)]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(np.full(len(rows), n, dtype=np.int32)),
                                       pa.array(columns[2], pa.int64())], names=["lang", "phrase", "size", "n"])


def named_phrases(told: DataFrame, sizes: range) -> DataFrame:
    """(lang, phrase, size, n): every frequent phrase once, with its count, and a row
    without phrase a block and size, with what is left of the block's second hashes."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grams = Grams(batch.slice(i, 1).to_pylist()[0])
                pairs = grams.frequent_pairs()
                for n in sizes:
                    rows, left = _elected(grams, n, pairs)
                    yield _rows([*rows, (None, None, left)], n)

    return told.mapInArrow(name, _GRAM)


def phrases_by_text(told: DataFrame, sizes: list[int], least: int) -> DataFrame:
    """(lang, phrase, size, n) of the frequent phrases, summed by their text."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grams = Grams(batch.slice(i, 1).to_pylist()[0])
                pairs = grams.frequent_pairs()
                for n in sizes:
                    rows = list(_strings(grams, n, pairs))
                    if rows:
                        yield _rows(rows, n)

    return told.mapInArrow(strings, _GRAM).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, lang: str = "lang", text: str = "text",
             block_words: int | None = None, by_text: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n): the phrases of 1 to `longest` words that occur at
    least `least` times, with their exact counts; and (lang, n): all words. Sizes in
    `by_text` are counted by text whether or not fingerprints collide."""
    total = (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 5  # words, about
    block_words = block_words or block_size(total, BLOCK_WORDS, MOST_WORDS)
    blocks = store_blocks(word_blocks(docs, block_words, lang, text), total // block_words)
    packed = blocks.select("block", "langs", "lang_of", "sizes", "tokens", "words")
    short, long = range(1, min(longest, 2) + 1), range(3, longest + 1)
    told = cut(reached(packed, lambda row: _named(row, short), parts_for(total), (least,), True))
    if long:
        more = reached(packed.join(told, "block"), lambda row: _named(row, long), parts_for(total), (least,), True).withColumnRenamed("answers", "more")
        every = F.concat("answers", F.coalesce("more", F.slice("answers", 1, 0)))
        told = cut(told.join(more, "block", "left").select("block", every.alias("answers")))
    told = packed.join(told, "block")
    named = cut(named_phrases(told, range(1, longest + 1)))
    left = named.filter("phrase is null").groupBy("size").agg(F.sum(F.col("n").cast("decimal(38, 0)")).alias("n")).collect()
    again = sorted({*by_text, *(r["size"] for r in left if int(r["n"]) % (1 << 64))})
    counted = named.filter(F.col("phrase").isNotNull() & (F.col("n") >= least))
    if again:
        counted = cut(counted.filter(~F.col("size").isin(again)).unionByName(phrases_by_text(told, again, least)))
    words = blocks.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(
        F.sum("x.lang_words").alias("n"))
    return counted, words


# --- collocations ---------------------------------------------------------------------

def _part(first: Column, size: Column) -> Column:
    """The phrase of `size` words from word `first` (0 is the first) in `w`."""
    return F.array_join(F.slice("w", first + 1, size), " ")


def _sequence(first: int, last: Column) -> Column:
    return F.sequence(F.lit(first), last)


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int | None = TOP, absorb: int = ABSORB, lang: str = "lang",
         text: str = "text", block_words: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top`
    collocations. A candidate goes when a longer one that holds its words has at
    least `absorb` percent of its occurrences."""
    counted, words = frequent(docs, longest, least, lang, text, block_words)
    several = counted.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    name = lambda part: F.concat("lang", F.lit("\t"), part)  # noqa: E731  no word holds a tab
    k = F.col("k")
    halves = F.array(F.struct(F.lit(True).alias("left"), name(_part(F.lit(0), k)).alias("part")),
                     F.struct(F.lit(False).alias("left"), name(_part(k, F.col("size") - k)).alias("part")))
    cuts = several.select("*", F.explode(_sequence(1, F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.explode(halves).alias("x")).select("lang", "phrase", "a", "k", "x.left", "x.part")
    cuts = cut(cuts)
    uses = cuts.groupBy("part").agg(F.count("*").alias("n"))
    counts = cut(counted.select(name(F.col("phrase")).alias("part"), F.col("n").alias("f")).join(uses, "part"))
    both = join_counted(cuts, counts, "part").groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    scored = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    inner = several.filter("size > 2").select("lang", "a", "w", "size", F.explode(_sequence(2, F.col("size") - 1)).alias("s")).select(
        "lang", "a", "w", "s", F.explode(_sequence(0, F.col("size") - F.col("s"))).alias("i"))
    longer = inner.groupBy("lang", _part(F.col("i"), F.col("s")).alias("phrase")).agg(F.max("a").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(19, 0)")
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (wide("most") * 100 < wide("a") * absorb))
    kept = kept.select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    window = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(window))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
