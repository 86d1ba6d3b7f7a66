"""Byte-level BPE over a table of distinct words.

Texts are split into words as the tokenizer's own splitter does. The words of
the largest counts, at most `frequent` of them, make a table of bounded size
that goes to every task, and a text becomes the ranks of its words in it. All
other occurrences are brought together by word (none of them is frequent, so no
key is hot), each distinct word is encoded once, and its ids return to their
places in the texts by row and position. Decoding looks every id up in the id-to-piece table,
whose size is that of the vocabulary, and joins the pieces' bytes.

Ids are carried as little-endian unsigned 32-bit integers in one binary value.

Defined results: a null text is empty and has no ids. Strings of special tokens
inside a text get their special id. Repeated rows get equal results. Bytes that
are no UTF-8 decode to U+FFFD. A very long text is one row of ids. `docs` may have
any other columns. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm.common import map_rows, row_key
from newsloom.session import cut

FREQUENT = 1 << 19      # most words that go to every task
STRETCH = 300_000       # distinct words that a task counts at once


def vocabulary_text(path: str | None = None) -> str:
    """The tokenizer file; by default the public byte-level one of 50k pieces."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


# --- splitting -----------------------------------------------------------------

_TAIL = "'s|'t|'re|'ve|'m|'ll|'d"


def _ranges(inside: Callable[[str], bool]) -> str:
    """A character class of the basic plane, as ranges."""
    out, first = [], None
    for code in range(0x10001):
        hit = code < 0x10000 and not 0xD800 <= code < 0xE000 and inside(chr(code))
        if hit and first is None:
            first = code
        elif not hit and first is not None:
            out.append(f"\\u{first:04x}-\\u{code - 1:04x}")
            first = None
    return "".join(out)


def word_pattern(pieces: Callable[[str], list]) -> re.Pattern:
    """The splitter's expression for texts of the basic plane. Its letters, numbers
    and spaces are those of the library's own Unicode tables, which `pieces`
    shows: one piece for "a" or "1" with a character of its class."""
    letters = _ranges(lambda c: len(pieces("a" + c)) == 1)
    numbers = _ranges(lambda c: len(pieces("1" + c)) == 1)
    known = re.compile(f"[{letters}{numbers}]")
    # two spaces and a word are three pieces, two signs and a word are two
    spaces = " " + _ranges(lambda c: c != " " and not known.match(c) and len(pieces(c + c + "a")) == 3)
    return re.compile(f" ?[{letters}]++|{_TAIL}| ?[{numbers}]++| ?[^{spaces}{letters}{numbers}]++|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


class Vocabulary:
    """Special tokens and pieces of a tokenizer file."""

    def __init__(self, text: str):
        data = json.loads(text)
        if data["normalizer"] or data["pre_tokenizer"]["type"] != "ByteLevel" or data["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level vocabularies without a normalizer are known")
        self.text = text
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        found = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None
        plain = {chr(c): b for b, c in _byte_chars().items()}
        vocab = {i: p for p, i in data["model"]["vocab"].items()}
        self.pieces = [b""] * (max([*vocab, *self.special.values()]) + 1)
        for i, p in vocab.items():
            self.pieces[i] = bytes(plain[c] for c in p)
        for p, i in self.special.items():
            self.pieces[i] = p.encode("utf-8")
        self._plane = word_pattern(self._tokenizer().pre_tokenizer.pre_tokenize_str)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_held"}

    def _tokenizer(self):
        """The library's tokenizer, held by this object: it goes with it, so that a
        resting worker does not keep it."""
        if "_held" not in self.__dict__:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
            from tokenizers import Tokenizer

            self._held = Tokenizer.from_str(self.text)
        return self._held

    def split_words(self, text: str | None) -> list[str]:
        """The words of a text that holds no special token."""
        if not text:
            return []
        if text.isascii() or max(text) <= "\uffff":
            return self._plane.findall(text)
        return [text[a:b] for _, (a, b) in self._tokenizer().pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str | None) -> list[str]:
        """Words and special tokens, in order."""
        if not text:
            return []
        if self._special is None or not self._special.search(text):
            return self.split_words(text)
        out: list[str] = []
        for n, part in enumerate(self._special.split(text)):
            out += [part] if n % 2 else self.split_words(part)
        return out

    def encoder(self) -> Callable[[list[str]], list[list[int]]]:
        tokenizer = self._tokenizer()
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda words: [x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


@cache
def _byte_chars() -> dict[int, int]:
    """The printable stand-in of every byte: itself if printable Latin, else the
    next free code point from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: b for b in own}, **{b: 256 + n for n, b in enumerate(rest)}}


@cache
def _vocabulary(text: str | None) -> Vocabulary:
    return Vocabulary(text or vocabulary_text())


# --- the words of the largest counts ---------------------------------------------------

def word_counts(docs: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """(word, n) of the words that stand twice or more in some stretch of a
    partition; stretches end when they hold `STRETCH` strings. In texts with
    single spaces only, the strings between them are counted and each distinct
    one is split into words once. These counts choose the table that every task
    gets; what they leave out is looked up like any rare word."""
    sent = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # strings after a space, strings that begin a line, and words
        after, first, words = Counter(), Counter(), Counter()
        for batch in batches:
            for value in filter(None, batch.column(0).to_pylist()):
                if _WIDE.search(value):
                    words.update(sent.value.split(value))
                else:
                    lines = [x.split(" ") for x in value.split("\n")]
                    words["\n"] += len(lines) - 1
                    first.update(x[0] for x in lines)
                    for x in lines:
                        after.update(x[1:])
                if len(after) + len(first) + len(words) > STRETCH:
                    yield _counted(after, first, words, sent.value)
                    after, first, words = Counter(), Counter(), Counter()
        yield _counted(after, first, words, sent.value)

    words = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


_WIDE = re.compile("  |[\t\r\x0b\x0c]")


def _counted(after: Counter, first: Counter, words: Counter, vocabulary: Vocabulary) -> pa.RecordBatch:
    for before, found in ((" ", after), ("", first)):
        for string, n in found.items():
            for word in vocabulary.split(before + string):
                words[word] += n
    several = {w: n for w, n in words.items() if n > 1}
    return pa.RecordBatch.from_arrays([pa.array(list(several), pa.string()), pa.array(list(several.values()), pa.int64())], names=["word", "n"])


def frequent_words(counts: DataFrame, vocabulary: str | None = None, most: int = FREQUENT) -> pa.Table:
    """(word, ids) of the words of the largest counts, at most `most`, by falling
    count. Counts are grouped by sixteenths of a power of two to find the least
    one."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = {r["s"]: (r["c"], r["least"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("c"), F.min("n").alias("least")).collect()}
    total, least = 0, 1 << 62
    for s in sorted(sizes, reverse=True):
        total += sizes[s][0]
        if total > most:
            break
        least = sizes[s][1]
    sent = counts.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))

    def encode(batch: pa.RecordBatch) -> dict:
        ids = sent.value.encoder()(batch.column(0).to_pylist())
        return {"word": batch.column(0), "n": batch.column(1), "ids": _packed(ids)}

    table = map_rows(counts.filter(F.col("n") >= least).select("word", "n"), encode, "word string, n long, ids binary").toArrow()
    return table.sort_by([("n", "descending"), ("word", "ascending")]).select(["word", "ids"]).combine_chunks()


def _packed(ids: list[list[int]]) -> pa.Array:
    return pa.array([np.array(x, dtype="<u4").tobytes() for x in ids], pa.binary())


# --- encoding and decoding ----------------------------------------------------------

def with_table(df: DataFrame, sent, column: str, make: Callable, schema: str) -> DataFrame:
    """`map_rows` with what `column` of the broadcast table gives. It is built for
    a task and goes with it, so that a resting worker keeps only the table's
    compact form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, table = sent.value
        known = ({w: n for n, w in enumerate(table["word"].to_pylist(), 1)} if column == "word"
                 else [b"", *table["ids"].to_pylist()])
        names = [x.split()[0] for x in schema.split(",")]
        for batch in batches:
            columns = make(batch, vocabulary.split, known)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str | None = None, frequent: int = FREQUENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_id, ids) for every row of `docs`."""
    counts = cut(word_counts(docs, vocabulary, text))
    sent = docs.sparkSession.sparkContext.broadcast((_vocabulary(vocabulary), frequent_words(counts, vocabulary, frequent)))
    rows = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def rare(batch: pa.RecordBatch, split: Callable, ranks: dict[str, int]) -> dict:
        """The words that are not in the table that every task has."""
        keys, places, words = [], [], []
        for key, value in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            found = [w for w in split(value) if w not in ranks]
            keys += [key] * len(found)
            places += range(len(found))
            words += found
        return {"key": pa.array(keys, pa.int64()), "place": pa.array(places, pa.int32()), "word": pa.array(words, pa.string())}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Encodes each word of the sorted rows once, for all its places."""
        encode = sent.value[0].encoder()
        last, last_ids = None, b""
        for batch in batches:
            words = batch.column("word").to_pylist()
            new = list(dict.fromkeys(words))
            if last in new:
                new.remove(last)  # the batch before ended with it
            known = {last: last_ids, **dict(zip(new, (np.array(x, dtype="<u4").tobytes() for x in encode(new))))}
            if words:
                last, last_ids = words[-1], known[words[-1]]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("place"), pa.array([known[w] for w in words], pa.binary())],
                                             names=["key", "place", "ids"])

    def ranked(batch: pa.RecordBatch, split: Callable, ranks: dict[str, int]) -> dict:
        """Each text as the ranks of its words, 0 for a rare one."""
        packer, packed = zstandard.ZstdCompressor(level=3), []
        for value in batch.column("text").to_pylist():
            found = [ranks.get(w, 0) for w in split(value)]
            planes = np.array(found, dtype="<u4").view(np.uint8).reshape(len(found), 4).T
            packed.append(packer.compress(planes.tobytes()))
        return {"key": batch.column("key"), "doc_id": batch.column("doc_id"), "packed": pa.array(packed, pa.binary())}

    def fill(batch: pa.RecordBatch, split: Callable, table: list[bytes]) -> dict:
        unpacker, out = zstandard.ZstdDecompressor(), []
        for packed, found in zip(batch.column("packed").to_pylist(), batch.column("found").to_pylist()):
            planes = np.frombuffer(unpacker.decompress(packed), dtype=np.uint8)
            ranks = np.ascontiguousarray(planes.reshape(4, len(planes) // 4).T).view("<u4").reshape(-1)
            parts = list(map(table.__getitem__, ranks.tolist()))
            gaps = np.flatnonzero(ranks == 0).tolist()
            # repeated rows bring their words several times; a place counts once
            words = {f["place"]: f["ids"] for f in found or ()}
            if len(words) != len(gaps):
                raise ValueError(f"{len(gaps)} words to fill in, {len(words)} came back")
            for n, at in enumerate(gaps):
                parts[at] = words[n]
            out.append(b"".join(parts))
        return {"key": batch.column("key"), "doc_id": batch.column("doc_id"), "ids": pa.array(out, pa.binary())}

    missing = with_table(rows, sent, "word", rare, "key long, place int, word string")
    found = missing.repartition("word").sortWithinPartitions("word").mapInArrow(look_up, "key long, place int, ids binary").groupBy("key").agg(
        F.collect_list(F.struct("place", "ids")).alias("found"))
    whole = with_table(rows, sent, "word", ranked, "key long, doc_id long, packed binary").join(found, "key", "left")
    return with_table(whole.select("key", "doc_id", "packed", "found"), sent, "ids", fill, "key long, doc_id long, ids binary")


def piece_table(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """(id, piece): the vocabulary as a table."""
    pieces = _vocabulary(vocabulary).pieces
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(pieces)), pa.int64()), "piece": pa.array(pieces, pa.binary())}))


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """`encoded` with the text of its ids. The id-to-piece table has the size of
    the vocabulary, so it goes to every task."""
    sent = encoded.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary).pieces)

    def make(batch: pa.RecordBatch) -> dict:
        pieces = sent.value
        texts = [b"".join(map(pieces.__getitem__, np.frombuffer(x, dtype="<u4").tolist())).decode("utf-8", "replace")
                 for x in batch.column("ids").to_pylist()]
        return {"key": batch.column("key"), "doc_id": batch.column("doc_id"), "ids": batch.column("ids"), "text": pa.array(texts, pa.string())}

    return map_rows(encoded.select("key", "doc_id", "ids"), make, "key long, doc_id long, ids binary, text string")
