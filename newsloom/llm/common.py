"""What the training-data operators share.

Rows are named by a key over id and text, because an id may be missing or
repeated. Rows that agree in id and text are one document: they get the same
result, once per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A-Z to a-z and nothing else, as operators are defined.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The same, and every ASCII byte that is neither digit nor letter to a space.
#: All bytes of longer UTF-8 sequences stay, so a word is `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER)


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def lower_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z: `split` cuts at exactly these bytes."""
    return text_bytes(text).translate(LOWER).split()


def plain_words(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, lower-cased."""
    return text_bytes(text).translate(PLAIN).split()


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit name of a row. The type marker keeps a null apart from a shift."""
    return F.xxhash64(F.col(doc_id), F.col(doc_id).isNull(), F.col(text), F.col(text).isNull())


def lists(rows: list, kind: pa.DataType) -> pa.Array:
    return pa.array(rows, type=pa.list_(kind))


def map_rows(df: DataFrame, make, schema: str) -> DataFrame:
    """`mapInArrow` with a function from one record batch to a dict of columns
    (or None for no rows); the batch bounds what a task holds."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = make(batch)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays(
                        [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in
                         (columns[n] for n in names)], names=names)

    return df.mapInArrow(run, schema)


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive pieces with the given lengths."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def row_name(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 128-bit name of a row; a null is apart from every value."""
    given = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.when(F.col(text).isNull(), "-").otherwise("+"), F.coalesce(F.col(text), F.lit("")))
    return F.unhex(F.md5(given))


def join_counted(rows: DataFrame, table: DataFrame, on: str, share: int = 1000) -> DataFrame:
    """`rows` joined to a stored table with one row a key, whose column `n` counts
    the key's rows. Keys that hold over 1 / `share` of them are `share` at most, so
    they are broadcast and their rows stay where they are; the others are shuffled."""
    most = (table.agg(F.sum("n")).first()[0] or 0) // share
    heavy, light = table.filter(F.col("n") > most), table.filter(F.col("n") <= most)
    common = rows.join(F.broadcast(heavy), on)
    rare = rows.join(F.broadcast(heavy.select(on)), on, "left_anti").join(light, on)
    return common.unionByName(rare)
