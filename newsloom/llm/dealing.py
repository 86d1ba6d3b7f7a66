"""Hashes counted over all blocks of a table, with the answer sent back.

A block is a stored row that packs many texts. It names each of its distinct
hashes once, with a weight. The hashes are dealt by range to parts, a part adds
up the weights of all blocks, and every block learns for each of its hashes how
many of the given levels the total reaches. A hash that very many texts share is one entry
a block, so no key is hot; a part holds about as many hashes as a block.

With total hashes T, blocks and parts of sqrt(PIECE * T) hashes keep the pieces
that travel between them at PIECE hashes, so `block_size` lets blocks grow with
the square root of the input between two bounds.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import starts_of
from newsloom.llm.lm import _borders, _unzip, _unzip_sorted, _zip, _zip_sorted
from newsloom.session import checkpoint_dir

PIECE, PART = 256, 2_000_000
MOST_BUCKETS = 4096
_SENT = "order int, part int, block long, hashes binary, weights binary"


def store_blocks(blocks: DataFrame, count: int, key: str = "block") -> DataFrame:
    """Blocks written once as a table in buckets of their number (`key`), in the
    shared folder. Whatever is joined to them by number comes to the buckets; the
    blocks themselves are never shuffled. `count` is about how many blocks there are."""
    spark, name = blocks.sparkSession, f"blocks_{uuid.uuid4().hex}"
    writer = blocks.write.bucketBy(max(1, min(count, MOST_BUCKETS)), key).sortBy(key)
    writer.option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def block_size(total: int, least: int, most: int, piece: int = PIECE) -> int:
    """How much of `total` a block holds."""
    return int(min(most, max(least, math.sqrt(piece * max(total, 1)))))


def parts_for(total: int, piece: int = PIECE) -> int:
    """Into how many parts `total` hashes are dealt."""
    return max(1, math.ceil(total / max(PART, math.sqrt(piece * max(total, 1)))))


def reached(blocks: DataFrame, make: Callable[[dict], list], parts: int, levels: tuple[int, ...], elect: bool = False) -> DataFrame:
    """(block, answers) for every block with a hash. `make` gives for a row of
    `blocks` a list of (order, sorted distinct hashes, weights); orders are counted
    apart. `levels` ascend. `answer` reads the result. With `elect` there is a
    second answer in order ~order, an unsigned 64-bit number: the total of a hash that
    reaches the first level in the block of the smallest number that names it, else 0."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                for order, hashes, weights in make(row):
                    borders = _borders(hashes, parts)
                    full = np.flatnonzero(np.diff(borders))
                    pieces = [slice(borders[p], borders[p + 1]) for p in full]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(full), order, dtype=np.int32)), pa.array(full.astype(np.int32)),
                        pa.array(np.full(len(full), row["block"], dtype=np.int64)),
                        pa.array([_zip_sorted(hashes[s]) for s in pieces], pa.binary()),
                        pa.array([_zip(weights[s].astype(np.uint32)) for s in pieces], pa.binary())],
                        names=["order", "part", "block", "hashes", "weights"])

    def add(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        hashes = [_unzip_sorted(x) for x in rows["hashes"]]
        _, first, at = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([_unzip(x, np.uint32) for x in rows["weights"]]))
        starts = starts_of(np.array([len(x) for x in hashes]))
        level = np.searchsorted(np.array(levels), total, side="right").astype(np.uint8)
        told = [(key[0], level[at])]
        if elect:
            own = np.zeros(len(at), dtype=np.uint64)
            own[first] = np.where(level > 0, total, 0).astype(np.uint64)
            told.append((~key[0], own))
        return pd.concat([pd.DataFrame({"order": order, "part": key[1], "block": rows["block"], "values": [
            _zip(x[a:b]) for a, b in zip(starts[:-1], starts[1:])]}) for order, x in told])

    answers = blocks.mapInArrow(send, _SENT).groupBy("order", "part").applyInPandas(
        add, "order int, part int, block long, values binary")
    return gathered(answers)


def gathered(answers: DataFrame) -> DataFrame:
    """(block, answers) from (order, part, block, values)."""
    return answers.groupBy("block").agg(F.collect_list(F.struct("order", "part", "values")).alias("answers"))


def answer(answers: list[dict] | None, order: int, kind=np.uint8) -> np.ndarray:
    """What a block was told of each hash that it named in this order."""
    mine = sorted((a["part"], a["values"]) for a in answers or [] if a["order"] == order)
    return np.concatenate([_unzip(v, kind) for _, v in mine]) if mine else np.zeros(0, dtype=kind)
