"""Rank and keep-first helpers that stay distributed when one key is hot.

* `keep_first` uses `row_number() <= k`; Spark places a partial group limit
  before the shuffle, so a hot key sends at most k rows per input partition.
* `global_rank` numbers a whole table without a single-task window: rows are
  range partitioned, numbered inside their partition, and shifted by the sizes
  of the partitions before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.session import cut


def keep_first(df: DataFrame, keys: list, order: list, k: int = 1) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= k).drop("_rn")


def page(df: DataFrame, order: list, limit: int | None, offset: int = 0) -> DataFrame:
    """One page of a total order; a top-k, not a full sort."""
    ordered = df.orderBy(*order)
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def attach(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row, as a scalar subquery."""
    value = row.select(F.struct(*row.columns).alias("_row")).scalar()
    return df.withColumn("_row", value).select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in row.columns])


def with_total(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """Attach the number of rows of `counted` to every row of a page."""
    return attach(rows, counted.agg(F.count("*").alias("total")))


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """1-based position of every row in the total order `order`."""
    placed = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition, so this window is as small as the partition count
    shifts = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_shift"),
    )
    return (
        placed.join(F.broadcast(shifts), "_part")
        .withColumn(name, F.col("_shift") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_shift")
    )


def previous_where(df: DataFrame, keys: list[str], at: str, tie: str, flag: Column,
                   name: str, bucket_seconds: int = 3600) -> DataFrame:
    """For each row the latest time `at` of an earlier row of the same key for
    which `flag` holds. A key's rows are cut into time buckets; only one
    summary row per bucket crosses them, so a hot key spreads over tasks."""
    marked = df.withColumn("_mark", F.when(flag, F.col(at))).withColumn(
        "_bucket", F.floor(F.unix_seconds(at) / bucket_seconds)
    )
    last = marked.groupBy(*keys, "_bucket").agg(F.max("_mark").alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*keys, "_bucket", F.max("_last").over(across).alias("_carry"))
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        marked.withColumn("_inside", F.max("_mark").over(inside))
        .join(carry, [*keys, "_bucket"])
        .withColumn(name, F.coalesce("_inside", "_carry"))
        .drop("_mark", "_bucket", "_inside", "_carry")
    )
