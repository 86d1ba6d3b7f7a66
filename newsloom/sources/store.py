"""Stored tables: versioned Parquet, upserts, copies, parameterised reads.

Plain Parquet has no in-place update, so a table is a folder of immutable
versions and a small pointer file naming the current one. A write makes a new
version and then moves the pointer; a failed job leaves the old one current.

A table that takes small batches is kept in hash buckets of its key. Its version is
a manifest: for every bucket the write that its files come from. An upsert reads
and writes the buckets its rows fall into, all others keep their files, and the
pointer moves to the new manifest at the end. `vacuum` removes what no manifest
names any more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from newsloom.functions import expr as e
from newsloom.operators.ranking import global_rank, keep_first
from newsloom.session import cut

WRITTEN = ["title", "content", "summary", "url", "source", "category", "published_at", "author",
           "read_count", "comment_count", "tags", "created_at", "updated_at"]
COMPARED = ["content", "title", "summary"]


# --- versioned tables --------------------------------------------------------

def _pointers(spark: SparkSession, path: str):
    """The pointer files of a table by number, and its file system. A pointer
    `_at-<number>` holds the name of a version; the highest one counts."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/_at-*")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(pattern) or []
    return {int(x.getPath().getName().removeprefix("_at-")): x.getPath() for x in found}, fs


def current_version(spark: SparkSession, path: str) -> str | None:
    pointers, fs = _pointers(spark, path)
    if not pointers:
        return None
    stream = fs.open(pointers[max(pointers)])
    try:
        return stream.readUTF()
    finally:
        stream.close()


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    version = current_version(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/{version}")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write a new version and make it current; returns its name. The new pointer
    appears under a higher number by one rename, before the old one goes: a stop
    at any point leaves the old version or the new one."""
    version = f"v-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{path}/{version}")
    _switch(df.sparkSession, path, version)
    return version


def _switch(spark: SparkSession, path: str, version: str) -> None:
    pointers, fs = _pointers(spark, path)
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    staged = named(f"{path}/_next-{version}")
    stream = fs.create(staged, True)
    try:
        stream.writeUTF(version)
    finally:
        stream.close()
    if not fs.rename(staged, named(f"{path}/_at-{max(pointers, default=0) + 1:012d}")):
        raise RuntimeError(f"another writer changed {path} at the same time")
    for old in pointers.values():
        fs.delete(old, False)


# --- bucketed tables ---------------------------------------------------------

BUCKET = "_bucket"


def _in_bucket(key: str, count: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def manifest(spark: SparkSession, path: str) -> dict | None:
    """{key, buckets, schema, top, parts: {bucket: write}} of the current version."""
    name = current_version(spark, path)
    if name is None:
        return None
    rows = spark.read.option("wholetext", "true").text(f"{path}/{name}").collect()  # one small file
    return json.loads(rows[0]["value"])


def read_buckets(spark: SparkSession, path: str, only: list[int] | None = None, held: dict | None = None) -> DataFrame | None:
    """The current version, or its given buckets; the others are not listed."""
    held = held or manifest(spark, path)
    if held is None:
        return None
    schema = StructType.fromJson(held["schema"])
    parts = [f"{path}/{write}/{BUCKET}={b}" for b, write in held["parts"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def write_buckets(df: DataFrame, path: str, key: str, count: int = 64, top: int = 0, touched: list[int] | None = None) -> dict:
    """Write rows in buckets of their key and make them current. With `touched`
    the rows replace those buckets and the others stay as they are. `top` is kept
    in the manifest. Returns the new manifest."""
    spark = df.sparkSession
    old = manifest(spark, path) if touched is not None else None
    if old is not None:
        key, count, top = old["key"], old["buckets"], max(old["top"], top)
    write = f"v-{uuid.uuid4().hex}"
    df.withColumn(BUCKET, _in_bucket(key, count)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{write}")
    fs, named = _files(spark, path)
    made = [x.getPath().getName().removeprefix(f"{BUCKET}=") for x in fs.globStatus(named(f"{path}/{write}/{BUCKET}=*")) or []]
    parts = {b: w for b, w in (old["parts"] if old else {}).items() if int(b) not in (touched or [])}
    parts.update({b: write for b in made})
    new = {"key": key, "buckets": count, "schema": df.schema.jsonValue(), "top": top, "parts": parts}
    name = f"manifest-{uuid.uuid4().hex}.json"
    stream = fs.create(named(f"{path}/{name}"), False)
    try:
        stream.write(bytearray(json.dumps(new), "utf-8"))
    finally:
        stream.close()
    _switch(spark, path, name)
    return new


def _files(spark: SparkSession, path: str):
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return named(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), named


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the files that the current manifest does not name; returns how many
    folders went. Run it when no reader holds an older version."""
    held, name = manifest(spark, path), current_version(spark, path)
    fs, named = _files(spark, path)
    current = {(write, b) for b, write in held["parts"].items()}
    writes = {write for write, _ in current}
    gone = 0
    for found in fs.globStatus(named(f"{path}/manifest-*")) or []:
        if found.getPath().getName() != name:
            fs.delete(found.getPath(), False)
    for found in fs.globStatus(named(f"{path}/v-*")) or []:
        write = found.getPath().getName()
        if write not in writes:
            gone += fs.delete(found.getPath(), True)
            continue
        for part in fs.globStatus(named(f"{path}/{write}/{BUCKET}=*")) or []:
            if (write, part.getPath().getName().removeprefix(f"{BUCKET}=")) not in current:
                gone += fs.delete(part.getPath(), True)
    return gone


def upsert_buckets(path: str, batch: DataFrame, now, order: str = "pos", count: int = 64) -> DataFrame:
    """`upsert_articles` into a bucketed table; returns the rows it wrote, with
    `action`. Rows of the batch are compared with the buckets of their ids only;
    buckets in which nothing changes keep their files."""
    spark = batch.sparkSession
    held = manifest(spark, path)
    last = cut(last_of_batch(batch, order))
    if held is None:
        target, top, touched = spark.createDataFrame([], batch.drop(order).schema), 0, None
    else:
        near = _numbers(last, held)
        top, target = held["top"], read_buckets(spark, path, near, held)
        changed = classify_batch(target, last).filter("action <> 'skip'")
        touched = _numbers(changed, held)
        target = read_buckets(spark, path, touched, held)
        last = last.filter(_in_bucket(held["key"], held["buckets"]).isin(touched) if touched else F.lit(False))
    merged = cut(_merged(target, last, now, top))
    written = merged.filter("action is not null")
    if touched is None or touched:
        # the largest id that a batch gave is known from its own rows
        top = max(top, merged.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
        write_buckets(merged.drop("action"), path, "article_id", count, top, touched)
    return written


def _numbers(rows: DataFrame, held: dict) -> list[int]:
    """The buckets that rows fall into: as many numbers as buckets at most."""
    return [r[0] for r in rows.select(_in_bucket(held["key"], held["buckets"])).distinct().collect()]


# --- upserts -----------------------------------------------------------------

def last_of_batch(batch: DataFrame, order: str = "pos") -> DataFrame:
    """One row per article_id; the last one in the batch wins."""
    return keep_first(batch, ["article_id"], [F.desc(order)])


def _digest(value) -> Column:
    return F.unhex(F.sha2(value, 256))


def classify_batch(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch rows with `action`: insert, update, or skip when content, title
    and summary are unchanged. Both sides bring digests (SHA-256), so the target's
    texts are not shuffled, and the batch's only if they are asked for."""
    old = target.select("article_id", F.lit(True).alias("_known"), *[_digest(F.col(c)).alias(f"_old_{c}") for c in COMPARED])
    new = batch.select("*", *[_digest(e.text_or_empty(c)).alias(f"_new_{c}") for c in COMPARED])
    joined = new.join(old, "article_id", "left")
    same = F.lit(True)
    for c in COMPARED:
        same = same & F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}"))
    action = F.when(F.col("_known").isNull(), "insert").when(same, "skip").otherwise("update")
    return joined.withColumn("action", action).select(*batch.columns, "action")


def upsert_articles(target: DataFrame, batch: DataFrame, now, order: str = "pos", top: int | None = None) -> DataFrame:
    """Target after the batch, with `action` per written row (null for rows the
    batch did not write). Changed rows keep id and hotness_score; new ones get
    ids after the largest one (`top`, if it is known), without gaps."""
    return _merged(target, last_of_batch(batch, order), now, top)


def _merged(target: DataFrame, last: DataFrame, now, top: int | None) -> DataFrame:
    """`upsert_articles` for a batch with one row an article_id."""
    rows = classify_batch(target, last).filter("action <> 'skip'")
    stamp = e.iso(e.as_time(now))
    rows = rows.withColumn("updated_at", stamp)
    keep = target.select("article_id", F.col("id").alias("_id"), F.col("hotness_score").alias("_hot"))
    # new ids are given to names alone; the texts meet them where they already lie by name
    value = F.lit(top) if top is not None else target.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")).scalar()
    unnumbered = rows.select("article_id").join(target.filter("id is not null").select("article_id"), "article_id", "left_anti")
    given = global_rank(unnumbered, [F.asc("article_id")], "_nth").select("article_id", (F.col("_nth") + value).alias("_given"))
    merged = rows.drop("id", "hotness_score").join(keep, "article_id", "left").join(given, "article_id", "left").select(
        F.coalesce("_id", "_given").alias("id"), "article_id", *WRITTEN,
        F.coalesce("_hot", F.lit(0.0)).alias("hotness_score"), "action")
    untouched = target.join(rows.select("article_id"), "article_id", "left_anti").select(
        "id", "article_id", *WRITTEN, "hotness_score", F.lit(None).cast("string").alias("action"))
    return untouched.unionByName(merged)


def written_count(result: DataFrame) -> DataFrame:
    return result.groupBy("action").agg(F.count("*").alias("n")).filter("action is not null")


def upsert_analysis(target: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per article, the newest of both tables; the batch wins ties."""
    both = target.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return keep_first(both, ["article_id"], [F.desc("created_at"), F.desc("_new")]).drop("_new")


# --- copies ------------------------------------------------------------------

def copy_table(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Target with the source's rows whose key it lacks."""
    fresh = keep_first(source.join(target.select(key), key, "left_anti"), [key], [F.asc(key)])
    return target.unionByName(fresh.select(*target.columns))


def copy_tables(spark: SparkSession, source: str, target: str, keys: dict[str, str]) -> None:
    """Append to every table under `target` the rows of the same table under
    `source` whose key it lacks; a table that does not exist yet is copied."""
    for name, key in keys.items():
        rows, have = read_table(spark, f"{source}/{name}"), read_table(spark, f"{target}/{name}")
        if rows is not None:
            write_table(rows if have is None else copy_table(rows, have, key), f"{target}/{name}")


def reconcile(source: DataFrame, target: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: counts of both tables, rows only in one of them, rows whose
    content differs, and whether both are equal."""
    def hashed(df, name):
        return df.select(key, F.lit(True).alias(f"_in_{name}"), F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias(f"_h_{name}"))

    both = hashed(source, "a").join(hashed(target, "b"), key, "full_outer")
    a, b = F.col("_in_a").isNotNull(), F.col("_in_b").isNotNull()
    counts = both.agg(
        F.count_if(a).alias("source_rows"), F.count_if(b).alias("target_rows"),
        F.count_if(a & ~b).alias("only_source"), F.count_if(b & ~a).alias("only_target"),
        F.count_if(a & b & (F.col("_h_a") != F.col("_h_b"))).alias("different"))
    return counts.withColumn("equal", (F.col("only_source") + F.col("only_target") + F.col("different")) == 0)


def reconcile_counts(sources: dict[str, DataFrame], targets: dict[str, DataFrame]) -> DataFrame:
    """(table, source_rows, target_rows, equal) for every table."""
    rows = None
    for name, source in sources.items():
        n, m = source.agg(F.count("*").alias("n")).scalar(), targets[name].agg(F.count("*").alias("n")).scalar()
        one = source.sparkSession.range(1).select(F.lit(name).alias("table"), n.alias("source_rows"), m.alias("target_rows"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("equal", F.col("source_rows") == F.col("target_rows"))


def dual_write(batch: DataFrame, primary: Callable[[DataFrame], None], secondary: Callable[[DataFrame], None],
               warn: Callable[[str], None] = print) -> bool:
    """Write to both stores. A primary failure propagates; a secondary one only
    warns. The batch is held for both writes, so it is computed once."""
    held = batch.persist()
    try:
        primary(held)
        try:
            secondary(held)
            return True
        except Exception as error:
            warn(f"secondary write failed: {error}")
            return False
    finally:
        held.unpersist()


# --- reads -------------------------------------------------------------------

def query(spark: SparkSession, sql: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Parameterised SQL; frames can be named in the text as {name}."""
    return spark.sql(sql, args=args, **tables)
