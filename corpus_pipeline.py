"""The corpus pipeline: documents in, training tokens out.

Five stages in order: quality rules, line dedup, near-dedup, benchmark
decontamination, byte-pair encoding. Each takes the session, the documents its
predecessor wrote and the folder of the input tables. All but the last return
the columns of the documents: texts shortened by a stage have their length
counted anew, rejected documents are gone. The last returns per document the
ids and their number; what it encodes decodes to the text again.

Documents with null or empty texts fail the quality rules; an empty table goes
through as an empty table; columns besides doc_id, text, source and n_chars are
carried along as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm import bpe, decontaminate, jaccard, line_dedup, near_dup, quality
from newsloom.session import cut, prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted go; lines over the
    limit go from the others."""
    prepare(spark)
    return quality.apply(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of equal or nearly equal lines the first stays."""
    prepare(spark)
    return line_dedup.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the SimHash trie links (2 differing bits)
    stays, then one of each group of near copies by the exact 5-word Jaccard
    similarity of 0.8, most of which lie further apart than 2 bits."""
    prepare(spark)
    return jaccard.drop_near_duplicates(cut(near_dup.drop_near_duplicates(docs)))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows go, and documents that mostly consist of them."""
    prepare(spark)
    return decontaminate.apply(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids (as little-endian unsigned 32-bit integers), their
    number, and digests of the ids and of the text they decode to."""
    prepare(spark)
    rows = bpe.decode(bpe.encode(docs))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("line dedup", lines), ("near duplicates", near_duplicates),
          ("benchmark decontamination", benchmark_passages), ("byte-pair encoding", token_ids)]

#: Edit joins, components and byte-pair encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each reads what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
