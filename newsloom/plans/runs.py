"""The recurring runs: one arriving batch, and the daily refresh. All tables
live under one root folder as versioned Parquet."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.operators import dedup, graph as gr, hotness as hot, keywords as kw, listing, search, stats
from newsloom.plans.analyze import batch_analyze
from newsloom.schemas import ANALYSIS_SCHEMA, ARTICLE_SCHEMA, conform
from newsloom.session import cut
from newsloom.sources import store
from newsloom.streaming import dedup as seen


@dataclass
class Run:
    """Settings of the runs over the tables under `root`."""

    root: str
    rule: str = "full"
    media_sources: list[str] = field(default_factory=lambda: list(listing.fv.MEDIA_SOURCES))
    exclude: list[str] = field(default_factory=lambda: list(listing.fv.EXCLUDED_SOURCES))
    analysis: dict = field(default_factory=dict)
    buckets: int = 64

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, spark: SparkSession, name: str, schema=None) -> DataFrame | None:
        found = store.read_table(spark, self.path(name))
        if found is None and schema is not None:
            return spark.createDataFrame([], schema)
        return found

    def articles(self, spark: SparkSession) -> DataFrame:
        """The stored articles with the scores of the last daily run, which are a
        table of their own."""
        found = store.read_buckets(spark, self.path("articles"))
        if found is None:
            return spark.createDataFrame([], ARTICLE_SCHEMA)
        scores = self.table(spark, "scores")
        return found if scores is None else hot.apply_hotness(found, scores).select(*found.columns)

    def arrive(self, batch: DataFrame, now, responses: DataFrame | None = None, version: int = 1,
               budget: int | None = None) -> dict[str, int]:
        """One arriving batch: near duplicates, repeated URLs and texts seen
        lately are dropped; the rest is upserted, indexed, analysed, paged, and
        merged into the graph when extraction responses are given. Each step
        writes its table before the next reads it."""
        spark = batch.sparkSession
        incoming = cut(conform(batch, ARTICLE_SCHEMA).withColumn("id", F.coalesce("id", F.monotonically_increasing_id())))
        known = self.table(spark, "fingerprints")
        stored = (dedup.fingerprints(incoming, self.rule).filter("fp is null").select("fp") if known is None
                  else dedup.valid_fingerprints(known, now, self.rule))
        stages = cut(dedup.dedup_stages(incoming, stored, self.rule))
        kept = cut(incoming.join(stages.filter("stage is null").select("id"), "id", "left_semi"))
        written = store.upsert_buckets(self.path("articles"), kept.withColumn("pos", F.col("id")), now, count=self.buckets).drop("action")
        seen.remember(kept, self.path("fingerprints"), now, self.rule)
        articles = self.articles(spark)
        self._index(spark, written, version)
        analysis = self.table(spark, "analysis", ANALYSIS_SCHEMA)
        fresh = cut(batch_analyze(articles, analysis, now, **self.analysis))
        store.write_table(store.upsert_analysis(analysis, fresh), self.path("analysis"))
        store.write_table(listing.materialize_pages(articles, now, self.media_sources, exclude=self.exclude), self.path("pages"))
        if responses is not None:
            self._graph(spark, responses.join(written.select("article_id"), "article_id", "left_semi"), articles, budget)
        total = stages.count()
        return {"collected": total, "kept": kept.count(), "written": written.count(), "analysed": fresh.count()}

    def _index(self, spark: SparkSession, written: DataFrame, version: int) -> None:
        postings = self.table(spark, "postings")
        index = search.build_index(written, version) if postings is None else search.update_index(
            self.load_index(spark), written, version)
        self._save_index(index)

    def _save_index(self, index: search.Index) -> None:
        for name, frame in search.stored_form(index).items():
            store.write_table(frame, self.path(name))

    def load_index(self, spark: SparkSession) -> search.Index:
        return search.Index(*[self.table(spark, name) for name in ("postings", "docs", "variants")])

    def _graph(self, spark: SparkSession, responses: DataFrame, articles: DataFrame, budget: int | None) -> None:
        hashed = gr.with_hash(responses.drop("content_hash"), articles)
        if self.table(spark, "graph_nodes") is None:
            graph = gr.build_graph(hashed)
        else:
            old = gr.Graph(*[self.table(spark, f"graph_{p}") for p in gr.PARTS])
            graph, _ = gr.incremental_graph(old, hashed, budget)
        parts = {p: cut(getattr(graph, p)) for p in gr.PARTS}
        for name, frame in parts.items():
            store.write_table(frame, self.path(f"graph_{name}"))

    def daily(self, spark: SparkSession, now, events: DataFrame | None = None, due: int = 100) -> dict[str, DataFrame]:
        """Daily refresh: analysis of what is missing, category counts, corpus
        keywords, index check and repair, reader activity, old events."""
        articles = self.articles(spark)
        analysis = self.table(spark, "analysis", ANALYSIS_SCHEMA)
        fresh = cut(batch_analyze(articles, analysis, now, **self.analysis))
        store.write_table(store.upsert_analysis(analysis, fresh), self.path("analysis"))
        index = self.load_index(spark)
        missing = cut(search.missing_from_index(articles, index))
        version = index.docs.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"] + 1
        fixed = search.update_index(index, missing, version)
        if search.index_health(fixed, due).first()["compaction_due"]:
            fixed = search.compact(fixed)
        self._save_index(fixed)
        if events is not None:
            store.write_table(hot.hotness(events, now), self.path("scores"))
            store.write_table(hot.purge_events(events, now), self.path("event_log"))
        return {
            "categories": stats.category_counts(articles),
            "keywords": kw.corpus_keywords(articles, F.col("content")),
            "lag": missing.agg(F.count("*").alias("lag")),
            "analysed": fresh.agg(F.count("*").alias("n")),
        }
