"""Entity graph as tables: facts (mentions and relations per article) and the
nodes and edges merged from them. Extraction responses are an input table
(id, article_id, title, source, published_at, entities_text, relations_text)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsloom import fixed_values as fv
from newsloom.functions import expr as e
from newsloom.operators import listing
from newsloom.operators.ranking import attach, keep_first, page
from newsloom.session import cut

SHOWN_REFS = 50   # articles listed with a node; its ref_count counts all
GUESSED = 5       # names on either side of guessed relations
RELATION_TYPE = "array<struct<source:string,target:string,relation:string,description:string>>"


@dataclass
class Graph:
    mentions: DataFrame  # id, article_id, title, source, published_at, content_hash, pos, entity, norm
    relations: DataFrame  # id, article_id, pos, src, dst, relation, description, created_at
    nodes: DataFrame
    edges: DataFrame


# --- reading responses -------------------------------------------------------

def entity_list(response, most: int | None = None) -> Column:
    """Entity names of one response: trimmed lines longer than one character
    without function characters, the first `most` of them if it is given."""
    lines = F.transform(F.split(e.text_or_empty(response), "\n"), lambda x: F.trim(x))
    clean = F.filter(lines, lambda x: (F.length(x) > 1) & ~e.contains_any(x, fv.ENTITY_FUNCTION_CHARS, fold=False))
    return clean if most is None else F.slice(clean, 1, most)


def normalize_entity(name, longest_first: bool = False) -> Column:
    """Name without bracketed parts and without one company suffix."""
    bare = F.regexp_replace(e.col(name), r"[（(][^)）]*[)）]", "")
    suffixes = sorted(fv.ENTITY_SUFFIXES, key=len, reverse=True) if longest_first else fv.ENTITY_SUFFIXES
    rule = None
    for suffix in suffixes:
        fits = bare.endswith(suffix) & (F.length(bare) > len(suffix) + 1)
        cut = F.substring(bare, F.lit(1), F.length(bare) - len(suffix))
        rule = F.when(fits, cut) if rule is None else rule.when(fits, cut)
    return F.trim(rule.otherwise(bare))


def parse_entities(responses: DataFrame, most: int | None = None) -> DataFrame:
    keep = [c for c in ("id", "article_id", "title", "source", "published_at", "content_hash") if c in responses.columns]
    return responses.select(*keep, F.posexplode(entity_list("entities_text", most)).alias("pos", "entity")).withColumn(
        "norm", normalize_entity("entity"))


def parse_relations(responses: DataFrame, created_at: str = "", most: int | None = None) -> DataFrame:
    """Relations of every response: its JSON array if it is one, else the
    pairs of the first five and the next five entities; the first `most` if it
    is given."""
    names = entity_list("entities_text")
    text = F.trim(e.text_or_empty("relations_text"))
    listed = F.when(text.startswith("["), F.from_json(text, RELATION_TYPE))
    guessed = F.flatten(F.transform(F.slice("_names", 1, GUESSED), lambda a: F.transform(
        F.slice("_names", GUESSED + 1, GUESSED), lambda b: F.struct(
            a.alias("source"), b.alias("target"), F.lit(fv.FALLBACK_RELATION).alias("relation"),
            F.lit(fv.FALLBACK_DESCRIPTION).alias("description")))))
    guessed = F.filter(guessed, lambda r: r["source"] != r["target"]).cast(RELATION_TYPE)
    found = F.coalesce(listed, guessed)
    chosen = F.when(F.size("_names") >= 2, found if most is None else F.slice(found, 1, most))
    return responses.withColumn("_names", names).select(
        "id", "article_id", F.posexplode(chosen).alias("pos", "r")
    ).select("id", "article_id", "pos", F.col("r.source").alias("src"), F.col("r.target").alias("dst"),
             F.coalesce("r.relation", F.lit("RELATED")).alias("relation"),
             F.coalesce("r.description", F.lit("")).alias("description"), F.lit(created_at).alias("created_at"))


# --- merging -----------------------------------------------------------------

def merge_nodes(mentions: DataFrame, created_at: str = "", shown: int = SHOWN_REFS) -> DataFrame:
    """One node per normalised name, shown as first seen. `ref_count` is the
    number of articles that mention it; the last `shown` of them are listed."""
    first = keep_first(mentions, ["norm"], [F.asc("id"), F.asc("pos")]).select(
        "norm", F.col("entity").alias("name"), "article_id", "title", "source")
    refs = mentions.groupBy("norm", "article_id").agg(F.min("id").alias("seq"), F.first("content_hash").alias("hash"))
    recent = keep_first(refs, ["norm"], [F.desc("seq")], shown).groupBy("norm").agg(
        F.array_sort(F.collect_list(F.struct("seq", "article_id", "hash"))).alias("r"))
    counts = refs.groupBy("norm").agg(F.count("*").cast("int").alias("ref_count"))
    return first.join(recent, "norm").join(counts, "norm").select(
        "name", "norm", F.lit("entity").alias("type"), "article_id", "title", "source",
        F.lit(created_at).alias("created_at"),
        F.transform("r", lambda x: x["article_id"]).alias("ref_articles"), "ref_count",
        F.element_at("r", -1)["hash"].alias("content_hash"))


def merge_edges(relations: DataFrame) -> DataFrame:
    """One edge per ordered pair of names; the last relation wins."""
    usable = relations.filter(
        (e.text_or_empty("src") != "") & (e.text_or_empty("dst") != "") & (F.col("src") != F.col("dst")))
    return keep_first(usable, ["src", "dst"], [F.desc("id"), F.desc("pos")]).select(
        "src", "dst", "relation", "description", "article_id", "created_at")


def add_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends that no response listed become bare nodes."""
    ends = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()
    bare = ends.join(nodes.select("name"), "name", "left_anti")
    return nodes.unionByName(bare.withColumn("norm", normalize_entity("name")), allowMissingColumns=True)


def with_hash(responses: DataFrame, a: DataFrame) -> DataFrame:
    """Responses with the hash of the article they belong to."""
    body = F.concat(e.text_or_empty("title"), e.text_or_empty("content"), e.text_or_empty("summary"))
    return responses.join(a.select("article_id", F.md5(body).alias("content_hash")), "article_id")


def build_graph(responses: DataFrame, created_at: str = "") -> Graph:
    """A graph from nothing; `responses` carries content_hash."""
    mentions = cut(parse_entities(responses))
    relations = cut(parse_relations(responses, created_at))
    edges = merge_edges(relations)
    return Graph(mentions, relations, add_endpoints(merge_nodes(mentions, created_at), edges), edges)


def classify_articles(graph: Graph, batch: DataFrame) -> DataFrame:
    """Batch rows with `state` new, changed or same by content hash."""
    known = graph.mentions.select("article_id", F.col("content_hash").alias("_old")).distinct()
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col("content_hash"), "changed").otherwise("same")
    return batch.join(known, "article_id", "left").withColumn("state", state).drop("_old")


def incremental_graph(graph: Graph, batch: DataFrame, budget: int | None = None, created_at: str = "") -> tuple[Graph, DataFrame]:
    """(graph, processed): new articles are added, changed ones replace what
    they said before. A node disappears only with its last mention. `budget` is
    the number of calls left; an article takes two. Only the names touched are
    merged again."""
    todo = classify_articles(graph, batch).filter("state <> 'same'")
    if budget is not None:
        todo = page(todo, [F.asc("id")], max(budget // 2, 0))
    todo = cut(todo)
    changed = todo.filter("state = 'changed'").select("article_id")
    fresh_mentions, fresh_relations = cut(parse_entities(todo)), cut(parse_relations(todo, created_at))
    mentions = graph.mentions.join(changed, "article_id", "left_anti").unionByName(fresh_mentions)
    relations = graph.relations.join(changed, "article_id", "left_anti").unionByName(fresh_relations)
    touched = fresh_mentions.select("norm").union(
        graph.mentions.join(changed, "article_id", "left_semi").select("norm")).distinct()
    listed = graph.nodes.filter(F.col("type").isNotNull())
    nodes = listed.join(touched, "norm", "left_anti").unionByName(
        merge_nodes(mentions.join(touched, "norm", "left_semi"), created_at))
    pairs = fresh_relations.select("src", "dst").union(
        graph.relations.join(changed, "article_id", "left_semi").select("src", "dst")).distinct()
    edges = graph.edges.join(pairs, ["src", "dst"], "left_anti").unionByName(
        merge_edges(relations.join(pairs, ["src", "dst"], "left_semi")))
    return Graph(mentions, relations, add_endpoints(nodes, edges), edges), todo.select("id", "article_id", "state")


# --- storage -----------------------------------------------------------------

PARTS = ("mentions", "relations", "nodes", "edges")


def save_graph(graph: Graph, path: str) -> None:
    for part in PARTS:
        getattr(graph, part).write.mode("overwrite").parquet(f"{path}/{part}")


def load_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(*[spark.read.parquet(f"{path}/{part}") for part in PARTS])


# --- questions ---------------------------------------------------------------

def graph_statistics(graph: Graph) -> DataFrame:
    counts = attach(graph.nodes.agg(F.count("*").alias("nodes")), graph.edges.agg(F.count("*").alias("edges")))
    n = F.col("nodes")
    return counts.withColumns({
        "is_directed": F.lit(True), "is_multigraph": F.lit(False),
        "density": F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(0.0)})


def degrees(graph: Graph) -> DataFrame:
    """(name, in_degree, out_degree) of every node. Each edge counts at both
    ends in one aggregate."""
    ends = graph.edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    counted = ends.groupBy("name").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return graph.nodes.select("name").join(counted, "name", "left").na.fill(0, ["in_degree", "out_degree"])


def graph_info(graph: Graph, nodes: int = 20, edges: int = 10) -> dict[str, DataFrame]:
    return {
        "stats": graph_statistics(graph),
        "nodes": page(graph.nodes.select("name"), [F.asc("name")], nodes),
        "edges": page(graph.edges.select("src", "dst"), [F.asc("src"), F.asc("dst")], edges),
    }


def neighbours(graph: Graph, entities: DataFrame, k: int = 5) -> DataFrame:
    """(name, dst, relation, description, rn): at most k outgoing edges each."""
    mine = graph.edges.join(entities.select(F.col("name").alias("src")), "src", "left_semi")
    order = [F.asc("dst")]
    rn = F.row_number().over(Window.partitionBy("src").orderBy(*order))
    return mine.withColumn("rn", rn).filter(F.col("rn") <= k).select(
        F.col("src").alias("name"), "dst", "relation", "description", "rn")


def entity_info(graph: Graph, name: str, k: int = 5) -> DataFrame:
    """One row: attributes, first relations and degrees of an entity."""
    node = graph.nodes.filter(F.col("name") == name)
    deg = degrees(Graph(graph.mentions, graph.relations, node,
                        graph.edges.filter((F.col("src") == name) | (F.col("dst") == name))))
    related = neighbours(graph, node, k).groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct("rn", "dst", "relation", "description"))).alias("related"))
    return node.join(deg, "name").join(related, "name", "left")


def relevant_entities(graph: Graph, question: str, k: int = 20) -> DataFrame:
    """Names found in the question, best known first; if there are none, the
    best known names."""
    named = F.contains(F.lower(F.lit(question)), F.lower(F.col("name")))
    ranked = page(graph.nodes.withColumn("named", named),
                  [F.desc("named"), F.desc(F.coalesce("ref_count", F.lit(0))), F.asc("name")], k)
    any_named = F.max("named").over(Window.partitionBy(F.lit(1)))  # at most k rows
    return ranked.withColumn("_any", any_named).filter(F.col("named") | ~F.col("_any")).select(
        "name", "named", F.coalesce("ref_count", F.lit(0)).alias("ref_count"))


def mentions_any(a: DataFrame, entities: DataFrame) -> DataFrame:
    """Articles that contain one of the names (a ranked list, short by
    `relevant_entities`), ignoring case."""
    listed = entities.agg(F.collect_list(F.lower("name")).alias("_names"))
    body = F.lower(F.concat(e.text_or_empty("title"), F.lit(" "), e.text_or_empty("content")))
    return attach(a, listed).withColumn("_body", body).filter(
        F.exists("_names", lambda n: F.contains(F.col("_body"), n))).drop("_names", "_body")


def collect_context(graph: Graph, a: DataFrame, entities: DataFrame, now: str, start: str | None = None,
                    end: str | None = None, news: int = 20, max_parts: int = 3) -> DataFrame:
    """One row with the text a question is answered from: what the graph says
    on up to ten entities, then the latest articles that mention one, the first
    `max_parts` parts."""
    named = page(entities, [F.desc("ref_count"), F.asc("name")], 10)
    lines = neighbours(graph, named, 5).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rn", F.concat(
        F.lit("  - 和 '"), F.col("dst"), F.lit("' 的关系: "), F.coalesce("relation", F.lit("关联")), F.lit("\n")
    ).alias("line")))).alias("l"))
    facts = named.join(lines, "name", "left").select(
        F.lit(0).alias("kind"), F.struct((-F.col("ref_count")).alias("n"), F.col("name").alias("s")).alias("seq"),
        F.concat(F.lit("实体 '"), F.col("name"), F.lit("' 的相关信息:\n"), F.coalesce(
            F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit(""))).alias("part"))
    latest = page(a.withColumn("_score", e.latest_score("published_at", "hotness_score", "tags", now)),
                  [F.desc("_score"), F.asc("id")], news).drop("_score")
    at = e.parse_time("published_at")
    if start:
        latest = latest.filter(at >= e.as_time(start))
    if end:
        latest = latest.filter(at < F.date_add(F.to_date(F.lit(end)), 1).cast("timestamp"))
    told = mentions_any(latest, entities).select(
        F.lit(1).alias("kind"),
        F.struct((-F.unix_seconds(at)).cast("int").alias("n"), F.lpad(F.col("id").cast("string"), 20, "0").alias("s")).alias("seq"),
        F.concat(F.lit("新闻标题: "), e.text_or_empty("title"), F.lit("\n新闻摘要: "),
                 e.text_or_empty("summary"), F.lit("\n")).alias("part"))
    parts = page(facts.unionByName(told), [F.asc("kind"), F.asc("seq")], max_parts)
    return parts.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("kind", "seq", "part"))), lambda x: x["part"]), "\n\n").alias("context"))


def entity_articles(graph: Graph, a: DataFrame, name: str) -> DataFrame:
    """Articles that mention the entity, found by normalised name."""
    refs = graph.mentions.filter(F.col("norm") == normalize_entity(F.lit(name))).select("article_id")
    return a.join(refs, "article_id", "left_semi")


def entity_timeline(graph: Graph, a: DataFrame, name: str, now: str, days: int = 7, most_lines: int | None = None) -> DataFrame:
    """One row (entity, days, article_count, summary, lines): the entity's
    recent articles in order. One article is its own summary; more are listed,
    the first `most_lines` if it is given, for a later summary."""
    rows = listing.within_days(entity_articles(graph, a, name), now, days)
    line = F.concat(F.lit("- ["), F.substring("published_at", 1, 10), F.lit("] "), e.text_or_empty("title"),
                    F.lit(": "), F.substring(e.first_filled("summary", "content"), 1, 100))
    entry = F.struct("published_at", "id", line.alias("line"), e.first_filled("summary", "title").alias("own"))
    return rows.agg(F.count("*").alias("article_count"), F.array_sort(F.collect_list(entry)).alias("r")).select(
        F.lit(name).alias("entity"), F.lit(days).alias("days"), "article_count",
        F.when(F.col("article_count") == 1, F.element_at("r", 1)["own"]).otherwise("").alias("summary"),
        F.when(F.col("article_count") > 1, F.array_join(F.transform(
            "r" if most_lines is None else F.slice("r", 1, most_lines), lambda x: x["line"]), "\n")).otherwise("").alias("lines"))
