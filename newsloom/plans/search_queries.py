"""Driver queries: text index, ranked search, entity graph, metrics, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import fixed_values as fv, views as v
from newsloom.operators import graph as gr, metrics, search as se
from newsloom.operators.ranking import attach
from newsloom.plans.catalog import query

NOW = v.NOW
EN = r"[\p{L}\p{Nd}]{2,}"
POSTINGS = v.with_views(v.SQL_ARTICLES) + f""", fields as (
 select id, 'title' field, regexp_extract_all(lower(title), '{EN}') w from articles
 union all select id, 'content', regexp_extract_all(lower(content), '{EN}') from articles
 union all select id, 'summary', regexp_extract_all(lower(summary), '{EN}') from articles
 union all select id, 'source', regexp_extract_all(lower(source), '{EN}') from articles
 union all select id, 'category', regexp_extract_all(lower(category), '{EN}') from articles),
 post as (select id, field, term, count(*) tf, any_value(flen) field_len from (
   select id, field, unnest(w) term, len(w) flen from fields) group by 1, 2, 3),
 lens as (select field, avg(len(w)) avg_len from fields group by 1) """


def index(spark, sf):
    return se.build_index(v.corpus(spark, sf))


def postings_of(index):
    """What an index holds of each term and field, with sums that depend on every
    document, frequency, length and position."""
    rows = se.posting_rows(index, True)
    places = F.aggregate("positions", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return rows.groupBy("term", "field").agg(
        F.count("*").alias("postings"), F.sum("tf").alias("tokens"), F.sum(F.col("id") * F.col("tf")).alias("by_id"),
        F.sum(F.col("field_len") * F.col("tf")).alias("by_length"), F.sum(places).alias("places"))


PLACES = """, placed as (select id, field, unnest(w) term, generate_subscripts(w, 1) - 1 pos, len(w) flen from fields),
 held as (select id, term, field, count(*) tf, any_value(flen) flen, sum(pos) places from placed group by 1, 2, 3) """
HELD = """select term, field, count(*) postings, sum(tf)::bigint tokens, sum(id * tf)::bigint by_id, sum(flen * tf)::bigint by_length,
 sum(places)::bigint places from held"""


@query("index_postings", POSTINGS + PLACES + HELD + " group by 1, 2")
def index_postings(spark, sf):
    return postings_of(index(spark, sf))


def bm25(terms, boosts, where="true"):
    boost = " ".join(f"when '{f}' then {w}::double" for f, w in boosts.items())
    listed = ",".join(f"'{t}'" for t in terms)
    return f""", hit as (select * from post where term in ({listed}) and field in ('title','content','summary')),
 dfs as (select term, field, count(*) df from hit group by 1, 2),
 ranked as (select id, sum((case field {boost} end) * (ln((select count(*) from articles) / (df + 1)) + 1)
     * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * field_len / avg_len))) score
   from hit join dfs using (term, field) join lens using (field) group by id having count(distinct term) = {len(terms)}),
 good as (select r.*, a.article_id from ranked r join articles a using (id) where {where}) """


def page_sql(limit, offset):
    return f"""select id, round(score, 6) score, (select count(*) from good) total from good
 order by round(score, 9) desc, id limit {limit} offset {offset}"""


def hits(df):
    return df.select("id", F.round("score", 6).alias("score"), "total")


@query("search_bm25", POSTINGS + bm25(["the", "tion"], {"title": 2.0, "content": 1.0, "summary": 1.0}) + page_sql(20, 20))
def search_bm25(spark, sf):
    return hits(se.search(index(spark, sf), ["The", "tion"], 2, 20))


@query("search_filtered", POSTINGS + bm25(["de", "la"], {"title": 2.0, "content": 1.0, "summary": 1.0},
                                          "a.category = 'fr'") + page_sql(50, 0))
def search_filtered(spark, sf):
    return hits(se.search(index(spark, sf), ["de", "la"], 1, 50, category="fr"))


@query("search_weighted", POSTINGS + bm25(["und", "der"], {"title": 1.0, "content": 0.4, "summary": 0.2}) + page_sql(50, 0))
def search_weighted(spark, sf):
    return hits(se.search_weighted(index(spark, sf), ["und", "der"], 1, 50))


@query("fuzzy", POSTINGS + """
 select distinct term, q query_term from post, (values ('thea'),('under'),('nation')) v(q)
 where abs(length(term) - length(q)) <= 1 and levenshtein(term, q) <= 1""")
def fuzzy(spark, sf):
    return se.fuzzy_terms(index(spark, sf), ["thea", "under", "nation"])


@query("search_fuzzy", POSTINGS + """, near as (
   select distinct term, q from post, (values ('thea'),('tioning')) v(q) where abs(length(term) - length(q)) <= 1 and levenshtein(term, q) <= 1),
 hit as (select * from post join near using (term) where field in ('title','content','summary')),
 dfs as (select term, field, count(*) df from hit group by 1, 2),
 good as (select id, sum((case field when 'title' then 2.0::double else 1.0::double end) * (ln((select count(*) from articles) / (df + 1)) + 1)
     * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * field_len / avg_len))) score
   from hit join dfs using (term, field) join lens using (field) group by id having count(distinct q) = 2) """ + page_sql(50, 0))
def search_fuzzy(spark, sf):
    return hits(se.search(index(spark, sf), ["thea", "tioning"], 1, 50, fuzzy=1))


def told(condition):
    """The scored words of the query below, in the documents that fit `condition`."""
    return bm25(["the", "and", "tion"], {"title": 2.0, "content": 1.0, "summary": 1.0}).replace(
        "having count(distinct term) = 3", "").replace("where true", f"where {condition}") + f"""
 , texts as (select id, list(' ' || array_to_string(w, ' ') || ' ') t, list_distinct(flatten(list(w))) words
   from fields where field in ('title','content','summary') group by id) """


FITS = """ good2 as (select g.* from good g join texts using (id) where list_contains(words, 'the')
   and (list_contains(words, 'and') or list_contains(words, 'tion')) and not list_contains(words, 'with'))
 select id, round(score, 6) score, (select count(*) from good2) total from good2 order by round(score, 9) desc, id limit 25 offset 25"""


@query("search_boolean", POSTINGS + told("true") + "," + FITS)
def search_boolean(spark, sf):
    asked = se.Query(every=["the"], some=["and", "tion"], none=["with"])
    return hits(se.search(index(spark, sf), asked, 2, 25))


@query("search_phrase", POSTINGS + bm25(["of", "the"], {"title": 2.0, "content": 1.0, "summary": 1.0}) + """
 , texts as (select id, ' ' || array_to_string(w, ' ') || ' ' t from fields where field in ('title','content','summary')),
 good2 as (select * from good where id in (select id from texts where contains(t, ' of the ')))
 select id, round(score, 6) score, (select count(*) from good2) total from good2 order by round(score, 9) desc, id limit 40""")
def search_phrase(spark, sf):
    return hits(se.search(index(spark, sf), se.Query(phrases=[["of", "the"]]), 1, 40))


NEWS = ["title", "content", "summary"]


@query("search_news", POSTINGS + bm25(["the", "tion"], {"title": 2.0, "content": 1.0, "summary": 1.0}) + """
 , pg as (select id, score from good order by round(score, 9) desc, id limit 30)
 select id, false fallback from pg join articles using (id) where source not in ('src0','src2')""")
def search_news(spark, sf):
    found = se.search_news(index(spark, sf), v.corpus(spark, sf), ["the", "tion"], 1, 30, exclude=["src0", "src2"])
    return found.select("id", "fallback")


@query("search_news_fallback", v.with_views(v.SQL_ARTICLES) + """
 select id, true fallback from articles where source not in ('src0','src2') and
   contains(lower(content), 'e th')
 order by published_at desc, id limit 30""")
def search_news_fallback(spark, sf):
    found = se.search_news(index(spark, sf), v.corpus(spark, sf), ["e th"], 1, 30, exclude=["src0", "src2"])
    return found.select("id", "fallback")


def lagging(spark, sf):
    """An index that lacks the last days' articles."""
    a = v.corpus(spark, sf)
    return a, se.build_index(a.filter("published_at < '2024-01-26'"))


@query("index_missing", v.with_views(v.SQL_ARTICLES) + """
 select article_id from articles where published_at >= '2024-01-26'""")
def index_missing(spark, sf):
    a, old = lagging(spark, sf)
    return se.missing_from_index(a, old).select("article_id")


@query("index_lag", v.with_views(v.SQL_ARTICLES) + """
 select count(*) lag, count(*) > 50 warning from articles where published_at >= '2024-01-26'""")
def index_lag(spark, sf):
    a, old = lagging(spark, sf)
    return se.index_lag(a, old)


@query("index_repair", POSTINGS + PLACES + HELD + " group by 1, 2")
def index_repair(spark, sf):
    a, old = lagging(spark, sf)
    return postings_of(se.repair_index(a, old, 1, None))


@query("index_update", v.with_views(v.SQL_ARTICLES) + """
 select count(*) docs, count(*) filter (category = 'de') deleted, round(count(*) filter (category = 'de') * 100
   / (count(*) + count(*) filter (category = 'de')), 2) deleted_pct, count(*) filter (category = 'de') > 100 compaction_due from articles""")
def index_update(spark, sf):
    a = v.corpus(spark, sf)
    return se.index_health(se.update_index(se.build_index(a), a.filter("category = 'de'"), 1))


@query("index_compaction", POSTINGS + PLACES + HELD + " where id not in (select id from articles where category = 'es') group by 1, 2")
def index_compaction(spark, sf):
    a = v.corpus(spark, sf)
    return postings_of(se.compact(se.delete_from_index(se.build_index(a), a.filter("category = 'es'"))))


# --- entity graph ------------------------------------------------------------

RESPONSES = v.with_views(v.SQL_ARTICLES) + """, raw as (
 select id, article_id, title, published_at, published_ts, summary, md5(title || content || summary) h,
   regexp_extract_all(content, '([A-Z][a-z]{3,})', 1) w from articles),
 uniq as (select id, article_id, token entity, min(pos) p from (
   select id, article_id, unnest(w) token, generate_subscripts(w,1) pos from raw) group by 1, 2, 3),
 men as (select *, rn - 1 pos from (select *, row_number() over (partition by id order by p) rn from uniq)),
 rel as (select a.id, a.article_id, a.entity src, b.entity dst, row_number() over (partition by a.id order by a.pos, b.pos) rn
   from men a join men b on a.id = b.id and a.pos < 5 and b.pos between 5 and 9),
 edges as (select src, dst, article_id from (select *, row_number() over (partition by src, dst order by id desc, rn desc) k from rel) where k = 1),
 refs as (select entity, article_id, min(id) seq from men group by 1, 2),
 nodes as (select entity "name", count(*) n from refs group by 1) """


def responses(spark, sf):
    return gr.with_hash(v.entity_responses(spark, sf), v.corpus(spark, sf))


def graph(spark, sf):
    return gr.build_graph(responses(spark, sf))


@query("entity_mentions", RESPONSES + "select id, pos::int pos, entity from men")
def entity_mentions(spark, sf):
    return gr.parse_entities(responses(spark, sf)).select("id", "pos", "entity")


@query("entity_relations", RESPONSES + "select id, (rn - 1)::int pos, src, dst from rel")
def entity_relations(spark, sf):
    return gr.parse_relations(responses(spark, sf)).select("id", "pos", "src", "dst")


@query("graph_nodes", RESPONSES + "select \"name\", n::int ref_count from nodes")
def graph_nodes(spark, sf):
    return graph(spark, sf).nodes.select("name", "ref_count")


@query("graph_edges", RESPONSES + "select src, dst, article_id from edges")
def graph_edges(spark, sf):
    return graph(spark, sf).edges.select("src", "dst", "article_id")


@query("graph_stats", RESPONSES + """
 select (select count(*) from nodes) nodes, (select count(*) from edges) edges, true is_directed, false is_multigraph,
   round((select count(*) from edges) / ((select count(*) from nodes)::double * ((select count(*) from nodes) - 1)), 9) density""")
def graph_stats(spark, sf):
    return gr.graph_statistics(graph(spark, sf)).withColumn("density", F.round("density", 9))


@query("graph_info", RESPONSES + """
 select 'node' kind, "name" a, '' b from (select "name" from nodes order by "name" limit 20)
 union all select 'edge', src, dst from (select src, dst from edges order by src, dst limit 10)""")
def graph_info(spark, sf):
    info = gr.graph_info(graph(spark, sf))
    nodes = info["nodes"].select(F.lit("node").alias("kind"), F.col("name").alias("a"), F.lit("").alias("b"))
    return nodes.union(info["edges"].select(F.lit("edge"), "src", "dst"))


@query("degrees", RESPONSES + """
 select n."name", (select count(*) from edges e where e.dst = n."name") in_degree,
   (select count(*) from edges e where e.src = n."name") out_degree from nodes n""")
def degrees(spark, sf):
    return gr.degrees(graph(spark, sf))


@query("entity_info", RESPONSES + """
 select 'That' "name", (select n::int from nodes where "name" = 'That') ref_count,
   (select count(*) from edges where dst = 'That') in_degree, (select count(*) from edges where src = 'That') out_degree,
   (select string_agg(dst, ' ' order by dst) from (select dst from edges where src = 'That' order by dst limit 5)) related""")
def entity_info(spark, sf):
    row = gr.entity_info(graph(spark, sf), "That")
    return row.select("name", "ref_count", "in_degree", "out_degree",
                      F.array_join(F.transform("related", lambda x: x["dst"]), " ").alias("related"))


@query("neighbours", RESPONSES + """
 select src "name", dst, k::int rn from (select src, dst, row_number() over (partition by src order by dst) k from edges) where k <= 5""")
def neighbours(spark, sf):
    g = graph(spark, sf)
    return gr.neighbours(g, g.nodes).select("name", "dst", "rn")


QUESTION = "What did That and With say about From and This?"


@query("relevant_entities", RESPONSES + f"""
 select "name", n::int ref_count from nodes where contains(lower('{QUESTION}'), lower("name")) order by n desc, "name" limit 20""")
def relevant_entities(spark, sf):
    return gr.relevant_entities(graph(spark, sf), QUESTION).select("name", "ref_count")


@query("entity_news", RESPONSES + f"""
 , named as (select lower("name") q from nodes where contains(lower('{QUESTION}'), lower("name")) order by n desc, "name" limit 20)
 select a.id from articles a where exists (select 1 from named where contains(lower(a.title || ' ' || a.content), q))""")
def entity_news(spark, sf):
    g = graph(spark, sf)
    return gr.mentions_any(v.corpus(spark, sf), gr.relevant_entities(g, QUESTION)).select("id")


@query("graph_context", RESPONSES + f"""
 , named as (select "name", n from nodes where contains(lower('{QUESTION}'), lower("name")) order by n desc, "name" limit 20),
 lines as (select src, string_agg('  - 和 ''' || dst || ''' 的关系: {fv.FALLBACK_RELATION}' || chr(10), '' order by dst) l from (
   select src, dst, row_number() over (partition by src order by dst) k from edges) where k <= 5 group by 1),
 facts as (select row_number() over (order by n desc, "name") k,
   '实体 ''' || "name" || ''' 的相关信息:' || chr(10) || coalesce(l, '') part
   from (select * from named order by n desc, "name" limit 10) left join lines on src = "name"),
 top20 as (select * from articles order by case when published_ts >= timestamp '2024-01-30' then 1.0::double
   when published_ts >= timestamp '2024-01-24' then 0.5::double else 0.1::double end desc, id limit 20),
 told as (select row_number() over (order by published_ts desc, id) + 100 k,
   '新闻标题: ' || title || chr(10) || '新闻摘要: ' || summary || chr(10) part
   from top20 a where published_ts >= timestamp '2024-01-20' and published_ts < timestamp '2024-02-01'
     and exists (select 1 from named where contains(lower(a.title || ' ' || a.content), lower("name"))))
 select string_agg(part, chr(10) || chr(10) order by k) context from (
   select * from (select * from facts union all select * from told) order by k limit 15)""")
def graph_context(spark, sf):
    g = graph(spark, sf)
    return gr.collect_context(g, v.corpus(spark, sf), gr.relevant_entities(g, QUESTION), NOW, "2024-01-20", "2024-01-31", max_parts=15)


@query("timeline", RESPONSES + """
 , kept as (select article_id from refs where entity = 'That'),
 rows as (select a.* from articles a join kept using (article_id) where a.published_ts >= timestamp '2024-01-01')
 select 'That' entity, 30 "days", (select count(*) from rows) article_count, (select string_agg(
   '- [' || substr(published_at,1,10) || '] ' || title || ': ' || substr(case when summary <> '' then summary else content end,1,100), chr(10)
   order by published_at, id) from rows) lines""")
def timeline(spark, sf):
    return gr.entity_timeline(graph(spark, sf), v.corpus(spark, sf), "That", NOW, 30).select(
        "entity", "days", "article_count", "lines")


@query("incremental_graph", RESPONSES + """
 select state, count(*) articles, (select count(*) from nodes) nodes, (select count(*) from edges) edges from (
   select case when published_at >= '2024-01-20' then 'new' else 'changed' end state from raw
   where (published_at >= '2024-01-20' or substr(published_at,1,10) = '2024-01-10') and w <> []) group by 1
 union all select 'new', 0, 0, 0 where false""")
def incremental_graph(spark, sf):
    """The stored graph lacks the latest articles and holds an old text of one
    day's articles; after the update it must equal a graph of all articles."""
    now = responses(spark, sf)
    old = F.col("published_at").startswith("2024-01-10") & (F.col("entities_text") != "")
    before = now.filter("published_at < '2024-01-20'").withColumns({
        "entities_text": F.when(old, F.concat(F.lit("Oldname\n"), F.col("entities_text"))).otherwise(F.col("entities_text")),
        "content_hash": F.when(old, "old").otherwise(F.col("content_hash"))})
    updated, done = gr.incremental_graph(gr.build_graph(before), now.filter("entities_text <> ''"))
    counts = gr.graph_statistics(updated).select("nodes", "edges")
    return attach(done.groupBy("state").agg(F.count("*").alias("articles")), counts)


# Responses that reach the other rules: a relation array instead of guessed pairs
# for every third article, names with a suffix or in brackets for every second one.

def rich_responses(spark, sf):
    rows = responses(spark, sf)
    names = F.filter(F.split("entities_text", "\n"), lambda x: x != "")
    first, second = F.get(names, F.lit(0)), F.get(names, F.lit(1))
    triple = F.to_json(F.array(F.struct(first.alias("source"), second.alias("target"), F.lit("cites").alias("relation")),
                               F.struct(second.alias("source"), second.alias("target"), F.lit("self").alias("relation")),
                               F.struct(second.alias("source"), first.alias("target"), F.lit(None).cast("string").alias("relation"))))
    dressed = F.array_join(F.transform(names, lambda x: F.concat(F.lit(" "), x, F.lit("（x）公司 "))), "\n")
    return rows.withColumns({
        "relations_text": F.when((F.col("id") % 3 == 0) & (F.size(names) >= 2), F.concat(F.lit("  "), triple)).otherwise(F.lit("no list")),
        "entities_text": F.when(F.col("id") % 2 == 1, dressed).otherwise(F.col("entities_text"))})


RICH = RESPONSES + """,
 shown as (select *, case when id % 2 = 1 then entity || '（x）公司' else entity end said from men),
 listed as (select a.id, a.article_id, a.entity src, b.entity dst, k, case k when 0 then 'cites' when 1 then 'self' else 'RELATED' end relation
   from men a join men b on a.id = b.id and a.pos = 0 and b.pos = 1 cross join range(3) r(k) where a.id % 3 = 0),
 turned as (select id, article_id, k rn, relation, case k when 0 then src else dst end src, case k when 2 then src else dst end dst from listed),
 several as (select id from men group by 1 having count(*) >= 2),
 guessed as (select a.id, a.article_id, row_number() over (partition by a.id order by a.pos, b.pos) - 1 rn, '提及关系' relation, a.said src, b.said dst
   from shown a join shown b on a.id = b.id and a.pos < 5 and b.pos between 5 and 9 where a.id % 3 <> 0),
 told as (select * from turned where id in (select id from several) union all by name select * from guessed) """


@query("relations_listed", RICH + "select id, rn::int pos, src, dst, relation from told")
def relations_listed(spark, sf):
    return gr.parse_relations(rich_responses(spark, sf)).select("id", "pos", "src", "dst", "relation")


@query("nodes_normalised", RICH + """
 select entity norm, arg_min(said, (id, pos)) "name", count(distinct id)::int ref_count from shown group by 1""")
def nodes_normalised(spark, sf):
    return gr.merge_nodes(gr.parse_entities(rich_responses(spark, sf))).select("norm", "name", "ref_count")


@query("graph_within_budget", RESPONSES + """
 select id, 'new' state from raw where published_at >= '2024-01-20' and w <> [] order by id limit 25""")
def graph_within_budget(spark, sf):
    """Fifty calls are left, an article takes two; the others wait."""
    now = responses(spark, sf).filter("entities_text <> ''")
    _, done = gr.incremental_graph(gr.build_graph(now.filter("published_at < '2024-01-20'")), now, 51)
    return done.select("id", "state")


# --- metrics and alerts ------------------------------------------------------

LOG = v.with_views(v.SQL_ACCESS)
CRAWL = v.with_views(v.SQL_CRAWL)


@query("request_counts", LOG + 'select "method", path, status, count(*) n from access_log group by 1, 2, 3')
def request_counts(spark, sf):
    return metrics.request_counts(v.access_log(spark, sf))


@query("latency_histogram", LOG + """
 select "method", path, le, count(*) filter (duration_ms <= bound) n, count(*) total, round(sum(duration_ms), 4) sum_ms
 from access_log, (values ('5',5),('10',10),('25',25),('50',50),('100',100),('250',250),('500',500),('1000',1000),
   ('2000',2000),('5000',5000),('+Inf',1e18)) b(le, bound) group by 1, 2, 3""")
def latency_histogram(spark, sf):
    return metrics.latency_histogram(v.access_log(spark, sf)).withColumn("sum_ms", F.round("sum_ms", 4))


@query("latency_p95", LOG + """
 select "method", path, quantile_disc(duration_ms, 0.95) latency from access_log group by 1, 2""")
def latency_p95(spark, sf):
    return metrics.latency_quantile(v.access_log(spark, sf), 0.95)


@query("latency_sketch", LOG + """
 select "method", path, count(*) n, true within_one_percent from access_log group by 1, 2""")
def latency_sketch(spark, sf):
    """The quantile of merged hourly sketches, held against its rank in the log."""
    log = v.access_log(spark, sf)
    found = metrics.sketched_quantile(metrics.latency_sketches(log), 0.95, "method", "path")
    both = log.join(found, ["method", "path"])
    below, upto = F.count_if(F.col("duration_ms") < F.col("latency")) / F.max("n"), F.count_if(F.col("duration_ms") <= F.col("latency")) / F.max("n")
    return both.groupBy("method", "path").agg(F.max("n").alias("n"), ((below <= 0.96) & (upto >= 0.94)).alias("within_one_percent"))


@query("crawl_articles", CRAWL + "select source, count(*) n from crawl_log where ok group by 1")
def crawl_articles(spark, sf):
    return metrics.crawl_article_counts(v.crawl_log(spark, sf))


@query("crawl_errors", CRAWL + "select source, error_type, count(*) n from crawl_log where not ok group by 1, 2")
def crawl_errors(spark, sf):
    return metrics.crawl_error_counts(v.crawl_log(spark, sf))


@query("call_counts", """
 select role operation, 'model-' || cast(conv_id % 3 as varchar) model, count(*) n from conversations group by 1, 2""")
def call_counts(spark, sf):
    return metrics.call_counts(v.call_log(spark, sf))


def gauges(spark, sf):
    return v.table(spark, sf, "events").select(
        F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("ts"), "value")


@query("gauges", """
 select event_type "name", arg_max(value, ts) "value" from events group by 1""")
def gauge_values(spark, sf):
    return metrics.last_values(gauges(spark, sf)).select("name", "value")


GRID = """, m as (select *, floor(epoch(ts) / 60)::bigint + 1 mi from {log}),
 clock as (select unnest(range(min(mi), max(mi) + 1)) mi from m) """


@query("alerts_5xx", LOG + GRID.format(log="access_log") + """,
 per as (select c.mi, count(*) filter (m.status between 500 and 599) e from clock c left join m on m.mi = c.mi group by 1),
 r as (select mi, sum(e) over (order by mi range between 4 preceding and current row) e from per),
 s as (select mi, e, min(case when e > 0.003 * 300 then 1 else 0 end) over w ok, count(*) over w n from r
   window w as (order by mi range between 5 preceding and current row))
 select mi "minute", e::bigint errors from s where ok = 1 and n = 6""")
def alerts_5xx(spark, sf):
    return metrics.error_rate_alerts(v.access_log(spark, sf), 0.003).select("minute", "errors")


@query("alerts_crawl", CRAWL + GRID.format(log="crawl_log") + """,
 series as (select distinct source from crawl_log),
 per as (select s.source, c.mi, count(*) filter (m.ok) a, count(*) filter (not m.ok) e
   from series s cross join clock c left join m on m.mi = c.mi and m.source = s.source group by 1, 2),
 r as (select source, mi, sum(a) over w a, sum(e) over w e from per window w as (partition by source order by mi range between 179 preceding and current row)),
 s as (select *, min(case when e > 0 and a > 0 and e > 0.05 * a then 1 else 0 end) over w ok, count(*) over w n from r
   window w as (partition by source order by mi range between 10 preceding and current row))
 select source, mi "minute", e::bigint errors, a::bigint articles from s where ok = 1 and n = 11""")
def alerts_crawl(spark, sf):
    return metrics.crawl_failure_alerts(v.crawl_log(spark, sf), 0.05, 180, 10).select("source", "minute", "errors", "articles")


@query("alerts_calls", LOG + GRID.format(log="access_log") + """,
 per as (select c.mi, count(m.event_id) e from clock c left join m on m.mi = c.mi group by 1),
 r as (select mi, sum(e) over (order by mi range between 59 preceding and current row) e from per),
 s as (select mi, e, min(case when e > 0.004 * 3600 then 1 else 0 end) over w ok, count(*) over w n from r
   window w as (order by mi range between 15 preceding and current row))
 select mi "minute", e::bigint calls from s where ok = 1 and n = 16""")
def alerts_calls(spark, sf):
    return metrics.call_rate_alerts(v.access_log(spark, sf), 0.004).select("minute", "calls")


@query("alerts_down", LOG + """, g as (
   select floor(epoch(ts) / 60)::bigint + 1 mi, arg_max(case when status = 200 then 1 else 0 end, ts) up from access_log group by 1),
 s as (select mi, up, min(case when up = 0 then 1 else 0 end) over w ok, count(*) over w n from g
   window w as (order by mi range between 1 preceding and current row))
 select mi "minute" from s where ok = 1 and n = 2""")
def alerts_down(spark, sf):
    up = (F.col("status") == 200).cast("int")
    return metrics.down_alerts(v.access_log(spark, sf).select("ts", up.alias("value"))).select("minute")


GAUGE = ", g as (select floor(epoch(ts) / 60)::bigint + 1 mi, arg_max(duration_ms, ts) val from access_log group by 1)"


@query("alerts_gauge", LOG + GAUGE + """,
 s as (select mi, val, min(case when val > 10 then 1 else 0 end) over w ok, count(*) over w n from g
   window w as (order by mi range between 1 preceding and current row))
 select mi "minute", val "value" from s where ok = 1 and n = 2""")
def alerts_gauge(spark, sf):
    samples = v.access_log(spark, sf).select("ts", F.col("duration_ms").alias("value"))
    return metrics.lag_alerts(samples, 10, 1).select("minute", "value")
