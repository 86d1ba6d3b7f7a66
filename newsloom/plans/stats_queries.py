"""Driver queries: statistics, dashboard, reader activity, event intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import views as v
from newsloom.operators import hotness as hot, listing, stats
from newsloom.plans import dashboard as board
from newsloom.plans.catalog import query
from newsloom.sources import validate

NOW = v.NOW
JOINED = v.with_views(v.SQL_ARTICLES, v.SQL_ANALYSIS) + """, joined as (
 select a.*, coalesce(n.sentiment_score, 0) score, coalesce(n.sentiment_label, 'neutral') lab
 from articles a left join analysis n using (article_id)) """
ART = v.with_views(v.SQL_ARTICLES)
COUNTS = """count(*) n, round(avg(score), 4) avg_sentiment, count(*) filter (lab = 'positive') positive,
 count(*) filter (lab = 'negative') negative, count(*) filter (lab = 'neutral') neutral"""


def joined(spark, sf):
    return stats.with_analysis(v.articles(spark, sf), v.analysis(spark, sf))


@query("dashboard", JOINED + f"""
 select 'category' section, category "key", count(*) n, round(avg(score),4) avg_sentiment,
   null::bigint positive, null::bigint negative, null::bigint neutral from joined
   where published_ts >= timestamp '2024-01-01' group by category
 union all select 'day', substr(published_at,1,10), {COUNTS} from joined
   where published_ts >= timestamp '2024-01-01' group by 2
 union all select 'keyword', k, n, null, null, null, null from (
   select k, count(*) n from (select n.sentiment_label k from articles join analysis n using (article_id)
     union all select n.kw2 from articles join analysis n using (article_id)) group by k order by n desc, k limit 15)
 union all select 'overall', case when round(avg(score),4) > 0.15 then 'positive'
     when round(avg(score),4) < -0.15 then 'negative' else 'neutral' end, {COUNTS} from joined
   where published_ts >= timestamp '2024-01-01'""")
def dashboard(spark, sf):
    return board.dashboard_rows(v.articles(spark, sf), v.analysis(spark, sf), NOW, "month")


@query("dashboard_category", JOINED + """
 select category, count(*) n, round(avg(score),4) avg_sentiment from joined group by category""")
def dashboard_category(spark, sf):
    return stats.category_stats(joined(spark, sf))


@query("dashboard_daily", JOINED + f"select substr(published_at,1,10) as \"day\", {COUNTS} from joined group by 1")
def dashboard_daily(spark, sf):
    return stats.daily_trend(joined(spark, sf))


@query("dashboard_overall", JOINED + """
 select count(*) total, round(avg(score),4) score, count(*) filter (lab = 'positive') positive,
   count(*) filter (lab = 'negative') negative, count(*) filter (lab = 'neutral') neutral,
   case when round(avg(score),4) > 0.15 then 'positive' when round(avg(score),4) < -0.15 then 'negative' else 'neutral' end "label",
   round(abs(round(avg(score),4)),4) confidence from joined""")
def dashboard_overall(spark, sf):
    return stats.overall_sentiment(joined(spark, sf))


@query("category_counts", ART + "select category, count(*) n from articles where category <> '' group by 1")
def category_counts(spark, sf):
    return stats.category_counts(v.articles(spark, sf))


@query("stored_keywords", JOINED + """
 select keyword, count(*) n from (
   select n.sentiment_label keyword from articles join analysis n using (article_id)
   union all select n.kw2 from articles join analysis n using (article_id)) group by 1 order by n desc, keyword limit 15""")
def stored_keywords(spark, sf):
    return stats.top_keywords(joined(spark, sf), 15)


@query("home_stats", v.with_views(v.SQL_ARTICLES, v.SQL_ANALYSIS) + """
 select count(*) analysed, round(avg(sentiment_score),4) avg_score,
   count(*) filter (sentiment_label = 'positive') positive, count(*) filter (sentiment_label = 'negative') negative,
   count(*) filter (sentiment_label = 'neutral') neutral, (select count(*) from articles) total_news from analysis""")
def home_stats(spark, sf):
    return stats.sentiment_aggregate(v.analysis(spark, sf), v.articles(spark, sf))


@query("sentiment_summary", v.with_views(v.SQL_ANALYSIS) + """
 select count(*) total, count(*) filter (sentiment_label = 'positive') positive,
   count(*) filter (sentiment_label = 'negative') negative, count(*) filter (sentiment_label = 'neutral') neutral,
   round(avg(sentiment_score),4) average, 'negative=' || count(*) filter (sentiment_label = 'negative') || ' neutral='
   || count(*) filter (sentiment_label = 'neutral') || ' positive=' || count(*) filter (sentiment_label = 'positive') distribution from analysis""")
def sentiment_summary(spark, sf):
    entries = F.transform(F.array_sort(F.map_entries("distribution")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return stats.sentiment_summary(v.analysis(spark, sf)).withColumn("distribution", F.array_join(entries, " "))


@query("breakdown_source_category", JOINED + """
 select dimension, "key", round(avg(score),4) avg_score, count(*) filter (lab='positive') positive,
   count(*) filter (lab='negative') negative, count(*) filter (lab='neutral') neutral, count(*) n
 from (select 'source' dimension, source "key", score, lab from joined
       union all select 'category', category, score, lab from joined) group by 1, 2""")
def breakdown_source_category(spark, sf):
    return stats.sentiment_breakdown(joined(spark, sf))


@query("freshness", ART + """
 select count(*) total, max(published_at) latest_at from articles where source not in ('src0','src2')""")
def freshness(spark, sf):
    return stats.freshness(listing.exclude_sources(v.articles(spark, sf), ["src0", "src2"]))


@query("store_status", v.with_views(v.SQL_ARTICLES, v.SQL_ANALYSIS) + """
 select count(*) articles, '2024-01-31T00:00:00' last_created, max(published_at) last_published,
   (select count(*) from analysis) analysed from articles""")
def store_status(spark, sf):
    return stats.store_status(v.articles(spark, sf), v.analysis(spark, sf))


@query("dup_urls", ART + """
 select url, count(*) n from articles where url <> '' group by url having count(*) > 1 order by n desc, url limit 10""")
def dup_urls(spark, sf):
    return stats.duplicate_urls(v.articles(spark, sf), 10)


@query("crawl_counts", ART + "select source, count(*) n from articles group by 1")
def crawl_counts(spark, sf):
    return stats.crawl_counts(v.articles(spark, sf))


@query("article_count", "select count(*) n from documents")
def article_count(spark, sf):
    return stats.row_count(v.articles(spark, sf))


@query("message_count", "select count(*) n from conversations")
def message_count(spark, sf):
    return stats.row_count(v.guest_book(spark, sf))


@query("unanalysed", v.with_views(v.SQL_ARTICLES, v.SQL_ANALYSIS) + """
 select article_id from articles where article_id not in (select article_id from analysis)""")
def unanalysed(spark, sf):
    return stats.unanalysed(v.articles(spark, sf), v.analysis(spark, sf)).select("article_id")


HOT = v.with_views(v.SQL_EVENTS) + """, newest as (
 select * from (select *, row_number() over (partition by client_id, article_id, event_type order by created_at desc) rn
   from event_log where created_at >= timestamp '2024-01-30') where rn = 1),
 scores as (select article_id, round(sum(greatest(0.1::double,
     exp(-(epoch_us(timestamp '2024-01-31') - epoch_us(created_at)) / 3.6e9::double / 24))
   * case event_type when 'article_click' then 1.0::double when 'article_view' then least(duration_ms/10000.0::double, 3.0::double)
       when 'search_click' then 2.0::double else 0.0::double end), 4) score from newest group by article_id) """


@query("hotness", HOT + "select article_id, score from scores")
def hotness(spark, sf):
    return hot.hotness(v.event_log(spark, sf), NOW)


@query("apply_hotness", HOT + """, arts as (select substr(md5(cast(doc_id as varchar)),1,16) article_id from documents)
 select article_id, coalesce(score, 0) hotness_score from arts left join scores using (article_id)""")
def apply_hotness(spark, sf):
    scored = hot.apply_hotness(v.articles(spark, sf), hot.hotness(v.event_log(spark, sf), NOW))
    return scored.select("article_id", "hotness_score")


@query("purge_events", v.with_views(v.SQL_EVENTS) + """
 select event_id from event_log where created_at >= timestamp '2024-01-24'""")
def purge_events(spark, sf):
    return hot.purge_events(v.event_log(spark, sf), NOW).select("event_id")


@query("event_validation", v.with_views(v.SQL_EVENTS) + """
 select case when event_type in ('article_click','article_view','search_click','search_query') then 'accepted' else 'type' end outcome,
   count(*) n from event_log group by 1""")
def event_validation(spark, sf):
    return validate.reject_counts(v.event_log(spark, sf))


@query("event_intake", v.with_views(v.SQL_EVENTS) + """
 select event_id, event_type, article_id, client_id from event_log
 where event_type in ('article_click','article_view','search_click','search_query')""")
def event_intake(spark, sf):
    accepted, _ = validate.ingest_events(v.event_log(spark, sf), NOW)
    return accepted.select("event_id", "event_type", "article_id", "client_id")


@query("guest_messages", """
 select conv_id*1000+turn id, md5(trim(regexp_replace(regexp_replace(text,'<[^>]+>','','g'),'\\s+',' ','g'))) body
 from conversations
 where length(trim(regexp_replace(regexp_replace(text,'<[^>]+>','','g'),'\\s+',' ','g'))) between 1 and 2000""")
def guest_messages(spark, sf):
    return validate.clean_messages(v.guest_book(spark, sf)).select("id", F.md5("content").alias("body"))
