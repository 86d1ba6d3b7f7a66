"""Driver queries: listings, filters, orderings, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import views as v
from newsloom.functions import expr as e
from newsloom.operators import listing
from newsloom.plans.catalog import query

NOW = v.NOW
ART = v.with_views(v.SQL_ARTICLES)
MEDIA = ["src1", "src3", "src5"]
EXCLUDE = ["src0", "src2"]
TRUSTED = ["src0", "src4", "src7"]
SCORE_SQL = """(case when published_ts >= timestamp '2024-01-30' then 1.0::double
 when published_ts >= timestamp '2024-01-24' then 0.5::double else 0.1::double end) * 0.5::double
 + (id * 7 % 11) / 10.0::double * 0.3::double + least(1 + id % 13, 10) * 0.02::double"""


def ranked(a):
    """Articles whose reader activity and number of tags differ."""
    return a.withColumn("hotness_score", F.col("id") * 7 % 11 / F.lit(10.0)).withColumn(
        "tags", F.transform(F.sequence(F.lit(0), F.col("id") % 13), lambda n: n.cast("string")))


@query("latest_page", ART + f"""
 select article_id, source, published_at, round({SCORE_SQL}, 6) score,
   (select count(*) from articles where source not in ('src0','src2')) total
 from articles where source not in ('src0','src2') order by {SCORE_SQL} desc, id limit 100 offset 20""")
def latest_page(spark, sf):
    rows = listing.latest(ranked(v.articles(spark, sf)), NOW, limit=100, offset=20, exclude=EXCLUDE)
    return rows.select("article_id", "source", "published_at", F.round("score", 6).alias("score"), "total")


@query("media_page", ART + """
 select article_id, source, published_at,
   (select count(*) from articles where source in ('src1','src3','src5')) total
 from articles where source in ('src1','src3','src5') order by published_at desc, id limit 20 offset 20""")
def media_page(spark, sf):
    return listing.by_sources(v.articles(spark, sf), MEDIA, 20, 20).select(
        "article_id", "source", "published_at", "total")


@query("category_page", ART + """
 select article_id, category, published_at,
   (select count(*) from articles where category = 'en' and source not in ('src0','src2')) total
 from articles where category = 'en' and source not in ('src0','src2')
 order by published_at desc, id limit 20""")
def category_page(spark, sf):
    return listing.by_category(v.articles(spark, sf), "en", EXCLUDE, 20).select(
        "article_id", "category", "published_at", "total")


@query("date_range", ART + """
 select article_id, title, published_at from articles
 where published_ts >= timestamp '2024-01-10' and published_ts < timestamp '2024-01-13'""")
def date_range(spark, sf):
    return listing.by_date_range(v.articles(spark, sf), "2024-01-10", "2024-01-12").select(
        "article_id", "title", "published_at")


@query("range_week", ART + """
 select article_id, published_at from articles where published_ts >= timestamp '2024-01-24'""")
def range_week(spark, sf):
    return listing.within_range(v.articles(spark, sf), "week", NOW).select("article_id", "published_at")


@query("like_search", ART + """
 select article_id, published_at, (select count(*) from articles where contains(lower(content),'tion the')
   or contains(lower(title),'tion the') or contains(lower(summary),'tion the')) total
 from articles where contains(lower(content),'tion the') or contains(lower(title),'tion the')
   or contains(lower(summary),'tion the') order by published_at desc, id limit 30""")
def like_search(spark, sf):
    return listing.search_like(v.articles(spark, sf), "Tion The", limit=30).select(
        "article_id", "published_at", "total")


@query("like_search_media", ART + """
 select article_id, source, (select count(*) from articles where source in ('src1','src3','src5') and
   (contains(lower(content),'und') or contains(lower(title),'und') or contains(lower(summary),'und'))) total
 from articles where source in ('src1','src3','src5') and
   (contains(lower(content),'und') or contains(lower(title),'und') or contains(lower(summary),'und'))
 order by published_at desc, id limit 15 offset 5""")
def like_search_media(spark, sf):
    return listing.search_like(v.articles(spark, sf), "und", MEDIA, 15, 5).select("article_id", "source", "total")


@query("ids_lookup", ART + """
 , ids as (select substr(md5(cast(event_id as varchar)),1,16) article_id, row_number() over (order by value desc, event_id) pos
   from events where event_type = 'error')
 select i.pos, a.article_id, a.title from ids i join articles a using (article_id)""")
def ids_lookup(spark, sf):
    wanted = v.table(spark, sf, "events").filter("event_type = 'error'")
    numbered = listing.numbered(wanted, [F.desc("value"), F.asc("event_id")])
    ids = numbered.select(v.doc_key("event_id").alias("article_id"), F.col("position").alias("pos"))
    return listing.get_by_ids(v.articles(spark, sf), ids).select("pos", "article_id", "title")


@query("recent_ids", ART + "select id, article_id from articles order by id desc limit 500")
def recent_ids(spark, sf):
    return listing.recent_ids(v.articles(spark, sf), 500)


@query("keyword_filter", ART + """
 select article_id, true matched from articles where contains(lower(content),'tionthe') or contains(lower(title),'tionthe')
 order by published_at desc, id limit 40""")
def keyword_filter(spark, sf):
    return listing.filter_keyword(v.articles(spark, sf), "tionthe", 40).select("article_id", "matched")


@query("keyword_filter_fallback", ART + """
 select article_id, false matched from articles order by published_at desc, id limit 40""")
def keyword_filter_fallback(spark, sf):
    return listing.filter_keyword(v.articles(spark, sf), "no such words here", 40).select("article_id", "matched")


@query("category_filter", ART + """
 select article_id, true matched from articles
 where contains(category,'de') or contains(title,'de') order by published_at desc, id limit 40""")
def category_filter(spark, sf):
    return listing.filter_category(v.articles(spark, sf), "de", 40).select("article_id", "matched")


@query("stock_filter", ART + """
 select article_id, true matched from articles
 where contains(title,'The') or contains(content,'The') order by published_at desc, id limit 30""")
def stock_filter(spark, sf):
    return listing.filter_stock(v.articles(spark, sf), "The", 30).select("article_id", "matched")


@query("time_range_filter", ART + """
 select article_id, published_at from articles
 where published_ts between timestamp '2024-01-05 06:00:00' and timestamp '2024-01-06 18:00:00'
 order by published_at desc, id limit 50""")
def time_range_filter(spark, sf):
    return listing.filter_time_range(
        v.articles(spark, sf), "2024-01-05 06:00:00", "2024-01-06 18:00:00", 50).select("article_id", "published_at")


@query("within_days", ART + """
 select article_id, published_at from articles where published_ts >= timestamp '2024-01-28'""")
def within_days(spark, sf):
    return listing.within_days(v.articles(spark, sf), NOW, 3).select("article_id", "published_at")


@query("recent_events", v.with_views(v.SQL_EVENTS) + """
 select event_id, event_type, article_id from event_log where created_at >= timestamp '2024-01-30'""")
def recent_events(spark, sf):
    return listing.recent_events(v.event_log(spark, sf), NOW).select("event_id", "event_type", "article_id")


@query("quality_sort", ART + """
 select article_id, round(least(length(content)/100.0::double, 10) + least(length(title)/10.0::double, 5)
   + case when source in ('src0','src4','src7') then 2 else 0 end, 6) quality
 from articles order by least(length(content)/100.0::double, 10) + least(length(title)/10.0::double, 5)
   + case when source in ('src0','src4','src7') then 2 else 0 end desc, id limit 100""")
def quality_sort(spark, sf):
    return listing.sort_by_quality(v.articles(spark, sf), 100, TRUSTED).select(
        "article_id", F.round("quality", 6).alias("quality"))


@query("first_per_url", ART + """
 select article_id, url from articles where url = '' or id in (select min(id) from articles where url <> '' group by url)""")
def first_per_url(spark, sf):
    return listing.first_per_url(v.articles(spark, sf)).select("article_id", "url")


@query("keep_min_id", ART + """
 select min(id) id from articles group by coalesce(nullif(url,''), title)""")
def keep_min_id(spark, sf):
    return listing.keep_min_id(v.articles(spark, sf)).select("id")


@query("page_tables", ART + f"""
 , lists as (
   select 'latest' listing, row_number() over (order by {SCORE_SQL} desc, id) rn, article_id,
     count(*) over () total from articles where source not in ('src0','src2')
   union all
   select 'media', row_number() over (order by published_at desc, id), article_id, count(*) over ()
     from articles where source in ('src1','src3','src5'))
 select listing, s.page_size, (rn-1)//s.page_size + 1 page, (rn-1)%s.page_size + 1 pos, article_id, total
 from lists, (values (12),(24)) s(page_size) where (rn-1)//s.page_size + 1 <= 3""")
def page_tables(spark, sf):
    return listing.materialize_pages(ranked(v.articles(spark, sf)), NOW, MEDIA, exclude=EXCLUDE).select(
        "listing", "page_size", "page", "pos", "article_id", "total")


@query("message_page", """
 select conv_id*1000+turn id, substr(md5(text),1,8) body, (select count(*) from conversations) total
 from conversations order by conv_id*1000+turn desc limit 20 offset 40""")
def message_page(spark, sf):
    return listing.message_page(v.guest_book(spark, sf), 20, 40).select(
        "id", F.substring(F.md5("content"), 1, 8).alias("body"), "total")


@query("position_list", ART + """
 select article_id, row_number() over (order by published_at desc, id) as "position" from articles""")
def position_list(spark, sf):
    rows = v.articles(spark, sf).select("id", "article_id", "published_at")
    return listing.numbered(rows, listing.newest()).select("article_id", "position")


@query("per_source_head", ART + """
 select source, article_id, rn from (select source, article_id,
   row_number() over (partition by source order by published_at desc, id) rn from articles) where rn <= 5""")
def per_source_head(spark, sf):
    from pyspark.sql import Window
    rows = v.articles(spark, sf).select("source", "article_id", "published_at", "id")
    w = Window.partitionBy("source").orderBy(*listing.newest())
    return listing.per_group_head(rows, ["source"], listing.newest(), 5).select(
        "source", "article_id", F.row_number().over(w).alias("rn"))


@query("language", """
 select substr(md5(cast(doc_id as varchar)),1,16) article_id,
   case when text = '' then 'unknown'
     when length(regexp_replace(text,'[^A-Za-z]','','g')) / greatest(length(replace(text,' ','')),1) > 0.5 then 'en'
     else 'unknown' end language
 from documents""")
def language(spark, sf):
    return v.articles(spark, sf).select("article_id", e.detect_language("content").alias("language"))


@query("needs_translation", """
 select substr(md5(cast(doc_id as varchar)),1,16) article_id from documents
 where text = '' or not (length(regexp_replace(text,'[^一-鿿]','','g')) / greatest(length(replace(text,' ','')),1) > 0.3)""")
def needs_translation(spark, sf):
    return v.articles(spark, sf).filter(e.needs_translation("content", "zh")).select("article_id")


@query("valid_text", """
 select substr(md5(cast(doc_id as varchar)),1,16) article_id from documents
 where length(text) >= 30 and length(regexp_replace(text,'[^A-Za-z0-9]','','g')) / greatest(length(text),1) >= 0.7""")
def valid_text(spark, sf):
    return v.articles(spark, sf).filter(e.valid_text("content")).select("article_id")


@query("quality_score", ART + """
 , parts as (select article_id,
   case when length(title)+1+length(content) >= 500 then 30 when length(title)+1+length(content) >= 200 then 25
     when length(title)+1+length(content) >= 80 then 15 else 5 end q_length,
   case when source in ('src0','src1') then 25 when source in ('src2','src3') then 18 else 10 end q_trust,
   least(20, cast(floor(len(regexp_extract_all(title || ' ' || content, '\\p{Nd}+\\.?\\p{Nd}*%?'))
     / greatest((length(title)+1+length(content))/100.0::double, 1.0) * 10) as int)) q_density,
   case when date_diff('second', published_ts, timestamp '2024-01-31') < 3600 then 15
     when date_diff('second', published_ts, timestamp '2024-01-31') < 21600 then 12
     when date_diff('second', published_ts, timestamp '2024-01-31') < 86400 then 8
     when date_diff('second', published_ts, timestamp '2024-01-31') < 259200 then 4 else 1 end q_time,
   least(10, len(list_filter(string_split(content, chr(10)), lambda p: length(p) > 20))) q_structure
   from articles)
 select article_id, q_length, q_trust, q_density, q_time, cast(q_structure as int) q_structure,
   cast(q_length+q_trust+q_density+q_time+q_structure as int) total,
   case when q_length+q_trust+q_density+q_time+q_structure >= 70 then 'high'
     when q_length+q_trust+q_density+q_time+q_structure >= 45 then 'medium' else 'low' end "label" from parts""")
def quality_score(spark, sf):
    q = e.quality_parts("title", "content", "source", "published_at", NOW, ["src0", "src1"], ["src2", "src3"])
    return v.articles(spark, sf).select("article_id", q.alias("q")).select(
        "article_id", F.col("q.length").alias("q_length"), F.col("q.trust").alias("q_trust"),
        F.col("q.density").alias("q_density"), F.col("q.timeliness").alias("q_time"),
        F.col("q.structure").alias("q_structure"), "q.total", "q.label")


LATIN_TOPICS = {"markets": ["thea", "tioning"], "policy": ["que ", "des "], "people": ["und", "der"]}


@query("classify", """
 select substr(md5(cast(doc_id as varchar)),1,16) article_id,
   case when regexp_matches(lower(text), 'thea|tioning') then 'markets'
     when regexp_matches(lower(text), 'que |des ') then 'policy'
     when regexp_matches(lower(text), 'und|der') then 'people' else '综合财经' end topic
 from documents""")
def classify(spark, sf):
    return v.articles(spark, sf).select(
        "article_id", e.classify(F.lit(""), "content", LATIN_TOPICS).alias("topic"))
