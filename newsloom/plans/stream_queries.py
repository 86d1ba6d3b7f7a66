"""Driver queries: windowed activity and batch analysis; streaming plans run on
the same tables in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import views as v
from newsloom.plans import analyze as an
from newsloom.plans.catalog import query
from newsloom.plans.text_queries import BASE, KEPT, LEAD_SQL, LEXICON, STOP, finance_sql, fp_views
from newsloom.sources import validate
from newsloom.streaming import dedup as sd, hotness

NOW = v.NOW


@query("hotness_windows", v.with_views(v.SQL_EVENTS) + """,
 w as (select *, unnest(range(0, 24)) k from event_log),
 placed as (select *, date_trunc('hour', created_at) + to_hours(cast(k + 1 as int)) we from w),
 newest as (select * from (select *, row_number() over (partition by we, client_id, article_id, event_type order by created_at desc) rn
   from placed) where rn = 1)
 select strftime(we, '%Y-%m-%dT%H:%M:%S') window_end, article_id, round(sum(greatest(0.1::double,
     exp(-(epoch_us(we) - epoch_us(created_at)) / 3.6e9::double / 24))
   * case event_type when 'article_click' then 1.0::double when 'article_view' then least(duration_ms/10000.0::double, 3.0::double)
       when 'search_click' then 2.0::double else 0.0::double end), 4) score from newest group by we, article_id""")
def hotness_windows(spark, sf):
    out = hotness.windowed_hotness(v.event_log(spark, sf))
    return out.select(F.date_format("window_end", "yyyy-MM-dd'T'HH:mm:ss").alias("window_end"), "article_id", "score")


def keywords_sql(k):
    return f"""tk as (select id, unnest(w) token, generate_subscripts(w, 1) pos from (
   select id, regexp_extract_all(content, '[\\p{{L}}\\p{{Nd}}]{{2,}}') w from articles)),
 kw as (select id, string_agg(token, ' ' order by rn) keywords from (select id, token,
   row_number() over (partition by id order by count(*) desc, min(pos)) rn from tk where {KEPT} group by id, token) where rn <= {k} group by 1)"""


@query("near_repeats", fp_views("full") + """,
 timed as (select s.*, published_ts at_ from seg s join articles using (id)),
 hit as (select distinct b.article_id from timed a join timed b on a.fp <> 0 and b.fp <> 0
   and (a.s0 = b.s0 or a.s1 = b.s1 or a.s2 = b.s2 or a.s3 = b.s3) and bit_count(xor(a.fp, b.fp)::uhugeint::varchar::hugeint) <= 3
   and (a.at_, a.article_id) < (b.at_, b.article_id) and a.at_ >= b.at_ - interval 24 hours)
 select article_id, article_id in (select article_id from hit) "repeat" from articles""")
def near_repeats(spark, sf):
    """The batch form of the stream of near repeats, by time of publication."""
    a = v.corpus(spark, sf).withColumn("arrived", F.col("published_at").cast("timestamp"))
    return sd.near_repeats(a).select("article_id", "repeat")


@query("batch_analyze", finance_sql("title || ' ' || content") + f""", {keywords_sql(8)}
 select article_id, score sentiment_score, lab sentiment_label, coalesce(keywords, '') keywords, {LEAD_SQL} summary,
   '{an.MODEL}' model_used, '2024-01-31T00:00:00' created_at
 from final f join articles a using (id) left join kw using (id) where a.id not in (select doc_id from labels)""")
def batch_analyze(spark, sf):
    rows = an.batch_analyze(v.corpus(spark, sf), v.analysis(spark, sf), NOW, None, stop=".", stop_words=STOP,
                            sentiment_args={"base_args": BASE, "lexicon": LEXICON})
    return rows.select("article_id", "sentiment_score", "sentiment_label", F.array_join("keywords", " ").alias("keywords"), "summary",
                       "model_used", "created_at")


@query("analyze_articles", finance_sql("content") + f""", {keywords_sql(10)}
 select a.id, len(list_filter(string_split_regex(content, '[ \t\n\r\f\v]+'), lambda w: w <> '')) word_count, length(content) char_count,
   score sentiment_score, lab sentiment_label, coalesce(keywords, '') keywords, {LEAD_SQL} summary
 from articles a join final using (id) left join kw using (id)""")
def analyze_articles(spark, sf):
    out = an.analyze_articles(v.corpus(spark, sf), stop=".", stop_words=STOP,
                              sentiment_args={"base_args": BASE, "lexicon": LEXICON})
    return out.select("id", F.col("analysis.word_count").cast("bigint").alias("word_count"),
                      F.col("analysis.char_count").cast("bigint").alias("char_count"), "sentiment_score", "sentiment_label",
                      F.array_join("analysis.keywords", " ").alias("keywords"), F.col("auto_summary").alias("summary"))


@query("event_rejects", v.with_views(v.SQL_EVENTS) + """
 select event_id, event_type, 'type' reject from event_log
 where event_type not in ('article_click','article_view','search_click','search_query')""")
def event_rejects(spark, sf):
    _, rejected = validate.ingest_events(v.event_log(spark, sf), NOW)
    return rejected.select("event_id", "event_type", "reject")
