"""Driver queries: words, topics, duplicates, sentiment, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import views as v
from newsloom.functions import expr as e, text as t
from newsloom.operators import clusters as cl, dedup, entities as ent, keywords as kw, sentiment as se
from newsloom.operators import stats, summary
from newsloom.plans.catalog import query
from newsloom.session import cut

NOW = v.NOW
STOP = ["the", "of", "and", "de", "la", "der"]
STOP_SQL = "'the','of','and','de','la','der'"
ART = v.with_views(v.SQL_ARTICLES)


def tok(expression: str) -> str:
    return f"""tok as (select id, published_at, unnest(w) token, generate_subscripts(w, 1) pos from (
      select id, published_at, regexp_extract_all({expression}, '[\\p{{L}}\\p{{Nd}}]{{2,}}') w from articles))"""


TOK = v.with_views(v.SQL_ARTICLES, tok("content"))
KEPT = f"token not in ({STOP_SQL}) and not regexp_full_match(token, '\\p{{Nd}}+')"


@query("tokens", TOK + "select id, count(*) n, count(distinct token) words from tok group by id")
def tokens(spark, sf):
    terms = t.term_table(v.corpus(spark, sf), t.tokens("content"))
    return terms.groupBy("id").agg(F.sum("tf").alias("n"), F.count("*").alias("words"))


@query("keywords", TOK + f"""
 select id, token, n, rn from (select id, token, count(*) n,
   row_number() over (partition by id order by count(*) desc, min(pos)) rn
   from tok where {KEPT} group by id, token) where rn <= 8""")
def keywords(spark, sf):
    return kw.keyword_rows(v.corpus(spark, sf), "content", 8, stop_words=STOP).select(
        "id", "token", F.col("tf").alias("n"), F.col("rank").alias("rn"))


@query("top_terms", TOK + f"""
 , c as (select id, token, count(*) n, min(pos) p from tok where {KEPT} group by id, token)
 select token, sum(n)::bigint n from c group by token order by n desc, min((id, p)) limit 20""")
def top_terms(spark, sf):
    return kw.corpus_keywords(v.corpus(spark, sf), "content", 20, stop_words=STOP)


def hot_sql(chars, k):
    text = "title || ' ' || content" if chars is None else f"title || ' ' || substr(content,1,{chars})"
    return v.with_views(v.SQL_ARTICLES) + f""", ranked as (
 select *, row_number() over (order by published_at desc, id) rk, count(*) over () n from articles),
 tok as (select rk, rk <= n // 2 newer, unnest(w) token, generate_subscripts(w,1) pos from (
   select rk, n, regexp_extract_all({text}, '[\\p{{L}}\\p{{Nd}}]{{2,}}') w from ranked)),
 good as (select * from tok where {KEPT}),
 counts as (select newer, token, count(*) c from good group by 1, 2),
 agg as (select token keyword, coalesce(sum(c) filter (newer), 0)::bigint current_count,
   coalesce(sum(c) filter (not newer), 0)::bigint prev_count from counts group by 1)
 select keyword, current_count, prev_count, case when current_count > prev_count * 1.5 then 'rising'
   when current_count < prev_count * 0.5 then 'falling' else 'stable' end trend
 from agg where current_count >= 3 or prev_count >= 3 order by current_count - prev_count desc, keyword limit {k}"""


@query("hot_topics", hot_sql(None, 15))
def hot_topics(spark, sf):
    return kw.hot_topics(v.corpus(spark, sf), 15, None, stop_words=STOP)


# --- fingerprints ------------------------------------------------------------

def fp_views(rule):
    text = {"lead": "title || ' ' || substr(summary,1,200)", "full": "title || ' ' || content"}[rule]
    return v.with_views(v.SQL_ARTICLES, tok(text)) + """, half as (
 select id, ('0x' || substr(md5(token),25,8))::bigint lo, ('0x' || substr(md5(token),17,8))::bigint hi from tok),
 bits as (select id, b, sum(case when ((case when b < 32 then lo else hi end) >> (b % 32)) & 1 = 1 then 1 else -1 end) s
   from half, range(64) r(b) group by id, b),
 fp as (select a.id, a.article_id, a.url, length(a.content) len,
   coalesce(sum(case when s > 0 then (1::hugeint << b::int) else 0 end), 0)::uhugeint fp
   from articles a left join bits on a.id = bits.id group by all),
 seg as (select *, (fp & 65535)::bigint s0, ((fp >> 16) & 65535)::bigint s1,
   ((fp >> 32) & 65535)::bigint s2, ((fp >> 48) & 65535)::bigint s3 from fp) """


PAIRS = """, pairs as (select a.id a, b.id b, bit_count(xor(a.fp, b.fp)::uhugeint::varchar::hugeint) d
   from seg a join seg b on a.id < b.id and (a.s0 = b.s0 or a.s1 = b.s1 or a.s2 = b.s2 or a.s3 = b.s3)
   where bit_count(xor(a.fp, b.fp)::uhugeint::varchar::hugeint) <= {t})"""


def segments(df, *columns):
    return df.select(*columns, *[dedup.segment("fp", i).alias(f"s{i}") for i in range(4)])


@query("simhash", fp_views("full") + "select id, s0, s1, s2, s3 from seg")
def simhash(spark, sf):
    return segments(dedup.fingerprints(v.corpus(spark, sf), "full"), "id")


def dup_pairs_sql(rule, threshold):
    return fp_views(rule) + PAIRS.format(t=threshold) + """
 select d::int distance, count(*) article_pairs from pairs group by 1"""


def dup_pairs_build(rule, threshold):
    def build(spark, sf):
        sizes = dedup.fingerprints(v.corpus(spark, sf), rule).groupBy("fp").agg(F.count("*").alias("n"))
        return dedup.pair_counts(cut(sizes), threshold)

    return build


query("dup_pair_counts", dup_pairs_sql("full", 4))(dup_pairs_build("full", 4))
query("dup_pair_counts_wide", dup_pairs_sql("full", 10))(dup_pairs_build("full", 10))


@query("dup_pairs", fp_views("full") + """,
 groups as (select fp, s0, s1, s2, s3, count(*) n from seg group by all)
 select least(a.s3,b.s3) lo_s3, greatest(a.s3,b.s3) hi_s3, bit_count(xor(a.fp,b.fp)::uhugeint::varchar::hugeint)::int distance,
   a.n * b.n article_pairs
 from groups a join groups b on a.fp < b.fp and (a.s0 = b.s0 or a.s1 = b.s1 or a.s2 = b.s2 or a.s3 = b.s3)
   and bit_count(xor(a.fp,b.fp)::uhugeint::varchar::hugeint) <= 4
 union all select s3, s3, 0, n * (n - 1) // 2 from groups where n > 1""")
def dup_pairs(spark, sf):
    _, pairs = dedup.duplicate_groups(v.corpus(spark, sf), 4, "full")
    a, b = dedup.segment("fp_a", 3), dedup.segment("fp_b", 3)
    return pairs.select(F.least(a, b).alias("lo_s3"), F.greatest(a, b).alias("hi_s3"), "distance", "article_pairs")


def clusters_sql(rule):
    return fp_views(rule) + PAIRS.format(t=4) + """,
 reach(id, other) as (select id, id from seg
   union select r.id, case when p.a = r.other then p.b else p.a end from reach r join pairs p on r.other in (p.a, p.b)),
 comp as (select id, min(other) cluster from reach group by id),
 best as (select c.cluster, arg_min(s.id, (-s.len, s.id)) best from comp c join seg s using (id) group by 1)
 select c.id, c.cluster, b.best = c.id representative from comp c join best b using (cluster)"""


@query("near_dup_clusters", clusters_sql("full"))
def near_dup_clusters(spark, sf):
    return dedup.near_dup_clusters(v.corpus(spark, sf), rule="full").select("id", "cluster", "representative")


def cross_batch(spark, sf):
    """The last days' articles arrive, the earlier ones are stored."""
    a = v.corpus(spark, sf)
    fresh, stored = a.filter("published_at >= '2024-01-16'"), a.filter("published_at < '2024-01-16'")
    return dedup.fingerprints(fresh, "full"), dedup.fingerprints(stored, "full")


@query("cross_batch", fp_views("full") + """
 select a.id from seg a where a.id in (select id from articles where published_at >= '2024-01-16') and a.fp <> 0 and exists (
   select 1 from seg b where b.id in (select id from articles where published_at < '2024-01-16') and b.fp <> 0 and (a.s0 = b.s0 or a.s1 = b.s1 or a.s2 = b.s2 or a.s3 = b.s3)
     and bit_count(xor(a.fp, b.fp)::uhugeint::varchar::hugeint) <= 3)""")
def cross_batch_matches(spark, sf):
    fresh, stored = cross_batch(spark, sf)
    return dedup.matches_stored(fresh, stored).select("id")


STAGES = clusters_sql("full").rsplit("\n select", 1)[0] + """,
 kept1 as (select s.id, s.url, b.cluster, s.fp from best b join seg s on s.id = b.best),
 kept2 as (select * from (select *, row_number() over (partition by url, case when url = '' then id end order by cluster) rn from kept1) where rn = 1),
 staged as (select s.id, case when s.id not in (select id from kept1) then 'near'
   when s.id not in (select id from kept2) then 'url'
   when s.url = '' and s.fp <> 0 and exists (select 1 from seg b where b.id % 10 = 7 and b.fp <> 0
     and (s.s0 = b.s0 or s.s1 = b.s1 or s.s2 = b.s2 or s.s3 = b.s3)
     and bit_count(xor(s.fp, b.fp)::uhugeint::varchar::hugeint) <= 3) then 'cross' end stage from seg s) """


@query("dedup_stages", STAGES + "select id, stage from staged")
def dedup_stages(spark, sf):
    a = v.corpus(spark, sf)
    stored = dedup.fingerprints(a.filter(F.col("id") % 10 == 7)).select("fp")
    return dedup.dedup_stages(a, stored).select("id", "stage")


@query("dedup_stats", STAGES + """
 select count(*) total, count(*) filter (stage is null) kept, count(*) filter (stage = 'near') removed_near,
   count(*) filter (stage = 'url') removed_url, count(*) filter (stage = 'cross') removed_cross,
   round(1 - count(*) filter (stage is null) / count(*), 4) ratio from staged""")
def dedup_stats(spark, sf):
    return stats.dedup_stats(dedup_stages(spark, sf))


# --- topic clusters ----------------------------------------------------------

def topic_sql(chars, threshold):
    text = "title || ' ' || content" if chars is None else f"title || ' ' || substr(content,1,{chars})"
    return v.with_views(v.SQL_ARTICLES, tok(text)) + f""",
 tf as (select id, token, count(*) tf from tok where token not in ({STOP_SQL}) group by 1, 2),
 spread as (select token, count(*) df from tf group by 1),
 raw as (select id, token, tf * (ln(((select count(*) from articles) + 1) / (df + 1)) + 1) w from tf join spread using (token)),
 vec as (select id, token, w / sqrt(sum(w * w) over (partition by id)) w from raw),
 pairs as (select x.id a, y.id b from vec x join vec y on x.token = y.token and x.id < y.id
   group by 1, 2 having sum(x.w * y.w) >= {threshold}),
 edges as (select a, b from pairs union select b, a from pairs),
 reach(id, other) as (select distinct a, a from edges union select r.id, g.b from reach r join edges g on r.other = g.a),
 comp as (select id, min(other) cluster from reach group by id) """


@query("topic_members", topic_sql(None, 0.35) + "select id, cluster from comp")
def topic_members(spark, sf):
    members, _ = cl.cluster_members(v.corpus(spark, sf), 0.35, None, STOP)
    return members


@query("clusters", topic_sql(None, 0.35) + """,
 top as (select cluster, count(*) "size" from comp group by 1 order by "size" desc, cluster limit 20),
 words as (select cluster, token, sum(tf) n, min((f.id, k.pos)) seen
   from tf f join comp using (id) join (select id, token, min(pos) pos from tok group by 1, 2) k using (id, token) where cluster in (select cluster from top) group by 1, 2),
 labels2 as (select c.cluster, substr(arg_min(a.title, (length(a.title), a.title)), 1, 40) "label"
   from comp c join articles a using (id) group by 1),
 key5 as (select cluster, string_agg(token, ' ' order by rn) keywords from (
   select *, row_number() over (partition by cluster order by n desc, seen) rn from words) where rn <= 5 group by 1)
 select t.cluster, t."size", k.keywords, l."label"
 from top t join key5 k using (cluster) join labels2 l using (cluster)""")
def clusters(spark, sf):
    found, _ = cl.cluster_articles(v.corpus(spark, sf), 0.35, None, 20, STOP)
    return found.select("cluster", "size", F.array_join("keywords", " ").alias("keywords"), "label")


# --- sentiment ---------------------------------------------------------------

POS = [w for w, x in v.LATIN_LEXICON if x > 0]
NEG = [w for w, x in v.LATIN_LEXICON if x < 0]
DEGREES = {"very": 2.0, "in": 1.5, "on": 0.5, "en": 1.2}
NEGATIONS = ("is", "not", "est")
BASE = {"positive": POS, "negative": NEG, "degrees": DEGREES, "negations": NEGATIONS}
LEXICON = {"positive": [x for x in v.LATIN_LEXICON if x[1] > 0], "negative": [x for x in v.LATIN_LEXICON if x[1] < 0],
           "modifiers": {"tion": 1.5, "ing": 0.5}, "negations": ("is ", "not "), "close_negation": "-"}


def _list(words):
    return ",".join(f"'{w}'" for w in words)


def base_sql(text):
    return v.with_views(v.SQL_ARTICLES) + f""", bodies as (select id, source, category, {text} body from articles),
 w as (select id, unnest(w) token, generate_subscripts(w,1) pos from (
   select id, regexp_extract_all(body, '[\\p{{L}}\\p{{Nd}}]+') w from bodies)),
 p as (select id, token, lag(token) over (partition by id order by pos) prev from w),
 s as (select id, sum((case when token in ({_list(POS)}) then 1.0::double when token in ({_list(NEG)}) then -1.0::double else 0.0::double end)
   * (case when prev in ({_list(NEGATIONS)}) then -1.0::double else 1.0::double end)
   * (case prev when 'very' then 2.0::double when 'in' then 1.5::double when 'on' then 0.5::double when 'en' then 1.2::double
      else 1.0::double end)) total from p group by id),
 base as (select a.id, a.source, a.category, coalesce(round(case when abs(total) >= 10 then sign(total) else tanh(total / 5) end, 4), 0)::double score
   from bodies a left join s using (id)) """


BASE_SQL = base_sql("content")


def scored(spark, sf):
    words = t.all_tokens("content")
    return v.corpus(spark, sf).withColumn("s", se.base_score(words, **BASE))


@query("sentiment_base", BASE_SQL + """
 select id, score sentiment_score, case when score > 0.1 then 'positive' when score < -0.1 then 'negative' else 'neutral' end sentiment_label
 from base""")
def sentiment_base(spark, sf):
    return scored(spark, sf).select("id", "s.sentiment_score", "s.sentiment_label")


@query("sentiment_words", ART + f"""
 select id, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: x in ({_list(POS)})))), ' ') pos_words,
   array_to_string(list_sort(list_distinct(list_filter(w, lambda x: x in ({_list(NEG)})))), ' ') neg_words
 from (select id, regexp_extract_all(content, '[\\p{{L}}\\p{{Nd}}]{{2,}}') w from articles)""")
def sentiment_words(spark, sf):
    words = se.sentiment_words(t.tokens("content"), POS, NEG)
    return v.corpus(spark, sf).select("id", words.alias("w")).select(
        "id", F.array_join("w.positive_words", " ").alias("pos_words"),
        F.array_join("w.negative_words", " ").alias("neg_words"))


def _claimed_sql(terms):
    """The body with each term written over by its mark and fillers, longest first."""
    text = "regexp_replace(body, '[\ue000-\uf8ff]', '\ufffd', 'g')"
    for n, term in enumerate(terms):
        text = f"replace({text}, '{term}', chr({0xE000 + n}) || repeat(chr({0xE000 + len(terms)}), {len(term) - 1}))"
    return text


def _side_sql(side, lexicon):
    terms = sorted((w for w, _ in lexicon), key=lambda w: -len(w))
    marks = f"[\ue000-{chr(0xE000 + len(terms) - 1)}]"
    weights = dict(lexicon)
    return f"""select id, {side} side, body, unnest(regexp_extract_all(c, '{marks}')) mark, unnest(regexp_split_to_array(c, '{marks}')[:-2]) gap,
     unnest(range(0, len(regexp_extract_all(c, '{marks}')))) k, [{",".join(f"{weights[w]}::double" for w in terms)}] weights
   from (select id, body, {_claimed_sql(terms)} c from bodies)"""


def finance_sql(text):
    return base_sql(text) + f""", marked as ({_side_sql(0, LEXICON["positive"])} union all {_side_sql(1, LEXICON["negative"])}),
 placed as (select *, sum(length(gap)) over (partition by id, side order by k) + k place from marked),
 hit as (select id, weights[unicode(mark) - {0xE000} + 1] weight, substr(body, greatest(place - 10, 0)::int + 1, least(place, 10)::int) near,
   substr(body, greatest(place - 20, 0)::int + 1, least(place, 20)::int) wide from placed),
 effects as (select id, count(*) hits, sum(weight * (case when contains(near, 'is ') or contains(near, 'not ') or suffix(near, '-') then -1.0::double else 1.0::double end)
   * (case when contains(wide, 'tion') then 1.5::double when contains(wide, 'ing') then 0.5::double else 1.0::double end)) total from hit group by 1),
 over_ as (select b.id, b.score base, coalesce(hits, 0) hits,
   greatest(-1.0::double, least(1.0::double, round(b.score * 0.6::double + greatest(-1.0::double, least(1.0::double, coalesce(total, 0))) * 0.4::double, 4))) score
   from base b left join effects using (id)),
 final as (select *, case when score > 0.15 then 'positive' when score < -0.15 then 'negative' else 'neutral' end lab from over_) """


FINANCE_SQL = finance_sql("content")


@query("finance_overlay", FINANCE_SQL + "select id, score sentiment_score, lab sentiment_label, hits::int hits from final")
def finance_overlay(spark, sf):
    rows = scored(spark, sf).select("id", "content", F.col("s.sentiment_score").alias("base_score"))
    return se.finance_overlay(rows, "content", **LEXICON).select(
        "id", "overlay.sentiment_score", "overlay.sentiment_label",
        F.size("overlay.finance_hits").alias("hits"))


@query("sentiment_full", FINANCE_SQL + """
 select f.id, case when trim(content) = '' then 0 else f.score end sentiment_score, case when trim(content) = '' then 'neutral' else lab end sentiment_label,
   case when trim(content) = '' then 0 else round(least(abs(base), 1), 4) end confidence from final f join articles using (id)""")
def sentiment_full(spark, sf):
    out = se.sentiment(v.corpus(spark, sf), "content", base_args=BASE, lexicon=LEXICON)
    return out.select("id", "sentiment.sentiment_score", "sentiment.sentiment_label", "sentiment.confidence")


NB_SQL = TOK + """, y as (select doc_id id, quality = 1 pos from labels),
 counts as (select token, count(*) filter (y.pos) p, count(*) filter (not y.pos) n from tok join y using (id) group by 1),
 tot as (select sum(p) tp, sum(n) tn, count(*) v from counts),
 odds as (select token, ln((p + 1) / (tp + v)) - ln((n + 1) / (tn + v)) o from counts, tot),
 prior as (select ln(count(*) filter (pos) + 1.0::double) - ln(count(*) filter (not pos) + 1.0::double) o from y),
 ev as (select a.id, (select o from prior) + coalesce(sum(d.o), 0) total
   from articles a left join (select id, o from tok join odds using (token)) d using (id) group by 1),
 sc as (select id, round(2 / (1 + exp(-least(greatest(total, -700), 700))) - 1, 4) s from ev) """


@query("nb_sentiment", NB_SQL + """
 select id, s sentiment_score, case when s > 0.15 then 'positive' when s < -0.15 then 'negative' else 'neutral' end sentiment_label,
   abs(s) confidence from sc""")
def nb_sentiment(spark, sf):
    a = v.corpus(spark, sf).select("id", "content")
    labels = v.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("positive"))
    model = se.nb_train(a.join(labels, "id"), "content")
    return se.nb_sentiment(model, a, "content")


@query("breakdown_scored", BASE_SQL + """, l as (select *,
   case when score > 0.1 then 'positive' when score < -0.1 then 'negative' else 'neutral' end lab from base)
 select dimension, "key", round(avg(score),4) avg_score, count(*) filter (lab='positive') positive,
   count(*) filter (lab='negative') negative, count(*) filter (lab='neutral') neutral, count(*) n
 from (select 'source' dimension, source "key", score, lab from l union all select 'category', category, score, lab from l) group by 1, 2""")
def breakdown_scored(spark, sf):
    return stats.sentiment_breakdown(scored(spark, sf).select(
        "source", "category", "s.sentiment_score", "s.sentiment_label"))


@query("economic_trend", BASE_SQL + f""", l as (select *,
   case when score > 0.1 then 'positive' when score < -0.1 then 'negative' else 'neutral' end lab from base),
 top5 as (select id, token, rn from (select id, token, row_number() over (partition by id order by count(*) desc, min(pos)) rn
   from w where length(token) > 1 and {KEPT} group by id, token) where rn <= 5)
 select count(*) total, round(avg(score), 4) average, count(*) filter (lab = 'positive') positive,
   count(*) filter (lab = 'negative') negative,
   case when round(avg(score),4) > 0.15 then 'positive' when round(avg(score),4) < -0.15 then 'negative' else 'neutral' end trend,
   (select string_agg(token, ' ' order by n desc, seen) from (
     select token, count(*) n, min((id, rn)) seen from top5 group by 1 order by n desc, seen limit 10)) dominant
 from l""")
def economic_trend(spark, sf):
    rows = scored(spark, sf).select("id", "s.sentiment_score", "s.sentiment_label")
    words = kw.keywords(v.corpus(spark, sf), "content", 5, stop_words=STOP)
    out = stats.economic_trend(rows.join(words, "id", "left"))
    return out.select("total", "average", "positive", "negative", "trend",
                      F.array_join("dominant_keywords", " ").alias("dominant"))


# --- summaries and entities --------------------------------------------------

LEAD_SQL = """case when trim(content) = '' then '' when length(content) < 50 then trim(content) else
   array_to_string(list_filter(list_transform(string_split(replace(content, chr(10), ' '), '.')[1:3], lambda p: trim(p)), lambda p: p <> ''), '.')
   || '.' end"""


@query("summary_lead", ART + f"select id, {LEAD_SQL} summary from articles")
def summary_lead(spark, sf):
    return v.corpus(spark, sf).select("id", summary.summary_lead("content", 3, ".").alias("summary"))


def rank_sql(rounds=10, damping=0.85):
    """The walk over shared words, one pair of steps a round."""
    steps = "".join(f""",
 x{k} as (select id, word, sum(r / d) / any_value(n) x from edge join r{k - 1} using (id, i) group by 1, 2),
 r{k} as (select t.id, t.i, {1 - damping!r}::double + {damping!r}::double * coalesce(sum(x), 0) r
   from sent t left join edge using (id, i) left join x{k} using (id, word) group by 1, 2)""" for k in range(1, rounds + 1))
    return ART + f""", cut_up as (select id, list_filter(list_transform(regexp_split_to_array(content, '[。！？!?.\n]+'), lambda p: trim(p)), lambda p: p <> '') p
   from articles),
 sent as (select id, generate_subscripts(p, 1) - 1 i, unnest(p) said from cut_up),
 words as (select id, i, unnest(list_distinct(regexp_extract_all(lower(said), '[\\p{{L}}\\p{{Nd}}]{{2,}}'))) word from sent),
 deg as (select id, i, count(*) d from words group by 1, 2),
 held as (select id, word, count(*) n from words group by 1, 2 having count(*) > 1),
 edge as (select id, i, word, d, n from words join deg using (id, i) join held using (id, word)),
 r0 as (select id, i, 1.0::double r from sent){steps},
 best as (select id, i, said, row_number() over (partition by id order by round(r, 9) desc, i) rn from r{rounds} join sent using (id, i))
 select a.id, coalesce(string_agg(said, '. ' order by i), '') summary from articles a left join best on best.id = a.id and rn <= 3 group by 1"""


@query("summary_rank", rank_sql())
def summary_rank(spark, sf):
    return summary.summary_rank(v.corpus(spark, sf), "content", 3, joiner=". ")


COMPANIES = ["The", "Que", "Und", "Der", "Les"]
PEOPLE = ["Of", "And", "Le"]
ENT_SQL = ART + f""", ent as (
 select id, article_id, title, source, list_sort(list_distinct(list_filter(w, lambda x: x in ({_list(COMPANIES)})))) companies,
   list_sort(list_distinct(list_filter(w, lambda x: x in ({_list(PEOPLE)})))) people,
   list_sort(list_distinct(list_filter(w, lambda x: regexp_full_match(x, '[A-Z]{{2,6}}')))) indicators
 from (select *, regexp_extract_all(content, '[\\p{{L}}\\p{{Nd}}]{{2,}}') w from articles)) """
GAZETTEERS = {"companies": COMPANIES, "people": PEOPLE, "organizations": [], "indicators": []}


@query("entities", ENT_SQL + """
 select id, array_to_string(companies,' ') companies, array_to_string(people,' ') people,
   array_to_string(indicators,' ') indicators from ent""")
def entities(spark, sf):
    found = v.corpus(spark, sf).select("id", ent.entities("content", **GAZETTEERS).alias("x"))
    return found.select("id", *[F.array_join(f"x.{k}", " ").alias(k) for k in ("companies", "people", "indicators")])


@query("entities_report", ENT_SQL + """
 select id, article_id, substr(title,1,50) title, array_to_string(companies,' ') companies, array_to_string(people,' ') people
 from ent where len(companies) > 0 or len(people) > 0""")
def entities_report(spark, sf):
    rows = ent.entities_report(v.corpus(spark, sf), **GAZETTEERS)
    return rows.select("id", "article_id", "title", *[
        F.array_join(f"entities.{k}", " ").alias(k) for k in ("companies", "people")])


@query("breakdown_entity", ENT_SQL + """, lab as (select doc_id id, (quality - toxic) * 0.5::double s from labels)
 select c "key", round(avg(coalesce(s,0)),4) avg_score, count(*) n
 from (select id, unnest(companies) c from ent) left join lab using (id) group by 1""")
def breakdown_entity(spark, sf):
    a = v.corpus(spark, sf)
    rows = stats.with_analysis(a, v.analysis(spark, sf)).withColumn(
        "companies", ent.entities("content", **GAZETTEERS)["companies"])
    return stats.sentiment_breakdown(rows, "companies").filter("dimension = 'entity'").select("key", "avg_score", "n")
