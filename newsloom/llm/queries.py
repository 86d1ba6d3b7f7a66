"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm import bpe, chat, decontaminate, licenses, line_dedup, lm, near_dup, phrases, quality, ranked, repeats, secrets, warc
from newsloom.llm.common import read
from newsloom.session import cut

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dup.with_components(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


@query("op4_quality_rules", rf"""
with d as (
  select doc_id, coalesce(text, '') t, 'h' || source host, text,
    {_WORDS.format("coalesce(text, '')")} w
  from documents),
grams as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g
  from d, unnest(range(1, len(w) - 1)) r(i)),
twice as (select doc_id, g from grams group by all having count(*) > 1),
inside as (select distinct doc_id, i + k pos from grams join twice using (doc_id, g), unnest([0, 1, 2]) o(k)),
repeated as (select doc_id, count(*) n from inside group by 1),
lines as (
  select doc_id, t, host, l, len({_WORDS.format("l")}) n, array_to_string({_WORDS.format(_LOWER.format("l"))}, ' ') norm
  from d, unnest(string_split(t, chr(10))) u(l)
  where len({_WORDS.format("l")}) > 0),
dups as (select doc_id, count(*) - count(distinct l) n from lines group by 1),
totals as (select host, count(distinct t) host_docs from d group by 1),
over_limit as (
  select host, norm from lines join totals using (host) group by host, norm, host_docs
  having count(distinct t) > {quality.MIN_DOCS} and count(distinct t) > {quality.MAX_SHARE} * host_docs),
removed as (select doc_id, sum(n) n from lines join over_limit using (host, norm) group by 1),
rated as (
  select d.doc_id, len(w) n_words, length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g')) word_chars,
    length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) n_symbols,
    coalesce(dups.n, 0) n_dup_lines, coalesce(repeated.n, 0) n_repeat_words, coalesce(removed.n, 0) removed_words
  from d left join dups using (doc_id) left join repeated using (doc_id) left join removed using (doc_id)),
failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from rated)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words::bigint removed_words,
  not base_failed and not (removed_words > 0 and n_words - removed_words < {quality.MIN_LEFT} * n_words) kept
from failed""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(cut(quality.measure(read(spark, sf_dir, "documents"))))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       F.col("removed_words").cast("long").alias("removed_words"), "kept")


@query("op5_benchmark_decontamination", rf"""
with d as (select doc_id, {_PLAIN.format("text")} w from documents),
b as (select item_id, {_PLAIN.format("text")} w from benchmark),
windows as (
  select distinct item_id, least(10, len(w)) n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') g
  from b, unnest(range(1, len(w) - least(10, len(w)) + 2)) r(i) where len(w) > 0),
sizes as (select distinct n from windows),
hits as (
  select doc_id, i, n, item_id
  from (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') g
        from d, sizes, unnest(range(1, len(w) - n + 2)) r(i)) join windows using (n, g)),
places as (select doc_id, count(distinct i + k) n_hit from hits, unnest(range(0, n)) o(k) group by 1),
items as (
  select doc_id, count(distinct item_id) n_items, sha256(array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',')) s
  from hits group by 1)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(s, sha256('')) items_sha256,
  coalesce(n_hit, 0) > 0 contaminated
from d left join places using (doc_id) left join items using (doc_id)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("op8_license_scan", rf"""
with d as (select doc_id, coalesce(text, '') t, {_PLAIN.format("text")} w from documents),
phrases as (
  select string_split(unnest({_sql_list(p for p, _ in licenses.PHRASES)}), ' ') p, unnest({_sql_list(x for _, x in licenses.PHRASES)}) label),
places as (
  select doc_id, i - 1 place, label from d, phrases, unnest(range(1, len(w) - len(p) + 2)) r(i) where w[i:i + len(p) - 1] = p),
base as (
  select doc_id, count(*) n, min(place) first_word, max(place) last_word, list(distinct label) labels from places group by 1),
templates as (
  select row_number() over () tid, label, list_distinct({_PLAIN.format("t")}) s
  from (select unnest({_sql_list(t for _, t in licenses.TEMPLATES)}) t, unnest({_sql_list(x for x, _ in licenses.TEMPLATES)}) label)),
found as (
  select doc_id, label, len(list_intersect(list_distinct(lw), s)) / len(s)::double share
  from (select doc_id, {_PLAIN.format("l")} lw from d, unnest(string_split(t, chr(10))) u(l)), templates),
blocks as (
  select doc_id, list(distinct label) labels, max(share) share from found where share >= {licenses.THRESHOLD} - 1e-9 group by 1)
select d.doc_id, len(w) n_words, coalesce(base.n, 0) n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(blocks.labels, [])))), ',') labels,
  case when base.n > 0 then 1.0::double else coalesce(share, 0.0)::double end score
from d left join base using (doc_id) left join blocks using (doc_id)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(read(spark, sf_dir, "documents"))
    n = F.size("places").cast("long")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return rows.select(
        "doc_id", "n_words", n.alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        joined(F.col("place_labels")).alias("base_labels"), joined(F.concat("place_labels", "block_labels")).alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("block_shares"), F.lit(0.0))).alias("score"))


_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"


@query("op10_warc", f"""
with p as (select page_id, coalesce(html, '') h from pages),
g as (select h, min(page_id) first_id from p group by 1),
x as (
  select page_id, h, first_id,
    [cast('0x' || substr(sha1(h), 10 * k + 1, 10) as bigint) for k in range(0, 4)] v
  from p join g using (h))
select page_id, strlen(h)::bigint payload_bytes,
  array_to_string([array_to_string([substr({_BASE32}, ((n >> (35 - 5 * i)) & 31)::int + 1, 1) for i in range(0, 8)], '') for n in v], '')
    payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end record_type,
  case when page_id <> first_id then first_id end refers_to
from x""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(read(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _sql_spans(number: int, rule: secrets.Rule) -> str:
    p = rule.pattern.replace("'", "''")
    sizes = f"[length(x) for x in regexp_extract_all(t, '{p}', {rule.group})]" if rule.least else "[0 for x in hits]"
    return f"""
  select doc_id, {number} kind, '{rule.kind}' name, unnest(range(1, len(hits) + 1)) i, unnest(hits) hit, unnest(gaps[:len(hits)]) gap, unnest({sizes}) size
  from (select doc_id, t, [length(x) for x in regexp_extract_all(t, '{p}')] hits, [length(x) for x in regexp_split_to_array(t, '{p}')] gaps
        from d where regexp_matches(t, '{p}'))"""


@query("op7_secret_scan", f"""
with d as (select doc_id, coalesce(text, '') t from documents),
pieces as ({" union all ".join(_sql_spans(n, r) for n, r in enumerate(secrets.RULES))}),
placed as (
  select *, sum(gap + hit) over (partition by doc_id, kind order by i) stop from pieces),
spans as (
  select doc_id, kind, stop - hit start, name || ':' || cast(stop - hit as bigint) || ':' || cast(stop as bigint) s
  from placed where kind > 0 or size >= 6),
joined as (
  select doc_id, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access, count(*) filter (kind = 2) n_hex,
    coalesce(string_agg(s, ',' order by start, kind) filter (kind < 3), '') base, string_agg(s, ',' order by start, kind) s
  from spans group by 1)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(s, '') spans
from d left join joined using (doc_id)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < len(secrets.BASE_RULES))
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                       F.sha2(secrets.as_text(base), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"))


_ESCAPED = (r"regexp_replace(replace({0}, '\', '\\'), '([<\[])(\|turn\|>|\|text\|>|\|end\|>|/?s>|/?INST\])', '\1\\\2', 'g')")


@query("op3_chat_windows", f"""
with c as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (
  select *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + {chat.OVERHEAD} cost,
    row_number() over w - 1 pos, count(*) over (partition by conv_id) n_turns, first(role) over w first_role,
    length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + {len(chat.TURN + chat.TEXT + chat.END)} chars
  from c window w as (partition by conv_id order by turn, role, text)),
s as (
  select *, case when first_role = 'system' and n_turns > 1 then first(cost) over w else 0 end reserved,
    case when first_role = 'system' and n_turns > 1 then first(chars) over w else 0 end system_chars,
    sum(cost) over w - cost at_all from o window w as (partition by conv_id order by pos)),
b as (
  select *, at_all - reserved beg, {chat.BUDGET} - reserved room, greatest(1, floor(({chat.BUDGET} - reserved) / 2)) step
  from s where not (reserved > 0 and pos = 0)),
t as (select *, floor(beg / step) * 2 + (cost > step)::int span from b),
spans as (
  select conv_id, span, min(beg) start_at, sum(cost) cost, max(room) room, max(system_chars) system_chars, sum(chars) chars
  from t group by 1, 2),
r as (select *, greatest(0, least({chat.HISTORY}, room - cost, start_at)) reach from spans),
repeated as (
  select r.conv_id, r.span, sum(t.chars) chars from r join t on t.conv_id = r.conv_id and t.beg >= r.start_at - reach and t.beg < r.start_at
  group by 1, 2),
lengths as (
  select conv_id, sum(r.chars + system_chars + coalesce(repeated.chars, 0)) chars, count(*) n_windows
  from r left join repeated using (conv_id, span) group by 1),
turns as (
  select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) turns_sha256,
    coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '') loss
  from o group by 1)
select conv_id, n_turns, turns_sha256, length(loss) loss_chars, sha256(loss) loss_sha256, chars::bigint formatted_chars, n_windows
from turns join lengths using (conv_id)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    made = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(made)
    rows = chat.read_back(cut(chat.windows(turns)))
    return rows.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_windows")


@query("op6_bpe_words")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.decode(bpe.encode(read(spark, sf_dir, "documents")))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query("op9_lm_scores")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.duplicate_lines(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "n_links",
                       F.col("removed.no").alias("removed_lines"), F.col("removed.kept_in").alias("kept_in"))


_N = repeats.LENGTH


@query("op11_suffix_array_dedup", f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, '')) n from documents),
strings as (select doc_id, i, substr(h, 2 * i + 1, 2 * {_N}) s from d, unnest(range(0, n - {_N} + 1)) r(i)),
least as (select s, min(doc_id) first_id from strings group by 1),
lost as (select doc_id, i from strings join least using (s) where doc_id > first_id),
marked as (select *, (lag(i) over w is null or i > lag(i) over w + {_N})::int new from lost window w as (partition by doc_id order by i)),
numbered as (select doc_id, i, sum(new) over (partition by doc_id order by i) span from marked),
spans as (select doc_id, span, min(i) a, max(i) + {_N} b from numbered group by 1, 2),
between as (select doc_id, a, b, a - coalesce(lag(b) over (partition by doc_id order by a), 0) gap from spans),
kept as (
  select doc_id, sum(b - a) n_removed, count(*) n_spans, string_agg(substr(h, 2 * (a - gap) + 1, 2 * gap), '' order by a) || substr(any_value(h), 2 * max(b) + 1) left_over
  from between join d using (doc_id) group by 1)
select doc_id, n::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
  sha256(unhex(coalesce(left_over, h))) kept_sha256
from d left join kept using (doc_id)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.find(read(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0), lambda s, x: s + x)
    return rows.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_ranked_search", f"""
with d as (select doc_id, {_PLAIN.format("text")} w from documents where text is not null),
sizes as (select doc_id, len(w)::bigint n from d where len(w) > 0),
total as (select count(*)::bigint nn, sum(n)::bigint ll from sizes),
words as (select doc_id, unnest(w) t from d),
tf as (select doc_id, t, count(*) tf from words group by 1, 2),
df as (select t, count(*) df from tf group by 1),
queries as (select distinct item_id, unnest({_PLAIN.format("text")}) t from benchmark where text is not null),
weights as (select t, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint w from df, total),
scores as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::bigint score
  from queries join weights using (t) join tf using (t) join sizes using (doc_id), total group by 1, 2),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) r from scores where score > 0)
select item_id, r::int rank, doc_id, score from ranked where r <= {ranked.K}""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_SPACED = "regexp_split_to_array({0}, '[.,;:!?\\x0A-\\x0D]')"


@query("op13_phrase_collocations", f"""
with pieces as (select coalesce(lang, 'und') lang, unnest({_SPACED.format(_LOWER.format("text"))}) p from documents),
words as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') w from pieces),
total as (select lang, sum(len(w))::bigint n from words group by 1),
grams as (
  select lang, s, array_to_string(w[i:i + s - 1], ' ') phrase, count(*) f
  from words, unnest(range(1, {phrases.LONGEST + 1})) k(s), unnest(range(1, len(w) - s + 2)) r(i) group by 1, 2, 3 having count(*) >= {phrases.LEAST}),
several as (select lang, phrase, s, f a, string_split(phrase, ' ') w from grams where s > 1),
cuts as (
  select c.lang, c.phrase, c.a, k, x.f l, y.f r, ((2000000::hugeint * c.a) // (x.f + y.f))::bigint score
  from (select *, unnest(range(1, s)) k from several) c
  join grams x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:k], ' ')
  join grams y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1:], ' ')),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_phrases as (
  select lang, array_to_string(w[i:i + t - 1], ' ') phrase, max(a) most
  from several, unnest(range(2, s)) k(t), unnest(range(1, s - t + 2)) r(i) group by 1, 2),
kept as (select lowest.* from lowest left join inner_phrases using (lang, phrase) where most is null or 100::hugeint * most < {phrases.ABSORB} * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) r_ from kept)
select lang, r_::int rank, phrase, a::bigint a, l::bigint l, r::bigint r, n, score from ranked join total using (lang) where r_ <= {phrases.TOP}""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(read(spark, sf_dir, "documents"))
