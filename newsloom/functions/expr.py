"""Column expressions shared by all operators. Everything here is a built-in
Spark expression, so it stays inside code generation and is pushed to scans
where Spark can do so."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from newsloom import fixed_values as fv

HAN = "[一-鿿]"
TAG = "<[^>]+>"


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_or_empty(value) -> Column:
    return F.coalesce(col(value), F.lit(""))


def first_filled(*values) -> Column:
    """First value that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(col(v), F.lit("")) for v in values], F.lit(""))


def strip_tags(value) -> Column:
    return F.regexp_replace(text_or_empty(value), TAG, "")


def head(value, n: int) -> Column:
    return F.substring(col(value), 1, n)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def md5_id(value) -> Column:
    return F.substring(F.md5(col(value)), 1, 16)


def article_key(url, title) -> Column:
    """md5 of the URL, or of the title when there is no URL; 16 hex digits."""
    return md5_id(first_filled(url, title))


def count_chars(value, char_class: str) -> Column:
    """Characters of a class: what a text loses without them, so no array of them is made."""
    return bound(text_or_empty(value), lambda body: F.length(body) - F.length(F.regexp_replace(body, char_class + "++", "")))


def in_list(column, values, negate: bool = False) -> Column:
    """IN / NOT IN; an empty list is FALSE either way. Null counts as '' so a
    row without a value survives an exclusion."""
    if not values:
        return F.lit(False)
    hit = text_or_empty(column).isin(list(values))
    return ~hit if negate else hit


def split_list(value) -> Column:
    """Comma text to a list; empty text to an empty list."""
    empty = F.array().cast("array<string>")
    return F.when(text_or_empty(value) == "", empty).otherwise(F.split(col(value), ","))


# --- time --------------------------------------------------------------------

def as_time(value) -> Column:
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


def parse_time(value) -> Column:
    """Timestamp of `yyyy-MM-ddTHH:mm:ss…` or the blank-separated form; null
    when the text has neither form."""
    cut = F.substring(F.trim(col(value)), 1, 19)
    return F.coalesce(
        F.try_to_timestamp(cut, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(cut, F.lit("yyyy-MM-dd HH:mm:ss")),
    )


def iso(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")


_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_MAIL_DATE = r"^(?:[A-Za-z]{3},\s*)?(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\s+(\d{2}:\d{2}(?::\d{2})?)\s*([+-]\d{4}|[A-Z]{1,4})?.*$"


def _mail_date(raw: Column) -> Column:
    """ISO text of a mail-style date, keeping its offset; null if it is none."""
    def part(n):
        return F.regexp_extract(raw, _MAIL_DATE, n)

    month = F.lpad(F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.initcap(part(2))).cast("string"), 2, "0")
    clock = F.when(F.length(part(4)) == 5, F.concat(part(4), F.lit(":00"))).otherwise(part(4))
    zone = (
        F.when(part(5).isin("GMT", "UT", "UTC", "Z"), F.lit("+00:00"))
        .when(part(5).isin("", "-0000") | ~part(5).rlike(r"^[+-]\d{4}$"), F.lit(""))
        .otherwise(F.concat(F.substring(part(5), 1, 3), F.lit(":"), F.substring(part(5), 4, 2)))
    )
    local = F.concat(part(3), F.lit("-"), month, F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"), clock)
    return F.when(raw.rlike(_MAIL_DATE) & parse_time(local).isNotNull(), F.concat(local, zone))


def normalize_pubdate(value, now) -> Column:
    """Publish time as ISO text. `now` stands in for what cannot be read."""
    raw = text_or_empty(value)
    now_text = iso(as_time(now))
    kept = raw.startswith("202") & (raw.contains("T") | (F.substring(raw, 5, 1) == "-"))
    epoch = F.when(raw.rlike(r"^\d{1,12}$"), iso(F.timestamp_seconds(raw.try_cast("bigint"))))
    cut = F.substring(raw, 1, 19)
    patterns = ["yyyy-M-d H:m:s", "yyyy-M-d", "yyyy/M/d H:m:s", "M/d/yyyy H:m:s"]
    parsed = [iso(F.try_to_timestamp(cut, F.lit(p))) for p in patterns]
    return (
        F.when(raw == "", now_text)
        .when(kept, F.substring(raw, 1, 25))
        .otherwise(F.coalesce(epoch, _mail_date(raw), *parsed, now_text))
    )


RANGE_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


def time_boundary(range_name: str, now) -> Column:
    """First day of a named range as a date; unknown names mean a week."""
    return F.date_sub(F.to_date(as_time(now)), RANGE_DAYS.get(range_name, 7))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


# --- text rules --------------------------------------------------------------

def valid_text(value, min_len: int = 30, ratio: float = 0.7) -> Column:
    """Long enough, and mostly Han, ASCII letters and digits."""

    def rule(body: Column) -> Column:
        good = count_chars(body, r"[A-Za-z0-9一-鿿\p{Nd}]")
        return (F.length(body) >= min_len) & (good / F.greatest(F.length(body), F.lit(1)) >= ratio)

    # a filter works a derived text out anew at each mention
    return bound(text_or_empty(value), rule)


def detect_language(value) -> Column:
    body = text_or_empty(value)
    visible = F.greatest(F.length(F.replace(body, F.lit(" "), F.lit(""))), F.lit(1))
    return (
        F.when(body == "", "unknown")
        .when(count_chars(body, HAN) / visible > 0.3, "zh")
        .when(count_chars(body, "[A-Za-z]") / visible > 0.5, "en")
        .otherwise("unknown")
    )


def needs_translation(value, target: str) -> Column:
    return detect_language(value) != target


def classify(title, content, patterns: dict | None = None) -> Column:
    """Name of the first keyword group found in the text, ignoring case."""
    patterns = patterns or fv.CATEGORY_KEYWORDS
    body = F.concat_ws(" ", text_or_empty(title), text_or_empty(content))
    rule = None
    for name, words in patterns.items():
        hit = body.rlike("(?iu)" + "|".join(_quote(w) for w in words))
        rule = F.when(hit, name) if rule is None else rule.when(hit, name)
    return rule.otherwise(fv.DEFAULT_CATEGORY)


def _quote(word: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|-" else c for c in word)


def alternation(words) -> str:
    """Regex of the words, longest first so that no word hides a longer one."""
    return "|".join(_quote(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


def contains_any(value, words, fold: bool = True) -> Column:
    """True if any of the words occurs in the text."""
    if not words:
        return F.lit(False)
    flag = "(?iu)" if fold else ""
    return text_or_empty(value).rlike(flag + alternation(words))


def like_any_field(keyword: str, *fields) -> Column:
    """Substring test over several columns, ignoring case; the keyword is
    taken literally, so no wildcard needs escaping."""
    needle = F.lower(F.lit(keyword))
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text_or_empty(f)), needle) for f in fields])


# --- scores ------------------------------------------------------------------

def sentiment_label(score: Column, bound: float) -> Column:
    return F.when(score > bound, "positive").when(score < -bound, "negative").otherwise("neutral")


def length_quality(title, content, source, trusted=fv.QUALITY_SOURCES) -> Column:
    """Ranking used to order one collected batch."""
    return (
        F.least(F.length(text_or_empty(content)) / 100, F.lit(10.0))
        + F.least(F.length(text_or_empty(title)) / 10, F.lit(5.0))
        + F.when(in_list(source, trusted), 2.0).otherwise(0.0)
    )


def latest_score(published_at, hotness, tags, now) -> Column:
    """Freshness, reader activity and number of tags in one ranking value."""
    at = parse_time(published_at)
    now = as_time(now)
    fresh = (
        F.when(at >= now - F.expr("interval 1 day"), 1.0)
        .when(at >= now - F.expr("interval 7 days"), 0.5)
        .otherwise(0.1)
    )
    tag_count = F.greatest(F.coalesce(F.size(col(tags)), F.lit(0)), F.lit(0))
    return fresh * 0.5 + F.coalesce(col(hotness), F.lit(0.0)) * 0.3 + F.least(tag_count, F.lit(10)) * 0.02


def quality_parts(title, content, source, published_at, now,
                  high=fv.HIGH_TRUST_SOURCES, medium=fv.MEDIUM_TRUST_SOURCES) -> Column:
    """Struct of the five quality signals, their total and its label."""
    body = F.concat(text_or_empty(title), F.lit(" "), text_or_empty(content))
    n = F.length(body)
    length = F.when(n >= 500, 30).when(n >= 200, 25).when(n >= 80, 15).otherwise(5)
    trust = F.when(in_list(source, high), 25).when(in_list(source, medium), 18).otherwise(10)
    numbers = F.regexp_count(body, F.lit(r"\p{Nd}+\.?\p{Nd}*%?"))
    density = F.least(F.lit(20), F.floor(numbers / F.greatest(n / 100, F.lit(1.0)) * 10).cast("int"))
    at = F.when(text_or_empty(published_at).startswith("202"), parse_time(published_at))
    age = hours_between(as_time(now), at)
    timely = (
        F.when(at.isNull(), 5).when(age < 1, 15).when(age < 6, 12)
        .when(age < 24, 8).when(age < 72, 4).otherwise(1)
    )
    long_lines = F.regexp_count(text_or_empty(content), F.lit(r"(?m)^[^\n]{21,}$"))
    structure = F.least(F.lit(10), long_lines)
    total = length + trust + density + timely + structure
    return F.struct(
        total.cast("int").alias("total"), length.alias("length"), trust.alias("trust"),
        density.alias("density"), timely.alias("timeliness"), structure.cast("int").alias("structure"),
        F.when(total >= 70, "high").when(total >= 45, "medium").otherwise("low").alias("label"),
    )


# --- URLs --------------------------------------------------------------------

def absolute_url(base, href) -> Column:
    """`href` as seen from the page `base`."""
    base, href = col(base), col(href)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(path == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(path, href))
        .when(href == "", base)
        .otherwise(F.concat(folder, F.regexp_replace(href, r"^(\./)+", "")))
    )


def bound(value: Column, use) -> Column:
    """`use` applied to a value that is computed once, however often it names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column, block: int = 64) -> Column:
    """Sums of an array of integers up to each place: inside blocks and over the
    blocks, so a long array does not cost the square of its length."""

    def sums(first: Column, part: Column) -> Column:
        return F.aggregate(part, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def over(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
        piece = lambda b: F.transform(F.sequence(b * block, F.least((b + 1) * block, F.size(v)) - 1), lambda i: F.get(v, i))
        totals = F.transform(blocks, lambda b: F.aggregate(piece(b), F.lit(0), lambda acc, x: acc + x))
        return bound(sums(F.lit(0), totals), lambda starts: F.flatten(F.transform(
            blocks, lambda b: F.slice(sums(F.get(starts, b), piece(b)), F.lit(2), F.lit(block)))))

    return bound(values, lambda v: F.when(F.size(v) > 0, over(v)).otherwise(F.array().cast("array<int>")))


def grouped(pairs: Column) -> Column:
    """Array of (key, values) from an array of (key, value): keys ascending, the
    values of each ascending. Sorted and cut into runs inside the row; an empty or
    null array gives null."""

    def groups(rows: Column) -> Column:
        key = lambda i: F.get(rows, i)["key"]
        starts = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: (i == 0) | (key(i) != key(i - 1)))
        return bound(F.concat(starts, F.array(F.size(rows))), lambda at: F.transform(
            F.sequence(F.lit(0), F.size(at) - 2),
            # a run is read by its places: cutting it out would copy the whole array for every key
            lambda k: F.struct(key(F.get(at, k)).alias("key"), F.transform(
                F.sequence(F.get(at, k), F.get(at, k + 1) - 1), lambda i: F.get(rows, i)["value"]).alias("values"))))

    return bound(F.sort_array(pairs), lambda rows: F.when(F.size(rows) > 0, groups(rows)))
