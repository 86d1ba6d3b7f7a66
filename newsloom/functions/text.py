"""Word segmentation and the term table.

Segmentation is one regular expression: dictionary terms first (longest
first), then runs of letters and digits, then pairs of Han characters. It runs
inside the JVM; a deployment with its own segmenter passes a token column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import fixed_values as fv
from newsloom.functions import expr as e

# ASCII comes first: only what is neither Latin letter nor digit has its script looked up
WORD = r"[A-Za-z0-9[\p{L}\p{Nd}&&[^\p{IsHan}]]]"

# multi-character terms the lexicon operators must see as one token
DICTIONARY = tuple(dict.fromkeys(
    fv.BASE_POSITIVE + fv.BASE_NEGATIVE + list(fv.BASE_DEGREES) + fv.REPORT_POSITIVE + fv.REPORT_NEGATIVE
    + fv.COMPANIES + fv.ORGANIZATIONS + fv.INDICATORS + [w for w in fv.KEYWORD_STOP_WORDS if len(w) > 1]))


def _pattern(dictionary, word: str, extra=(), lone_han: bool = False) -> str:
    # a Latin dictionary term only counts as a whole word; terms are tried only
    # where a Han character stands, so other scripts skip the list at once
    terms = [t for t in [*dictionary, *extra] if not t.isascii()]
    mixed = [t for t in terms if t[0].isascii()]
    native = e.alternation([t for t in terms if not t[0].isascii()])
    # a pair of characters must not swallow the beginning of a term
    second = rf"(?!{native})\p{{IsHan}}" if native else r"\p{IsHan}"
    pair = rf"\p{{IsHan}}(?:{second})" + ("?" if lone_han else "")
    parts = [e.alternation(mixed)] if mixed else []
    parts.append(word)
    if native:
        parts.append(rf"(?=\p{{IsHan}})(?:{native})")
    return "|".join(parts + [pair])


def tokens(text, dictionary=DICTIONARY) -> Column:
    """Words of at least two characters, in reading order."""
    return F.regexp_extract_all(
        e.text_or_empty(text), F.lit(_pattern(dictionary, WORD + WORD + "++")), F.lit(0))


def all_tokens(text, dictionary=DICTIONARY, singles=tuple(fv.BASE_NEGATIONS)) -> Column:
    """Words of any length; the given single characters stand alone."""
    return F.regexp_extract_all(
        e.text_or_empty(text), F.lit(_pattern(dictionary, WORD + "++", singles, True)), F.lit(0))


def search_tokens(text, dictionary=DICTIONARY) -> Column:
    return tokens(F.lower(e.text_or_empty(text)), dictionary)


def lead(text, chars: int | None) -> Column:
    return e.text_or_empty(text) if chars is None else F.substring(e.text_or_empty(text), 1, chars)


def article_text(chars: int | None = None) -> Column:
    """Title and body, the summary standing in for a missing body."""
    return F.concat(e.text_or_empty("title"), F.lit(" "), lead(e.first_filled("content", "summary"), chars))


def kept_tokens(words: Column, stop_words, drop_digits: bool = True) -> Column:
    def keep(word):
        ok = ~word.isin(list(stop_words)) if stop_words else F.lit(True)
        return ok & ~word.rlike(r"^\p{Nd}+$") if drop_digits else ok

    return F.filter(words, keep)


def position_vector(words: Column) -> Column:
    """Array of (token, positions) of an array of words, by token: sorted with their
    positions and cut into runs, all inside the row."""
    none = F.array().cast("array<struct<token:string,positions:array<int>>>")
    placed = F.transform(words, lambda w, i: F.struct(w.alias("key"), i.alias("value")))
    return F.coalesce(F.transform(e.grouped(placed), lambda x: F.struct(x["key"].alias("token"), x["values"].alias("positions"))), none)


def term_vector(words: Column) -> Column:
    """Array of (token, tf, pos), by token: frequency and first position."""
    return F.transform(position_vector(words), lambda x: F.struct(
        x["token"].alias("token"), F.size(x["positions"]).cast("bigint").alias("tf"), F.get(x["positions"], F.lit(0)).alias("pos")))


def term_table(df: DataFrame, words: Column, key: str = "id", keep_empty: bool = False) -> DataFrame:
    """(key, token, tf, pos): frequency and first position per document. The
    vectors are made inside the rows, so no text and no word is shuffled."""
    explode = F.explode_outer if keep_empty else F.explode
    return df.select(key, explode(term_vector(words)).alias("_t")).select(key, "_t.token", "_t.tf", "_t.pos")
