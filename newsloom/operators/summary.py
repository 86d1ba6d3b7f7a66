"""Summaries: leading sentences, or the sentences most alike to the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions import expr as e, text as t

STOP = "。"


def summary_lead(text, n: int = 3, stop: str = STOP, short: int = 50) -> Column:
    """The first n sentences. A text under `short` characters stays whole."""
    body = e.text_or_empty(text)
    parts = F.slice(F.split(F.replace(body, F.lit("\n"), F.lit(" ")), e._quote(stop)), 1, n)
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    return (
        F.when(F.trim(body) == "", "")
        .when(F.length(body) < short, F.trim(body))
        .otherwise(F.concat(F.array_join(kept, stop), F.lit(stop)))
    )


def sentences(text, pattern: str = r"[。！？!?.\n]+") -> Column:
    """Array of the non-blank sentences of a text, in order."""
    return F.filter(F.transform(F.split(e.text_or_empty(text), pattern), lambda s: F.trim(s)), lambda s: s != "")


def sentence_ranks(parts: Column, rounds: int = 10, damping: float = 0.85) -> Column:
    """Rank of each sentence by a walk over shared words, for an array of sentences.

    The walk goes sentence -> word -> sentence, so its edges are the words
    themselves and there is never a pair of sentences. Both directions are kept as
    sparse arrays of numbers, and the rounds are one aggregate over them: a text
    never leaves its row. A sentence that shares no word has the rank 1 - damping."""

    def walk(words: Column) -> Column:  # the distinct words of each sentence
        edges = F.flatten(F.transform(words, lambda ws, i: F.transform(ws, lambda w: F.struct(w.alias("key"), i.alias("value")))))
        shared = F.filter(e.grouped(edges), lambda x: F.size(x["values"]) > 1)
        holders = F.coalesce(F.transform(shared, lambda x: x["values"]), F.array().cast("array<array<int>>"))
        return e.bound(holders, lambda rows: rank(words, rows))

    def rank(words: Column, holders: Column) -> Column:  # the sentences of each shared word
        back = F.flatten(F.transform(holders, lambda ss, k: F.transform(ss, lambda s: F.struct(s.alias("key"), k.alias("value")))))
        every = F.transform(words, lambda ws, i: F.struct(i.alias("key"), F.lit(-1).alias("value")))
        held = F.transform(e.grouped(F.concat(back, every)), lambda x: F.filter(x["values"], lambda k: k >= 0))
        return e.bound(held, lambda own: F.aggregate(
            F.sequence(F.lit(1), F.lit(rounds)), F.transform(words, lambda ws: F.lit(1.0)), lambda ranks, _: step(words, holders, own, ranks)))

    def step(words: Column, holders: Column, own: Column, ranks: Column) -> Column:
        given = F.transform(holders, lambda ss: F.aggregate(
            ss, F.lit(0.0), lambda acc, s: acc + F.get(ranks, s) / F.size(F.get(words, s))) / F.size(ss))
        return e.bound(given, lambda shares: F.transform(own, lambda ks: F.lit(1 - damping) + F.lit(damping) * F.aggregate(
            ks, F.lit(0.0), lambda acc, k: acc + F.get(shares, k))))

    return e.bound(F.transform(parts, lambda s: F.array_distinct(t.search_tokens(s))), walk)


def rank_summary(text, n: int = 3, rounds: int = 10, damping: float = 0.85, joiner: str = STOP) -> Column:
    """The n sentences with the highest ranks in reading order; ties (to nine
    digits) go to the earlier one. A text without sentences gives ''."""

    def best(parts: Column) -> Column:
        order = F.sort_array(F.transform(sentence_ranks(parts, rounds, damping), lambda r, i: F.struct((-F.round(r, 9)).alias("r"), i.alias("i"))))
        chosen = F.sort_array(F.transform(F.slice(order, 1, n), lambda x: x["i"]))
        return F.array_join(F.transform(chosen, lambda i: F.get(parts, i)), joiner)

    return e.bound(sentences(text), lambda parts: F.when(F.size(parts) > 0, best(parts)).otherwise(""))


def summary_rank(df: DataFrame, text, n: int = 3, key: str = "id", rounds: int = 10, damping: float = 0.85,
                 joiner: str = STOP) -> DataFrame:
    """(key, summary) of every row."""
    return df.select(key, rank_summary(text, n, rounds, damping, joiner).alias("summary"))
