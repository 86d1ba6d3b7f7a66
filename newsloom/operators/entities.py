"""Named entities by gazetteers and naming rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import fixed_values as fv
from newsloom.functions import expr as e, text as t

KINDS = ("companies", "people", "places", "indicators", "organizations")


def _ends_like(word: Column, marks) -> Column:
    return word.rlike(r"^\p{IsHan}{2,}$") & e.contains_any(word, marks, fold=False)


def entities(text, k: int | None = None, companies=fv.COMPANIES, organizations=fv.ORGANIZATIONS,
             indicators=fv.INDICATORS, people=(), places=(), minor: int | None = None) -> Column:
    """Struct of five sorted lists. A word belongs to the first gazetteer that
    holds it; names of people and places come from their gazetteers, since
    there is no tagger. Words in capitals count as indicators. `k` companies and
    `minor` names of each other kind are kept if they are given."""
    extra = [*companies, *organizations, *indicators, *people, *places]
    words = t.tokens(text, tuple(dict.fromkeys([*t.DICTIONARY, *extra])))
    listed = [*companies, *organizations, *indicators]

    def pick(rule, cap):
        found = F.array_sort(F.array_distinct(F.filter(words, rule)))
        return found if cap is None else F.slice(found, 1, cap)

    def unlisted(word):
        return ~word.isin(listed)

    def member(word, names):
        return word.isin(list(names)) if names else F.lit(False)

    company_mark = lambda w: _ends_like(w, fv.COMPANY_MARKS)
    return F.struct(
        pick(lambda w: member(w, companies) | (unlisted(w) & company_mark(w)), k).alias("companies"),
        pick(lambda w: unlisted(w) & member(w, people), minor).alias("people"),
        pick(lambda w: unlisted(w) & member(w, places) & ~member(w, people), minor).alias("places"),
        pick(lambda w: (member(w, indicators) & ~member(w, [*companies, *organizations]))
             | (unlisted(w) & w.rlike("^[A-Z]{2,6}$")), minor).alias("indicators"),
        pick(lambda w: (member(w, organizations) & ~member(w, companies))
             | (unlisted(w) & ~company_mark(w) & _ends_like(w, fv.ORGANIZATION_MARKS) & (F.length(w) > 2)),
             minor).alias("organizations"),
    )


def entities_report(a: DataFrame, **gazetteers) -> DataFrame:
    """Articles that name a company or a person, with all entity lists."""
    found = a.withColumn("entities", entities(e.first_filled("content", "summary"), **gazetteers))
    return found.filter((F.size("entities.companies") > 0) | (F.size("entities.people") > 0)).select(
        "id", "article_id", e.head("title", 50).alias("title"), "entities")
