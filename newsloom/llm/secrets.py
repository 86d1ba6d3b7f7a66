"""Secret scans over a trigram inverted index, in DataFrame functions only.

Every rule's regular expression is turned into a Boolean query over trigrams
that each of its matches must hold. The index has a posting (trigram, document)
for the trigrams that some rule asks for, taken from the case-folded text.
Intersecting and uniting postings gives the candidates of a rule; only those are
searched with its expression. A rule without mandatory trigrams (a run of hex
digits has none) scans every text.

Positions are code points: the text is split at the matches, and lengths of
gaps and matches are added up.

Defined results: a null text is empty and has no match. Rows are keyed by a hash
of id and text; a collision only makes an extra candidate. Repeated rows get
equal results. A very long text is searched whole. `docs` may have any other
columns. An empty table gives no rows.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import row_key
from newsloom.session import cut


class Rule(NamedTuple):
    kind: str
    pattern: str            # valid for Java and Python alike
    group: int = 0          # this group must have `least` characters
    least: int = 0


BASE_RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # greedy runs: the ones of enough characters are the ones with a lower bound
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: Well-known forms of keys and credentials.
MORE_RULES = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_password", r"[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9._%-]+:[A-Za-z0-9._%!-]+@"),
]
RULES = BASE_RULES + MORE_RULES

_MOST = 64  # strings, or sets of trigrams, that are kept apart


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """An AND of ORs of trigram sets that every match of `pattern` fulfils, over
    lower-cased text. An empty list means that nothing is mandatory."""
    tree = rp.parse(pattern)
    strings, query = _concat(list(tree))
    return _reduced(query + ([_trigrams(strings)] if strings else []))


def _trigrams(strings: set[str]) -> list[frozenset[str]]:
    return [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings]


def _reduced(query: list[list[frozenset[str]]]) -> list[list[frozenset[str]]]:
    out = []
    for choice in query:
        sets = set(choice)
        least = [s for s in sets if not any(o < s for o in sets)]
        if frozenset() not in sets and least not in out:
            out.append(sorted(least, key=sorted))
    return out


def _concat(items: list) -> tuple[set[str] | None, list]:
    """The finite set of strings that the items match (None: not finite), and the
    query that holds besides."""
    strings, query, finite = {""}, [], True
    for item in items:
        own, asks = _one(item)
        query += asks
        joined = None if own is None else {a + b for a, b in product(strings, own)}
        if joined is None or len(joined) > _MOST:
            query.append(_trigrams(strings))
            finite, strings = False, {""} if own is None else own
        else:
            strings = joined
    if finite:
        return strings, query
    return None, [*query, _trigrams(strings)]


def _one(item) -> tuple[set[str] | None, list]:
    kind, value = item
    if kind is rc.LITERAL:
        return ({chr(value).lower()}, []) if value < 128 else (None, [])
    if kind is rc.IN:
        chars = set()
        for what, x in value:
            if what is rc.LITERAL and x < 128:
                chars.add(chr(x).lower())
            elif what is rc.RANGE and x[1] < 128 and x[1] - x[0] < 8:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, []
        return (chars, []) if len(chars) <= 8 else (None, [])
    if kind is rc.SUBPATTERN:
        return _concat(list(value[3]))
    if kind is rc.BRANCH:
        parts = [_concat(list(b)) for b in value[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), [_any([q for _, q in parts])] if any(q for _, q in parts) else []
        return None, [_any([q + ([_trigrams(s)] if s is not None else []) for s, q in parts])]
    if kind in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
        low, high, body = value
        own, asks = _concat(list(body))
        if low == 0:
            return (own | {""}, []) if own is not None and high == 1 else (None, [])
        if own is not None and low == high and len(own) ** min(low, 7) <= _MOST and low <= 8:
            return {"".join(p) for p in product(own, repeat=low)}, asks
        return None, asks + ([_trigrams(own)] if own is not None else [])
    return None, []


def _any(queries: list[list]) -> list[frozenset[str]]:
    """One of several queries holds: their sets multiplied out, or no demand."""
    out: list[frozenset[str]] = []
    for query in queries:
        sets = [frozenset().union(*p) for p in product(*query)] if query else [frozenset()]
        out += sets
        if len(out) > _MOST:
            return [frozenset()]
    return out


def postings(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(trigram, key): the number of a trigram in `trigrams` and the key of a row
    whose case-folded text holds it."""
    folded = docs.select(row_key(doc_id, text).alias("key"), F.lower(F.col(text)).alias("folded"))
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return folded.select(F.explode(held).alias("trigram"), "key")


def candidates(index: DataFrame, queries: dict[int, list], trigrams: list[str]) -> DataFrame:
    """(key, rules): bit r of `rules` is set if the row's postings fulfil the
    query of rule r. A key's postings are united before the shuffle."""
    number = {t: i for i, t in enumerate(trigrams)}
    words = (len(trigrams) + 61) // 62
    one = F.lit(1).cast("long")
    united = index.groupBy("key").agg(*[
        F.bit_or(F.when(F.floor(F.col("trigram") / 62) == w, F.expr("shiftleft(1L, trigram % 62)")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}")
        for w in range(words)])

    def holds(choice: frozenset[str]) -> Column:
        masks = [0] * words
        for t in choice:
            masks[number[t] // 62] |= 1 << (number[t] % 62)
        return _all([F.col(f"w{w}").bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long") for w, m in enumerate(masks) if m])

    rules = F.lit(0).cast("long")
    for r, query in queries.items():
        fulfilled = _all([_either([holds(c) for c in choices]) for choices in query])
        rules = rules.bitwiseOR(F.when(fulfilled, F.lit(1 << r).cast("long")).otherwise(one * 0))
    return united.select("key", rules.alias("rules")).filter("rules <> 0")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _either(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def match_spans(text: Column, rule: Rule, number: int) -> Column:
    """The leftmost non-overlapping matches of a rule as (start, kind, end)."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    hits = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length)
    if rule.least:
        sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length)
    else:
        sizes = F.transform(hits, lambda h: F.lit(rule.least))
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), sizes.alias("size"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("out"))

    def add(state: Column, step: Column) -> Column:
        begin = state["at"] + step["gap"]
        end = begin + step["hit"]
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(step["size"] >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    return F.aggregate(steps, start, add, lambda s: s["out"])


def scan(docs: DataFrame, rules: list[Rule] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, doc_id and spans, an array of (start, kind, end)
    sorted by start, then by the rule's place in `rules`."""
    rules = RULES if rules is None else rules
    queries = {r: q for r, rule in enumerate(rules) if (q := trigram_query(rule.pattern))}
    trigrams = sorted({t for q in queries.values() for choices in q for c in choices for t in c})
    rows = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    if trigrams:
        index = cut(postings(docs, trigrams, doc_id, text))
        found = cut(candidates(index, queries, trigrams))
        rows = rows.join(found, "key", "left")
    else:
        rows = rows.withColumn("rules", F.lit(0).cast("long"))
    none = F.expr(f"cast(array() as {_SPANS})")
    spans = []
    for r, rule in enumerate(rules):
        if r in queries:
            asked = F.coalesce(F.col("rules").bitwiseAND(F.lit(1 << r).cast("long")) != 0, F.lit(False))
        else:
            asked = F.col("text").rlike(rule.pattern)
        spans.append(F.when(asked, match_spans(F.col("text"), rule, r)).otherwise(none))
    return rows.select("key", "doc_id", F.array_sort(F.flatten(F.array(*spans))).alias("spans"))


def as_text(spans: Column, rules: list[Rule] | None = None) -> Column:
    """Spans as `kind:start:end`, comma-joined."""
    rules = RULES if rules is None else rules
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
