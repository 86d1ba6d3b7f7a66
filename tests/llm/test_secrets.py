import random
import re

from newsloom.llm import secrets as sec


def brute(text, rules=sec.RULES):
    out = []
    for n, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or ""):
            if not rule.least or len(m[rule.group]) >= rule.least:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_queries_hold_for_matches():
    r = random.Random(1)
    samples = ["api_key='abcdef'", "PASSWD:abcdefgh", "AKIA" + "A1" * 8, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-" + "1" * 12,
               "AIza" + "b" * 35, "eyJ" + "a" * 9 + "." + "b" * 9 + ".c", "https://user:pass@host"]
    for rule in sec.RULES:
        query = sec.trigram_query(rule.pattern)
        for s in samples:
            if re.search(rule.pattern, s):
                low = "x" * r.randrange(3) + s.lower()
                assert all(any(all(t in low for t in c) for c in choices) for choices in query), (rule.kind, s)
    assert sec.trigram_query(r"[0-9a-f]{24,}") == [] and sec.trigram_query(r"a?b*") == []
    assert sec.trigram_query(r"(foo|bar)baz") == [[frozenset({"bar", "arb", "rba", "baz"}), frozenset({"foo", "oob", "oba", "baz"})]]
    assert sec.trigram_query(r"abcd.*wxyz") == [[frozenset({"abc", "bcd"})], [frozenset({"wxy", "xyz"})]]


def texts():
    r = random.Random(2)
    parts = ["password: token: abcdef", 'Api_Key="AbC123=="', "secret=short", "secret = longer1", "AKIA" + "Q7" * 8, "AKIAAKIA" + "Z" * 14, "f" * 23, "0a" * 15,
             "é😀ü", " ", "\n", "token=secret=abcdefgh", "-----BEGIN PRIVATE KEY-----", "ghs_" + "Ab1" * 13, "ftp://a.b:c@d", "plain words", "KIA aki", "passw ord"]
    return ["".join(r.choice(parts) + r.choice(["", " ", "x"]) for _ in range(r.randrange(12))) for _ in range(80)]


def test_spans_against_brute_force(documents):
    rows = [(i, t) for i, t in enumerate(texts())] + [(100, None), (101, ""), (None, "token: abcdefg"), (1, texts()[1])]
    docs = documents(*rows).selectExpr("*", "1 as rules", "2 as spans", "3 as folded")
    got = sec.scan(docs).collect()
    want = sorted((str(i), brute(t)) for i, t in rows)
    assert sorted((str(r.doc_id), [tuple(x) for x in r.spans]) for r in got) == want
    shown = {r.doc_id: r.s for r in sec.scan(docs).select("doc_id", sec.as_text(sec.F.col("spans")).alias("s")).collect()}
    assert shown[None] == "assign:0:14" and shown[100] == ""


def test_rules_without_trigrams_and_empty_table(documents):
    docs = documents((1, "ab12 cd"), (2, None))
    rules = [sec.Rule("digits", r"[0-9]+"), sec.Rule("pair", r"[0-9]{2}")]
    assert {r.doc_id: [tuple(x) for x in r.spans] for r in sec.scan(docs, rules).collect()} == {1: [(2, 0, 4), (2, 1, 4)], 2: []}
    assert sec.scan(docs.filter("false")).count() == 0
