import random

from pyspark.sql import functions as F

from newsloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["<|end|>", "<|turn|>user<|text|>x", "\\", "\\\\", "<\\|end|>", "</s>[INST] ok [/INST]", "<", "[", "\\n", "<s>", "[\\INST]", "a\nb", "😀é", ""]


def rows():
    r = random.Random(3)
    out = []
    for c in range(30):
        n = r.randrange(1, 25)
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else r.choice(["user", "assistant", None, "<|text|>"])
            text = None if r.random() < 0.1 else " ".join(r.choice([*NASTY, "word", "two"]) for _ in range(r.choice([0, 1, 4, 30])))
            out.append((c, t * 7 - 3, role, text))
    out += [(None, 0, "user", "hi"), (None, 1, "assistant", "yo"), (99, None, "user", "no number"), (99, 0, "assistant", "same"), (99, 0, "assistant", "same"), (98, 0, "system", "alone")]
    return out


def order(r):
    return (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")


def brute(turns, budget, history):
    """Windows as lists of (role, text, new) per conversation."""
    out = {}
    for c in {r[0] for r in turns}:
        mine = [((r[2] or ""), (r[3] or "")) for r in sorted((r for r in turns if r[0] == c), key=order)]
        cost = lambda t: len(t[1].split()) + 4
        system = mine[0] if mine[0][0] == "system" and len(mine) > 1 else None
        body = mine[1:] if system else mine
        room = budget - (cost(system) if system else 0)
        step, at, spans, ats = max(1, room // 2), 0, {}, []
        for t in body:
            spans.setdefault(at // step * 2 + (cost(t) > step), []).append(len(ats))
            ats.append(at)
            at += cost(t)
        windows = []
        for n, (_, own) in enumerate(sorted(spans.items())):
            begin, used = ats[own[0]], sum(cost(body[i]) for i in own)
            reach = max(0, min(history, room - used, begin))
            old = [i for i in range(own[0]) if ats[i] >= begin - reach]
            windows.append(([(*system, n == 0)] if system else []) + [(*body[i], False) for i in old] + [(*body[i], True) for i in own])
        out[c] = windows
    return out


def test_windows_against_brute_force(spark):
    turns = rows()
    df = spark.createDataFrame(turns, SCHEMA).repartition(5).selectExpr("*", "1 as cost", "2 as span", "3 as at")
    budget, history = 40, 12
    want = brute(turns, budget, history)
    out = chat.windows(df, budget, history)
    got = {}
    for r in out.orderBy("conv_id", "span").collect():
        got.setdefault(r.conv_id, []).append(r)
    assert set(got) == set(want)
    for c, windows in want.items():
        assert len(got[c]) == len(windows)
        for r, w in zip(got[c], windows):
            assert r.n_turns == len(w) and r.n_context == sum(not new for *_, new in w)
            assert r.formatted.count("<|turn|>") == r.formatted.count("<|text|>") == r.formatted.count("<|end|>") == len(w)
            assert "</s>" not in r.formatted and "[INST]" not in r.formatted
            assert len(r.loss_starts) == sum(new and role == "assistant" for role, _, new in w)
            cost = sum(len(t.split()) + 4 for _, t, _ in w)
            assert r.cost == cost and r.over_budget == (cost > budget)
            assert not r.over_budget or sum(new for role, _, new in w if role != "system") == 1


def test_read_back_is_exact(spark):
    turns = rows()
    back = {r.conv_id: r for r in chat.read_back(chat.windows(spark.createDataFrame(turns, SCHEMA), 40, 12)).collect()}
    for c in {r[0] for r in turns}:
        mine = [((r[2] or ""), (r[3] or "")) for r in sorted((r for r in turns if r[0] == c), key=order)]
        assert back[c].turns == "".join(f"{a}\n{b}\n" for a, b in mine) and back[c].n_turns == len(mine)
        assert back[c].loss == "".join(b for a, b in mine if a == "assistant")


def test_escape_is_reversible(spark):
    r = random.Random(5)
    texts = ["".join(r.choice([*NASTY, "|end|>", "s>", "INST]", "/"]) for _ in range(r.randrange(8))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for row in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert row.u == row.t and not any(x in row.e for x in ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]"))


def test_only_dataframe_functions(spark):
    plan = chat.windows(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert chat.windows(spark.createDataFrame([], SCHEMA)).count() == 0
