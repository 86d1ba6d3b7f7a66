import random

from newsloom.llm import quality as q


def repeated(words):
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def test_repeated_words_against_brute_force():
    r = random.Random(4)
    for _ in range(300):
        words = [r.choice([b"a", b"b", b"c", b"dd"]) for _ in range(r.randrange(25))]
        assert q.repeated_words(words) == repeated(words)


def measured(docs):
    return {r.doc_id: r for r in q.measure(docs).collect()}


def test_base_counts(documents):
    text = "Née #1\tx\n \nNée #1\tx\n\x0bend <b>\n"
    row = measured(documents((1, text)))[1]
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines) == (8, 18, 4, 1)
    assert len(row.lines) == 3 and row.lines[0] == row.lines[1] and list(row.line_words) == [3, 3, 2]
    for empty in (None, "", " \n\t"):
        row = measured(documents((1, empty)))[1]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, list(row.lines)) == (0, 0, 0, 0, 0, [])


def body(i, n=60):
    r = random.Random(i)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_line_frequency_counts_distinct_documents_of_a_host(documents):
    line = "Share this page with all of your friends now"
    rows = [(i, f"{body(i)}\n{line.upper() if i % 2 else line}  ", "h") for i in range(30)]
    rows += [(100 + i, f"{line}\n{body(i, 3)}", "h") for i in range(3)]            # mostly that line, too short
    rows += [(200, "\n".join([line] * 20) + "\n" + body(1, 12), "h")]              # depleted
    rows += [(300 + i, body(7) + "\n" + body(8), "h") for i in range(40)]          # one text, many copies
    rows += [(400, f"{body(9)}\n{line}", "other"), (401, f"{body(10)}\n{line}", None), (402, None, "h")]
    docs = documents(*rows)
    judged = {r.doc_id: r for r in q.judge(q.measure(docs)).collect()}
    assert all(judged[i].kept and judged[i].removed_words == 9 for i in range(30))
    assert all(judged[100 + i].base_failed and not judged[100 + i].kept for i in range(3))
    assert not judged[200].kept and judged[200].base_failed  # its lines repeat, too
    assert all(judged[300 + i].kept and judged[300 + i].removed_words == 0 for i in range(40))
    assert judged[400].kept and judged[400].removed_words == 0 and judged[401].removed_words == 0
    assert judged[402].base_failed and not judged[402].kept
    out = q.apply(docs.selectExpr("*", "1 as lines", "'x' as key"))
    kept = {r.doc_id: r for r in out.collect()}
    assert set(kept) == {*range(30), *range(300, 340), 400, 401}
    assert kept[4].text == body(4) and kept[4].n_chars == len(body(4)) and kept[4].lines == 1
    assert kept[301].text == body(7) + "\n" + body(8) and out.columns == [*docs.columns, "lines", "key"]


def test_depleted_without_repeats(documents):
    lines = [body(1000 + i, 12) for i in range(6)]
    rows = [(i, "\n".join(lines[j] for j in range(6) if j != i % 6) + "\n" + body(i, 200)) for i in range(60)]
    rows.append((100, "\n".join(lines) + "\n" + body(500, 10)))
    judged = {r.doc_id: r for r in q.judge(q.measure(documents(*rows))).collect()}
    assert not judged[100].base_failed and not judged[100].kept and judged[100].removed_words == 72
    assert all(judged[i].kept for i in range(60))


def test_repeated_rows_and_empty_table(documents):
    docs = documents((1, body(1)), (1, body(1)), (None, body(2)))
    assert q.apply(docs).count() == 3
    none = docs.filter("false")
    assert q.judge(q.measure(none)).count() == 0 and q.apply(none).count() == 0
