import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from newsloom.llm import bpe

POOL = [chr(c) for c in range(1, 0x250)] + list(" \t\n\r\x0b\x0c\x1c\x85\xa0 　'") * 8 + [
    "'s", "'re", "<|endoftext|>", "的", "١", "²", "Ⅷ", "😀", "𝐀", "é", "‍", "﻿", "ª", "՘", "word", "the"] * 3


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(bpe.vocabulary_text())


def texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(POOL) for _ in range(r.randrange(40))) for _ in range(n)]


def test_words_ids_and_pieces_are_the_librarys(library):
    v = bpe._vocabulary(None)
    encode = v.encoder()
    for s in texts(3000):
        ids = [i for w in v.split(s) for i in encode([w])[0]]
        assert ids == library.encode(s, add_special_tokens=False).ids
        assert b"".join(v.pieces[i] for i in ids).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False) == s


@pytest.mark.parametrize("frequent", [0, 20, 1 << 19])
def test_encode_and_decode(documents, library, frequent, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 50)
    rows = [(i, t) for i, t in enumerate(texts(60) + ["the the word " * 50] * 4)] + [(90, None), (91, ""), (None, "the end"), (3, texts(60)[3]), (3, texts(60)[3])]
    docs = documents(*rows).selectExpr("*", "1 as ids", "2 as key", "3 as word", "4 as found")
    out = bpe.decode(bpe.encode(docs, frequent=frequent)).collect()
    got = sorted((str(r.doc_id), np.frombuffer(r.ids, dtype="<u4").tolist(), r.text) for r in out)
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows)
    assert got == want


def test_pieces_are_a_table_of_the_vocabulary(spark):
    rows = {r.id: bytes(r.piece) for r in bpe.piece_table(spark).collect()}
    assert len(rows) == 50257 and rows[50256] == b"<|endoftext|>" and rows[262] == b" the"


def test_empty_table(documents):
    assert bpe.decode(bpe.encode(documents((1, "x")).filter("false"))).count() == 0
