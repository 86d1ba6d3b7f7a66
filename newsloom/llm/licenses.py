"""License scans: an exact set-similarity join of text blocks with templates.

A block is a line of a text; block and template are sets of words. A template
is found in a block that holds at least `threshold` of its words. The template
words are ordered by the number of documents they occur in, rarest first, over
the whole corpus. By pigeonhole a block that reaches the threshold holds one of
a template's first |T| - need + 1 words (prefix filter), at least `need`
template words (length filter), and enough words after the one that met
(positional filter); what is left is counted exactly.

Templates are a parameter of bounded size (`MAX_TEMPLATE_WORDS`), so their index
and the corpus counts of their words go to every task.

Beside this stand the fixed phrases, counted wherever their words follow each
other in the text.

Defined results: a null text has no words. Repeated rows get equal results. A very
long text is scanned by one task. `docs` may have any other columns. An empty table
gives no rows; without templates only phrases are found.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import PLAIN, lists, map_rows, plain_words, row_key, text_bytes

THRESHOLD = 0.8
MAX_TEMPLATE_WORDS = 200_000

PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Notices by which licenses are usually named, with a label each.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
                 "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
              "Public License, version 2."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved."),
]


class Index:
    """The prefix index of the templates under one word order."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        sets = [(label, set(plain_words(text))) for label, text in templates]
        words = sorted(set().union(*(s for _, s in sets)) if sets else (), key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(words)}
        self.templates = [(label, frozenset(self.rank[w] for w in s)) for label, s in sets if s]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for _, s in self.templates]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, (_, s) in enumerate(self.templates):
            for position, token in enumerate(sorted(s)[:len(s) - self.need[t] + 1]):
                self.prefix.setdefault(token, []).append((t, position))
        self.heads = {words[token] for token in self.prefix}

    def blocks(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(template, share of its words) found in one block."""
        rank = self.rank
        tokens = sorted({rank[w] for w in words if w in rank})
        alive: dict[int, bool] = {}
        for at, token in enumerate(tokens):
            for t, position in self.prefix.get(token, ()):
                if t in alive:
                    continue
                size, need = len(self.templates[t][1]), self.need[t]
                # nothing of t's prefix came before, so only what follows can meet
                alive[t] = len(tokens) >= need and 1 + min(size - position - 1, len(tokens) - at - 1) >= need
        out, own = [], set(tokens)
        for t in sorted(t for t, yes in alive.items() if yes):
            both = len(own & self.templates[t][1])
            if both >= self.need[t]:
                out.append((t, both / len(self.templates[t][1])))
        return out


def word_frequency(docs: DataFrame, words: frozenset[bytes], text: str = "text") -> dict[bytes, int]:
    """In how many rows each of the given words stands; at most one number a word
    comes to the driver."""

    def make(batch: pa.RecordBatch) -> dict | None:
        found: Counter = Counter()
        for value in batch.column(0).to_pylist():
            found.update(words.intersection(plain_words(value)))
        return {"word": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())}

    rows = map_rows(docs.select(F.col(text).alias("text")), make, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}


def scan(docs: DataFrame, templates=None, phrases=None, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, doc_id, n_words, the places of the phrases
    (word number and label), and the blocks found: line number, label and share."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    vocabulary = frozenset(w for _, t in templates for w in plain_words(t))
    if len(vocabulary) > MAX_TEMPLATE_WORDS:
        raise ValueError("more template words than go to every task; scan with parts of the templates")
    index = Index(templates, word_frequency(docs, vocabulary, text) if vocabulary else {}, threshold)
    wanted = [(b" " + b" ".join(plain_words(p)) + b" ", label) for p, label in phrases]
    sent = docs.sparkSession.sparkContext.broadcast((index, wanted))

    def make(batch: pa.RecordBatch) -> dict:
        index, wanted = sent.value
        cols: dict[str, list] = {k: [] for k in ("n_words", "places", "place_labels", "block_lines", "block_labels", "block_shares")}
        for value in batch.column(2).to_pylist():
            raw = text_bytes(value).translate(PLAIN)
            words = raw.split()
            line = b" " + b" ".join(words) + b" "
            places = []
            for phrase, label in wanted:
                at = line.find(phrase)
                while at >= 0:
                    places.append((line.count(b" ", 0, at), label))
                    at = line.find(phrase, at + 1)
            places.sort()
            found = []
            if not index.heads.isdisjoint(words):
                # `translate` turned line ends into spaces, so the lines come from the text
                for n, one in enumerate(text_bytes(value).split(b"\n")):
                    of_line = one.translate(PLAIN).split()
                    if not index.heads.isdisjoint(of_line):
                        found += [(n, index.templates[t][0], share) for t, share in index.blocks(of_line)]
            cols["n_words"].append(len(words))
            cols["places"].append([p for p, _ in places])
            cols["place_labels"].append([x for _, x in places])
            cols["block_lines"].append([n for n, _, _ in found])
            cols["block_labels"].append([x for _, x, _ in found])
            cols["block_shares"].append([x for _, _, x in found])
        return {"key": batch.column(0), "doc_id": batch.column(1), "n_words": pa.array(cols["n_words"], pa.int64()),
                "places": lists(cols["places"], pa.int64()), "place_labels": lists(cols["place_labels"], pa.string()),
                "block_lines": lists(cols["block_lines"], pa.int64()), "block_labels": lists(cols["block_labels"], pa.string()),
                "block_shares": lists(cols["block_shares"], pa.float64())}

    rows = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(rows, make, "key long, doc_id long, n_words long, places array<bigint>, place_labels array<string>, "
                                "block_lines array<bigint>, block_labels array<string>, block_shares array<double>")
