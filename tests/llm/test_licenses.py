"""License scans on odd rows, against a word-by-word search."""

from __future__ import annotations

import re

from colophon.llm import licenses

PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
TEXTS = [
    None, "", "!!", "MIT License mit-license; the MIT", "Apache\nLicense, Version 2.0 and Apache license version 3",
    "GNU GENERAL PUBLIC LICENSE, version 3. general public general public license", "license mit", "Mİt license é mit license",
    "Licensed under CC BY-NC 4.0.", "word " * 20_000 + "mit license", "Permission is hereby granted, free of charge, to any man obtaining a copy of this software",
]


def brute(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = [(i, k) for k, p in PHRASES.items() for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({k for _, k in found}))


def test_base_places(docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3]), (3, TEXTS[3])]
    got = licenses.summary(licenses.scan(docs_of(rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(TEXTS[3 if r.doc_id is None else r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_labels_of_longer_wordings(docs_of):
    got = {r.doc_id: r.labels for r in licenses.summary(licenses.scan(docs_of(list(enumerate(TEXTS))))).collect()}
    assert got[4] == "apache,apache-2.0" and got[5] == "gpl,gpl-3.0" and got[8] == "cc-by-nc" and got[10] == "mit" and got[6] == ""


def test_empty_table(docs_of):
    assert licenses.summary(licenses.scan(docs_of([]))).count() == 0
