"""Token counts against the library itself, and the proof of the whole-token shortcut."""

from __future__ import annotations

import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colophon.llm import tokencounts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter(spark):
    return tokencounts.TokenCounter(spark, PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(spark, docs_of, counter, library):
    rng = random.Random(7)
    alphabets = ["etaoin shrdlu", "abc 'sdmtre,.!?\n\t ", "äöüßéèêç «»", "0123456789.,-", "日本語カタカナ한국어", "  \u0085\u001c \x00\x7f", "😀👩‍👩‍👧́‍"]
    texts = [None, "", " ", "\n\n \n", "a" * 5000, "ab" * 3000, " " * 4000, "<|endoftext|>", "x<|endoftext|>  <|endoftext|>y <|endof", "don't they'LL I'm"]
    texts += ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 300))) for _ in range(600)]
    texts += ["".join(chr(c) for c in (rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)) * 3) for _ in range(600)]
    texts += [f"a{c}1 {c}!{c}" for r in counter.vocabulary.suspects for c in map(chr, r)]
    rows = [(None if i % 50 == 3 else i, t) for i, t in enumerate(texts)]
    got = tokencounts.token_counts(docs_of(rows).withColumn("n_tokens", F.lit("clash")), counter)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    expected = sorted(((r[0], len((r[1] or "").encode()), n, n > 512) for r, n in zip(rows, want)), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == expected
    assert any(r[3] for r in expected) and not got.schema["doc_id"].dataType.simpleString() == "string"


def test_whole_tables_and_empty_ones(spark, docs_of, counter, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in tokencounts.token_counts(docs, counter).collect()}
    assert got == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert tokencounts.token_counts(docs_of([(1, "a")]).limit(0), counter).count() == 0
    twice = tokencounts.token_counts(docs_of([(1, "same"), (1, "same")]), counter).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_long_text_in_slices(counter, library, monkeypatch):
    text = "It's a fine day, 2026!  \n" * 4000
    inside = tokencounts.TextCounter(*counter._shared.value)
    whole = inside(text)
    monkeypatch.setattr(tokencounts, "SLICE_CHARS", 100)
    assert inside(text) == whole == len(library.encode(text, add_special_tokens=False).ids)


def test_proof_covers_the_vocabulary(spark, counter):
    """Every proven string is one token; one that its own merges never reach is not proven."""
    proof = tokencounts.prove(spark, counter.vocabulary)
    assert proof.count() == len(counter.vocabulary.tokens) == 50256
    alone = {bytes(r.token) for r in proof.filter("alone").collect()}
    assert all(len(tokencounts._text(t) or "x") for t in alone)
    odd = tokencounts.Vocabulary([b"a", b"b", b"c", b"ab", b"bc", b"abc"], {(b"a", b"b"): 0, (b"b", b"c"): 1, (b"a", b"bc"): 2}, [])
    assert {bytes(r.token): r.alone for r in tokencounts.prove(spark, odd).collect()} == {
        b"a": True, b"b": True, b"c": True, b"ab": True, b"bc": True, b"abc": False}


def test_unsupported_files_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        tokencounts.read_vocabulary(str(tmp_path / "t.json"))
