"""Byte-level BPE against the library that defines it, and as an exact round trip."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from colophon.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [chr(c) for c in [*range(0x250), 0x1680, 0x2028, 0x202F, 0x3000, 0x200B, 0xFEFF, 0x661, 0x2160, 0x4E2D, 0x1F600]]


@pytest.fixture(scope="module")
def library():
    ranks = {token: i for i, token in enumerate(bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    noise = ["".join(rng.choices(ODD, k=60)) for _ in range(200)]
    plain = ["".join(rng.choices("ab' \n09.st", k=60)) for _ in range(200)]
    return [None, "", " ", "it's we'll  end \n\n x", "a" * 30_000, "<|endoftext|>", *noise, *plain, "x" * 5 + "é" * 5000]


def test_perfect_hash_is_minimal():
    tokens = bpe.read_ranks(PATH)
    found = bpe.PerfectHash(tokens)
    assert sorted(found.order) == list(range(len(tokens)))
    assert all(found.find(t) == i for i, t in enumerate(tokens)) and found.find(b"no such token") == -1
    assert bpe.PerfectHash([]).find(b"a") == -1


def test_ascii_matcher_splits_alike():
    split, full = bpe.splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    assert all(split(t) == full(t) for t in texts() if t)


def test_ids_are_the_librarys_and_decode_to_the_text(spark, docs_of, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "twice"), (None, "twice")]
    tokenizer = bpe.Tokenizer(spark, PATH, public_tokenizers.PATTERN)
    docs = docs_of(rows)
    got = docs.select("text", tokenizer.encode(docs.text).alias("ids")).withColumn("back", tokenizer.decode("ids")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
    for r in bpe.token_digests(docs, tokenizer).collect():
        text = "twice" if r.doc_id is None else rows[r.doc_id][1] or ""
        ids = np.array(library.encode_ordinary(text), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_long_texts_are_encoded_in_parts_and_long_pieces_are_not_remembered(library):
    given = [None, "ab", *["x" * bpe.PART_CHARS] * 3, "", "c"]
    runs = list(bpe.parts(given))
    assert [t for run in runs for t in run] == [t or "" for t in given]
    assert [len(run) for run in runs] == [3, 1, 1, 2] and list(bpe.parts([])) == []
    pieces = bpe.Pieces(bpe.PerfectHash(bpe.read_ranks(PATH)))
    for text in ("word", "a" * 30_000):
        assert np.frombuffer(pieces[text], dtype="<u4").tolist() == library.encode_ordinary(text)
    assert list(pieces) == ["word"]


def test_empty_table(spark, docs_of):
    assert bpe.token_digests(docs_of([]), bpe.Tokenizer(spark, PATH, public_tokenizers.PATTERN)).count() == 0
