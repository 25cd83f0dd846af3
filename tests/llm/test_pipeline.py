"""The pipeline as a whole: what it must drop, keep and encode, against brute force on a small corpus."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as cp
from colophon.llm import bpe

_fixed = random.Random(3)
PASSAGE = " ".join("".join(_fixed.choices(["th", "er", "on", "an", "re"], k=3)) for _ in range(60))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices(["th", "er", "on", "an", "re"], k=rng.randint(2, 5)))
    line = lambda k: " ".join(word() for _ in range(k))
    rows = []
    for i in range(300):
        text = "\n".join(line(14) for _ in range(4))
        if i % 5 == 4:
            text += f"\nidiot {line(4)} moron {line(3)} scumbag"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(400 + i, rows[0][1], "en", "s0", 1) for i in range(5)]  # copies
    rows += [(500 + i, line(12) + "\n" + PASSAGE + "\n" + line(12), None, "s1", None) for i in range(4)]
    rows += [(600, None, None, None, None), (601, "", "en", "s2", 0), (None, line(20), "en", None, None), (1, rows[1][1], "en", "s1", 5)]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 4)) for i in range(0, 300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "byte_bpe":
            assert docs.columns == cp.COLUMNS
    ids = {name: Counter(r.doc_id for r in d.select("doc_id").collect()) for name, d in seen.items()}
    assert not any(i is not None and i < 300 and i % 5 == 4 for i in ids["toxicity"]) and len(ids["toxicity"]) == 240 + 5 + 4 + 3
    assert not set(range(400, 405)) & set(ids["line_dedup"]) and {0, 600, 601, None} <= set(ids["line_dedup"])
    with_passage = [r.doc_id for r in seen["line_dedup"].collect() if PASSAGE in (r.text or "")]
    assert with_passage == [500]
    # Null and empty text share fingerprint zero; repeated rows are one document; nothing else is alike.
    assert set(ids["line_dedup"]) - set(ids["simhash"]) == {601} and set(ids["simhash"].values()) == {1}
    assert set(ids["mixing"]) <= set(ids["simhash"]) and max(ids["mixing"].values()) <= 3
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))})
    texts = {r.doc_id: r.text for r in seen["mixing"].collect()}
    for r in seen["byte_bpe"].collect():
        text = texts[r.doc_id]
        assert r.ids == library.encode_ordinary(text) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert ids["byte_bpe"] == ids["mixing"]


def test_run_and_registration(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is cp.run and "pipeline" not in entry.oracle_sql()
    assert cp.run(spark, sf_dir).count() > 200


def test_copies_with_short_lines_go_whole(spark, docs_of):
    rng = random.Random(5)
    line = lambda k: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(k))
    body = [line(14) for _ in range(6)]
    copy = "\n".join(["A heading", *body, "Are."])
    near = "\n".join(["A heading", *body[:5], line(14), "Are."])
    poem = "\n".join([body[0], *[line(4) for _ in range(10)]])  # one recurring line over a text of its own short lines
    shorts = "\n".join(["A heading", *[line(4) for _ in range(5)]])
    docs = docs_of([(1, copy), (2, copy), (3, near), (4, poem), (5, shorts), (6, shorts), (None, copy), (7, None), (8, "")]).select(*cp.COLUMNS)
    got = {r.doc_id: r for r in cp.drop_recurring_lines(spark, docs, "").collect()}
    assert set(got) == {1, 3, 4, 5, 6, 7, 8}  # copies of short lines only are left to the SimHash stage
    assert got[1].text == copy and got[4].text == "\n".join(poem.split("\n")[1:]) and got[5].text == got[6].text == shorts
    assert got[3].text == near.split("\n")[6] and got[4].n_chars == len(got[4].text)  # its own line is all that is left


def test_no_line_of_the_corpus_is_lost(spark, docs_of):
    """Documents may be copies of each other in any chain; every line stays in the first document that has it."""
    rng = random.Random(6)
    line = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12))
    pool = [line() for _ in range(60)]
    rows = [(i, "\n".join([*rng.sample(pool, 10), *(["Short."] if i % 2 else [])])) for i in range(40)]
    docs = docs_of(rows).select(*cp.COLUMNS)
    got = {r.doc_id: (r.text or "").split("\n") for r in cp.drop_recurring_lines(spark, docs, "").collect()}
    first = {}
    for i, text in rows:
        for x in text.split("\n"):
            first.setdefault(x, i)
    long_lines = {x: i for x, i in first.items() if x != "Short."}
    assert {x: i for i, kept in got.items() for x in kept if x in long_lines} == long_lines
    assert sum(x in long_lines for kept in got.values() for x in kept) == len(long_lines)
    assert any("Short." in kept for kept in got.values())
