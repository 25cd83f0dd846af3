"""Line templates: generalised fields, first occurrence, odd rows, and a brute-force twin on random lines."""

from __future__ import annotations

import random

from colophon.llm import lines

PASSAGE = "this passage of many words stands in several documents and goes on for quite a while here"


def run(docs, **args):
    return {r.doc_id: r for r in lines.dedup(docs, **args).collect()}


def test_passages_and_fields(docs_of):
    rows = [
        (1, f"first own line of the text\n{PASSAGE}"), (2, f"{PASSAGE}\nsecond own line of another text"),
        (3, PASSAGE.replace("several", "seventeen different")), (4, PASSAGE.replace("several", "five")),
        (5, "error 17 at line 90210 of the log file"), (6, "error 4 at line 8 of the log file"), (7, "too short line"), (8, "too short line"),
        (None, PASSAGE), (9, None), (10, ""), (11, "\n\n"), (12, PASSAGE + "\n" + PASSAGE),
    ]
    got = run(docs_of(rows))
    assert len(got) == len(rows)
    assert got[1].text == rows[0][1] and got[2].text == "second own line of another text"
    assert got[3].text == rows[2][1] and got[4].text == ""  # other number of tokens; one word differs
    assert got[5].dropped_lines == 0 and got[6].dropped_lines == 1 and got[7].dropped_lines == got[8].dropped_lines == 0
    assert got[None].text == "" and got[9].text is None and got[10].text == "" and got[11].text == "\n\n" and got[12].text == ""
    assert (got[9].n_lines, got[11].n_lines, got[12].dropped_lines) == (0, 3, 2) and got[1].key == "x"


def test_repeated_rows_and_min_docs(docs_of):
    rows = [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE + "\nmore")]
    assert sorted(r.text for r in lines.dedup(docs_of(rows)).collect()) == ["more", PASSAGE, PASSAGE]
    assert all(r.dropped_lines == 0 for r in lines.dedup(docs_of(rows), min_docs=3).collect())
    assert sum(r.dropped_lines for r in lines.dedup(docs_of([*rows, (3, PASSAGE)]), min_docs=3).collect()) == 2


def test_long_text_and_empty_table(docs_of):
    text = "\n".join(f"line {chr(97 + i % 26) * (1 + i // 26)} of a very long text here" for i in range(5000))
    got = run(docs_of([(1, text), (2, text)]))
    assert got[1].text == text and got[2].text == "" and got[2].dropped_lines == 5000
    assert lines.dedup(docs_of([])).count() == 0


def test_brute_force(docs_of):
    rng = random.Random(2)
    pool = ["a", "b", "cc", "d1", "2"]
    rows = [(i, "\n".join(" ".join(rng.choices(pool, k=rng.randint(10, 12))) for _ in range(40))) for i in range(40)]

    def keys(line):
        p = line.split()
        t = ["<*>" if any(c.isdigit() for c in w) else w for w in p]
        n, d = len(t), 3

        def closed(a, b):
            literal = sum(w != "<*>" for w in t[:a] + t[b:])
            of = t if literal >= 4 and 2 * literal >= n else p
            return n, *of[:a], "|", *of[b:]

        out = [(0, *closed(n, n))]
        for k in range(lines.SEGMENTS) if n - d >= 2 * lines.SEGMENTS else ():
            out.append((k + 1, *closed(d + (n - d) * k // lines.SEGMENTS, d + (n - d) * (k + 1) // lines.SEGMENTS)))
        return out

    first, many = {}, set()
    for i, text in rows:
        for key in {key for line in text.split("\n") for key in keys(line)}:
            if key in first:
                many.add(key)
            first.setdefault(key, i)
    got = run(docs_of(rows))
    for i, text in rows:
        kept = [x for x in text.split("\n") if not any(k in many and first[k] != i for k in keys(x))]
        assert got[i].text == "\n".join(kept)


def test_rows_of_figures_are_kept(docs_of):
    table = lambda k: "\n".join(" ".join(str(i * j + k) for j in range(3, 3 + n)) for i, n in enumerate([6, 8, 12, 14], 1))
    rows = [(1, table(0)), (2, table(1000)), (3, table(0)), (4, "12 of 17 at 9 or 3"), (5, "11 of 18 at 8 or 4"),
            (6, "the price of lot 17 was 9 marks"), (7, "the price of lot 4 was 12 marks")]
    got = run(docs_of(rows))
    assert got[1].text == rows[0][1] and got[2].text == rows[1][1] and got[3].text == ""
    assert got[5].dropped_lines == 0 and got[7].dropped_lines == 1


def test_sql_twin_has_the_same_rules(docs_of):
    import duckdb

    rng = random.Random(8)
    word = lambda: rng.choice(["alpha", "beta", "12", "7", "x@y.z", "3%", "gamma", "Delta"])
    pool = [[word() for _ in range(rng.randint(4, 16))] for _ in range(150)]
    varied = lambda line: [rng.choice([w, w, w, w, w, word()]) for w in line]
    rows = [(i, "\n".join(rng.choice([" ", "  ", "\t"]).join(varied(rng.choice(pool))) for _ in range(12))) for i in range(60)]
    rows += [(100, "1 2 3 4 5 6 7 8"), (101, "9 8 7 6 5 4 3 2"), (102, None), (103, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r[1:] for r in con.execute(lines.oracle()).fetchall()}
    got = {r.doc_id: (r.n_lines, r.dropped_lines, r.text_sha256) for r in lines.digests(lines.dedup(docs_of(rows))).collect()}
    assert want == got and got[102][:2] == (0, 0) and sum(v[1] for v in got.values()) > 20 and got[101][1] == 0


def test_many_lines_take_seconds(docs_of):
    import time

    text = "\n".join(f"line {i} {'abcdefghij'[i % 10] * (1 + i % 97)} of a very long text here and {chr(97 + i % 26) * (1 + i // 500)}" for i in range(50_000))
    started = time.monotonic()
    got = run(docs_of([(1, text), (2, text), (3, "short\n" + text)]), copies=0.8)
    assert got[1].dropped_lines < 50_000 and got[2].text == "" and got[3].text == "short" and got[2].dropped_lines == 50_000
    assert time.monotonic() - started < 90


def test_nothing_unique_goes_with_a_copy(docs_of):
    """The first holder of a line keeps it even if the rest of its text is a copy."""
    rng = random.Random(4)
    line = lambda k=12: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(k))
    body, x, own = [line() for _ in range(9)], line(), line()
    rows = [(1, "\n".join(body)), (2, "\n".join(["Head", *body, x])), (3, f"{x}\n{own}"), (4, "\n".join(["Head", *body]))]
    got = run(docs_of(rows), copies=0.8)
    assert got[1].text == rows[0][1] and got[2].text == f"Head\n{x}" and got[3].text == own and got[4].text == ""
