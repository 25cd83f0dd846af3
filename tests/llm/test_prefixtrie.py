"""The trie against one built turn by turn, conversations of many blocks, and its SQL twin."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from colophon.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, pos string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    digest = lambda k: hashlib.sha256(",".join(str(c) for c in members[k] if paths[c] == k).encode()).hexdigest()
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), children[k], leaves[k], saved[k], digest(k)) for k, m in members.items())


def nodes(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    for name in ("n", "a", "t1", "depth", "block"):
        df = df.withColumn(name, F.lit("clash"))
    found = prefixtrie.trie(*prefixtrie.with_openings(prefixtrie.numbered(df.repartition(3)))).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in found)


def conversations(seed, n, length, words=3, empty=True):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, length)):
            rows.append((c, t, rng.choice(["user", "assistant"] if t else ["user"]), rng.choice(["Hi", "", "ünï", "a longer text"][:words])))
    return rows


def test_small_tries(spark):
    rows = conversations(1, 60, 12)
    assert nodes(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, 3, "user", "x"), (0, 3, "user", "x"), (0, 3, "assistant", "x"), (1, -5, "user", None), (2, 10**15, "", "user"),
            (3, 1, "us", "erx"), (4, 1, "user", "x"), (None, 1, "user", "lost"), (7, 0, "a", "b"), (7, None, "a", "b"), (11, 2, "user", "x" * 100_000),
            (12, 0, "user", "no base"), (-3, 0, "user", "x"), (2**62, 0, "user", "x")]
    # a negative id: remainders as in SQL, -3 - (-3) = 0 is its base
    rows = [r for r in rows if r[0] != -3]
    assert nodes(spark, rows) == brute(rows)
    assert nodes(spark, []) == []
    lone = [(13, 0, "user", "all of its turns are replaced by those of an absent conversation")]
    got = nodes(spark, lone)
    assert got == brute(lone)


def test_turnless_conversations_are_members_of_the_root(spark):
    short = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1]
    rows = [(c, 0, "user", "gone") for c in short]  # no base exists, so the only turn goes
    assert nodes(spark, rows) == brute(rows) and len(brute(rows)) == 1


@pytest.mark.parametrize("hot", [3000])
def test_long_and_copied_conversations(spark, monkeypatch, hot):
    """One conversation of a third of all rows, many copies of another; ranges small enough to be used."""
    monkeypatch.setattr(prefixtrie, "RANGE", 16)
    base = [(0, t, "user", f"t{t % 7}") for t in range(hot)] + [(5, t, "user", f"t{t % 7}") for t in range(hot - 1000)]
    base += [(c, 0, "user", "same") for c in range(10, 2000, 5)] + [(c, t, "user", "same") for c in range(2000, 2030) for t in range(20)]
    got, want = nodes(spark, base), long_brute(base)
    assert got == want


def long_brute(rows):
    """As ``brute``, with prefixes named by numbers so that long paths stay cheap."""
    own = defaultdict(list)
    for c, turn, role, text in sorted(rows):
        own[c].append((role, text))
    ids, paths = {}, {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        path, node = own.get(c - c % 5, [])[:h] + own[c][h:], 0
        at = [0]
        for t in path:
            node = ids.setdefault((node, t), len(ids) + 1)
            at.append(node)
        paths[c] = at
    up = {child: (parent, t) for (parent, t), child in ids.items()}
    members, end = defaultdict(list), defaultdict(list)
    for c, at in paths.items():
        end[at[-1]].append(c)
        for node in at:
            members[node].append(c)
    depth = {0: 0}
    for node in range(1, len(ids) + 1):
        depth[node] = depth[up[node][0]] + 1
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in range(len(ids), -1, -1):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * len(up[node][1][1].encode()) if node else 0
        if node:
            parent = up[node][0]
            children[parent] += 1
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
    digest = lambda n: hashlib.sha256(",".join(map(str, end[n])).encode()).hexdigest()
    return sorted((m[0], depth[k], members[up[k][0]][0] if k else -1, len(m), children[k], leaves[k], saved[k], digest(k)) for k, m in members.items())


def test_brute_forces_agree():
    rows = conversations(4, 40, 9)
    assert brute(rows) == long_brute(rows)


def test_sql_twin(spark):
    rows = conversations(2, 30, 10) + [(31, None, None, "é"), (31, 2, "user", None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = con.execute(prefixtrie.oracle()).fetchall()
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in found) == brute(rows)
