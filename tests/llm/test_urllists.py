"""Dated list entries: intervals, same-day rules, and captures without host or day."""

from __future__ import annotations

from colophon.llm import urllists

LOG = [
    ("spam", "bad.com", "add", 10), ("spam", "bad.com", "add", 12), ("spam", "bad.com", "remove", 20), ("spam", "bad.com", "add", 50),
    ("ads", "x.bad.com", "add", 15), ("ads", "x.bad.com", "remove", 15), ("lang", "ok.org/de/", "add", 0), ("ads", "Bad.com", "add", 18),
    (None, "bad.com", "add", 1), ("spam", None, "add", 1), ("spam", "bad.com", None, 1), ("spam", "bad.com", "add", None),
]


def judged(spark, rows):
    log = spark.createDataFrame(LOG, "list string, pattern string, action string, day int")
    captures = spark.createDataFrame(rows, "id int, url string, fetched int").selectExpr("*", "'x' AS pattern", "1 AS period", "'y' AS lists")
    return urllists.judge(captures, log)


def test_intervals(spark):
    log = spark.createDataFrame(LOG, "list string, pattern string, action string, day int")
    got = {tuple(r) for r in urllists.intervals(log).collect()}
    assert got == {("spam", "bad.com", 10, 20), ("spam", "bad.com", 50, None), ("lang", "ok.org/de/", 0, None), ("ads", "bad.com", 18, None)}


def test_as_of(spark):
    rows = [
        (1, "http://bad.com/a", 9), (2, "http://bad.com/a", 10), (3, "https://www.BAD.com:80/a?x", 19), (4, "http://bad.com", 20),
        (5, "http://x.bad.com/", 500), (6, "http://notbad.com", 15), (7, "https://ok.org/de/7", 3), (8, "https://ok.org/de", 3),
        (9, "https://ok.org/en/de/", 3), (10, None, 3), (11, "no address", 3), (12, "http://bad.com/", None), (2, "http://bad.com/a", 10),
        (None, "http://user@bad.com./x/", 50), (14, "http://bad.com/" + "a/" * 20_000, 51), (15, "http://bad.com/", -5),
    ]
    got = judged(spark, rows).collect()
    lists = sorted((str(r.id), r.lists, r.blocked) for r in got)
    want = {1: "", 2: "spam", 3: "ads,spam", 4: "ads", 5: "ads,spam", 6: "", 7: "lang", 8: "", 9: "", 10: "", 11: "", 12: "", None: "ads,spam", 14: "ads,spam", 15: ""}
    assert lists == sorted([(str(i), v, v != "") for i, v in want.items()] + [("2", "spam", True)])
    assert all(r.pattern == "x" and r.period == 1 for r in got)


def test_empty(spark):
    assert judged(spark, []).count() == 0


def test_hosts_in_brackets_and_a_listed_top_domain(spark):
    log = spark.createDataFrame([("v6", "[2001:db8::1]", "add", 1), ("all", "com", "add", 1)], "list string, pattern string, action string, day int")
    rows = [(1, "http://[2001:DB8::1]/x", 5), (2, "http://[2001:db8::1]:8080/x/", 5), (3, "http://[2001:db8::2]/", 5), (4, "http://a.b.com/", 5), (5, "http://[::1", 5), (6, "http://com/", 5)]
    captures = spark.createDataFrame(rows, "id int, url string, fetched int")
    got = {r.id: (r.host, r.lists) for r in urllists.judge(captures, log).collect()}
    assert got == {1: ("[2001:db8::1]", "v6"), 2: ("[2001:db8::1]", "v6"), 3: ("[2001:db8::2]", ""), 4: ("a.b.com", "all"), 5: (None, ""), 6: ("com", "all")}
