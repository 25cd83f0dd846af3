"""Column functions on literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from colophon.functions import cellref, dates, formats, text, urls, vectors


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("v")).first()["v"]


def test_partial_dates(spark):
    cases = {
        "2024": 20240000, " 2024年 ": 20240000, "2024/5": 20240500, "2024-02-29": 20240229, "2023-02-29": None,
        "2024年5月7日": 20240507, "1899": None, "2101-01": None, "2024-13": None, "soon": None, "": None,
    }
    rows = spark.createDataFrame(list(cases.items()), "raw string, want int")
    got = rows.select("raw", "want", dates.parse_partial_date(F.col("raw"))["sort_key"].alias("got")).collect()
    assert [(r.raw, r.got) for r in got] == [(r.raw, r.want) for r in got]


def test_serial_dates_in_both_epochs(spark):
    raw = F.lit("45429.75")
    assert one(spark, dates.parse_serial_date(raw)["label"]) == "2024-05-17"
    assert one(spark, dates.parse_serial_date(raw, True)["label"]) == "2028-05-18"
    assert one(spark, dates.parse_partial_date(raw)) is None
    assert one(spark, dates.date_is_malformed(F.lit("soon"), True)) is True
    assert one(spark, dates.date_is_malformed(F.lit("  "), True)) is False


def test_similarity(spark):
    sim = lambda a, b: one(spark, text.text_similarity(F.lit(a), F.lit(b)))
    assert sim("Ｂook ＃1", "book #1") == 1.0
    assert abs(sim("book", "book two") - (0.68 + 0.22 * 4 / 8)) < 1e-12
    assert sim("", "x") == 0.0 and sim("ab", "xy") == 0.0
    assert abs(sim("night", "nacht") - 2 * 1 / 8) < 1e-12


def test_natural_order(spark):
    names = ["image10", "image2", "Image02", "image", "image2b"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.name for r in df.orderBy(text.natural_sort_key(F.col("name")), "name").collect()]
    assert got == ["image", "Image02", "image2", "image2b", "image10"]


def test_default_order(spark):
    values = ["10", "9.5", "b", "A", " ", None, "1e1"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.v for r in df.orderBy(text.default_order_key(F.col("v")), F.col("v").desc_nulls_last()).collect()]
    assert got[0] == "9.5" and set(got[1:3]) == {"10", "1e1"} and got[3:5] == ["A", "b"]


def test_cell_references(spark):
    for ref, row, col in (("A1", 0, 0), ("Z9", 8, 25), ("AA10", 9, 26), ("$xfd$1", 0, 16383)):
        got = one(spark, cellref.a1_parse(F.lit(ref)))
        assert (got.row, got.col) == (row, col)
        assert one(spark, cellref.a1_format(F.lit(row), F.lit(col))) == ref.replace("$", "").upper()
    assert one(spark, cellref.a1_parse(F.lit("12"))) is None
    assert cellref.range_bounds("C9:$A$2") == (1, 8, 0, 2)


def test_formats(spark):
    kind = lambda code, fid=0: one(spark, formats.classify_format(F.lit(fid), F.lit(code)))
    assert [kind(c) for c in ("yyyy", "h:mm", "[h]:mm", "0%", "0.0", '"d"0', "mmm", "yy h")] == [
        "DATE", "TIME", "TIME", "PERCENT", "NUMBER", "GENERAL", "DATE", "DATE_TIME",
    ]
    assert kind("", 22) == "DATE_TIME" and kind(" ", 3) == "GENERAL"
    show = lambda k, raw, numeric=True, d1904=False: one(
        spark, formats.display_value(F.lit(k), F.lit(raw), F.lit(numeric), d1904)
    )
    assert show("DATE", "45429") == "2024-05-17" and show("DATE", "59") == "1900-02-28" and show("DATE", "60") == "60"
    assert show("DATE", "0", d1904=True) == "1904-01-01"
    assert show("DATE_TIME", "45429.5") == "2024-05-17 12:00" and show("TIME", "0.500011574") == "12:00:01"
    assert show("PERCENT", "0.125") == "12.5%" and show("NUMBER", "-0.001") == "0" and show("NUMBER", "3.10") == "3.1"
    assert show("NUMBER", "100") == "100" and show("DATE", "45429", numeric=False) == "45429"


def test_urls(spark):
    norm = lambda u: one(spark, urls.normalise_url(F.lit(u)))
    assert norm("HTTP://Shop.Example.:80/a/?utm_x=1&b=2#f") == "https://shop.example/a?b=2"
    assert norm("https://h.example:8443/") == "https://h.example:8443"
    assert norm("ftp://h.example/") is None and norm("not a url") is None
    safe = lambda u: one(spark, urls.is_safe_image_url(F.lit(u)))
    assert safe("https://img.example/a.png") and not safe("http://img.example/a.png")
    for bad in ("https://10.0.0.1/a", "https://192.168.1.1/", "https://100.64.0.1/", "https://printer.lan/x",
                "https://user@img.example/a", "https://img.example:444/a", "https://[::1]/a", "https://nodot/a", None):
        assert safe(bad) is False
    assert one(spark, urls.valid_url(F.lit("http://a.b"))) and not one(spark, urls.valid_url(F.lit("http://a.")))


def test_vectors(spark):
    level = lambda p: one(spark, vectors.match_level(F.lit(p)))
    assert [level(70.0), level(45.0), level(44.9)] == ["HIGH", "MID", "LOW"]
    assert abs(one(spark, vectors.score_percent(F.lit(0.75), F.lit(0.5))) - 50) < 1e-9
    assert one(spark, vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    signature = vectors.median_signature(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda x: x.cast("double")))
    want = sum(1 << i for i in range(33, 64))
    assert one(spark, signature) & 0xFFFFFFFFFFFFFFFF == want
    assert one(spark, vectors.hamming(F.lit(5), F.lit(6))) == 2
