import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filingweave.functions import dates, numeric, text, urls


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def many(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in rows.select("i", f("x")).orderBy("i").collect()]


def test_strip_tags(spark):
    cells = ["<a href='x'>A &amp; B</a><br>c", None, "  a \n b ", "&amp;lt;b&gt;", "<b>"]
    assert many(spark, text.strip_tags, cells) == ["A & B c", "", "a b", "<b>", ""]


@given(st.lists(st.text(alphabet="ab &;<>/\n\tampltgqu\"", max_size=30), min_size=1, max_size=20))
@settings(max_examples=10, deadline=None)
def test_strip_tags_model(spark, cells):
    import re

    def model(v):
        t = re.sub("<[^>]+>", " ", v)
        for a, b in (("&amp;", "&"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
            t = t.replace(a, b)
        return re.sub(r"\s+", " ", t).strip()

    assert many(spark, text.strip_tags, cells) == [model(c) for c in cells]


def test_links_and_headlines(spark):
    cell = '<a href="/d?ann_id=77">Quarterly <b>rpt</b></a> <a href="/f/R.PDF?x=1"> </a>'
    got = spark.createDataFrame([(cell,)], "x string").select(text.headline("x"), text.attachments("x"), text.announcement_id("x")).first()
    assert got[0] == "Quarterly rpt" and [tuple(a) for a in got[1]] == [("R.PDF?x=1", "/f/R.PDF?x=1")] and got[2] == "77"


def test_stock_code(spark):
    x = spark.createDataFrame([(None, "<a href='/p?stock_code=0823EA'>X</a>"), ("", "ACME (1234)"), (" 55 ", "y"), (None, None)], "c string, t string")
    assert [r[0] for r in x.select(text.stock_code("c", "t")).collect()] == ["0823EA", "1234", "55", None]


def test_tokens(spark):
    assert [sorted(x) for x in many(spark, text.identifying_tokens, ["Acme Holdings Berhad 2024 A", "THE Group", None])] == [["acme"], [], []]


def test_results_titles(spark):
    titles = ["Quarterly rpt on x", "Change in financial year end", "Condensed Consolidated accounts", "INTERIM report"]
    assert many(spark, lambda c: text.looks_like_results(c, F.lit(None).cast("string")), titles) == [True, False, True, True]


def test_dates(spark):
    cells = ["16 Aug 2026", "16 August 2026", "16/08/2026", "2026-8-16", "16-AUG-2026", "<div>14 Aug 2026</div><div>14 Aug 2026</div>", "on 31/02/2026 or 01/03/2026", "seen 2026-13-45 here", "x", None, "5 Jan 2026 09:30 | late", "31/02/2026"]
    assert many(spark, dates.normalise_date, cells) == ["2026-08-16"] * 5 + ["2026-08-14", "2026-03-01", "2026-13-45", None, None, "2026-01-05", None]


def test_period_index(spark):
    rows = spark.createDataFrame([("2024", "Q1"), ("2023", "Q4"), ("x", "Q1"), ("2024", "H1"), (None, None)], "y string, q string")
    assert [r[0] for r in rows.select(dates.period_index("y", "q")).collect()] == [8096, 8095, None, None, None]


@given(st.lists(st.tuples(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6)), min_size=1, max_size=30))
@settings(max_examples=10, deadline=None)
def test_pct_change_model(spark, pairs):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, c double, p double")
    got = [r[0] for r in rows.orderBy("i").select(numeric.pct_change("c", "p")).collect()]
    for (c, p), g in zip(pairs, got, strict=True):
        if p == 0:
            assert g is None
        elif abs(c / p) < 1e6:
            assert g == pytest.approx(round((c - p) / abs(p) * 100, 2), abs=0.011)


def test_rounding_as_printed(spark):
    assert many(spark, numeric.round_printed, [2.675, -2.675, 0.125, -0.001, None], "double") == [2.67, -2.67, 0.12, 0.0, None]


def test_scale_and_forms(spark):
    assert many(spark, numeric.scale_factor, ["US$ '000", "SEK million", "RM bn", "k", "RMk", None]) == [1e-3, 1.0, 1e3, 1e-3, None, None]
    assert many(spark, lambda c: numeric.printed_forms(F.col(c)), [-1234.001, 0.25], "double") == [["1,234", "1234"], ["0.2", "0.25", "0.2", "0.25"]]


def test_anchoring(spark):
    rows = spark.createDataFrame([("340", "340,000"), ("340", "was (340)."), ("3.4", "3.45"), ("3.4", "a 3x4 b 3.4,")], "f string, t string")
    assert [r[0] for r in rows.select(numeric.anchored(F.col("f"), F.col("t"))).collect()] == [False, True, False, False]


def test_num_close(spark):
    rows = spark.createDataFrame([(100.0, 101.0), (100.0, 110.0), (None, None), (1.0, None), (0.0, 0.04)], "a double, e double")
    assert [r[0] for r in rows.select(numeric.num_close(F.col("a"), F.col("e"))).collect()] == [True, False, True, False, True]


def test_formats(spark):
    assert many(spark, numeric.fmt_money, [1234.56, None], "double") == ["1,234.6", "—"]
    assert many(spark, numeric.fmt_pct, [6.94, 0.0, -3.0, None], "double") == ["+6.9%", "+0.0%", "-3.0%", "—"]


def test_hosts(spark):
    given = ["HTTPS://User:p@Ex.com:443/a", "http://ex.com:8080/", "ftp://ex.com", "/rel", None, "https://ex.com:99999/"]
    assert many(spark, urls.host_key, given) == ["https://ex.com", "http://ex.com:8080", "", "", "", ""]


def test_robots():
    rules = urls.disallowed("User-agent: *\nDisallow: /private/\nDisallow: /*.pdf$\n\nUser-agent: other\nDisallow: /\n", "me")
    assert rules == ["^/private/", r"^/.*\.pdf$"]
    assert urls.disallowed("User-agent: *\nDisallow:\n", "me") == []
    both = urls.disallowed("User-agent: *\nDisallow: /a\n\nUser-agent: me\nUser-agent: other\nDisallow: /b$\n\nUser-agent: third\nDisallow: /c\n", "Me/1.0")
    assert both == ["^/a", "^/b$"]


def test_cache_name_and_file_name(spark):
    name = one(spark, urls.cache_name("u"), u="https://ex.com/a/b~c.html?x")
    assert name.startswith("ex.com_") and name.endswith("_b_c.html") and len(name) == len("ex.com__b_c.html") + 12
    assert many(spark, text.safe_filename, ["a b/c d.pdf?x", "", None, "x"]) == ["c_d.pdf", "attachment.pdf", "attachment.pdf", "x.pdf"]


def test_dedup_key(spark):
    row = dict(i="", c=" 11 ", n="Acme  Bhd", d="2024-01-01", t="A  Title")
    import hashlib

    want = "sha256:" + hashlib.sha256(b"11|acme bhd|2024-01-01|a title").hexdigest()
    assert one(spark, text.dedup_key("i", "c", "n", "d", "t"), **row) == want
    assert one(spark, text.dedup_key("i", "c", "n", "d", "t"), **{**row, "i": "9"}) == "bursa:9"
