import re

import pytest
from pyspark.sql import functions as F

from filingweave.operators import audit, evaluate, evidence, growth, ingest, validate, watchlist
from filingweave.plans import filings


def test_growth_equals_self_joins_and_skips_no_gap(spark):
    rows = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 12.0), ("a", 4, 6.0), ("a", 5, 20.0), ("b", 2, None), ("b", 3, 1.0), ("c", None, 5.0), ("b", 7, 0.0), ("b", 8, 3.0)], "s string, p int, v double")
    one, two = growth.growth(rows, "s", "p", ["v"]), growth.growth_by_joins(rows, "s", "p", ["v"])
    columns = sorted(one.columns)
    assert sorted(map(tuple, one.select(columns).collect()), key=str) == sorted(map(tuple, two.select(columns).collect()), key=str)
    got = {(r.s, r.p): (r.v_prev, r.v_qoq, r.v_yoy) for r in one.collect()}
    assert got["a", 2] == (10.0, 20.0, None) and got["a", 4] == (None, None, None) and got["a", 5] == (6.0, 233.33, 100.0)
    assert got["b", 3] == (None, None, None) and got["b", 8] == (0.0, None, None) and got["c", None] == (None, None, None)


def test_latest_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", None), (4, None, 1)], "id int, k string, t int")
    assert {r.id for r in growth.latest(rows, ["k"], ["t", "id"]).collect()} == {2, 4}


TEXT = "Revenue 340 355 362. Selling expenses (121). Margin 121% of 1,121. Profit before tax 148 132 121\nNet  sales of US$48.2 million"


def places(spark, *columns, **values):
    kinds = {float: "double", str: "string", type(None): "string"}
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return frame.select(*columns).first()


def test_locate_quote(spark):
    got = places(spark, *(evidence.locate_quote(F.lit(q), F.col("t")).alias(f"q{i}") for i, q in enumerate(["Selling expenses (121)", "net sales OF us$48.2", "x", "missing words here", None, "(121).   margin"])), t=TEXT)
    at = TEXT.index("Selling")
    assert tuple(got[0]) == (at, at + 22) and got[2] is None and got[3] is None and got[4] is None
    assert TEXT[got[1][0] : got[1][1]] == "Net  sales of US$48.2" and TEXT[got[5][0] : got[5][1]] == "(121). Margin"


def test_caption_decides_among_equal_figures(spark):
    got = places(spark, evidence.locate_figure(F.lit(121.0), F.lit("million"), F.col("t"), F.lit("pbt_current")), evidence.locate_figure(F.lit(121.0), F.lit("million"), F.col("t"), F.lit("other")), evidence.figure_hits(F.lit("121"), F.col("t")), t=TEXT)
    at = TEXT.rindex("121")
    assert tuple(got[0]) == (at, at + 3) and got[1] is None
    assert [h.start for h in got[2]] == [TEXT.index("(121)") + 1, at]


def test_trace_methods(spark):
    args = lambda value, quote, own: evidence.trace(F.lit(value), F.lit("million"), F.lit(quote).cast("string"), F.col("t"), F.lit("pbt_current"), F.lit(own))
    got = places(spark, args(148.0, "Profit before tax 148", True), args(148.0, "Selling expenses", True), args(999.0, None, True), args(148.0, None, False), t=TEXT)
    assert [g.method for g in got] == ["llm_verified", "deterministic", "unverified", "prior_entry"]
    assert got[0].printed_form == "Profit before tax 148" and got[3].start is None


def test_page_for_offset(spark):
    pages = F.array(F.lit("abc"), F.lit(""), F.lit("de"))
    got = places(spark, *(evidence.page_for_offset(F.lit(i), pages).alias(f"p{i}") for i in (0, 2, 3, 7, 8, 50)), evidence.page_for_offset(F.lit(None).cast("int"), pages).alias("n"), t="")
    assert list(got) == [1, 1, 2, 3, 3, 3, None]


def test_unit_audit(spark):
    values = F.array(*(F.lit(x) for x in (0.34, 0.355, 0.362)))
    text = "Revenue 340 355 362"
    got = places(spark, audit.unit_audit(values, F.lit("million"), F.lit(text)), audit.unit_audit(values, F.lit("?"), F.lit(text)), audit.unit_audit(F.array().cast("array<double>"), F.lit("million"), F.lit(text)), audit.unit_audit(values, F.lit("million"), F.lit("nothing")), t="")
    assert (got[0].verdict, got[0].shift, got[0].hits) == ("rescaled", 1000.0, 3)
    assert [g.verdict for g in got[1:]] == ["unknown_unit", "no_figures", "unanchored"]


def test_validation(spark):
    schema = "company_name string, title string, author string, fiscal_quarter string, fiscal_year string, quarter_end_date string, currency string, confidence_score double, " + ", ".join(f"{f} double" for f in audit.FIELDS)
    rows = [
        ("Acme Berhad", "Zeta report", "x", "Q5", "soon", "31/12/2024", "rm", 0.5, -1.0, None, None, 2.0, None, None),
        ("Acme Berhad", "Acme", None, "Q1", "2024", "2020-03-31", "MYR", 1.5, 10.0, None, None, 20.0, None, None),
        (None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, schema)
    got = [r[0] for r in frame.select(validate.warnings(2026, set(frame.columns))).collect()]
    assert got[0][:5] == ["fiscal_quarter 'Q5' is not one of Q1/Q2/Q3/Q4", "fiscal_year 'soon' cannot be parsed as an integer", "quarter_end_date '31/12/2024' is not in YYYY-MM-DD format", "currency 'rm' is not a valid ISO 4217 code (expected 3 uppercase letters, e.g. USD)", "revenue_current is negative (-1.00M) — revenue cannot be negative"]
    assert got[0][5].startswith("Low confidence score (50%)") and got[0][6].startswith("Document metadata names a different entity") and len(got[0]) == 7
    assert [w.split(" (")[0] for w in got[1]] == ["quarter_end_date year", "pbt_current", "confidence_score 1.5 is outside the valid range [0, 1]"]
    assert got[2] == ["No financial values were extracted — the PDF may not contain machine-readable financial tables"]


def test_carried_forward(spark):
    got = places(spark, validate.carried_forward(F.array(F.lit("Unit label 'x' was"), F.lit("Low confidence"), F.lit("2 of 6 figures could not be traced to")), F.array(F.lit("new"))), t="")
    assert got[0] == ["Unit label 'x' was", "2 of 6 figures could not be traced to", "new"]


def test_token_match(spark):
    listed = spark.createDataFrame([(1, "Malayan Banking Berhad", "Maybank"), (2, "Acme Steel Industries Bhd", None), (3, "Acme Foods Bhd", "ACME")], "company_id int, name string, short_name string")
    rows = spark.createDataFrame([(1, "MALAYAN BANKING"), (2, "Maybank Holdings"), (3, "Steel Industries"), (4, "Acme Steel Industries Group"), (5, "Berhad"), (6, None), (7, "Industries of Steelworks"), (1, "MALAYAN BANKING")], "row_id int, company string")
    got = watchlist.match_by_tokens(rows, "row_id", "company", listed, "company_id", ["name", "short_name"])
    assert {(r.row_id, r.company_id, r.overlap) for r in got.collect()} == {(1, 1, 2), (2, 1, 1), (3, 2, 2), (4, 2, 3)}


def test_code_match_has_no_fallback(spark):
    rows = spark.createDataFrame([(1, " 11 "), (2, "99"), (3, ""), (4, None)], "row_id int, code string")
    got = watchlist.match_by_code(rows, "code", spark.createDataFrame([("11", "A")], "stock_code string, name string"))
    assert {(r.row_id, r.match.name if r.match else None) for r in got.collect()} == {(1, "A"), (2, None)}


def test_reconcile(spark):
    held = spark.createDataFrame([("1", "A", True), ("2", "B", True), ("3", "C", None)], "k string, n string, a boolean")
    given = spark.createDataFrame([("1", "A", True), ("2", "B2", True), ("4", "D", False), (None, "x", True)], "k string, n string, a boolean")
    got = {(r.k, r.change, r.n) for r in watchlist.reconcile(held, given, "k", ["n", "a"]).collect()}
    assert got == {("1", "same", "A"), ("2", "update", "B2"), ("3", "dropped", "C"), ("4", "insert", "D")}


def test_ingested_scope(spark):
    s = "sha256 string, file_size int, id int"
    files = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("", 1, 0), ("a", 2, 0), (None, 1, 0)], s)
    got = ingest.ingested_scope(files.select("sha256", "file_size"), spark.createDataFrame([("a", 1, 7), ("a", 1, 5), ("", 1, 1)], s), spark.createDataFrame([("a", 1, 2), ("b", 1, 3)], s))
    assert {(r.sha256, r.file_size, r.scope, r.held_id) for r in got.collect()} == {("a", 1, "approved", 5), ("b", 1, "pending", 3), ("", 1, None, None), ("a", 2, None, None), (None, 1, None, None)}


def test_attachments_complete_placeholders(spark):
    s = "announcement_id int, filename string, url string, sha256 string, file_size long"
    held = spark.createDataFrame([(1, "a", "u1", None, None), (1, "b", "u2", None, None), (1, "c", "u3", None, None)], s)
    seen = spark.createDataFrame([(1, "a", "u1", "h", 9), (1, "b", "u2", "h", 9)], s)
    got = ingest.merge_attachments(held, seen)
    assert {(r.url, r.sha256) for r in got.collect()} == {("u1", "h"), ("u3", None)}
    assert {(r.url, r.sha256) for r in ingest.merge_attachments(got, seen).collect()} == {("u1", "h"), ("u3", None)}
    assert tuple(ingest.outstanding(got).first()) == (1, 2, 1)


def test_verify(spark):
    rows = spark.createDataFrame([(b"",), (b"x" * 10,), (b" \n%PDF-1.4" + b"x" * 2000,), (b"<html>" + b"x" * 2000,), (None,)], "c binary")
    got = [r[0].status for r in rows.select(ingest.verify_bytes(F.col("c"))).collect()]
    assert got == ["rejected", "rejected", "verified", "rejected", "rejected"]


def test_evaluation(spark):
    s = "k string, v double, u string"
    expected = spark.createDataFrame([("a", 100.0, "SEK million (MSEK)"), ("b", None, None), ("c", 1.0, "x")], s)
    actual = spark.createDataFrame([("a", 101.5, "sek  Million"), ("b", None, "z")], s)
    checks = evaluate.field_checks(actual, expected, "k", ["v"], ["u"])
    assert {(r.k, r.field, r.passed) for r in checks.collect()} == {("a", "v", True), ("a", "u", True), ("b", "v", True), ("b", "u", False), ("c", "v", False), ("c", "u", False)}
    assert {(r.k, r.n_failed, r.passed) for r in evaluate.case_results(checks, "k", ["u"]).collect()} == {("a", 0, True), ("b", 1, True), ("c", 2, False)}


def test_warning_diff(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    got = places(spark, evaluate.warning_diff(a("Score 0.5 low", "new 3"), a("score 0.6 low", "gone"), a("NEW 9")), t="")[0]
    assert got.missing == ["gone"] and got.unexpected == []


GOLDEN = [("1", 48.2, 45.1, 38.5, 6.87, 25.19), ("2", 1240.0, 1180.0, 1090.0, 5.08, 13.76), ("3", -22.6, -18.4, -14.1, -22.83, -60.28), ("4", 49800.0, 46200.0, 44100.0, 7.79, 12.93), ("5", 512.0, 41.0, 47.0, 1148.78, 989.36)]


@pytest.mark.parametrize(("case", "now", "before", "year", "qoq", "yoy"), GOLDEN)
def test_golden_growth(spark, case, now, before, year, qoq, yoy):
    from filingweave.functions.numeric import pct_change

    assert list(places(spark, pct_change("n", "b"), pct_change("n", "y"), n=now, b=before, y=year)) == [qoq, yoy]


REPORT = """id long, title string, author string, uploaded_at timestamp, company_name string, quarter_end_date string, fiscal_quarter string, fiscal_year int, currency string, confidence_score double, analysis_error string,
revenue_qoq double, revenue_yoy double, pbt_qoq double, pbt_yoy double, """ + ", ".join(f"{f} double" for f in audit.FIELDS)


def reports(spark, folder, rows):
    """A pdf_metadata table of rows given by name, the other columns null."""
    names = [c.split()[0] for c in REPORT.replace("\n", " ").split(", ")]
    spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], REPORT).write.parquet(f"{folder}/pdf_metadata.parquet")
    return str(folder)


def test_refreshed_ratios_sees_each_of_the_four(spark, tmp_path):
    quarters = [(2023, "Q4", 100.0, 10.0), (2023, "Q3", 80.0, 8.0), (2022, "Q4", 50.0, 5.0)]
    true = {"revenue_qoq": 25.0, "revenue_yoy": 100.0, "pbt_qoq": 25.0, "pbt_yoy": 100.0}
    rows = []
    for i, wrong in enumerate([None, *true]):
        rows += [{"id": 10 * i + j, "company_name": f"c{i}", "fiscal_year": y, "fiscal_quarter": q, "revenue_current": r, "pbt_current": p} for j, (y, q, r, p) in enumerate(quarters)]
        rows[-3] |= true | ({wrong: None if i % 2 else 7.0} if wrong else {})
    got = {r.id: r.asDict() for r in filings.refreshed_ratios(spark, reports(spark, tmp_path, rows)).collect()}
    assert got == {i: {"id": i, **true} for i in (10, 20, 30, 40)}


def test_report_warnings_applies_every_rule(spark, tmp_path):
    told = dict.fromkeys(audit.FIELDS, 1.0) | {"company_name": "Acme Berhad", "title": "Acme results", "confidence_score": 0.9}
    rows = [
        told,
        told | {"pbt_previous_quarter": 2.0},
        told | {"pbt_same_quarter_last_year": 2.0},
        told | {"revenue_previous_quarter": -1.0, "revenue_same_quarter_last_year": -1.0},
        told | dict.fromkeys(audit.FIELDS),
        told | {"title": "Zeta", "author": "Annual report"},
    ]
    got = {r.id: [w.split(" (")[0] for w in r.warnings] for r in filings.report_warnings(spark, reports(spark, tmp_path, [r | {"id": i} for i, r in enumerate(rows)])).collect()}
    negative = ["revenue_previous_quarter is negative", "revenue_same_quarter_last_year is negative"]
    assert [got[i] for i in range(4)] == [[], ["pbt_previous_quarter"], ["pbt_same_quarter_last_year"], negative]
    assert got[4][0].startswith("No financial values") and got[5] == ["Document metadata names a different entity than the report body"]


def test_discovered(spark):
    from filingweave.operators import views

    attachments = spark.createDataFrame(
        [(1, 10, "a.pdf", "/a", "/d/a", "verified"), (2, 10, "b.pdf", "/b", "/d/b", "verified"), (3, 11, "c.pdf", "/c", "/d/c", "rejected"), (4, 12, "d.pdf", "/d", None, "verified"), (5, 12, "e.pdf", "/e", "/d/e", "verified"), (6, 99, "f", "/f", "/d/f", "verified")],
        "id long, announcement_id long, filename string, url string, local_path string, verification_status string",
    )
    announcements = spark.createDataFrame([(10, 1, "A", "2024-01-02", "discovered"), (11, None, "B", None, "discovered"), (12, 7, "C", "2024-03-01", "approved")], "id long, company_id long, title string, announced_at string, status string")
    companies = spark.createDataFrame([(1, "One"), (1, "Uno")], "id long, name string")
    pending = spark.createDataFrame([(2,), (2,), (None,)], "source_attachment_id long")
    files = spark.createDataFrame([("/d/a",), ("/d/b",), ("/d/c",), ("/d/e",), ("/d/e",), (None,)], "path string")
    rows = views.discovered(attachments, announcements, companies, pending, files).collect()
    assert [(r.id, r.company_name, r.n_pending, r.available) for r in rows] == [(5, None, 0, False), (4, None, 0, False), (2, "One", 2, False), (1, "One", 0, True), (3, None, 0, False)]
    assert "local_path" not in rows[0].asDict()


def test_a_boundary_that_is_no_date_fails_the_query(spark):
    from filingweave.functions import dates

    rows = spark.createDataFrame([("2024-03-06",), ("2024-03-04",), (None,)], "day string")
    assert rows.where(dates.since_filter(F.col("day"), dates.boundary("5 March 2024"))).count() == 2
    with pytest.raises(Exception, match="no date: soon"):
        rows.where(dates.since_filter(F.col("day"), dates.boundary("soon"))).count()


def test_scale_messages(spark):
    rows = [("RM'000", [1.0, 2.0, 3.0], "1,000 2,000 3,000"), ("RM'000", [1000.0, 2000.0, 3000.0], "1,000 2,000 3,000"), ("RM'000", [1.0, None, 3.0], "no figures"), ("see 'note'", [1.0], "1"), (None, [1.0], "1"), ("million", [None], "x")]
    frame = spark.createDataFrame(rows, "label string, figures array<double>, text string").withColumn("a", audit.unit_audit(F.col("figures"), F.col("label"), F.col("text")))
    got = frame.select(audit.scale_message(F.col("a"), F.col("label"), F.size(audit.present(F.col("figures")))).alias("m"), audit.corrected(F.col("figures"), F.col("a")).alias("c")).collect()
    assert got[0].m is None and got[5].m is None
    assert got[1].m.startswith("Unit scale corrected: figures were rescaled by 0.001x") and "3 of 3 figures now match" in got[1].m and got[1].c == [1.0, 2.0, 3.0]
    assert got[2].m.startswith("None of the extracted figures") and got[2].c == [1.0, None, 3.0]
    assert got[3].m.startswith("Unit label \"see 'note'\" was not") and got[4].m.startswith("Unit label None was not")


def test_offsets_of_many_hits_and_pages(spark):
    text = " ".join(["12.5 and 112.5, 12.5% or (12.5)"] * 200)
    row = spark.createDataFrame([(text, "12.5", ["ab", "", "cde", "f"])], "t string, f string, p array<string>")
    hits = row.select(evidence.figure_hits(F.col("f"), F.col("t")).alias("h")).first().h
    want = [(m.start(), m.end()) for m in re.finditer(r"(?<![\d,.])12\.5(?![\d,.])", text) if text[m.end() : m.end() + 1] != "%"]
    assert [(h.start, h.end) for h in hits] == want
    pages = row.select(*(evidence.page_for_offset(F.lit(o), F.col("p")).alias(f"o{o}") for o in range(14)), evidence.page_for_offset(F.lit(None).cast("int"), F.col("p")).alias("none")).first()
    ends = [2, 4, 9, 12]
    assert [pages[f"o{o}"] for o in range(14)] == [min(4, 1 + sum(e <= o for e in ends)) for o in range(14)] and pages.none is None


def test_traced_rows_are_as_traced(spark):
    rows = [(1.2, "RM'000", "Revenue rose to 1,200 thousand", "Revenue rose to  1,200 thousand.", "revenue_current", True), (3.5, "million", None, "pbt 3.50", "pbt_current", True), (350.0, "million", "nothing here", "Profit before tax was 350", "pbt_current", True), (1.0, None, None, None, "x", True), (350.0, "million", None, "350", "pbt_current", False)]
    frame = spark.createDataFrame(rows, "v double, u string, q string, t string, m string, d boolean")
    args = [F.col(c) for c in ("v", "u", "q", "t", "m", "d")]
    got = evidence.trace_rows(frame, *args, to="a").withColumn("b", evidence.trace(*args)).collect()
    assert [r.a for r in got] == [r.b for r in got] and [r.a.method for r in got] == ["llm_verified", "deterministic", "deterministic", "unverified", "prior_entry"]
