import json

import pytest
from pyspark.sql import functions as F

from filingweave.functions import answers
from filingweave.operators import ingest, requests
from filingweave.sources import files, html, listing
from filingweave.sources.folders import Commits, Folder
from filingweave.sources.store import CommitConflict, Store
from filingweave.streaming import poll

OBJECT = {"ID": 77, "Announcement_Date": "16 Aug 2026", "company": "<b>ACME</b> BERHAD", "stock_code": "1234", "title": "Quarterly rpt", "url": "/d?ann_id=77", "attachments": [{"name": "r.pdf", "href": "/f/r.pdf"}]}
CELLS = [1, "<div>16 Aug 2026</div><div>16 Aug 2026</div>", "<a href='/p?stock_code=1234'>ACME BERHAD</a>", "<a href='/d?ann_id=77'>Quarterly rpt</a><p><a href='/f/r.pdf'>r.pdf</a>"]
FIELDS = ["title", "stock_code", "company_name", "announced_at", "url", "bursa_id"]
WANT = ("Quarterly rpt", "1234", "ACME BERHAD", "2026-08-16", "/d?ann_id=77", "77")


def payloads(spark, *bodies):
    return spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "page int, body string")


def test_three_shapes_are_one(spark):
    page = "<table><tr><th>#</th><th>Date</th><th>Company</th><th>Title</th></tr><tr>" + "".join(f"<td>{c}" for c in CELLS) + "</tr></table>"
    shapes = [listing.parse(payloads(spark, {"data": [OBJECT]}), "body"), listing.parse(payloads(spark, [CELLS]), "body"), listing.from_html(spark.createDataFrame([(1, page)], "k int, html string"), "k", "html")]
    for rows in shapes:
        got = rows.select(*FIELDS, "attachments").collect()
        assert [tuple(r)[:6] for r in got] == [WANT]
        assert [tuple(a) for a in got[0].attachments] == [("r.pdf", "/f/r.pdf")]


def test_mixed_short_and_empty_rows(spark):
    rows = listing.parse(payloads(spark, {"records": [OBJECT, CELLS, [1], {"id": 3}]}, {"data": []}, []), "body")
    assert sorted((r.page, r.row_no) for r in rows.collect()) == [(0, 0), (0, 1)]


def test_keys_alike_but_for_case(spark):
    odd = '[{"Title": "one", "TITLE": "two", "id": "", "ID": "5"}]'
    got = listing.parse(payloads(spark, odd), "body").collect()
    assert [(r.title, r.bursa_id) for r in got] == [("two", "5")]


def test_unknown_shapes_are_errors_not_empty(spark):
    bad = payloads(spark, {"status": "ok", "payload": {"announcementList": []}}, "no json", "")
    got = {r.page: r.problem for r in listing.split_payload(bad, "body").collect()}
    assert got == {0: "no announcement list among the keys: payload, status", 1: "not a listing", 2: "not a listing"}
    with pytest.raises(listing.ListingError):
        listing.parse(bad, "body")


@pytest.mark.parametrize(
    ("page", "rows"),
    [
        ("<tr><td>a<td>b <a href='x'>c</a></tr></td><tr></tr>", [["a", 'b <a href="x">c</a>']]),
        ("<table><tr><td>out<table><tr><td>in</td></tr></table></td><td>z</td></tr></table>", [["in"], ["out", "z"]]),
        ("</td></tr><p>", []), ("", []), (None, []), ("<tr><td>&amp;&nbsp;x", []),
    ],
)
def test_broken_tables(page, rows):
    assert html.table_rows(page) == rows


def test_pdf_links(spark):
    page = "<a href='/a.PDF?x=1'>A <b>file</b></a><a href='/a.PDF?x=1'>again</a><iframe src='/b.pdf'></iframe><a href='/c.html'>c</a><object data='d.pdf'>"
    assert html.pdf_links(page) == [("A file", "/a.PDF?x=1"), ("b.pdf", "/b.pdf"), ("d.pdf", "d.pdf")]
    got = html.read_pdf_links(spark.createDataFrame([(1, page), (2, None)], "k int, h string"), "k", "h").collect()
    assert [(r.page_key, r.place, r.url) for r in got] == [("1", 0, "/a.PDF?x=1"), ("1", 1, "/b.pdf"), ("1", 2, "d.pdf")]


def test_store_commits_all_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("t") is None
    at = store.manifest()["commit"]
    store.commit(replaced={"t": spark.range(3)}, appended={"log": spark.range(1)})
    store.commit(appended={"log": spark.range(2).withColumn("extra", F.lit("x"))})
    assert store.read("t").count() == 3 and store.read("log").count() == 3 and "extra" in store.read("log").columns
    with pytest.raises(CommitConflict):
        store.commit(replaced={"t": spark.range(9)}, expected=at)
    assert store.read("t").count() == 3


def test_polling_twice_inserts_nothing_and_resumes(spark, tmp_path):
    source, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, key string")

    def run():
        poll.run_once(spark.readStream.schema("id long, key string").parquet(str(source)), store, "t", "key", str(tmp_path / "check"))
        return {r.key for r in store.read("t").collect()}, store.read("t").count()

    rows.write.parquet(str(source))
    assert run() == ({"a", "b"}, 2) == run()
    spark.createDataFrame([(4, "b"), (5, "c")], "id long, key string").write.mode("append").parquet(str(source))
    assert run() == ({"a", "b", "c"}, 3)


def test_replayed_batch_is_a_no_op(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    accept = poll.accept_batch(store, "t", "key")
    batch = spark.createDataFrame([(1, "a")], "id long, key string")
    accept(batch, 0)
    accept(spark.createDataFrame([(2, "z")], "id long, key string"), 0)
    assert [r.key for r in store.read("t").collect()] == ["a"]


def test_watchlist_file(spark, tmp_path):
    path = tmp_path / "w.json"
    path.write_text(json.dumps([{"stock_code": "1", "name": "A"}, {"stock_code": "1", "name": "A2", "is_active": False}, {"stock_code": "2"}, {"name": "x"}, {"stock_code": "3", "name": "C", "notes": "n", "more": 1}]))
    assert {(r.stock_code, r.name, r.is_active) for r in files.read_watchlist(spark, str(path)).collect()} == {("1", "A2", False), ("3", "C", True)}
    for text in ("{}", "[{", ""):
        path.write_text(text)
        assert files.read_watchlist(spark, str(path)).count() == 0
    assert files.read_watchlist(spark, str(tmp_path / "none.json")).count() == 0


def test_triage(spark):
    rows = spark.createDataFrame([("stop", '{"a": 1}'), ("length", '{"a"'), ("stop", "  "), ("stop", None), (None, "{oops")], "r string, c string")
    got = [tuple(r[0]) for r in rows.select(answers.triage(F.col("r"), F.col("c"))).collect()]
    assert [g[0] for g in got] == ["ok", "cut_off", "empty", "empty", "not_json"] and got[0][1] is None and got[4][1].endswith("{oops")


def test_request_plan(spark):
    rows = spark.createDataFrame([(i, f"https://h{i % 3}.org/{i}") for i in range(12)] + [(1, "ftp://x/y"), (2, None), (99, "https://h0.org/0")], "n int, u string")
    got = requests.plan(rows, "u", "n", per_run=5, per_host=2, hosts=2, delay=0.1).orderBy("place").collect()
    assert [(r.url[-1], r.at_host, r.earliest_s) for r in got] == [("0", 1, 0.0), ("1", 1, 0.0), ("3", 2, 2.0), ("4", 2, 2.0)]


def test_commits_claims_and_compaction(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id long, dedup_key string")
    for i in range(4):
        store.commit(appended={"t": rows(i)}, marks={"t": i})
    assert not store.compact("t", 4) and store.compact("t", 3)
    assert sorted(r.id for r in store.read("t").collect()) == [0, 1, 2, 3] and len(store.manifest()["tables"]["t"]) == 1
    assert store.vacuum() == 4 and store.read("t").count() == 4 and store.vacuum() == 0
    with pytest.raises(CommitConflict):
        store.commit(appended={"t": rows(9)}, expected=2)
    assert store.read("t").count() == 4

    commits = Commits(Folder(spark, f"file://{tmp_path}/c"), {"runs": []})
    assert commits.current() == {"commit": 0, "runs": []}
    assert commits.folder.claim("commit-000000001.claim")
    with pytest.raises(CommitConflict):  # another is at work on version 1
        commits.put({"runs": [1]}, 0)
    commits.folder.remove("commit-000000001.claim")
    for n in range(4):
        commits.put({"runs": [n]}, n)
    assert commits.current() == {"commit": 4, "runs": [3]} and commits.folder.names() == ["commit-000000003.json", "commit-000000004.json"]


def test_first_of_each_key(spark):
    rows = spark.createDataFrame([(3, "a", "x"), (1, "a", "z"), (1, "a", "y"), (2, None, "n"), (None, "b", "b"), (9, None, "m")], "id long, dedup_key string, t string")
    assert {tuple(r) for r in ingest.firsts(rows, "dedup_key").collect()} == {(1, "a", "y"), (2, None, "n"), (None, "b", "b")}
    held = spark.createDataFrame([("b",), ("b",)], "dedup_key string")
    assert {r.id for r in ingest.unseen(rows, held, "dedup_key").collect()} == {1, 2}
