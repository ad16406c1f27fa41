import json
import random

import pytest

from filingweave.llm import history as h

SCHEMA = "id long, company_id long, bursa_announcement_id string, dedup_key string, title string, announced_at string, raw_json string, batch_no long, issuer string, identity string"


def filings(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def row(i, title, company=1, bursa=None, day="2024-01-10", raw=None, batch=1):
    return (i, company, bursa, f"bursa:{bursa}" if bursa else f"sha256:{i}", title, day, raw, batch)


def links(spark, rows, companies=None):
    return {(r.id_a, r.id_b) for r in h.link_all(filings(spark, rows), companies).collect()}


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Award of contract no. 6853 for the Zuslih Mulrik works, Package 1", "AWARD OF CONTRACT NUMBER 6,853 FOR THE ZUSLIH MULRIK WORKS, PKG 1...", True),
        ("Quarterly rpt on consolidated results for the financial period ended 31/01/2024", "ACME BERHAD: Quartrly report on consol. results for the FPE 31-Jan-2024<br/>", True),
        ("Memorandum of understanding between the company and Jo Li Sdn Bhd", "memorandum of understanding betwwen the company and Jo Li Sendirian Berhad [ENG]", True),
        ("Changes in Substantial Shareholder&#x27;s Interest - Pesyah Nominees No. 6479", "Changes in Subst. S/H Interest - Pesah Noms No. 6479 (re-listed)", True),
        ("Litigation update, Suit 1 (Hearing 1)", "Litigation update, Suit 1 (Hearing 2)", False),
        ("Litigation update, Suit 1 (Hearing 1)", "Amended announcement: Litigation update, Suit 1 (Hearing 1)", False),
        ("Corrigendum to Award no. 5 at Kenjo", "Award no. 5 at Kenjo (Amendment)", False),
        ("Proposed acquisition of Lot 9, Mukim Kesjoh", "Proposed acquisition of Lot 9, Mukim Basloh", False),
        ("Proposed acquisition of Lot 9, Mukim Kesjoh", "Termination of tenancy, Lot 9, Mukim Kesjoh", False),
        (None, "", True),
    ],
)
def test_titles(a, b, same):
    assert h.same_title(h.canonical_title(a), h.canonical_title(b)) is same
    assert h.unpack(h.pack(h.canonical_title(a))) == h.canonical_title(a)


def test_within_one():
    assert all(h.within_one(a, b) for a, b in [("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "abxc"), ("abc", "axc"), ("", "a")])
    assert not any(h.within_one(a, b) for a, b in [("abc", "cba"), ("abc", "a"), ("abcd", "badc")])


def test_cases(spark):
    t = "Award of contract no. 6853 for the Zuslih Mulrik works, Package 1"
    rows = [
        row(1, t, bursa="3000001"), row(2, t.upper() + "...", day="2024-01-12"), row(3, t, day="2024-03-01"), row(4, t, company=2),
        row(5, "quite another text", bursa="3000001"), row(6, "Award of contraet no. 6853 for the Zuslh Mulrik works, Package 1", bursa="ANN-03000001"),
        row(7, t, company=None, raw=json.dumps({"company": "ACME BERHAD"})), row(8, t, raw=json.dumps({"company": "Acme Berhad"})),
        row(9, t, company=None, raw='[1, "x", "<a href=\'/p?stock_code=1\'>ACME BERHAD</a>", "cut'), row(10, None), row(11, None), row(1, t, bursa="3000001"),
        row(12, "Notice of meeting 77", day=None, raw='{"announcement_date": 1704844800000}'), row(13, "Notice of meeting 77"),
        row(14, "Undated 5 matter", day=None), row(15, "Undated 5 matter", day=None), row(16, "Undated 5 matter", day="2024-02-01"),
    ]
    assert links(spark, rows) == {(1, 2), (1, 6), (1, 7), (1, 8), (1, 9), (10, 11), (12, 13), (14, 15), (14, 16)}


def test_a_filing_lies_within_days_of_its_first_row(spark):
    rows = [row(i, "Results for the financial period ended 30 Jun 2020", bursa=f"300000{i}", day=f"2024-01-{10 + 2 * i:02d}") for i in range(1, 6)]
    assert links(spark, rows) == {(1, 2), (3, 4)}


def test_null_issuers_match_by_name_only(spark):
    raw = lambda n: json.dumps({"company": n})
    rows = [row(1, "Matter 5 at Kenjo", company=None, raw=raw("A BHD")), row(2, "Matter 5 at Kenjo", company=None, raw=raw("B BHD")), row(3, "Matter 5 at Kenjo", company=None, raw=raw("a bhd")), row(4, "Matter 5 at Kenjo", company=9)]
    on_file = spark.createDataFrame([(9, "B Bhd"), (8, None)], "id long, name string")
    assert links(spark, rows, on_file) == {(1, 3), (2, 4)}


def test_empty_and_long(spark):
    assert links(spark, []) == set()
    assert links(spark, [row(1, "x " * 100_000 + "5"), row(2, "x " * 100_000 + "5")]) == {(1, 2)}


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    names = ["Kenjo", "Basloh", "Zuslih", "Mulrik", "Dansa", "Terwit"]
    rows = []
    for i in range(1, n + 1):
        if rows and rng.random() < 0.3:
            _, c, b, k, t, d, r, _ = rng.choice(rows)
            if rng.random() < 0.5:
                p = rng.randrange(len(t))
                t = t[:p] + t[p + 1 :] if t[p].isalpha() else t.upper()
            b = rng.choice([b, None])
            rows.append((i, c, b, k, t, d, r, i // 40))
        else:
            t = f"Litigation update, Suit {rng.randint(1, 30)} before the {rng.choice(names)} {rng.choice(names)} court (Hearing {rng.randint(1, 2)})"
            rows.append((i, rng.randint(1, 4), rng.choice([f"30{i:05d}", None]), f"k{i}", t, f"2024-01-{rng.randint(1, 28):02d}", None, i // 40))
    return rows


def brute(rows):
    """All pairs, then components."""
    full = [(r[0], r[1], h.day_of(r[5], r[6]), h.id_digits(r[2], r[3]), h.canonical_title(r[4])) for r in rows]
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(full):
        for b in full[:k]:
            if a[1] == b[1] and abs(a[2] - b[2]) <= h.DAYS:
                one = a[3] is not None and a[3] == b[3]
                if (one and a[4][:2] == b[4][:2]) or h.same_title(a[4], b[4]):
                    x, y = find(a[0]), find(b[0])
                    root[max(x, y)] = min(x, y)
    day, anchors, out = {r[0]: r[2] for r in full}, {}, set()
    for i in sorted(root):
        mine = anchors.setdefault(find(i), [])
        near = [a for a in mine if abs(day[a] - day[i]) <= h.DAYS]
        out |= {(min(near), i)} if near else set()
        if not near:
            mine.append(i)
    return out


def test_against_all_pairs(spark):
    rows = corpus()
    got, want = links(spark, rows), brute(rows)
    assert len(got & want) >= 0.97 * len(want) and got <= want


def undated(rows, share=0.15, seed=2):
    rng = random.Random(seed)
    return [(*r[:5], None, *r[6:]) if rng.random() < share else r for r in rows]


@pytest.mark.parametrize("rows", [corpus(115, 5), undated(corpus(79, 6))], ids=["dated", "some undated"])
def test_batches_find_what_the_bulk_run_finds(spark, tmp_path, rows):
    bulk = links(spark, rows)
    runs = h.Runs(spark, f"file://{tmp_path}/runs", range_rows=20, fan=3)  # many ranges and compactions
    batches = sorted({r[7] for r in rows})
    at_once = set()
    for batch in batches:
        part = filings(spark, [r for r in rows if r[7] == batch])
        found = {tuple(r) for r in runs.add(part, name=str(batch)).collect()}
        at_once |= found
        if batch == 1:  # again: nothing changes
            assert {tuple(r) for r in runs.add(part, name=str(batch)).collect()} == found
        assert all(len(runs_) < 3 for runs_ in levels(runs).values())
    assert {tuple(r) for r in runs.repeats().collect()} == bulk
    # what was told with a batch differs only where a later row showed two filings to be one
    assert {b for _, b in at_once} <= {b for _, b in bulk} and len(at_once - bulk) <= 0.05 * len(bulk)
    runs.compact()
    assert {tuple(r) for r in runs.repeats().collect()} == bulk
    state = runs.commits.current()
    kept = {f[0].split("/")[1] for run in state["runs"] for files in run["files"].values() for f in files}
    assert len(state["runs"]) == 1 and kept == {f"run={state['runs'][0]['n']}"}
    assert {n for kind in h.Runs.KINDS for n in h.Folder(spark, f"{runs.folder.path}/{kind}").names()} == kept
    again = runs.add(filings(spark, [(999, *rows[0][1:])]))
    assert {r.id_b for r in again.collect()} == {999}


def levels(runs):
    out = {}
    for run in runs.commits.current()["runs"]:
        out.setdefault(runs._level(run), []).append(run)
    return out


def test_a_name_is_told_its_company_later(spark, tmp_path):
    t, raw = "Award of contract no. 6853 for the Zuslih Mulrik works, Package 1", json.dumps({"company": "Acme Berhad"})
    rows = [row(1, t, company=None, raw=raw), row(2, t, company=7), row(3, "Other matter 5", company=7, raw=raw), row(4, t, company=None, raw=raw), row(5, t, company=8)]
    runs = h.Runs(spark, f"file://{tmp_path}/runs", range_rows=1)
    told = [{tuple(r) for r in runs.add(filings(spark, [r])).collect()} for r in rows]
    assert told == [set(), set(), set(), {(1, 4)}, set()]
    assert {tuple(r) for r in runs.repeats().collect()} == links(spark, rows) == {(1, 2), (1, 4)}


def test_batches_in_any_order_and_merged_filings(spark, tmp_path):
    """Rows whose ids are lower than those accepted, and a row that joins two filings accepted as two."""
    t = "Award of contract no. 6853 for the Zuslih Mulrik works, Package 1"
    far, near = t.replace("Zuslih", "Zusl"), t.replace("Zuslih", "Zusli")
    rows = [row(5, t), row(6, far), row(4, near), row(2, t), row(9, far)]
    runs = h.Runs(spark, f"file://{tmp_path}/runs", range_rows=1, fan=9)
    for r in rows:
        runs.add(filings(spark, [r]))
    assert {tuple(r) for r in runs.repeats().collect()} == links(spark, rows) == {(2, 4), (2, 5), (2, 6), (2, 9)}


def test_a_batch_reads_only_its_own_ranges(spark, tmp_path):
    rows = [row(i, f"Litigation update, Suit {i}", company=i % 50, day=f"20{10 + i % 14}-0{1 + i % 9}-11") for i in range(1, 401)]
    runs = h.Runs(spark, f"file://{tmp_path}/runs", range_rows=10)
    runs.add(filings(spark, rows))
    read = []
    before = runs._read
    runs._read = lambda kind, files: (read.append((kind, len(files))), before(kind, files))[1]
    assert [tuple(r) for r in runs.add(filings(spark, [(2000, *rows[200][1:])])).collect()] == [(201, 2000)]
    total = {kind: len(runs._files(runs.commits.current(), kind)) for kind in runs.KINDS}
    assert total["entries"] > 40 and total["states"] > 40
    assert max(n for kind, n in read if kind in ("entries", "states")) <= 4


def test_by_batch_leaves_nothing(spark, tmp_path):
    rows = corpus(90, 9)
    nulls = [(*r[:7], None if i % 3 == 0 else r[7]) for i, r in enumerate(rows)]
    got = h.repeats_by_batch(spark, filings(spark, nulls), None, f"file://{tmp_path}/runs", 3)
    assert {tuple(r) for r in got.collect()} == links(spark, rows) and not (tmp_path / "runs").exists()
    assert h.repeats_by_batch(spark, filings(spark, []), None, f"file://{tmp_path}/runs").count() == 0


def slipped(n=300, seed=3):
    """Filings without other figures, so that windows are crowded, with up to one slip in every word, names included."""
    rng = random.Random(seed)
    names = ["Vembang", "Lirtat", "Kenjo", "Basloh", "Zuslih", "Mulrik"]
    rows = []

    def slip(w):
        p, kind = rng.randrange(1, len(w)), rng.randrange(4)
        return {0: w[:p] + w[p + 1 :], 1: w[:p] + "q" + w[p:], 2: w[:p] + "q" + w[p + 1 :], 3: w[: p - 1] + w[p] + w[p - 1] + w[p + 1 :]}[kind]

    for i in range(1, n + 1):
        if rows and rng.random() < 0.5:
            _, c, b, k, t, d, r, _ = rng.choice(rows)
            t = " ".join(slip(w) if w.isalpha() and len(w) > 3 and rng.random() < 0.5 else w for w in t.split())
            d = f"2024-01-{min(28, int(d[-2:]) + rng.randint(0, 2)):02d}"
            rows.append((i, c, rng.choice([b, None]), k, t, d, r, i // 100))
        else:
            t = rng.choice(["Proposed disposal of {} {} {}", "Quarterly results of consolidated {} {} {}", "Litigation update {} {}", "Notice of general meeting"])
            t = t.format(*(rng.choice(names) + rng.choice(["", "wit", "dor"]) for _ in range(3)))
            rows.append((i, rng.randint(1, 2), rng.choice([f"30{i:05d}", None]), f"k{i}", t, f"2024-01-{rng.randint(1, 28):02d}", None, i // 100))
    return rows


def test_equal_to_all_pairs(spark):
    start = 10_000
    pairs = [("Proposed disposal of Vembang Lirtat", "Proposed disposal of Vembag Lirtta"), ("Notice of general meeting of shareholder", "Notice of general meeting")]
    rows = slipped() + [row(start + 2 * i + j, t, company=10 + i) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    got = links(spark, rows)
    assert {(start, start + 1), (start + 2, start + 3)} <= got and got == brute(rows)


def test_crowded_windows_miss_nothing():
    titles = list(dict.fromkeys(h.pack(h.canonical_title(r[4])) for r in slipped(300, 7)))
    held, found = h.Held(), set()
    for i, t in enumerate(titles):
        found |= {(k, t) for k, _ in held.near(t, None) if h._alike(k, t, False)}
        held.put(t, (i, i, None))
    assert held.marked is not None
    assert found == {(a, b) for i, b in enumerate(titles) for a in titles[:i] if h._alike(a, b, False)}
    held.drop_before(len(titles) - 3)
    assert list(held.rows) == titles[-3:] and {k for m in held.marked.values() for k in m} == set(titles[-3:])


def test_like_titles_share_a_mark():
    titles = [h.canonical_title(r[4]) for r in slipped(300, 7)]
    alike = [(a, b) for i, a in enumerate(titles) for b in titles[:i] if h.same_title(a, b)]
    assert sum(a[2][:1] != b[2][:1] and a[2][-1:] != b[2][-1:] for a, b in alike) > 50
    assert all(h.shared(h.pack(a), None) & h.shared(h.pack(b), None) for a, b in alike)
    left_out = h.canonical_title("consolixxted Kenjo"), h.canonical_title("consolidated Kenjo")
    assert h.same_title(*left_out) and h.shared(h.pack(left_out[0]), None) & h.shared(h.pack(left_out[1]), None)


def named(rows, seed=4):
    """Rows of which some have no company id and some records tell the company's name."""
    rng = random.Random(seed)
    out = []
    for i, c, b, k, t, d, _, batch in rows:
        told = json.dumps({"company": f"Company {c} Bhd"}) if rng.random() < 0.5 else None
        out.append((i, None if told and rng.random() < 0.6 else c, b, k, t, d, told, batch))
    return out


def test_each_batch_is_checked_by_itself(spark, tmp_path):
    """A row is resolved by what was accepted up to its own batch, not by the other batches of a lot."""
    t, raw = "Award of contract no. 6853 for the Zuslih Mulrik works, Package 1", json.dumps({"company": "Acme Berhad"})
    rows = [
        row(1, t, company=None, raw=raw, batch=1), row(2, "Other matter 5", company=7, raw=raw, batch=1), row(3, t, company=7, batch=2),
        row(4, "Other matter 6", company=8, raw=raw, batch=2), row(5, "Other matter 7", company=8, raw=raw, batch=2),
        row(6, t, company=None, raw=raw, batch=3), row(7, t, company=8, batch=4),
    ]
    got = h.repeats_by_batch(spark, filings(spark, rows), None, f"file://{tmp_path}/runs")
    assert {tuple(r) for r in got.collect()} == {(1, 3), (6, 7)}


def test_batches_of_a_table_as_one_by_one(spark, tmp_path):
    """Batches with few and many rows, one without a number, undated rows, and names told their company later."""
    rows = undated(named(corpus(100, 8)), 0.1)
    rows = [(*r[:7], None if r[0] < 9 else (3, 20, 20, 21)[r[0] % 4 if r[0] > 60 else 0]) for r in rows]
    late = [row(501, "Late matter 5", company=None, raw='{"company": "Z"}', batch=3), row(502, "Late matter 5", company=77, raw='{"company": "Z"}', batch=20)]
    rows += [*late, row(503, "Late matter 5", company=77, batch=21), row(504, "Late matter 5", company=None, raw='{"company": "Z"}', batch=21)]
    each, one = h.Runs(spark, f"file://{tmp_path}/each"), h.Runs(spark, f"file://{tmp_path}/one")
    each.accept_each(filings(spark, rows))
    for b in (None, 3, 20, 21):
        one.accept(filings(spark, [r for r in rows if r[7] == b]), name=None if b is None else str(b))
    assert each.commits.current()["batches"] == one.commits.current()["batches"] == {"3": 2, "20": 3, "21": 4}
    for batch in (None, 1, 2, 3, 4):
        assert {tuple(r) for r in each.repeats(batch).collect()} == {tuple(r) for r in one.repeats(batch).collect()}
    assert {(501, 502), (501, 503), (501, 504)} <= {tuple(r) for r in each.repeats().collect()}
    more = [(900, *rows[70][1:7], 21), (901, *rows[20][1:7], 22)]  # of a batch accepted already, and of a new one
    each.accept_each(filings(spark, more))
    assert {r.id_b for r in each.repeats().collect()} >= {901} and 900 not in {r.id_b for r in each.repeats().collect()}
