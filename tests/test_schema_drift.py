import json
import random

from filingweave.operators import schema_drift as sd

RAW = "table_name string, feed string, file_no long, body string, extra string"


def run(spark, files, wrapped=False, block=sd.BLOCK):
    raw = spark.createDataFrame([("t", f, n, b if b is None or isinstance(b, str) else json.dumps(b), "x") for f, n, b in files], RAW)
    rows = sd.drift(sd.headers(raw, wrapped).cache(), block).collect()
    return {(r.feed, r.file_no, r.change_kind, r.field_name, r.new_name) for r in rows}


def brute(files):
    """Layouts by dictionaries; without renames."""
    out, state = set(), {}
    layouts = {}
    for feed, n, record in files:
        if isinstance(record, dict):
            for k, v in record.items():
                layouts.setdefault((feed, n), {}).setdefault(k, set()).add(sd.json_type(v))
    for (feed, n), lay in sorted(layouts.items()):
        own = {k: "|".join(sorted(t - {"null"})) for k, t in lay.items()}
        if feed in state:
            before = state[feed]
            out |= {(feed, n, "added", k, "") for k in own.keys() - before.keys()} | {(feed, n, "removed", k, "") for k in before.keys() - own.keys()}
            out |= {(feed, n, "retyped", k, "") for k in own.keys() & before.keys() if own[k] and before[k] and own[k] != before[k]}
        state[feed] = {k: t or state.get(feed, {}).get(k, "") for k, t in own.items()}
    return out


def test_lattice():
    assert sd.promote(None, "number") == "number" and sd.promote("null", "array") == "array"
    assert sd.promote("number", "number") == "number" and sd.promote("number", "boolean") == "string" and sd.promote("object", "string") == "string"


def test_changes(spark):
    files = [
        ("f", 1, {"date": "01 Jan 2024", "n": 3, "flag": True}),
        ("f", 1, {"date": "02 Jan 2024", "n": None, "flag": False}),
        ("f", 2, None), ("f", 3, ""), ("f", 4, '{"date": "03'), ("f", 5, [1, 2]),
        ("f", 6, {"Date": "03 Jan 2024", "n": None, "flag": True}),
        ("f", 7, {"Date": "04 Jan 2024", "n": "x", "flag": True}),
        ("f", 8, {"Date": "05 Jan 2024", "n": "x", "pages": 7}),
        ("f", 7, {"Date": "04 Jan 2024", "n": "x", "flag": True}),
    ]
    want = {("f", 6, "renamed", "date", "Date"), ("f", 7, "retyped", "n", ""), ("f", 8, "added", "pages", ""), ("f", 8, "removed", "flag", "")}
    for block in (1, 2, 1024):
        assert run(spark, files, block=block) == want


def test_content_decides_renames(spark):
    names = ["ALPHA BERHAD", "BETA BERHAD", "GAMMA BERHAD"]
    files = [("f", 1, {"issuer": n, "when": "01 Jan 2024"}) for n in names] + [("f", 2, {"entity": n, "pages": 12}) for n in names]
    assert run(spark, files) == {("f", 2, "renamed", "issuer", "entity"), ("f", 2, "removed", "when", ""), ("f", 2, "added", "pages", "")}


def test_wrapped_payload_and_top_key(spark):
    files = [("f", 1, {"list": [{"a": 1}, {"a": 2}, [3]]}), ("f", 2, {"list": []}), ("f", 3, {"rows": [{"a": {"k": 1}}]})]
    assert run(spark, files, wrapped=True) == {("f", 3, "renamed", "list", "rows"), ("f", 3, "retyped", "a", "")}


def test_against_brute_force(spark):
    rng = random.Random(4)
    values = [1, 2.5, "tok", True, None, {"x": 1}, ["y"]]
    files = []
    for feed in ("a", "b"):
        for n in range(25):
            for _ in range(rng.randint(0, 2)):
                files.append((feed, n, {k: rng.choice(values) for k in ("k1", "k2", "k3") if rng.random() < 0.8}))
    files = [f for f in files if f[2]]
    raw = spark.createDataFrame([("t", f, n, json.dumps(b), "x") for f, n, b in files], RAW)
    heads = sd.headers(raw, False)
    for block in (4, 1024):
        got = {(r.feed, r.file_no, r.change_kind, r.field_name, "") for r in sd.steps(heads, block).collect()}
        assert got == brute(files)


def test_unified_table(spark):
    files = [("f", 1, {"issuer": "A BERHAD", "n": 1, "feed": "q"}), ("f", 2, {"entity": "B BERHAD", "n": "2", "feed": None}), ("f", 3, {"entity": "C BERHAD", "n": {"v": 3}})]
    raw = spark.createDataFrame([("t", f, n, json.dumps(b), "x") for f, n, b in files], RAW)
    heads = sd.headers(raw, False).cache()
    names = sd.lineages(sd.drift(heads), heads)
    rows = [r.asDict() for r in sd.unify(raw, names, False).orderBy("file_no").collect()]
    assert [(r["issuer"], r["n"], r["f_feed"]) for r in rows] == [("A BERHAD", "1", "q"), ("B BERHAD", "2", None), ("C BERHAD", '{"v": 3}', None)]


def test_empty_and_odd_records(spark):
    assert run(spark, []) == set()
    odd = ['{"a\\ud800": "x\\udfff", "k": NaN}', "[" * 100_000, '{"a": ' * 5000, '"text"', "7", '{"deep": ' + "[" * 400 + "]" * 400 + "}", '{"e": "\\ud83d\\ude00"}']
    got = run(spark, [("f", None, {"z": 1}), *(("f", i, x) for i, x in enumerate(odd))])
    assert {(n, kind) for _, n, kind, _, _ in got} == {(5, "added"), (5, "removed"), (6, "added"), (6, "removed")}


def test_blocks_of_any_size_tell_the_same(spark):
    """A key that vanishes and comes back with nulls only has lost its type, wherever the blocks are cut."""
    rng = random.Random(3)
    files = [("f", 1, {"a": 1, "b": 1}), ("f", 2, {"b": 1}), ("f", 3, {"a": None, "b": 1}), ("f", 4, {"a": "x", "b": 1})]
    files += [("g", n, {k: rng.choice([None, 1, "x"]) for k in "abcd" if rng.random() < 0.7} | {"e": 1}) for n in range(1, 40)]
    told = [run(spark, files, block=b) for b in (1, 2, 3, 1000)]
    assert told[0] == told[1] == told[2] == told[3]
    assert not any(feed == "f" and kind == "retyped" for feed, _, kind, _, _ in told[0])


def test_unify_loses_no_cell(spark):
    feeds = {"x": [("news", [{"issuer": f"A{i} BERHAD", "n": i} for i in range(9)]), ("items", [{"entity": f"A{i} BERHAD", "issuer": None, "n": str(i)} for i in range(9)])]}
    feeds["y"] = [("news", [{"entity": f"A{i} BERHAD", "issuer": f"B{i}", "also": {"k": i}, "news": "text"} for i in range(9)])]
    raw = spark.createDataFrame([("t", feed, i + 1, json.dumps({"ok": 1, top: records}), "x") for feed, fs in feeds.items() for i, (top, records) in enumerate(fs)], RAW)
    heads = sd.headers(raw, True).cache()
    names = sd.lineages(sd.drift(heads), heads)
    assert "items" not in names["t"] and "news" in names["t"]  # a record holds `news` too
    rows = [r.asDict() for r in sd.unify(raw, names, True).collect()]
    cells = [v for fs in feeds.values() for _, records in fs for r in records for v in r.values() if v is not None]
    back = [v for r in rows for k, v in r.items() if k not in ("table_name", "feed", "file_no", "record_no", "also") and v is not None]
    more = [v for r in rows if r["also"] for v in json.loads(r["also"]).values()]
    plain = lambda v: v if isinstance(v, str) else json.dumps(v)
    assert len(rows) == 27 and sorted(map(plain, cells)) == sorted(map(plain, back + more))
