import datetime as dt

import pytest

from filingweave.operators.references import Reference, orphans, report

T = [dt.datetime(2024, m, 1) for m in range(1, 13)]
CHILD = "id long, a long, b string, at timestamp, name string"
PARENT = "a long, b string, since timestamp, name string"


def found(spark, child, parent, match="simple", keys=("a", "b"), **more):
    c, p = spark.createDataFrame(child, CHILD), spark.createDataFrame(parent, PARENT)
    got = orphans(c, p, Reference("t", "id", keys, keys, "at", "since", match), **more)
    return {(r.row_id, r.null_mask, r.reason) for r in got.collect()}


CHILDREN = [(1, 1, "x", T[5], "n"), (2, 9, "x", T[5], "n"), (3, None, "x", T[5], "n"), (4, None, "z", T[5], "n"), (5, None, None, T[5], "n"), (6, 1, None, T[0], "n"), (2, 9, "x", T[5], "n"), (7, 1, "x", None, "n")]
PARENTS = [(1, "x", T[3], "p"), (1, "x", T[8], "p"), (2, "y", None, "p")]


def test_simple(spark):
    assert found(spark, CHILDREN, PARENTS) == {(2, "11", "missing")}


def test_partial_and_full(spark):
    assert found(spark, CHILDREN, PARENTS, "partial") == {(2, "11", "missing"), (4, "01", "missing"), (6, "10", "later")}
    assert found(spark, CHILDREN, PARENTS, "full") == {(2, "11", "missing"), (3, "01", "mixed_nulls"), (4, "01", "mixed_nulls"), (6, "10", "mixed_nulls")}


def test_earliest_target_time_counts_and_null_times_do_not(spark):
    assert found(spark, [(1, 1, "x", T[2], None), (2, 2, "y", T[0], None), (3, 1, "x", T[3], None)], PARENTS) == {(1, "11", "later")}


def test_empty_tables(spark):
    assert found(spark, [], PARENTS) == set()
    assert found(spark, CHILDREN[:1], []) == {(1, "11", "missing")}


def test_hot_key_and_salts_agree(spark):
    child = [(i, 1 if i % 3 else 7, "x", T[5], "n") for i in range(300)]
    want = {(i, "11", "missing") for i in range(0, 300, 3)}
    assert found(spark, child, PARENTS, salts=1) == found(spark, child, PARENTS, salts=8) == want


def test_report(spark):
    c, p = spark.createDataFrame(CHILDREN, CHILD), spark.createDataFrame(PARENTS, PARENT)
    rows = report(orphans(c, p, Reference("t", "id", ["a", "b"], ["a", "b"], "at", "since"))).collect()
    assert [(r.table_name, r.period, r.reason, r.n_orphans) for r in rows] == [("t", "2024-06", "missing", 1)]


def test_wrong_declarations(spark):
    frame = spark.createDataFrame(CHILDREN, CHILD)
    for ref in (Reference("t", "id", ["a"], ["a", "b"]), Reference("t", "id", [], []), Reference("t", "id", ["a"], ["a"], match="most")):
        with pytest.raises(ValueError):
            orphans(frame, frame, ref)
