"""References to records that do not exist (problem 3).

A reference is a tuple of key columns. Rows are grouped by their null mask; the rows of each mask are
matched on that mask's non-null columns only, under the declared match semantics of SQL foreign keys:

* `simple`: a row with any null key column refers to nothing and is no orphan;
* `partial`: the non-null columns must agree with some target row; an all-null reference is no orphan;
* `full`: an all-null reference is no orphan, a partly null one always is (reason `mixed_nulls`).

Targets are reduced to one row per key with their earliest time before the join, so a join never multiplies
rows and the moved side is one row per distinct key. The referring side may hold one key in a third of all
rows: `salts` spreads each key over that many sub-keys and repeats the (unique-keyed) targets as often.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingweave.operators.joins import SALTS, salted_join


@dataclass(frozen=True)
class Reference:
    """How one table refers to another. `time`/`target_time` may be None: then only existence counts."""

    table_name: str
    row_id: str
    keys: Sequence[str]
    target_keys: Sequence[str]
    time: str | None = None
    target_time: str | None = None
    match: str = "simple"


def _mask_rows(rows: DataFrame, keys: Sequence[str], mask: Sequence[bool]) -> DataFrame:
    where = F.lit(True)
    for key, present in zip(keys, mask, strict=True):
        where = where & (F.col(key).isNotNull() if present else F.col(key).isNull())
    return rows.where(where)


def orphans(rows: DataFrame, targets: DataFrame, ref: Reference, salts: int = SALTS) -> DataFrame:
    """One row per distinct (row_id, time) whose reference does not resolve.

    Columns: table_name string, row_id (as in `rows`), row_time, null_mask string ('1' = column given), reason
    (`missing`: no target; `later`: the earliest target is later than the row; `mixed_nulls`).

    Defined cases: null row ids are kept (as null); repeated rows count once; an empty target table makes every
    given reference `missing`; a null row time or a target without any time is never `later`; extra columns
    with clashing names are ignored because both sides are projected to private names first.
    """
    if ref.match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics {ref.match!r}")
    if len(ref.keys) != len(ref.target_keys) or not ref.keys:
        raise ValueError("keys and target_keys must be equally many, at least one")
    names = [f"__k{i}" for i in range(len(ref.keys))]
    child = rows.select(
        F.col(ref.row_id).alias("row_id"),
        (F.col(ref.time) if ref.time else F.lit(None).cast("timestamp")).alias("row_time"),
        *(F.col(k).alias(n) for k, n in zip(ref.keys, names, strict=True)),
    )
    parent = targets.select(
        (F.col(ref.target_time) if ref.target_time else F.lit(None).cast("timestamp")).alias("__t"),
        *(F.col(k).alias(n) for k, n in zip(ref.target_keys, names, strict=True)),
    )
    out = None
    for mask in product((True, False), repeat=len(names)):
        if not any(mask) or (ref.match == "simple" and not all(mask)):
            continue
        text = "".join("1" if m else "0" for m in mask)
        part = _mask_rows(child, names, mask)
        if ref.match == "full" and not all(mask):
            found = part.select("row_id", "row_time", F.lit("mixed_nulls").alias("reason"))
        else:
            found = _unmatched(part, parent, [n for n, m in zip(names, mask, strict=True) if m], salts)
        found = found.select(F.lit(ref.table_name).alias("table_name"), "row_id", "row_time", F.lit(text).alias("null_mask"), "reason")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _unmatched(part: DataFrame, parent: DataFrame, on: list[str], salts: int) -> DataFrame:
    known = parent.where(" and ".join(f"{n} is not null" for n in on)).groupBy(*on).agg(F.min("__t").alias("__first"), F.lit(True).alias("__there"))
    joined = salted_join(part, known, on, "row_id", "left", salts)
    later: Column = F.col("__first") > F.col("row_time")
    return joined.where(F.col("__there").isNull() | F.coalesce(later, F.lit(False))).select(
        "row_id", "row_time", F.when(F.col("__there").isNull(), "missing").otherwise("later").alias("reason")
    )


def report(found: DataFrame) -> DataFrame:
    """Orphans per table, UTC month of the referring row, and reason."""
    return (
        found.withColumn("period", F.date_format("row_time", "yyyy-MM"))
        .groupBy("table_name", "period", "reason")
        .agg(F.countDistinct("row_id").alias("n_orphans"))
    )
