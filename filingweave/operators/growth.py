"""Growth on the quarter before and the same quarter a year before, in one window pass.

A company's periods are consecutive numbers, so both lookups are RANGE frames over one partitioning: exact periods,
no fallback to a nearer one. Reports are reduced to the latest of a company and period first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingweave.functions.numeric import pct_change


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by `order` (descending, nulls last); state ties out by adding a unique column."""
    place = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order))
    return rows.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def growth(rows: DataFrame, source: str, period: str, values: Sequence[str]) -> DataFrame:
    """Adds <value>_prev, <value>_ly, <value>_qoq and <value>_yoy; one row per source and period is expected.

    Rows with a null period get nulls. A missing period in between gives null, never the one before it.
    """
    series = Window.partitionBy(source).orderBy(period)
    before, year = series.rangeBetween(-1, -1), series.rangeBetween(-4, -4)
    told = F.col(period).isNotNull()
    for v in values:
        rows = rows.withColumn(f"{v}_prev", F.when(told, F.first(v).over(before))).withColumn(f"{v}_ly", F.when(told, F.first(v).over(year)))
    for v in values:
        rows = rows.withColumn(f"{v}_qoq", pct_change(v, f"{v}_prev")).withColumn(f"{v}_yoy", pct_change(v, f"{v}_ly"))
    return rows


def growth_by_joins(rows: DataFrame, source: str, period: str, values: Sequence[str]) -> DataFrame:
    """The same by two self joins on the shifted period: a check of `growth`, and the form for unsorted input."""
    out = rows
    for name, shift in (("prev", 1), ("ly", 4)):
        other = rows.select(F.col(source), (F.col(period) + shift).alias(period), *(F.col(v).alias(f"{v}_{name}") for v in values))
        out = out.join(other, [source, period], "left")
    for v in values:
        out = out.withColumn(f"{v}_qoq", pct_change(v, f"{v}_prev")).withColumn(f"{v}_yoy", pct_change(v, f"{v}_ly"))
    return out
