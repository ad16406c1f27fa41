"""Extractions against golden rows: field by field, within tolerances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingweave.functions.numeric import num_close
from filingweave.functions.text import folded, masked_numbers


def field_checks(actual: DataFrame, expected: DataFrame, key: str, numbers: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """One row per key and field: actual, expected (as text) and passed; every expected row is checked, also where
    there is no actual one. Texts are compared apart from case, blanks and asides in brackets."""
    a = actual.select(F.col(key), *(F.col(f).alias(f"a_{f}") for f in (*numbers, *texts)))
    e = expected.select(F.col(key), *(F.col(f).alias(f"e_{f}") for f in (*numbers, *texts)))
    both = e.join(a, key, "left")

    def check(field: str, ok: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), F.col(f"a_{field}").cast("string").alias("actual"), F.col(f"e_{field}").cast("string").alias("expected"), ok.alias("passed"))

    near = [check(f, num_close(F.col(f"a_{f}").cast("double"), F.col(f"e_{f}").cast("double"))) for f in numbers]
    same = [check(f, folded(f"a_{f}").eqNullSafe(folded(f"e_{f}"))) for f in texts]
    return both.select(key, F.inline(F.array(*near, *same)))


def case_results(checks: DataFrame, key: str, informational: Sequence[str] = ()) -> DataFrame:
    """Per key: checks, failed checks, and whether all but the informational ones passed."""
    counts = F.col("field").isin(*informational) if informational else F.lit(False)
    return checks.groupBy(key).agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(~F.col("passed")).alias("n_failed"), F.bool_and(F.col("passed") | counts).alias("passed"))


def run_totals(cases: DataFrame) -> DataFrame:
    """One row for a run of cases: total, passed, failed."""
    return cases.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def warning_diff(actual: Column, required: Column, optional: Column) -> Column:
    """struct<missing,unexpected> of two lists of messages, figures apart."""
    plain = lambda x: F.transform(x, masked_numbers)
    return F.struct(F.array_except(plain(required), plain(actual)).alias("missing"), F.array_except(F.array_except(plain(actual), plain(required)), plain(optional)).alias("unexpected"))
