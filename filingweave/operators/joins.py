"""Joins that survive a key that holds a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(rows: DataFrame, unique: DataFrame, on: Sequence[str], by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """`rows` joined to a table with one row per key: each key is spread over `salts` sub-keys by a hash of the
    column `by`, and the unique-keyed side is repeated as often. Null keys match nothing."""
    if salts <= 1:
        return rows.join(unique, list(on), how)
    spread = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    repeated = unique.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*on, "__salt"], how).drop("__salt")
