"""What the operators on documents share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_source(source: str = "source") -> Column:
    """Sources are compared regardless of spelling."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(source)), "[^\\p{L}\\p{N}]+", "_"), F.lit("")), F.lit("unknown"))
