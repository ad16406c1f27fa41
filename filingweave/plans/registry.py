"""All core queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filingweave.plans import filings, references, schema_drift, units, views

_MODULES = (filings, references, schema_drift, units, views)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return filings.growth_by_supplier_quarter(spark, d)
