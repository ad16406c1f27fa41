"""Queries of problem 4: the layouts of announcements.raw_json and announcements_malformed.payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingweave.operators import schema_drift as sd
from filingweave.session import cut
from filingweave.sources.tables import table


def raw_announcements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "announcements").select(
        F.lit("announcements").alias("table_name"), F.lit("").alias("feed"), F.col("batch_no").alias("file_no"), F.col("raw_json").alias("body")
    )


def raw_malformed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "announcements_malformed").select(F.lit("announcements_malformed").alias("table_name"), "feed", "file_no", F.col("payload").alias("body"))


def filing_headers(spark: SparkSession, d: str) -> DataFrame:
    return cut(
        sd.headers(raw_announcements(spark, d), wrapped=False)
        .unionByName(sd.headers(raw_malformed(spark, d), wrapped=True))
        .groupBy("table_name", "feed", "file_no", "field", "kind", "bucket")
        .agg(F.sum("n").alias("n"))
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sd.drift(filing_headers(spark, d)).select("table_name", "feed", "file_no", "change_kind", "field_name", "new_name")


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    heads = filing_headers(spark, d)
    names = sd.lineages(sd.drift(heads), heads)
    rows = sd.unify(raw_announcements(spark, d), names, wrapped=False)
    return rows.unionByName(sd.unify(raw_malformed(spark, d), names, wrapped=True))


QUERIES = {"p4_found": p4_found, "p4_unified": p4_unified}
ORACLES: dict[str, str] = {}
