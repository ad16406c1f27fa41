"""Queries of the operators in this package."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingweave.llm import abuse, history, leakage, mixing, names
from filingweave.session import shared_folder
from filingweave.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    typed = table(spark, d, "announcements_objects").where("stock_code is null or trim(stock_code) in ('', '-')").select("row_id", "company")
    return names.link(typed, table(spark, d, "watchlist"), table(spark, d, "companies")).select("row_id", "stock_code")


def _runs_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeats_by_batch(spark, table(spark, d, "announcements"), table(spark, d, "companies"), _runs_folder(spark))


def p5_last_batch(spark: SparkSession, d: str) -> DataFrame:
    """The repeats in the last batch, found by merging it into the persisted runs of all batches before."""
    rows, companies = table(spark, d, "announcements"), table(spark, d, "companies")
    last = rows.agg(F.max("batch_no")).first()[0]
    runs = history.Runs(spark, _runs_folder(spark))
    runs.add(rows.where(F.col("batch_no") < last), companies)
    found = runs.add(rows.where(F.col("batch_no") == last), companies)
    runs.folder.remove()
    return found


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.where("kind = 'verbatim'").select("doc_id", "item_id").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Per item: documents that carry it, that carry less of it, and that only re-parameterise it."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    count = [F.countDistinct(F.when(F.col("kind") == k, F.col("doc_id"))).alias(f"n_{k}") for k in ("verbatim", "partial", "reparameterised")]
    return found.groupBy("item_id").agg(*count, F.max("words").alias("most_words"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score(table(spark, d, "documents"), table(spark, d, "abuse_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(table(spark, d, "documents"), p8_scores(spark, d))


QUERIES = {
    "p7_shares": p7_shares, "p7_selection": p7_selection, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates,
    "p2_found": p2_found, "p5_found": p5_found, "p5_last_batch": p5_last_batch, "p6_found": p6_found, "p6_report": p6_report,
}
ORACLES: dict[str, str] = {}
