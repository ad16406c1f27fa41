"""Listing rows against a watchlist: by code, else by the words of the name; and keeping the list in step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingweave.functions.text import identifying_tokens
from filingweave.operators.joins import SALTS, salted_join


def match_by_code(rows: DataFrame, code: str, companies: DataFrame, company_code: str = "stock_code", by: str | None = None) -> DataFrame:
    """Rows with a code, joined to the company of that code (the first by its columns' values where it is listed twice);
    an unknown code matches nothing. `by`: a column to spread rows of one code by."""
    given = rows.withColumn("__code", F.trim(code)).where("__code <> ''")
    listed = companies.withColumn("__code", F.trim(company_code)).where("__code <> ''").groupBy("__code").agg(F.min(F.struct(*companies.columns)).alias("match"))
    return salted_join(given, listed, ["__code"], by or code, "left", SALTS if by else 1).drop("__code")


def match_by_tokens(rows: DataFrame, row_id: str, name: str, companies: DataFrame, company_id: str, names: Sequence[str]) -> DataFrame:
    """(row_id, company_id, overlap): the smaller set of identifying words is contained in the other.

    The words are exploded and equi-joined, so only pairs that share a word meet; counts decide containment. The most
    shared words win, ties go to the lowest company id. Typed names are reduced to distinct word sets first; a word
    that a third of all names share costs as many rows as there are distinct word sets, times the companies with it.
    """
    typed = rows.select(F.col(row_id).alias("row_id"), F.array_sort(identifying_tokens(name)).alias("words"))
    sets = typed.where("size(words) > 0").select("words", F.xxhash64("words").alias("set_id")).distinct()
    listed = companies.select(F.col(company_id).alias("company_id"), F.explode(F.array(*(F.col(n) for n in names))).alias("name"))
    listed = listed.select("company_id", "name", identifying_tokens("name").alias("own")).where("size(own) > 0").distinct()
    listed = listed.withColumn("name_id", F.xxhash64("company_id", "name"))
    shared = (
        sets.select("set_id", F.size("words").alias("n_typed"), F.explode("words").alias("word"))
        .join(listed.select("company_id", "name_id", F.size("own").alias("n_own"), F.explode("own").alias("word")), "word")
        .groupBy("set_id", "company_id", "name_id", "n_typed", "n_own")
        .agg(F.count(F.lit(1)).alias("overlap"))
        .where("overlap = least(n_typed, n_own)")
    )
    best = shared.groupBy("set_id").agg(F.max_by(F.struct("company_id", "overlap"), F.struct("overlap", -F.col("company_id"))).alias("b"))
    return salted_join(typed.withColumn("set_id", F.xxhash64("words")), best, ["set_id"], "row_id").select("row_id", F.col("b.company_id").alias("company_id"), F.col("b.overlap").alias("overlap"))


def reconcile(held: DataFrame, given: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per key: `insert`, `update`, `same` or `dropped` (reported, never deleted), with the values to hold."""
    a = held.select(F.col(key).alias("__k"), F.struct(*fields).alias("old"))
    b = given.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.struct(*fields).alias("new"))
    both = a.join(b, "__k", "full")
    change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "dropped").when(~F.col("old").eqNullSafe(F.col("new")), "update").otherwise("same")
    return both.select(F.col("__k").alias(key), change.alias("change"), *(F.coalesce(F.col("new"), F.col("old"))[f].alias(f) for f in fields))


def first_of(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    place = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")
