"""Incremental intake: what is new, what was ingested before, what is outstanding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_TEXT = 400
MIN_BYTES = 1_000
MAX_BYTES = 40 * 1024 * 1024


def firsts(rows: DataFrame, key: str, order: str = "id") -> DataFrame:
    """The first row of each key by `order` (nulls last), ties by the other columns; rows with a null key are one key."""
    whole = F.struct(F.col(order).isNull().alias("__none"), F.col(order).alias("__at"), *(F.col(f"`{c}`") for c in rows.columns))
    first = rows.groupBy(F.col(key).alias("__key")).agg(F.min(whole).alias("__first"))
    return first.select(*(F.col(f"__first.`{c}`").alias(c) for c in rows.columns))


def unseen(batch: DataFrame, held: DataFrame, key: str, order: str = "id") -> DataFrame:
    """Rows of a batch whose key isn't held, of each key the first by `order`."""
    return firsts(batch.join(held.select(key).distinct(), key, "left_anti"), key, order)


def ingested_scope(files: DataFrame, approved: DataFrame, pending: DataFrame) -> DataFrame:
    """files (sha256, file_size) with the scope and id of the same file held elsewhere: approved before pending, then
    the lowest id. Empty and null hashes match nothing."""
    held = (
        approved.select("sha256", "file_size", F.lit(0).alias("rank"), "id")
        .unionByName(pending.select("sha256", "file_size", F.lit(1).alias("rank"), "id"))
        .where("sha256 <> ''")
        .groupBy("sha256", "file_size")
        .agg(F.min(F.struct("rank", "id")).alias("first"))
    )
    scope = F.when(F.col("first.rank") == 0, "approved").when(F.col("first.rank") == 1, "pending")
    return files.join(held, ["sha256", "file_size"], "left").select(*files.columns, scope.alias("scope"), F.col("first.id").alias("held_id"))


def file_identity(content: Column) -> Column:
    """struct<sha256,file_size> of a file's bytes."""
    return F.struct(F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("file_size"))


def verify_text(text: Column, own_report: Column) -> Column:
    """`rejected` for too little text (a scan) or one of the tool's own reports, else `verified`."""
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < MIN_TEXT, "rejected").when(own_report, "rejected").otherwise("verified")


def verify_bytes(content: Column) -> Column:
    """struct<status,detail> of a file's bytes before it is opened."""
    size = F.coalesce(F.octet_length(content), F.lit(0))
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    told = lambda status, detail: F.struct(F.lit(status).alias("status"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))
    return (
        F.when(size == 0, told("rejected", "Empty response"))
        .when(size < MIN_BYTES, told("rejected", F.concat(F.lit("Too small to be a filing ("), size.cast("string"), F.lit(" bytes)"))))
        .when(size > MAX_BYTES, told("rejected", "Larger than the 40MB limit"))
        .when(~F.regexp_replace(head, r"^\s+", "").startswith("%PDF-"), told("rejected", "Not a PDF — no %PDF- header"))
        .otherwise(told("verified", F.concat(size.cast("string"), F.lit(" bytes"))))
    )


def merge_attachments(held: DataFrame, seen: DataFrame) -> DataFrame:
    """Attachments after a download pass: announcement_id, filename, url, sha256, file_size.

    A file seen with its hash completes the placeholder of its url; the same content under a second url leaves one
    row (the lowest url); placeholders stay only for urls nothing was downloaded from.
    """
    every = held.unionByName(seen)
    done = every.where("sha256 is not null")
    kept = done.groupBy("announcement_id", "sha256").agg(F.min(F.struct("url", "filename", "file_size")).alias("f"))
    waiting = every.where("sha256 is null").join(done.select("announcement_id", "url").distinct(), ["announcement_id", "url"], "left_anti")
    first = waiting.groupBy("announcement_id", "url").agg(F.min("filename").alias("filename"))
    columns = ["announcement_id", "filename", "url", "sha256", "file_size"]
    return kept.select("announcement_id", F.col("f.filename").alias("filename"), F.col("f.url").alias("url"), "sha256", F.col("f.file_size").alias("file_size")).unionByName(
        first.select("announcement_id", "filename", "url", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("long").alias("file_size")).select(*columns)
    )


def outstanding(attachments: DataFrame) -> DataFrame:
    """Per announcement: attachments recorded, and those still without content."""
    return attachments.groupBy("announcement_id").agg(F.count(F.lit(1)).alias("n_attachments"), F.count_if(F.col("sha256").isNull()).alias("n_outstanding"))
