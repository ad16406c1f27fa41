"""What lists show: their order, which rows can be taken on, and which columns stay inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that name places on disk.
PRIVATE = ("local_path", "report_path")


def newest_first(rows: DataFrame, at: str, key: str = "id") -> DataFrame:
    """Rows by time, latest first, rows without one last, then by the highest key."""
    return rows.orderBy(F.col(at).desc_nulls_last(), F.col(key).desc_nulls_last())


def available(status: Column, extracted: Column, on_disk: Column) -> Column:
    """Whether a discovered file can be extracted: verified, not extracted before, and there."""
    return F.coalesce((status == "verified") & ~extracted & on_disk, F.lit(False))


def public(rows: DataFrame) -> DataFrame:
    """Rows without the columns that name places on disk."""
    return rows.drop(*PRIVATE)


def discovered(attachments: DataFrame, announcements: DataFrame, companies: DataFrame, pending: DataFrame, files: DataFrame) -> DataFrame:
    """The discovery queue: attachments with their announcement and company (null where it isn't on file), the reviews
    open for them, and whether they can be extracted; newest first.

    attachments: id, announcement_id, filename, url, local_path, verification_status; announcements: id, company_id, title,
    announced_at, status; companies: id, name; pending: source_attachment_id; files: path (those on disk). Attachments of
    no announcement are left out; nulls match nothing.
    """
    told = announcements.select(F.col("id").alias("announcement_id"), "company_id", "title", "announced_at", "status")
    named = companies.groupBy(F.col("id").alias("company_id")).agg(F.min("name").alias("company_name"))
    open_for = pending.where("source_attachment_id is not null").groupBy(F.col("source_attachment_id").alias("id")).agg(F.count(F.lit(1)).alias("n_pending"))
    there = files.select(F.col("path").alias("local_path")).where("path is not null").distinct().withColumn("there", F.lit(True))
    rows = attachments.join(told, "announcement_id").join(named, "company_id", "left").join(open_for, "id", "left").join(there, "local_path", "left")
    n_pending = F.coalesce("n_pending", F.lit(0))
    taken = (F.coalesce("status", F.lit("")) != "discovered") | (n_pending > 0)
    can = available(F.col("verification_status"), taken, F.coalesce("there", F.lit(False)))
    shown = rows.select("id", "announcement_id", "title", "announced_at", "company_name", "filename", "url", "verification_status", "local_path", n_pending.alias("n_pending"), can.alias("available"))
    return public(newest_first(shown, "announced_at"))
