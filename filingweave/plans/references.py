"""Queries of problem 3 over the filing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingweave.operators.references import Reference, orphans, report
from filingweave.sources.tables import table


def filing_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Unresolved references of evidence, announcements and review_events, one row per row and time.

    A pending review that was approved or discarded at any time was deleted properly; its id then counts as a
    target known since ever (time null).
    """
    evidence = orphans(
        table(spark, d, "evidence"),
        table(spark, d, "metric_observations"),
        Reference("evidence", "id", ["metric_observation_id"], ["id"], "created_at", "observed_at"),
    )
    filings = orphans(
        table(spark, d, "announcements"),
        table(spark, d, "companies"),
        Reference("announcements", "id", ["company_id"], ["id"], "discovered_at", "added_at"),
    )
    events = table(spark, d, "review_events")
    closed = events.where("subject_type = 'pending' and event in ('approved', 'discarded')").select(
        F.lit("pending").alias("kind"), F.col("subject_id").alias("id"), F.lit("1970-01-01").cast("timestamp").alias("since")
    )
    subjects = (
        table(spark, d, "pending_reviews")
        .select(F.lit("pending").alias("kind"), "id", F.col("created_at").alias("since"))
        .unionByName(table(spark, d, "pdf_metadata").select(F.lit("approved").alias("kind"), "id", F.col("uploaded_at").alias("since")))
        .unionByName(closed)
    )
    reviews = orphans(
        events,
        subjects,
        Reference("review_events", "id", ["subject_type", "subject_id"], ["kind", "id"], "created_at", "since"),
    )
    return evidence.unionByName(filings).unionByName(reviews)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return filing_orphans(spark, d).select("table_name", "row_id", F.date_format("row_time", "yyyy-MM").alias("period")).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return report(filing_orphans(spark, d))


_FOUND = """
with closed as (select distinct subject_id from review_events where subject_type = 'pending' and event in ('approved', 'discarded')),
obs as (select id, min(observed_at) t from metric_observations group by id),
com as (select id, min(added_at) t from companies group by id),
pen as (select id, min(created_at) t from pending_reviews group by id),
pdf as (select id, min(uploaded_at) t from pdf_metadata group by id),
found as (
select 'evidence' as table_name, e.id as row_id, e.created_at as row_time, case when o.id is null then 'missing' else 'later' end as reason
from evidence e left join obs o on e.metric_observation_id = o.id
where e.metric_observation_id is not null and (o.id is null or o.t > e.created_at)
union
select 'announcements', a.id, a.discovered_at, case when c.id is null then 'missing' else 'later' end
from announcements a left join com c on a.company_id = c.id
where a.company_id is not null and (c.id is null or c.t > a.discovered_at)
union
select 'review_events', r.id, r.created_at, case when p.id is null then 'missing' else 'later' end
from review_events r left join pen p on r.subject_id = p.id
where r.subject_type = 'pending' and r.subject_id is not null and r.subject_id not in (select subject_id from closed where subject_id is not null) and (p.id is null or p.t > r.created_at)
union
select 'review_events', r.id, r.created_at, case when p.id is null then 'missing' else 'later' end
from review_events r left join pdf p on r.subject_id = p.id
where r.subject_type = 'approved' and r.subject_id is not null and (p.id is null or p.t > r.created_at)
)
"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
ORACLES = {
    "p3_found": _FOUND + "select distinct table_name, row_id, strftime(row_time at time zone 'UTC', '%Y-%m') as period from found",
    "p3_report": _FOUND
    + "select table_name, strftime(row_time at time zone 'UTC', '%Y-%m') as period, reason, count(distinct row_id) as n_orphans from found group by 1, 2, 3",
}
