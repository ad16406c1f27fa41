"""Lists, names and totals over the tables: queries of small operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingweave.functions import dates, urls
from filingweave.functions import text as tx
from filingweave.operators import evaluate, ingest, validate, views
from filingweave.plans.filings import WS_SQL, sql_tags
from filingweave.sources.tables import table

QUERIES = {}
ORACLES = {}


def query(sql: str):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


@query("select doc_id, sha256(text) as sha256, strlen(text) as file_size from documents where text is not null")
def file_identities(spark: SparkSession, d: str) -> DataFrame:
    """Hash and size of every text as a file's bytes."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", ingest.file_identity(F.encode("text", "UTF-8")).alias("f"))
    return rows.select("doc_id", "f.sha256", "f.file_size")


@query("select id, strftime(discovered_at, '%Y-%m-%dT%H:%M:%SZ') as discovered from announcements")
def discovery_stamps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "announcements").select("id", dates.utc_stamp("discovered_at").alias("discovered"))


@query("select count(*) as n, min(announced_at) as first_day from announcements where announced_at is null or announced_at >= '2024-03-05'")
def since_boundary(spark: SparkSession, d: str) -> DataFrame:
    """A boundary given as listings print dates."""
    rows = table(spark, d, "announcements").where(dates.since_filter(F.col("announced_at"), dates.boundary("5 Mar 2024 | 09:00")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("announced_at").alias("first_day"))


@query("""select distinct id, filename, company_name, strftime(uploaded_at, '%Y-%m-%dT%H:%M:%SZ') as uploaded, len(cast(cast(validation_warnings as json) as varchar[])) as n_warnings from pdf_metadata""")
def approved_list(spark: SparkSession, d: str) -> DataFrame:
    """Reports on file, newest first, with their warnings as a list."""
    rows = table(spark, d, "pdf_metadata").select("id", "filename", "company_name", "uploaded_at", F.size(F.from_json("validation_warnings", "array<string>")).alias("n_warnings")).distinct()
    n = F.when(F.col("n_warnings") >= 0, F.col("n_warnings"))
    return views.newest_first(rows, "uploaded_at").select("id", "filename", "company_name", dates.utc_stamp("uploaded_at").alias("uploaded"), n.cast("long").alias("n_warnings"))


@query("""select id, filename, attempt_count, json_extract_string(extracted_data, '$.company_name') as company_name, json_extract_string(extracted_data, '$.fiscal_quarter') || ' ' || json_extract_string(extracted_data, '$.fiscal_year') as period,
strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') as created from pending_reviews""")
def pending_list(spark: SparkSession, d: str) -> DataFrame:
    """Reviews still open, newest first, with what was extracted."""
    held = F.from_json("extracted_data", "company_name string, fiscal_quarter string, fiscal_year string")
    rows = views.newest_first(table(spark, d, "pending_reviews"), "created_at").withColumn("e", held)
    period = F.concat("e.fiscal_quarter", F.lit(" "), "e.fiscal_year")
    return rows.select("id", "filename", "attempt_count", "e.company_name", period.alias("period"), dates.utc_stamp("created_at").alias("created"))


@query("""with f as (select row_id, unnest(attachments) as a from announcements_objects), b as (select row_id, a.url as url, regexp_replace(trim(regexp_extract(split_part(coalesce(a.filename, ''), '?', 1), '[^/]*$')), '[^A-Za-z0-9._-]+', '_', 'g') as base, a.filename as filename from f)
select distinct row_id, url, left(case when ends_with(lower(base), '.pdf') then base else coalesce(nullif(base, ''), 'attachment') || '.pdf' end, 120) as saved_as, coalesce(contains(filename, '.') and lower(regexp_extract(filename, '[^.]*$')) = 'pdf', false) as is_pdf from b""")
def saved_names(spark: SparkSession, d: str) -> DataFrame:
    """Attachments under the names they are saved by, and whether their ending says PDF."""
    files = table(spark, d, "announcements_objects").select("row_id", F.inline("attachments"))
    return files.select("row_id", "url", tx.safe_filename("filename").alias("saved_as"), F.coalesce(tx.is_pdf_name("filename"), F.lit(False)).alias("is_pdf")).distinct()


@query(r"""with c as (select id, json_extract_string(try_cast(raw_json as json), '$[2]') as company, json_extract_string(try_cast(raw_json as json), '$[3]') as title from announcements where raw_json like '[%')
select id, coalesce(nullif(regexp_extract(company, '(?i)stock_code=([A-Za-z0-9]+)', 1), ''), nullif(regexp_extract(title, '(?i)stock_code=([A-Za-z0-9]+)', 1), ''), nullif(regexp_extract(""" + sql_tags("company") + r""", '\(([0-9]{4,5}[A-Za-z]{0,2})\)', 1), ''), nullif(regexp_extract(""" + sql_tags("title") + r""", '\(([0-9]{4,5}[A-Za-z]{0,2})\)', 1), '')) as stock_code from c where company is not null""")  # fmt: skip
def stock_codes_of_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = F.from_json("raw_json", "array<string>")
    rows = table(spark, d, "announcements").where("raw_json like '[%'").select("id", F.get(cells, F.lit(2)).alias("company"), F.get(cells, F.lit(3)).alias("title")).where("company is not null")
    return rows.select("id", tx.stock_code(F.lit(None).cast("string"), "company", "title").alias("stock_code"))


@query(r"select id, trim(lower(regexp_replace(title, '[-+]?\d[\d,]*\.?\d*', '#', 'g'))) as masked, replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped from announcements")
def titles_masked_and_escaped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "announcements").select("id", tx.masked_numbers("title").alias("masked"), tx.escape_xml("title").alias("escaped"))


_ROBOTS = "User-agent: *\nDisallow: /market_information/*ann_id=*7$\n\nUser-agent: poller\nDisallow: /misc/\n"


@query("""select id, case when url like '/%' then 'https://www.example.com' || url when url is null then null else url end as resolved, coalesce(not (regexp_matches(url, '^/market_information/.*ann_id=.*7$') or starts_with(url, '/misc/')), true) as allowed
from announcements where url is null or url like '/%' or url like 'http%'""")
def crawl_rules(spark: SparkSession, d: str) -> DataFrame:
    """Urls resolved against the listing's host, and whether its rules for all agents and for ours allow them."""
    rules = urls.disallowed(_ROBOTS, "poller/1.0")
    rows = table(spark, d, "announcements").where("url is null or url like '/%' or url like 'http%'")
    return rows.select("id", urls.resolve("https://www.example.com")(F.col("url")).alias("resolved"), F.coalesce(urls.allowed(F.col("url"), rules), F.lit(True)).alias("allowed"))


_RUN = """with a as (select pdf_metadata_id as id, min(value_millions) as v, min(currency) as c from metric_observations where metric = 'pbt_current' and pdf_metadata_id is not null group by 1),
e as (select id, min(pbt_current) as v, min(currency) as c from pdf_metadata group by 1),
k as (select [case when a.v is null or e.v is null then a.v is null and e.v is null else abs(a.v - e.v) <= greatest(0.05, abs(e.v) * 0.02) end] as ok from e left join a on a.id = e.id)
select count(*) as total, count(*) filter (where ok[1]) as passed, count(*) filter (where not ok[1]) as failed from k"""


@query(_RUN)
def eval_run_totals(spark: SparkSession, d: str) -> DataFrame:
    """One row for a run: its cases, those passed and failed; the currency counts as information only."""
    seen = table(spark, d, "metric_observations").where("metric = 'pbt_current' and pdf_metadata_id is not null")
    actual = seen.groupBy(F.col("pdf_metadata_id").alias("id")).agg(F.min("value_millions").alias("value"), F.min("currency").alias("currency"))
    golden = table(spark, d, "pdf_metadata").groupBy("id").agg(F.min("pbt_current").alias("value"), F.min("currency").alias("currency"))
    checks = evaluate.field_checks(actual, golden, "id", ["value"], ["currency"])
    return evaluate.run_totals(evaluate.case_results(checks, "id", ["currency"]))


_TYPES = ["fiscal_quarter", "fiscal_year", "revenue_current", "confidence_score"]


@query("""with r as (select id, try_cast(extracted_data as json) as e from pending_reviews)
select id, list_filter([case when json_type(e, '$.company_name') not in ('VARCHAR', 'NULL') then 'company_name' end, case when json_type(e, '$.fiscal_quarter') not in ('VARCHAR', 'NULL') then 'fiscal_quarter' end,
case when json_type(e, '$.fiscal_year') not in ('BIGINT', 'UBIGINT', 'DOUBLE', 'NULL') then 'fiscal_year' end, case when json_type(e, '$.unit_raw') not in ('VARCHAR', 'NULL') then 'unit_raw' end], lambda x: x is not null) as wrong from r""")
def type_errors(spark: SparkSession, d: str) -> DataFrame:
    """The extracted fields whose JSON value is of another type than the field's."""
    kinds = {"company_name": "string", "fiscal_quarter": "string", "fiscal_year": "number", "unit_raw": "string"}
    return table(spark, d, "pending_reviews").select("id", validate.type_errors("extracted_data", kinds).alias("wrong"))


@query(f"select id, sha256(url) as whole, substr(sha256(url), 1, 12) as part, trim(regexp_replace(lower(regexp_replace(coalesce(title, ''), '{WS_SQL}*\\([^)]*\\)', '', 'g')), '{WS_SQL}+', ' ', 'g')) as folded from announcements where url is not null")
def cached_responses(spark: SparkSession, d: str) -> DataFrame:
    """The hash part of a response's cache name, and titles without asides."""
    rows = table(spark, d, "announcements").where("url is not null")
    part = F.regexp_extract(urls.cache_name("url"), "^[^_]*_([0-9a-f]{12})_", 1)
    return rows.select("id", F.sha2("url", 256).alias("whole"), part.alias("part"), tx.folded(F.coalesce("title", F.lit(""))).alias("folded"))
