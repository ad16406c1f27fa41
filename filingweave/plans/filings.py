"""Queries of the operators for filings over the tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingweave.functions import answers, dates, numeric, urls
from filingweave.functions import text as tx
from filingweave.operators import audit, evaluate, evidence, growth, ingest, requests, validate, watchlist
from filingweave.session import cut, shared_folder
from filingweave.sources import listing
from filingweave.sources.folders import Folder
from filingweave.sources.store import Store
from filingweave.sources.tables import table
from filingweave.streaming import poll

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


R2 = "cast(format('{{:.2f}}', cast({0} as double)) as double) + 0.0"
WS_SQL = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_pct(c: str, p: str) -> str:
    return R2.format(f"(({c}) - ({p})) / nullif(abs({p}), 0) * 100")


def sql_tags(x: str) -> str:
    inner = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')"
    for a, b in (("&amp;", "&"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        inner = f"replace({inner}, '{a}', '{b}')"
    return f"trim(regexp_replace({inner}, '{WS_SQL}+', ' ', 'g'))"


# --- growth ---------------------------------------------------------------------------------------------------------

_SUPPLIER = """select l_suppkey as source, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 as period,
cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) as revenue from lineitem group by 1, 2"""


def _supplier_quarters(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    period = F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1
    return lines.groupBy(F.col("l_suppkey").alias("source"), period.alias("period")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("revenue"))


_GROWTH_SQL = f"""with q as ({_SUPPLIER})
select a.source, a.period, a.revenue, b.revenue as revenue_prev, y.revenue as revenue_ly, {sql_pct('a.revenue', 'b.revenue')} as revenue_qoq, {sql_pct('a.revenue', 'y.revenue')} as revenue_yoy
from q a left join q b on a.source = b.source and a.period = b.period + 1 left join q y on a.source = y.source and a.period = y.period + 4"""


@query(_GROWTH_SQL)
def growth_by_supplier_quarter(spark: SparkSession, d: str) -> DataFrame:
    return growth.growth(_supplier_quarters(spark, d), "source", "period", ["revenue"])


@query(_GROWTH_SQL)
def growth_self_join(spark: SparkSession, d: str) -> DataFrame:
    return growth.growth_by_joins(_supplier_quarters(spark, d), "source", "period", ["revenue"])


@query(f"with q as ({_SUPPLIER}) select source, period from q a where not exists (select 1 from q b where b.source = a.source and b.period = a.period - 1)")
def missing_predecessor(spark: SparkSession, d: str) -> DataFrame:
    rows = _supplier_quarters(spark, d).select("source", "period")
    return rows.join(rows.select("source", (F.col("period") + 1).alias("period")), ["source", "period"], "left_anti")


_LATEST = """select * from (select distinct id, lower(company_name) as source, fiscal_year * 4 + cast(substr(fiscal_quarter, 2, 1) as int) - 1 as period, uploaded_at, revenue_current, pbt_current,
row_number() over (partition by lower(company_name), fiscal_year, fiscal_quarter order by uploaded_at desc nulls last, id desc) as n
from (select distinct id, company_name, fiscal_year, fiscal_quarter, uploaded_at, revenue_current, pbt_current from pdf_metadata where analysis_error is null and company_name is not null and fiscal_quarter in ('Q1', 'Q2', 'Q3', 'Q4') and fiscal_year is not null)) where n = 1"""


def _latest_reports(spark: SparkSession, d: str) -> DataFrame:
    reports = table(spark, d, "pdf_metadata").where("analysis_error is null and company_name is not null")
    rows = reports.select(
        "id", F.lower("company_name").alias("source"), dates.period_index("fiscal_year", "fiscal_quarter").alias("period"), "uploaded_at", "revenue_current", "pbt_current"
    ).where("period is not null")
    return growth.latest(rows.distinct(), ["source", "period"], ["uploaded_at", "id"])


@query(f"select id, source, period, revenue_current, pbt_current from ({_LATEST})")
def latest_per_company_period(spark: SparkSession, d: str) -> DataFrame:
    return _latest_reports(spark, d).select("id", "source", "period", "revenue_current", "pbt_current")


_REPORT_GROWTH = f"""with l as ({_LATEST}) select a.id, {', '.join(f"{sql_pct(f'a.{v}', f'b.{v}')} as {v}_qoq, {sql_pct(f'a.{v}', f'y.{v}')} as {v}_yoy" for v in ('revenue_current', 'pbt_current'))}
from l a left join l b on a.source = b.source and a.period = b.period + 1 left join l y on a.source = y.source and a.period = y.period + 4"""


@query(_REPORT_GROWTH)
def growth_by_company_quarter(spark: SparkSession, d: str) -> DataFrame:
    grown = growth.growth(_latest_reports(spark, d), "source", "period", ["revenue_current", "pbt_current"])
    return grown.select("id", "revenue_current_qoq", "revenue_current_yoy", "pbt_current_qoq", "pbt_current_yoy")


_STORED = "(select id, any_value(revenue_qoq) as old_qoq, any_value(revenue_yoy) as old_yoy from pdf_metadata group by id)"


@query(f"select g.id, revenue_current_qoq as new_qoq, revenue_current_yoy as new_yoy from ({_REPORT_GROWTH}) g join {_STORED} s on g.id = s.id where revenue_current_qoq is distinct from old_qoq or revenue_current_yoy is distinct from old_yoy")
def refreshed_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Only rows whose stored revenue comparison differs from the recomputed one; `refreshed_ratios` has all four."""
    new = growth_by_company_quarter(spark, d)
    old = table(spark, d, "pdf_metadata").groupBy("id").agg(F.first("revenue_qoq").alias("old_qoq"), F.first("revenue_yoy").alias("old_yoy"))
    changed = ~F.col("revenue_current_qoq").eqNullSafe(F.col("old_qoq")) | ~F.col("revenue_current_yoy").eqNullSafe(F.col("old_yoy"))
    return new.join(old, "id").where(changed).select("id", F.col("revenue_current_qoq").alias("new_qoq"), F.col("revenue_current_yoy").alias("new_yoy"))


_RATIOS = {f"{v}_{p}": f"{v}_current_{p}" for v in ("revenue", "pbt") for p in ("qoq", "yoy")}


@query(f"""select g.id, {', '.join(f'{new} as {x}' for x, new in _RATIOS.items())} from ({_REPORT_GROWTH}) g join (select id, {', '.join(f'any_value({x}) as old_{x}' for x in _RATIOS)} from pdf_metadata group by id) s on g.id = s.id
where {' or '.join(f'{new} is distinct from old_{x}' for x, new in _RATIOS.items())}""")
def refreshed_ratios(spark: SparkSession, d: str) -> DataFrame:
    """The four recomputed ratios of the rows where any of them differs from the stored one."""
    new = growth_by_company_quarter(spark, d)
    old = table(spark, d, "pdf_metadata").groupBy("id").agg(*(F.first(x, ignorenulls=True).alias(f"old_{x}") for x in _RATIOS))
    changed = F.lit(False)
    for x, to in _RATIOS.items():
        changed = changed | ~F.col(to).eqNullSafe(F.col(f"old_{x}"))
    return new.join(old, "id").where(changed).select("id", *(F.col(to).alias(x) for x, to in _RATIOS.items()))


# --- text, dates, links ---------------------------------------------------------------------------------------------


@query(f"select id, {sql_tags('raw_json')} as shown from announcements")
def strip_tags_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "announcements").select("id", tx.strip_tags("raw_json").alias("shown"))


@query(r"select row_id, strftime(coalesce(try_strptime(announcement_date, '%d %b %Y'), try_strptime(announcement_date, '%d %B %Y'), try_strptime(announcement_date, '%d/%m/%Y'), try_strptime(announcement_date, '%Y-%m-%d'), try_strptime(announcement_date, '%d-%b-%Y')), '%Y-%m-%d') as day from announcements_objects")
def normalise_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "announcements_objects").select("row_id", dates.normalise_date("announcement_date").alias("day"))


@query("select count(*) as n, min(announced_at) as first_day, max(announced_at) as last_day from announcements where announced_at is null or announced_at >= '2024-06-01'")
def since_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "announcements").where(dates.since_filter(F.col("announced_at"), "2024-06-01"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("announced_at").alias("first_day"), F.max("announced_at").alias("last_day"))


@query(f"select id from announcements where regexp_matches(coalesce(title, '') || ' ' || coalesce(announcement_type, ''), '{tx.RESULTS}')")
def results_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "announcements").where(tx.looks_like_results("title", "announcement_type")).select("id")


@query(r"""with c as (select id, json_extract_string(try_cast(raw_json as json), '$[3]') as cell from announcements where raw_json like '[%')
select id, nullif(regexp_extract(cell, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1), '') as href, nullif(regexp_extract(cell, '(?i)[?&]ann(?:ouncement)?_id=(\d+)', 1), '') as bursa_id from c where cell is not null""")
def links_of_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = F.get(F.from_json("raw_json", "array<string>"), F.lit(3))
    rows = table(spark, d, "announcements").where("raw_json like '[%'").select("id", cells.alias("cell")).where("cell is not null")
    first = F.get(tx.links("cell"), F.lit(0))["href"]
    return rows.select("id", first.alias("href"), tx.announcement_id(first).alias("bursa_id"))


_HOSTED = "'https://www.' || case when id % 3 = 0 then 'Example.com:443' when id % 3 = 1 then 'example.com:8443' else 'example.org' end || url"


@query("""select case when id % 3 = 0 then 'https://www.example.com' when id % 3 = 1 then 'https://www.example.com:8443' else 'https://www.example.org' end as host, count(*) as n
from announcements where url like '/%' group by 1""")
def host_key_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "announcements").where("url like '/%'").select(urls.host_key(F.expr(_HOSTED)).alias("host"))
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with u as (select {_HOSTED} as url, min(id) as first from announcements where url like '/%' group by 1), h as (select *, case when starts_with(url, 'https://www.Example.com') then 'https://www.example.com' when starts_with(url, 'https://www.example.com') then 'https://www.example.com:8443' else 'https://www.example.org' end as host from u),
r as (select *, row_number() over (partition by host order by first, url) as at_host from h), k as (select * from r where at_host <= 8 order by first, url limit 20)
select url, host, at_host, row_number() over (order by first, url) as place, (at_host - 1) * 3.0 as earliest_s from k""")
def request_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "announcements").where("url like '/%'").select("id", F.expr(_HOSTED).alias("url"))
    done = requests.plan(rows, "url", "id", per_run=20, per_host=8, delay=3.0)
    return done.select("url", "host", F.col("at_host").cast("long").alias("at_host"), F.col("place").cast("long").alias("place"), "earliest_s")


@query("""select id, case when id % 7 = 0 then 'cut_off' when trim(coalesce(raw_json, '')) = '' then 'empty' when not json_valid(raw_json) then 'not_json' else 'ok' end as status from announcements""")
def answer_triage(spark: SparkSession, d: str) -> DataFrame:
    """Raw records in the place of a model's answers, every seventh cut off."""
    reason = F.when(F.col("id") % 7 == 0, "length").otherwise("stop")
    return table(spark, d, "announcements").select("id", answers.triage(reason, F.col("raw_json"))["status"].alias("status"))


@query("select id, coalesce(nullif(json_extract_string(try_cast(raw_json as json), '$.title'), ''), nullif(json_extract_string(try_cast(raw_json as json), '$.subject'), '')) as title, coalesce(nullif(json_extract_string(try_cast(raw_json as json), '$.company'), ''), nullif(json_extract_string(try_cast(raw_json as json), '$.issuer'), ''), nullif(json_extract_string(try_cast(raw_json as json), '$.entity'), '')) as company from announcements where raw_json like '{%}'")
def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    record = F.from_json("raw_json", "map<string,string>")
    get = lambda *names: F.coalesce(*(F.nullif(F.try_element_at(record, F.lit(n)), F.lit("")) for n in names))
    return table(spark, d, "announcements").where("raw_json like '{%}'").select("id", get("title", "subject").alias("title"), get("company", "issuer", "entity").alias("company"))


@query()
def parsed_listing(spark: SparkSession, d: str) -> DataFrame:
    """Raw records of either shape as announcements."""
    raw = table(spark, d, "announcements").where("raw_json is not null").select("id", F.concat(F.lit("["), "raw_json", F.lit("]")).alias("body"))
    return listing.parse(raw, "body", strict=False).withColumn("attachments", F.to_json("attachments"))


# --- watchlist ------------------------------------------------------------------------------------------------------


@query("select o.row_id, w.stock_code as matched, w.name from announcements_objects o left join watchlist w on trim(o.stock_code) = trim(w.stock_code) where trim(o.stock_code) <> ''")
def watchlist_code_match(spark: SparkSession, d: str) -> DataFrame:
    rows = watchlist.match_by_code(table(spark, d, "announcements_objects").select("row_id", "stock_code"), "stock_code", table(spark, d, "watchlist").select("stock_code", "name"), by="row_id")
    return rows.select("row_id", F.col("match.stock_code").alias("matched"), F.col("match.name").alias("name"))


_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"


def _sql_tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda w: length(w) > 1 and not regexp_full_match(w, '[0-9]+') and not list_contains({_STOP}, w)))"


@query(f"""with t as (select row_id, {_sql_tokens('company')} as w from announcements_objects where stock_code is null or trim(stock_code) in ('', '-')),
c as (select stock_code, unnest([name, short_name]) as n from watchlist), k as (select stock_code, {_sql_tokens('n')} as o from c),
m as (select t.row_id, k.stock_code, len(list_intersect(t.w, k.o)) as overlap from t join k on len(t.w) > 0 and len(k.o) > 0 and len(list_intersect(t.w, k.o)) = least(len(t.w), len(k.o))),
r as (select *, row_number() over (partition by row_id order by overlap desc, cast(regexp_extract(stock_code, '[0-9]+') as bigint)) as n from m)
select row_id, cast(regexp_extract(stock_code, '[0-9]+') as bigint) as company_id, overlap from r where n = 1""")
def watchlist_token_match(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "announcements_objects").where("stock_code is null or trim(stock_code) in ('', '-')")
    listed = table(spark, d, "watchlist").withColumn("company_id", F.regexp_extract("stock_code", "[0-9]+", 0).cast("long"))
    return watchlist.match_by_tokens(rows, "row_id", "company", listed, "company_id", ["name", "short_name"]).select("row_id", "company_id", F.col("overlap").cast("long").alias("overlap"))


@query("""with h as (select stock_code, min(struct_pack(name := name, short_name := short_name, is_active := is_active)) as v from companies group by 1), g as (select stock_code, min(struct_pack(name := name, short_name := short_name, is_active := is_active)) as v from watchlist group by 1)
select coalesce(g.stock_code, h.stock_code) as stock_code, case when h.v is null then 'insert' when g.v is null then 'dropped' when h.v is distinct from g.v then 'update' else 'same' end as change,
coalesce(g.v, h.v).name as name, coalesce(g.v, h.v).short_name as short_name, coalesce(g.v, h.v).is_active as is_active from h full join g on h.stock_code = g.stock_code""")
def reconcile_companies(spark: SparkSession, d: str) -> DataFrame:
    fields = ["name", "short_name", "is_active"]
    one = lambda name: table(spark, d, name).groupBy("stock_code").agg(F.min(F.struct(*fields)).alias("v")).select("stock_code", "v.*")
    return watchlist.reconcile(one("companies"), one("watchlist"), "stock_code", fields)


# --- intake ---------------------------------------------------------------------------------------------------------


@query("select dedup_key, count(*) as n from announcements where batch_no > 10 and dedup_key not in (select dedup_key from announcements where batch_no <= 10) group by 1")
def unseen_announcements(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "announcements")
    late = rows.where("batch_no > 10")
    new = ingest.unseen(late, rows.where("batch_no <= 10"), "dedup_key").select("dedup_key")
    return late.join(new, "dedup_key").groupBy("dedup_key").agg(F.count(F.lit(1)).alias("n"))


@query("select id, dedup_key from (select id, dedup_key, row_number() over (partition by dedup_key order by id) as n from announcements) where n = 1")
def first_of_dedup_key(spark: SparkSession, d: str) -> DataFrame:
    return watchlist.first_of(table(spark, d, "announcements").select("id", "dedup_key"), "dedup_key", ["id"])



def _sql_title(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '{WS_SQL}+', ' ', 'g'))"



@query(f"select row_id, case when coalesce(id, '') <> '' then 'bursa:' || id else 'sha256:' || sha256(trim(coalesce(stock_code, '')) || '|' || {_sql_title('company')} || '|' || coalesce(announcement_date, '') || '|' || {_sql_title('title')}) end as key from announcements_objects")
def dedup_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "announcements_objects").select("row_id", tx.dedup_key("id", "stock_code", "company", "announcement_date", "title").alias("key"))


@query("""with f as (select distinct sha256, file_size from (select sha256, file_size from pdf_metadata union all select sha256, file_size from pending_reviews)),
a as (select sha256, file_size, min(id) as id from pdf_metadata where sha256 <> '' group by all), p as (select sha256, file_size, min(id) as id from pending_reviews where sha256 <> '' group by all)
select f.sha256, f.file_size, case when a.id is not null then 'approved' when p.id is not null then 'pending' end as scope, coalesce(a.id, p.id) as held_id
from f left join a on f.sha256 = a.sha256 and f.file_size = a.file_size left join p on f.sha256 = p.sha256 and f.file_size = p.file_size""")
def already_ingested_scope(spark: SparkSession, d: str) -> DataFrame:
    approved, pending = table(spark, d, "pdf_metadata"), table(spark, d, "pending_reviews")
    files = approved.select("sha256", "file_size").unionByName(pending.select("sha256", "file_size")).distinct()
    return ingest.ingested_scope(files, approved, pending)


@query(f"select doc_id, case when length(trim(coalesce(text, ''))) < 400 or contains(coalesce(text, ''), '{tx.SELF_REPORT_MARKER}') then 'rejected' else 'verified' end as status from documents")
def verify_documents(spark: SparkSession, d: str) -> DataFrame:
    own = validate.self_report(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", ingest.verify_text(F.col("text"), own).alias("status"))


@query("""select a.id, a.title, a.announced_at, c.name, coalesce(n.n, 0) as n_same from announcements a left join (select id, min(name) as name from companies group by id) c on a.company_id = c.id
left join (select dedup_key, count(*) as n from announcements group by 1) n on a.dedup_key = n.dedup_key where a.status = 'discovered'""")
def discovery_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "announcements")
    names = table(spark, d, "companies").groupBy(F.col("id").alias("company_id")).agg(F.min("name").alias("name"))
    same = rows.groupBy("dedup_key").agg(F.count(F.lit(1)).alias("n_same"))
    queue = rows.where("status = 'discovered'").join(names, "company_id", "left").join(same, "dedup_key", "left")
    return queue.select("id", "title", "announced_at", "name", F.coalesce("n_same", F.lit(0)).alias("n_same"))


@query("""with f as (select row_id, unnest(attachments) as a from announcements_objects), s as (select row_id as announcement_id, a.url as url, min(a.filename) as filename from f group by 1, 2)
select announcement_id, count(*) as n_attachments, count(*) filter (where announcement_id % 3 <> 0) as n_outstanding from s group by 1""")
def outstanding_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Listed attachments, those of every third row downloaded: placeholders complete, none is doubled."""
    seen = table(spark, d, "announcements_objects").select(F.col("row_id").alias("announcement_id"), F.inline("attachments"))
    none = seen.select("announcement_id", "filename", "url", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("long").alias("file_size"))
    done = none.where("announcement_id % 3 = 0").withColumn("sha256", F.sha2("url", 256)).withColumn("file_size", F.length("url").cast("long"))
    return ingest.outstanding(ingest.merge_attachments(none, done))


@query(f"""with t as (select a.*, regexp_matches(coalesce(title, '') || ' ' || coalesce(announcement_type, ''), '{tx.RESULTS}') as is_results, company_id in (select id from companies where is_active) as is_listed, row_number() over (partition by dedup_key order by id) = 1 as is_new from announcements a)
select count(*) as parsed, count(*) filter (where is_results) as results_filings, count(*) filter (where is_results and is_listed) as watchlisted, count(*) filter (where is_results and is_listed and is_new) as new_announcements from t""")
def poll_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "announcements")
    active = table(spark, d, "companies").where("is_active").select(F.col("id").alias("company_id")).distinct().withColumn("is_listed", F.lit(True))
    firsts = rows.groupBy("dedup_key").agg(F.min("id").alias("first_id"))
    tagged = rows.withColumn("is_results", tx.looks_like_results("title", "announcement_type")).join(active, "company_id", "left").join(firsts, "dedup_key").withColumn("is_new", F.col("id") == F.col("first_id"))
    return poll.poll_summary(tagged, "is_results", "is_listed", "is_new")


@query("select count(distinct dedup_key) + max((dedup_key is null)::int) as n_rows, count(distinct dedup_key) as n_keys from announcements")
def stream_poll_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """The announcements through a run-once stream, twice: the second run finds nothing new."""
    folder = f"{shared_folder(spark).rstrip('/')}/poll-{uuid.uuid4().hex}"
    store = Store(spark, f"{folder}/store")
    source = table(spark, d, "announcements")
    for _ in range(2):
        stream = spark.readStream.schema(source.schema).parquet(f"{d}/announcements.parquet*")
        poll.run_once(stream.select("id", "dedup_key", "title", "announced_at"), store, "announcements", "dedup_key", f"{folder}/checkpoint")
    counted = cut(store.read("announcements").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("dedup_key").alias("n_keys")))
    Folder(spark, folder).remove()
    return counted


# --- figures and evidence -------------------------------------------------------------------------------------------

_SIX = ", ".join(audit.FIELDS)


def _reports(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat_ws("\n\n", F.coalesce("management_commentary", F.lit("")), F.coalesce("outlook_summary", F.lit("")))
    return table(spark, d, "pdf_metadata").withColumn("body", body).dropDuplicates(["id"])


@query(f"select distinct id, metric, value_printed from (unpivot (select distinct id, {_SIX} from pdf_metadata) on {_SIX} into name metric value value_printed)")
def evidence_unpivot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pdf_metadata").select("id", *audit.FIELDS).distinct()
    return rows.unpivot("id", list(audit.FIELDS), "metric", "value_printed").where("value_printed is not null").distinct()


_FIELD_LIST = "[" + ", ".join(f"'{f}'" for f in audit.FIELDS) + "]"


@query(f"select o.pdf_metadata_id, o.metric, e.match_method, e.page_number, e.char_start, coalesce(nullif(list_position({_FIELD_LIST}, o.metric), 0), 99) as place from metric_observations o join evidence e on e.metric_observation_id = o.id")
def evidence_trail(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "metric_observations").select(F.col("id").alias("metric_observation_id"), "pdf_metadata_id", "metric")
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, audit.FIELDS)), F.col("metric")), F.lit(0)), F.lit(99))
    return seen.join(table(spark, d, "evidence"), "metric_observation_id").select("pdf_metadata_id", "metric", "match_method", "page_number", "char_start", place.cast("int").alias("place"))


@query("""select o.pdf_metadata_id, count(*) filter (where match_method = 'llm_verified') as llm_verified, count(*) filter (where match_method = 'deterministic') as deterministic,
count(*) filter (where match_method = 'unverified') as unverified, count(*) filter (where match_method = 'prior_entry') as prior_entry from metric_observations o join evidence e on e.metric_observation_id = o.id group by 1""")
def evidence_methods(spark: SparkSession, d: str) -> DataFrame:
    trail = evidence_trail(spark, d)
    return trail.groupBy("pdf_metadata_id").pivot("match_method", list(evidence.METHODS)).count().na.fill(0)


@query(f"""with t as (select o.pdf_metadata_id as id, o.metric, min(list_position({_FIELD_LIST}, o.metric)) as place, bool_or(e.match_method = 'unverified') as lost from metric_observations o join evidence e on e.metric_observation_id = o.id where o.pdf_metadata_id is not null group by 1, 2)
select id, count(*) filter (where lost) || ' of ' || count(*) || ' figures could not be traced to a line in the document (' || string_agg(metric, ', ' order by place) filter (where lost) || ') — verify these against the original report before relying on them' as message from t group by id having count(*) filter (where lost) > 0""")
def untraced_summary(spark: SparkSession, d: str) -> DataFrame:
    each = evidence_trail(spark, d).where("pdf_metadata_id is not null").groupBy(F.col("pdf_metadata_id").alias("id"), "metric").agg(F.min("place").alias("place"), F.bool_or(F.col("match_method") == "unverified").alias("lost"))
    lost = F.transform(F.array_sort(F.collect_list(F.when(F.col("lost"), F.struct("place", "metric")))), lambda x: x["metric"])
    return each.groupBy("id").agg(validate.untraced(lost, F.count(F.lit(1))).alias("message")).where("message is not null")


_LOOSE_SQL = f"regexp_extract(t, '(?i)' || array_to_string(list_transform(list_filter(string_split_regex(q, '{WS_SQL}+'), lambda w: w <> ''), lambda w: regexp_escape(w)), '{WS_SQL}+'))"


@query(f"""with q as (select id, regexp_replace(title, '^{WS_SQL}+|{WS_SQL}+$', '', 'g') as q, raw_json as t from announcements where title is not null and raw_json is not null), f as (select id, t, case when strpos(t, q) > 0 then q else {_LOOSE_SQL} end as hit from q where length(q) >= 4 and t <> '')
select id, strpos(t, hit) - 1 as char_start, strpos(t, hit) - 1 + length(hit) as char_end from f where hit <> ''""")
def quote_location(spark: SparkSession, d: str) -> DataFrame:
    """Where the raw record holds the title: exactly, else apart from case and white space."""
    found = table(spark, d, "announcements").where("title is not null and raw_json is not null").select("id", evidence.locate_quote(F.col("title"), F.col("raw_json")).alias("at"))
    return found.where("at is not null").select("id", F.col("at.start").cast("long").alias("char_start"), F.col("at.end").cast("long").alias("char_end"))


def _values() -> F.Column:
    return F.array(*(F.col(f).cast("double") for f in audit.FIELDS))


_BODY_SQL = "coalesce(management_commentary, '') || chr(10) || chr(10) || coalesce(outlook_summary, '')"


def _sql_hit(p: str) -> str:
    """Whether a figure's printed forms hold one of the text's runs of digits, points and commas."""
    forms = lambda *kinds: " or ".join(f"list_contains(runs, format('{k}', {p}))" for k in kinds)
    whole, parts = forms("{:,.0f}", "{:.0f}"), forms("{:,.1f}", "{:,.2f}", "{:.1f}", "{:.2f}")
    return f"({p} >= {numeric.MIN_ANCHOR} and case when abs({p} - round_even({p}, 0)) < 0.005 then {whole} else {parts} end)"


def _sql_hits(shift: str, factor: str) -> str:
    return f"len(list_filter(vals, lambda v: {_sql_hit(f'abs(v * {shift} / {factor})')}))"


_SHIFTS_SQL = ("1.0::double", "1000.0::double", "0.001::double")


@query(f"""with r as (select distinct id, {_SIX}, {_BODY_SQL} as body from pdf_metadata),
x as (select id, regexp_extract_all(body, '[\\d,.]+') as runs, list_filter([{_SIX}], lambda v: v is not null) as vals from r)
select id, {', '.join(f"{_sql_hits(s, '1.0::double')} as {n}" for s, n in zip(_SHIFTS_SQL, ('as_is', 'by_1000', 'by_thousandth'), strict=True))} from x""")
def figure_anchors(spark: SparkSession, d: str) -> DataFrame:
    """How many of a report's figures stand in its own texts, as they are and rescaled."""
    hits = [audit.anchor_count(audit.present(_values()), F.lit(1.0), s, F.col("body")).alias(n) for s, n in zip(audit.SHIFTS, ("as_is", "by_1000", "by_thousandth"), strict=True)]
    return _reports(spark, d).select("id", *hits)


_SLIP = "case id % 3 when 1 then 1000.0 when 2 then 0.001 else 1.0 end"
_QUOTE = "''"
_FACTOR_SQL = f"case when regexp_matches(unit_raw, '{numeric.THOUSANDS.replace(chr(39), _QUOTE)}') then 0.001 when regexp_matches(unit_raw, '{numeric.BILLIONS}') then 1000.0 when regexp_matches(unit_raw, '{numeric.MILLIONS}') then 1.0 end"
_PLAIN_SQL = """case when unit_raw is null then 'None' when contains(unit_raw, chr(39)) and not contains(unit_raw, '"') then '"' || unit_raw || '"' else chr(39) || unit_raw || chr(39) end"""


@query(f"""with r as (select distinct id, unit_raw, {_SIX}, {_BODY_SQL} as body, cast({_FACTOR_SQL} as double) as f, cast({_SLIP} as double) as slip from pdf_metadata),
x as (select id, unit_raw, f, regexp_extract_all(body || ' ' || concat_ws(' ', {', '.join(f"'{v} ' || format('{{:,.1f}}', abs({v}))" for v in audit.FIELDS)}), '[\\d,.]+') as runs, list_transform(list_filter([{_SIX}], lambda v: v is not null), lambda v: v * coalesce(f, 1.0::double) * slip) as vals from r),
h as (select id, unit_raw, f, len(vals) as n, {', '.join(f"{_sql_hits(s, 'f')} as h{i}" for i, s in enumerate(_SHIFTS_SQL))} from x),
b as (select *, greatest(h0, h1, h2) as best, case when h0 >= greatest(h1, h2) then 1.0 when h1 >= h2 then 1000.0 else 0.001 end as shift from h),
w as (select *, shift <> 1.0 and best > h0 and best >= greatest(3, ceil(n * 2 / 3.0)) as wins from b),
v as (select *, case when n = 0 then 'no_figures' when f is null then 'unknown_unit' when wins then 'rescaled' when best = 0 then 'unanchored' else 'ok' end as verdict from w)
select id, verdict, cast(case when verdict = 'rescaled' then shift else 1.0 end as double) as shift, case when verdict not in ('no_figures', 'unknown_unit') then best end as hits, case when verdict not in ('no_figures', 'unknown_unit') then h0 end as hits_as_is,
case verdict when 'unknown_unit' then 'Unit label ' || {_PLAIN_SQL} || ' was not recognised — normalisation to millions could not be verified against the document'
when 'unanchored' then 'None of the extracted figures could be matched against the document text (unit as reported: ' || coalesce(unit_raw, 'None') || ') — the scale is unverified and should be checked manually'
when 'rescaled' then 'Unit scale corrected: figures were rescaled by ' || case when shift = 1000 then '1000' else '0.001' end || 'x to match the document (unit as reported: ' || unit_raw || '). ' || best || ' of ' || n || ' figures now match the printed source, against ' || h0 || ' before — please verify against the original report' end as message from v""")
def unit_scale_audit(spark: SparkSession, d: str) -> DataFrame:
    """Figures turned into millions by their label, two of three reports by a slip of a thousand up or down, checked against
    a text that prints them."""
    factor = F.coalesce(numeric.scale_factor("unit_raw"), F.lit(1.0))
    slip = F.expr(_SLIP).cast("double")
    printed = F.concat_ws(" ", *(F.concat(F.lit(f + " "), F.format_number(F.abs(f), 1)) for f in audit.FIELDS))
    values = F.transform(_values(), lambda v: v * factor * slip)
    checked = _reports(spark, d).select("id", "unit_raw", F.size(audit.present(_values())).alias("n"), audit.unit_audit(values, F.col("unit_raw"), F.concat_ws(" ", "body", printed)).alias("a"))
    return checked.select("id", "a.*", audit.scale_message(F.col("a"), F.col("unit_raw"), F.col("n")).alias("message"))


@query()
def traced_figures(spark: SparkSession, d: str) -> DataFrame:
    """Each figure, in millions by its label, traced in its report's texts: by a quote (the first passage with a number)
    where that holds it, by its own place under its caption, else unverified."""
    rows = _reports(spark, d).select("id", "unit_raw", "body", F.inline(F.array(*(F.struct(F.lit(f).alias("metric"), F.col(f).cast("double").alias("printed")) for f in audit.FIELDS)))).where("printed is not null")
    value = F.col("printed") * F.coalesce(numeric.scale_factor("unit_raw"), F.lit(1.0))
    quote = F.regexp_substr("body", F.lit(r"[^.\n]*\d[^\n]{0,80}"))
    got = evidence.trace_rows(rows.withColumn("quote", quote), value, F.col("unit_raw"), F.col("quote"), F.col("body"), F.col("metric"), F.lit(True), "t")
    return got.select("id", "metric", "t.*")


_NOW_SQL = f"unpivot (select id, {', '.join(f'min({f}) as {f}' for f in audit.FIELDS)} from pdf_metadata group by id) on {_SIX} into name metric value current"


@query(f"""with o as (select id, min_by(pdf_metadata_id, (observed_at, metric, value_millions)) as report_id, min_by(metric, (observed_at, metric, value_millions)) as metric, min_by(value_millions, (observed_at, metric, value_millions)) as recorded
from metric_observations where value_millions is not null group by id), n as ({_NOW_SQL})
select distinct e.id, 'recorded ' || format('{{:,.1f}}', o.recorded) || ', now ' || format('{{:,.1f}}', n.current) || ' — re-verify' as message from evidence e join o on o.id = e.metric_observation_id join n on n.id = o.report_id and n.metric = o.metric where abs(n.current - o.recorded) > 1e-9""")
def stale_traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces whose figure, as first observed, differs from the one now in the report."""
    first = F.min(F.struct("observed_at", "metric", "value_millions", "pdf_metadata_id"))
    seen = table(spark, d, "metric_observations").where("value_millions is not null").groupBy(F.col("id").alias("metric_observation_id")).agg(first.alias("o"))
    seen = seen.select("metric_observation_id", F.col("o.pdf_metadata_id").alias("id"), F.col("o.metric").alias("metric"), F.col("o.value_millions").alias("recorded"))
    now = table(spark, d, "pdf_metadata").groupBy("id").agg(*(F.min(f).alias(f) for f in audit.FIELDS)).unpivot("id", list(audit.FIELDS), "metric", "current")
    both = table(spark, d, "evidence").select(F.col("id").alias("trace"), "metric_observation_id").join(seen, "metric_observation_id").join(now, ["id", "metric"])
    said = F.concat(F.lit("recorded "), F.format_number("recorded", 1), F.lit(", now "), F.format_number("current", 1), F.lit(" — re-verify"))
    return both.where(F.abs(F.col("current") - F.col("recorded")) > 1e-9).select(F.col("trace").alias("id"), said.alias("message")).distinct()


# --- checks and evaluation ------------------------------------------------------------------------------------------

_V = "(select distinct id, fiscal_quarter, fiscal_year, quarter_end_date, currency, confidence_score, revenue_current, pbt_current from pdf_metadata)"


@query(f"""select id, list_filter([
case when fiscal_quarter not in ('Q1', 'Q2', 'Q3', 'Q4') then 'fiscal_quarter ''' || fiscal_quarter || ''' is not one of Q1/Q2/Q3/Q4' end,
case when fiscal_year not between 2000 and 2027 then 'fiscal_year ' || fiscal_year || ' is outside the expected range (2000–2027)' end,
case when not regexp_full_match(quarter_end_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then 'quarter_end_date ''' || quarter_end_date || ''' is not in YYYY-MM-DD format' when abs(cast(substr(quarter_end_date, 1, 4) as int) - fiscal_year) > 1 then 'quarter_end_date year (' || substr(quarter_end_date, 1, 4) || ') does not match fiscal_year (' || fiscal_year || ') — possible extraction error' end,
case when not regexp_full_match(currency, '[A-Z]{{3}}') then 'currency ''' || currency || ''' is not a valid ISO 4217 code (expected 3 uppercase letters, e.g. USD)' end,
case when revenue_current < 0 then 'revenue_current is negative (' || format('{{:.2f}}', revenue_current) || 'M) — revenue cannot be negative' end,
case when revenue_current > 0 and pbt_current > revenue_current then 'pbt_current (' || format('{{:.2f}}', pbt_current) || 'M) exceeds revenue_current (' || format('{{:.2f}}', revenue_current) || 'M) — unusual, though legitimate with one-off gains such as asset disposals or revaluations; confirm against the report' end,
case when confidence_score < 0.7 then 'Low confidence score (' || format('{{:.0f}}', confidence_score * 100) || '%) — results should be reviewed manually' end], lambda w: w is not null) as warnings from {_V}""")
def validation_warnings(spark: SparkSession, d: str) -> DataFrame:
    """The rules that need the current figures only; `report_warnings` applies all."""
    columns = ["fiscal_quarter", "fiscal_year", "quarter_end_date", "currency", "confidence_score", "revenue_current", "pbt_current"]
    rows = table(spark, d, "pdf_metadata").select("id", *columns).distinct()
    return rows.select("id", validate.warnings(2026, set(columns)).alias("warnings"))


_CHECKED = ("fiscal_quarter", "fiscal_year", "quarter_end_date", "currency", "confidence_score", "company_name", "title", "author", *audit.FIELDS)
_SQL_STOPWORDS = ", ".join(f"'{w}'" for w in sorted(tx.STOPWORDS))


def _sql_tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda w: length(w) > 1 and not regexp_full_match(w, '[0-9]+') and w not in ({_SQL_STOPWORDS}))"


def _sql_money(x: str) -> str:
    return f"format('{{:.2f}}', {x})"


_NEGATIVE_SQL = ",\n".join(f"case when {r} < 0 then '{r} is negative (' || {_sql_money(r)} || 'M) — revenue cannot be negative' end" for r, _ in validate.PAIRS)
_EXCEEDS_SQL = ",\n".join(
    f"case when {r} > 0 and {p} > {r} then '{p} (' || {_sql_money(p)} || 'M) exceeds {r} (' || {_sql_money(r)} || 'M) — unusual, though legitimate with one-off gains such as asset disposals or revaluations; confirm against the report' end"
    for r, p in validate.PAIRS
)


@query(f"""select id, list_filter([
case when fiscal_quarter not in ('Q1', 'Q2', 'Q3', 'Q4') then 'fiscal_quarter ''' || fiscal_quarter || ''' is not one of Q1/Q2/Q3/Q4' end,
case when fiscal_year not between 2000 and 2027 then 'fiscal_year ' || fiscal_year || ' is outside the expected range (2000–2027)' end,
case when not regexp_full_match(quarter_end_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then 'quarter_end_date ''' || quarter_end_date || ''' is not in YYYY-MM-DD format' when abs(cast(substr(quarter_end_date, 1, 4) as int) - fiscal_year) > 1 then 'quarter_end_date year (' || substr(quarter_end_date, 1, 4) || ') does not match fiscal_year (' || fiscal_year || ') — possible extraction error' end,
case when not regexp_full_match(currency, '[A-Z]{{3}}') then 'currency ''' || currency || ''' is not a valid ISO 4217 code (expected 3 uppercase letters, e.g. USD)' end,
{_NEGATIVE_SQL},
{_EXCEEDS_SQL},
case when confidence_score not between 0 and 1 then 'confidence_score ' || confidence_score || ' is outside the valid range [0, 1]' when confidence_score < 0.7 then 'Low confidence score (' || format('{{:.0f}}', confidence_score * 100) || '%) — results should be reviewed manually' end,
case when coalesce({', '.join(audit.FIELDS)}) is null then 'No financial values were extracted — the PDF may not contain machine-readable financial tables' end,
case when len({_sql_tokens('company_name')}) > 0 and len({_sql_tokens('meta')}) > 0 and not list_has_any({_sql_tokens('company_name')}, {_sql_tokens('meta')}) then 'Document metadata names a different entity than the report body (metadata: ''' || trim(meta) || ''', extracted: ''' || company_name || ''') — verify the file is the report it claims to be' end], lambda w: w is not null) as warnings
from (select distinct id, {', '.join(_CHECKED)}, coalesce(title, '') || ' ' || coalesce(author, '') as meta from pdf_metadata)""")
def report_warnings(spark: SparkSession, d: str) -> DataFrame:
    """All rules: six figures, three pairs of revenue and pbt, nothing extracted, and the entity of title and author."""
    rows = table(spark, d, "pdf_metadata").select("id", *_CHECKED).distinct()
    return rows.select("id", validate.warnings(2026, set(_CHECKED)).alias("warnings"))


@query("select distinct id, list_filter(cast(cast(validation_warnings as json) as varchar[]), lambda w: regexp_matches(w, '^(?:Unit scale corrected:|Unit label |None of the extracted figures|This document appears to be a review report)|^\\d+ of \\d+ figures could not be traced')) || ['rechecked'] as warnings from pdf_metadata where validation_warnings is not null")
def carried_warnings(spark: SparkSession, d: str) -> DataFrame:
    prior = F.from_json("validation_warnings", "array<string>")
    return table(spark, d, "pdf_metadata").where("validation_warnings is not null").select("id", validate.carried_forward(prior, F.array(F.lit("rechecked"))).alias("warnings")).distinct()


_EVAL = """with a as (select pdf_metadata_id as id, min(value_millions) as v, min(currency) as c, min(unit_raw) as u from metric_observations where metric = 'revenue_current' and pdf_metadata_id is not null group by 1),
e as (select id, min(revenue_current) as v, min(currency) as c, min(unit_raw) as u from pdf_metadata group by 1),
k as (select e.id, [case when a.v is null or e.v is null then a.v is null and e.v is null else abs(a.v - e.v) <= greatest(0.05, abs(e.v) * 0.02) end, {0} is not distinct from {1}, {2} is not distinct from {3}] as ok from e left join a on a.id = e.id)"""


def _sql_folded(x: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace({x}, '{WS_SQL}*\\([^)]*\\)', '', 'g')), '{WS_SQL}+', ' ', 'g'))"


@query(_EVAL.replace("{0}", _sql_folded("a.c")).replace("{1}", _sql_folded("e.c")).replace("{2}", _sql_folded("a.u")).replace("{3}", _sql_folded("e.u")) + " select id, 3 as n_checks, len(list_filter(ok, lambda x: not x)) as n_failed, len(list_filter(ok, lambda x: not x)) = 0 as passed from k")
def eval_field_diff(spark: SparkSession, d: str) -> DataFrame:
    """The old pipeline's observations against the reports, within tolerances."""
    seen = table(spark, d, "metric_observations").where("metric = 'revenue_current' and pdf_metadata_id is not null")
    actual = seen.groupBy(F.col("pdf_metadata_id").alias("id")).agg(F.min("value_millions").alias("value"), F.min("currency").alias("currency"), F.min("unit_raw").alias("unit_raw"))
    golden = table(spark, d, "pdf_metadata").groupBy("id").agg(F.min("revenue_current").alias("value"), F.min("currency").alias("currency"), F.min("unit_raw").alias("unit_raw"))
    checks = evaluate.field_checks(actual, golden, "id", ["value"], ["currency", "unit_raw"])
    done = evaluate.case_results(checks, "id")
    return done.select("id", F.col("n_checks").cast("int").alias("n_checks"), "n_failed", "passed")


@query("select subject_type, event, count(*) as n, count(distinct subject_id) as n_subjects, min(created_at) as first_at, max(created_at) as last_at from review_events group by 1, 2")
def review_event_trail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "review_events").groupBy("subject_type", "event").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("subject_id").alias("n_subjects"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")
    )


@query("""select distinct id, coalesce(fiscal_quarter || ' ' || fiscal_year, fiscal_quarter, cast(fiscal_year as varchar), 'Reporting period unknown') as period,
coalesce(format('{:,.1f}', revenue_current), '—') as revenue, coalesce(format('{:,.1f}', pbt_current), '—') as pbt, coalesce(case when revenue_qoq >= 0 then '+' else '' end || format('{:.1f}', revenue_qoq) || '%', '—') as revenue_qoq, coalesce(format('{:.0f}', confidence_score * 100) || '%', '—') as confidence from pdf_metadata""")
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """The figures of a report as they are shown."""
    period = F.coalesce(F.concat("fiscal_quarter", F.lit(" "), F.col("fiscal_year").cast("string")), "fiscal_quarter", F.col("fiscal_year").cast("string"), F.lit("Reporting period unknown"))
    confidence = F.coalesce(F.concat(F.format_number(F.col("confidence_score") * 100, 0), F.lit("%")), F.lit("—"))
    return table(spark, d, "pdf_metadata").select("id", period.alias("period"), numeric.fmt_money("revenue_current").alias("revenue"), numeric.fmt_money("pbt_current").alias("pbt"), numeric.fmt_pct("revenue_qoq").alias("revenue_qoq"), confidence.alias("confidence")).distinct()
