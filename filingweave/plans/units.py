"""Queries of problem 1 over pdf_metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filingweave.operators import units
from filingweave.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Figures whose unit is stated, in whole units."""
    done = units.convert(table(spark, d, "pdf_metadata"))
    return done.where("basis <> 'history' and amount is not null").select("id", "field_name", "amount").distinct()


def p1_converted(spark: SparkSession, d: str) -> DataFrame:
    return units.convert(table(spark, d, "pdf_metadata"))


def p1_unit_changes(spark: SparkSession, d: str) -> DataFrame:
    return units.unit_changes(table(spark, d, "pdf_metadata"))


_FOUND = r"""
with r as (select distinct id, unit_raw, title, management_commentary as a, outlook_summary as b, revenue_current, pbt_current from pdf_metadata),
s as (select *, regexp_matches(unit_raw, '(?i)^revenue:? .*[/;] PBT:? ') as two, regexp_matches(unit_raw, '(?i)\(profit before tax in ') as inner_two,
  coalesce(nullif(regexp_extract(title, '\(in ([^()]*)\)', 1), ''), nullif(regexp_extract(coalesce(a, '') || chr(10) || coalesce(b, ''), '(?i)(?:\(expressed in |figures in this report are presented in |tables are prepared in |amounts are stated in |unit of presentation: |amounts shown are )([^.)\n]*)', 1), '')) as told from r),
f as (
  select id, 'revenue_current' as field_name, revenue_current as figure, case when two then regexp_extract(unit_raw, '(?i)^revenue:? (.*?) ?[/;] PBT', 1) when inner_two then regexp_extract(unit_raw, '(?i)^(.*?) ?\(profit before tax in', 1) else unit_raw end as label, told from s
  union all
  select id, 'pbt_current', pbt_current, case when two then regexp_extract(unit_raw, '(?i) PBT:? (.*)$', 1) when inner_two then regexp_extract(unit_raw, '(?i)\(profit before tax in (.*)\)', 1) else unit_raw end, told from s),
l as (select id, field_name, figure, 0 as place, label as u from f where figure is not null union all select id, field_name, figure, 1, told from f where figure is not null),
n as (select * exclude (u), replace(regexp_replace(lower(coalesce(u, '')), '[’‘`]', '''', 'g'), 'ooo', '000') as u from l),
p as (select *, case
  when regexp_matches(u, '\b(whole|full|penuh)\b') then 0
  when regexp_matches(u, '10,000|ten thousand|\bwan\b') then 4
  when regexp_matches(u, '100 million|hundreds? of millions?|\boku\b') then 8
  when regexp_matches(u, '十億') then 9 when regexp_matches(u, '百万') then 6 when regexp_matches(u, '億') then 8 when regexp_matches(u, '万') then 4 when regexp_matches(u, '千') then 3
  when regexp_matches(u, '\btril(l)?i[ou]ns?\b') then 12
  when regexp_matches(u, '\b(billions?|bil|bn|miliar)\b') then 9
  when regexp_matches(u, '\b(cr|crores?)\b') then 7
  when regexp_matches(u, '\bmill?ions?\b|\b(mil|mn|mm|juta|jutaan|msek)\b|\b(rm|usd|sek) ?m\b') then 6
  when regexp_matches(u, '\b(lakhs?|lacs?)\b') then 5
  when regexp_matches(u, 'thou?sands?\b|000|\bribu|\b(rm|us\$)k\b|\$k\b') then 3
  when regexp_matches(u, '\bsen\b') then -2
  when regexp_matches(u, '\b(rm|myr|ringgit|usd|dollars?)\b|\$') then 0 end as power from n),
q as (select id, field_name, figure, coalesce(min(power) filter (where place = 0), min(power) filter (where place = 1)) as power from p group by id, field_name, figure)
select distinct id, field_name, cast(round_even(figure * power(10.0, power), 0) as bigint) as amount from q where power is not null
"""

QUERIES = {"p1_found": p1_found, "p1_converted": p1_converted, "p1_unit_changes": p1_unit_changes}
ORACLES = {"p1_found": _FOUND}
