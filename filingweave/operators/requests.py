"""Which requests a run may make: budgets per run and per host, as a plan over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingweave.functions.urls import host_key

PER_RUN = 30
HOSTS = 40
MIN_DELAY = 2.0
MAX_DELAY = 60.0


def plan(urls: DataFrame, url: str, order: str, per_run: int = PER_RUN, per_host: int | None = None, hosts: int = HOSTS, delay: float = MIN_DELAY) -> DataFrame:
    """The requests of one run in order: url, host, at_host (from 1), place (from 1), earliest second after the start.

    Only http(s) urls count, each once; the first `hosts` hosts, `per_host` requests of each and `per_run` in all. The
    delay of a host is kept within its limits. The numbering window runs over the requests left after the budget per
    host, at most hosts x per_host rows.
    """
    share = per_run if per_host is None else per_host
    wait = min(max(delay, MIN_DELAY), MAX_DELAY)
    once = urls.groupBy(F.col(url).alias("url")).agg(F.min(order).alias("first")).withColumn("host", host_key("url")).where("host <> ''")
    ranked = once.withColumn("at_host", F.row_number().over(Window.partitionBy("host").orderBy("first", "url"))).where(F.col("at_host") <= share)
    early = once.groupBy("host").agg(F.min("first").alias("seen")).orderBy("seen", "host").limit(hosts).select("host")
    kept = ranked.join(early, "host", "left_semi")
    numbered = kept.orderBy("first", "url").limit(per_run).withColumn("place", F.row_number().over(Window.orderBy("first", "url")))
    return numbered.select("url", "host", "at_host", "place", ((F.col("at_host") - 1) * wait).alias("earliest_s"))
