"""Incremental polling: a run-once stream of listing rows into a store, idempotent by dedup key and by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingweave.operators.ingest import firsts, unseen
from filingweave.sources.store import Store


def poll_summary(parsed: DataFrame, is_results: str, is_listed: str, is_new: str) -> DataFrame:
    """One row of counters of a tagged batch."""
    hit = lambda *flags: F.count_if(F.expr(" and ".join(f"coalesce({f}, false)" for f in flags)))
    return parsed.agg(
        F.count(F.lit(1)).alias("parsed"), hit(is_results).alias("results_filings"), hit(is_results, is_listed).alias("watchlisted"), hit(is_results, is_listed, is_new).alias("new_announcements")
    )


def accept_batch(store: Store, table: str, key: str, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows, order: str = "id") -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: appends the rows whose key isn't held, of each key the first by `order`. A batch
    replayed after a crash is a no-op, because its number is committed together with its rows; small deltas are merged."""

    def accept(batch: DataFrame, number: int) -> None:
        state = store.manifest()
        if number <= state["marks"].get(table, -1):
            return
        rows = prepare(batch)
        held = store.read(table)
        fresh = firsts(rows, key, order) if held is None else unseen(rows, held, key, order)
        store.commit(appended={table: fresh}, marks={table: number}, expected=state["commit"])
        store.compact(table)

    return accept


def run_once(stream: DataFrame, store: Store, table: str, key: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows, order: str = "id") -> None:
    """Process what has arrived since the last run, then stop."""
    query = stream.writeStream.foreachBatch(accept_batch(store, table, key, prepare, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
