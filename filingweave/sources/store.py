"""Versioned tables in a folder, committed all or nothing.

`<folder>/<table>/v=<n>` holds Parquet snapshots and deltas; the latest commit names, for every table, the versions that make
it up. A transaction writes new versions first and then commits, only if no other commit came between; a lost job leaves
versions no commit names. The folder may be on any file system that Spark reaches from all executors.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from filingweave.sources.folders import CommitConflict, Commits, Folder

__all__ = ["CommitConflict", "Store"]

MOST_VERSIONS = 16


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, Folder(spark, folder)
        self._commits = Commits(self.folder, {"tables": {}, "marks": {}})

    def manifest(self) -> dict:
        return self._commits.current()

    def _paths(self, table: str, versions: list[int]) -> list[str]:
        return [f"{self.folder.path}/{table}/v={n}" for n in versions]

    def read(self, table: str) -> DataFrame | None:
        """The table as of the last commit, or None where it was never written. Columns that came later are null in
        earlier versions."""
        versions = self.manifest()["tables"].get(table)
        if not versions:
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(*self._paths(table, versions))

    def commit(self, replaced: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None, marks: dict[str, int] | None = None, expected: int | None = None) -> int:
        """Write new versions of tables (whole, or as a delta) and name them in one commit; returns its number."""
        base = self.manifest()["commit"] if expected is None else expected
        new = {}
        for kind, tables in (("whole", replaced or {}), ("delta", appended or {})):
            for table, rows in tables.items():
                n = time.time_ns()
                rows.write.parquet(*self._paths(table, [n]))
                new[table] = (kind, n)
        state = self.manifest()
        if state["commit"] != base:
            raise CommitConflict(f"commit {state['commit']} came after {base}")
        for table, (kind, n) in new.items():
            state["tables"][table] = [n] if kind == "whole" else [*state["tables"].get(table, []), n]
        state["marks"].update(marks or {})
        return self._commits.put(state, base)["commit"]

    def compact(self, table: str, most: int = MOST_VERSIONS) -> bool:
        """Where a table is made up of more than `most` versions, write it as one. The old ones go with `vacuum`."""
        state = self.manifest()
        if len(state["tables"].get(table, [])) <= most:
            return False
        self.commit(replaced={table: self.read(table)}, expected=state["commit"])
        return True

    def vacuum(self) -> int:
        """Remove the versions that no commit names; to be called while no reader or writer is under way."""
        removed = 0
        for table, versions in self.manifest()["tables"].items():
            under = Folder(self.spark, f"{self.folder.path}/{table}")
            for name in under.names():
                if name.startswith("v=") and int(name[2:]) not in versions:
                    under.remove(name)
                    removed += 1
        return removed
