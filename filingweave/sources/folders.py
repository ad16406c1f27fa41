"""Small files in a folder of any file system Spark can reach: written whole, read, listed, removed."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

STALE_SECONDS = 120


class CommitConflict(RuntimeError):
    """Another transaction was committed since this one began."""


class Folder:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(""))

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("")))

    def read(self, name: str) -> str | None:
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The file appears whole or not at all."""
        draft = self._at(f".{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(draft, self._at(name)):
            self._fs.delete(draft, False)
            raise CommitConflict(f"{name} is there already")

    def claim(self, name: str) -> bool:
        """Make an empty file; False where another has made it."""
        return self._fs.createNewFile(self._at(name))

    def age(self, name: str) -> float:
        """Seconds since the file was written, 0 where it is gone."""
        try:
            return max(0.0, time.time() - self._fs.getFileStatus(self._at(name)).getModificationTime() / 1000)
        except Exception:
            return 0.0

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)


class Commits:
    """A state (JSON) with numbered versions in a folder: `commit-<n>.json`, the latest holds.

    A version is claimed by its number before it is written, so of two that began at one state only one is committed; a
    claim whose owner was lost is void after STALE_SECONDS.
    """

    def __init__(self, folder: Folder, empty: dict) -> None:
        self.folder, self.empty = folder, empty

    def _versions(self) -> list[int]:
        return sorted(int(n[7:-5]) for n in self.folder.names() if n.startswith("commit-") and n.endswith(".json"))

    def current(self) -> dict:
        versions = self._versions()
        while versions:
            text = self.folder.read(f"commit-{versions[-1]:09d}.json")
            if text is not None:
                return json.loads(text)
            versions.pop()
        return {"commit": 0, **json.loads(json.dumps(self.empty))}

    def put(self, state: dict, base: int) -> dict:
        """Commit `state` as the version after `base`; CommitConflict where another came between."""
        number = base + 1
        claim = f"commit-{number:09d}.claim"
        if self.current()["commit"] != base:
            raise CommitConflict(f"another commit came after {base}")
        if not self.folder.claim(claim):
            if self.folder.age(claim) < STALE_SECONDS:
                raise CommitConflict(f"another commit after {base} is under way")
            self.folder.remove(claim)
            if not self.folder.claim(claim):
                raise CommitConflict(f"another commit after {base} is under way")
        state = {**state, "commit": number}
        try:
            if self.current()["commit"] != base:
                raise CommitConflict(f"another commit came after {base}")
            self.folder.write(f"commit-{number:09d}.json", json.dumps(state))
        finally:
            self.folder.remove(claim)
        for old in self._versions():
            if old < number - 1:  # the last but one stays for readers under way
                self.folder.remove(f"commit-{old:09d}.json")
        return state
