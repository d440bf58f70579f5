"""A table of committed parts: batches that count once, whatever fails and however often they are done again.

A batch is written to a folder of its own and takes effect when the next
numbered manifest is made, a small file that names the folders of the table and
the last batch of each job. Making a file that must not exist yet is the only
step that has to be atomic: of two writers one succeeds, the other reads again
and tries once more. A batch killed before that left a folder that no manifest
names; one killed after it is known as done when it comes again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class AlreadyRunning(RuntimeError):
    """Another run of the job holds its guard."""


class Ledger:
    """The committed parts of one or more tables (by name) below a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("manifests"))

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _make(self, name: str, text: str) -> bool:
        """Make a file with this text; False if it is there already."""
        try:
            out = self._fs.create(self._at(name), False)
        except Py4JJavaError as error:
            if self._fs.exists(self._at(name)):
                return False
            raise error
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _text(self, name: str) -> str:
        source = self._fs.open(self._at(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(self._at("manifests")) if s.getPath().getName()[:-5].isdigit() and s.getLen() > 0)

    def state(self) -> tuple[int, dict]:
        """The latest version and its manifest: done (job -> last batch), tables (name -> folders), facts (name -> value)."""
        known = self.versions()
        return (known[-1], json.loads(self._text(f"manifests/{known[-1]:010d}.json"))) if known else (-1, {"done": {}, "tables": {}, "facts": {}})

    def is_done(self, job: str, batch: int) -> bool:
        return self.state()[1]["done"].get(job, -1) >= batch

    def commit(self, job: str, batch: int, add: dict[str, str] | None = None, replace: dict[str, str] | None = None, facts: dict | None = None) -> bool:
        """Let folders (table -> folder) count from now on, added to the table or in place of it; False if the batch counts already."""
        while True:
            version, now = self.state()
            if now["done"].get(job, -1) >= batch:
                return False
            for table, folder in (add or {}).items():
                now["tables"].setdefault(table, []).append(folder)
            for table, folder in (replace or {}).items():
                now["tables"][table] = [folder]
            now["facts"] |= facts or {}
            now["done"][job] = batch
            if self._make(f"manifests/{version + 1:010d}.json", json.dumps(now)):
                return True

    def write(self, df: DataFrame) -> str:
        """The rows as a new folder, which does not count yet."""
        folder = f"parts/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def read(self, table: str, schema: str) -> DataFrame:
        folders = self.state()[1]["tables"].get(table, [])
        reader = self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def append(self, df: DataFrame, job: str, batch: int, table: str = "rows") -> bool:
        """Add a batch once; done again, it writes nothing."""
        return not self.is_done(job, batch) and self.commit(job, batch, add={table: self.write(df)})

    def compact(self, schema: str, table: str = "rows", most: int = 64) -> None:
        """Many folders as one, so that a manifest stays small; for the one writer of a table. Readers of older manifests keep theirs."""
        _, now = self.state()
        if len(now["tables"].get(table, [])) > most:
            job = f"compact {table}"
            self.commit(job, now["done"].get(job, -1) + 1, replace={table: self.write(self.read(table, schema))})

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last ``keep`` manifests names, and older manifests; when no batch is under way. How many folders went."""
        versions = self.versions()
        named = {f for v in versions[-keep:] for folders in json.loads(self._text(f"manifests/{v:010d}.json"))["tables"].values() for f in folders}
        gone = 0
        if self._fs.exists(self._at("parts")):
            for status in self._fs.listStatus(self._at("parts")):
                if f"parts/{status.getPath().getName()}" not in named:
                    gone += bool(self._fs.delete(status.getPath(), True))
        for v in versions[:-keep]:
            self._fs.delete(self._at(f"manifests/{v:010d}.json"), False)
        return gone

    @contextmanager
    def guard(self, job: str, stale_s: float = 3600) -> Iterator[None]:
        """One run of a job at a time: a second one raises :class:`AlreadyRunning`, unless the first began ``stale_s`` seconds ago."""
        name = f"running-{job}"
        if not self._make(name, str(time.time())):
            if time.time() - float(self._text(name) or 0) < stale_s:
                raise AlreadyRunning(f"{job} is running")
            self._fs.delete(self._at(name), False)
            if not self._make(name, str(time.time())):
                raise AlreadyRunning(f"{job} is running")
        try:
            yield
        finally:
            self._fs.delete(self._at(name), False)
