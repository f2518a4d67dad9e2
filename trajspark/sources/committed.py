"""A Parquet table whose files count only once a commit names them.

    <path>/data/attempt=<name>/_slot=<slot>/part-*.parquet
    <path>/commits/<name>.json

A writer puts its rows into a folder of its own, then names the folder in a commit, which is written beside and renamed: a reader sees all of it or
nothing. What a failed attempt left lies in folders that no commit names. A commit may replace folders
(compaction), in the same one step. ``_slot`` tells which rows belong together, so that a reader opens only the slots it needs.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CommittedTable:
    """One writer at a time; any number of readers. The log is read once, then kept up to date."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.names: set[str] = set()
        self.slots: dict[str, set[str]] = {}          # folders by slot
        entries = []
        if self._there("commits"):
            rows = spark.read.schema("name string, folder string, slots array<string>, replaces array<string>").json(f"{self.path}/commits")
            entries = [r.asDict() for r in rows.collect()]       # one row per commit
        gone = {f for e in entries for f in e["replaces"] or ()}
        for e in entries:
            self._know(e, gone)

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _there(self, name: str) -> bool:
        fs, p = self._file(name)
        return fs.exists(p)

    def _know(self, entry: dict, gone=()) -> None:
        self.names.add(entry["name"])
        if entry["folder"] not in gone:
            for s in entry["slots"]:
                self.slots.setdefault(s, set()).add(entry["folder"])

    def has(self, name: str) -> bool:
        return name in self.names or self._there(f"commits/{name}.json")

    def folders(self) -> set[str]:
        return {f for some in self.slots.values() for f in some}

    def _write(self, rows: DataFrame, name: str) -> tuple[str, list[str]]:
        folder = f"attempt={name}-{uuid.uuid4().hex[:8]}"
        # a slot is few files, a large one is split
        rows.hint("rebalance", F.col("_slot")).write.partitionBy("_slot").parquet(f"{self.path}/data/{folder}")
        fs, p = self._file(f"data/{folder}")
        return folder, [s.getPath().getName()[len("_slot="):] for s in fs.listStatus(p) if s.isDirectory()]

    def _commit(self, entry: dict) -> None:
        fs, kept_at = self._file(f"commits/{entry['name']}.json")
        _, beside = self._file(f"commits/.{entry['name']}-{uuid.uuid4().hex[:8]}")
        out = fs.create(beside)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if fs.exists(kept_at) or not fs.rename(beside, kept_at):
            raise FileExistsError(f"{kept_at}: another writer has committed it")
        self._know(entry)

    def append(self, rows: DataFrame, name: str) -> None:
        """Add rows (with the string column ``_slot``) under a name that is committed once: a second time nothing happens."""
        if not self.has(name):
            folder, slots = self._write(rows, name)
            self._commit({"name": name, "folder": folder, "slots": slots, "replaces": []})

    def replace(self, rows: DataFrame, name: str, folders: set[str]) -> None:
        """Put ``rows`` in the place of ``folders``. Their files stay until ``clean``, for those who read them now."""
        folder, slots = self._write(rows, name)
        self._commit({"name": name, "folder": folder, "slots": slots, "replaces": sorted(folders)})
        self.slots = {s: kept for s, some in self.slots.items() if (kept := some - folders)}

    def paths(self, slots=None) -> list[str]:
        chosen = self.slots if slots is None else [s for s in slots if s in self.slots]
        return sorted(f"{self.path}/data/{f}/_slot={s}" for s in chosen for f in self.slots[s])

    def read(self, slots=None) -> DataFrame:
        """The committed rows of some slots, or of all."""
        paths = self.paths(slots)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        if slots is None:
            paths = sorted({p.rsplit("/", 1)[0] for p in paths})
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_slot", T.StringType())])).option("basePath", f"{self.path}/data").parquet(*paths)
        return rows.select(*self.schema.names)

    def clean(self) -> int:
        """Remove the folders that no commit names, or that were replaced. Not while somebody writes or still reads those."""
        if not self._there("data"):
            return 0
        fs, p = self._file("data")
        old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in self.folders()]
        for q in old:
            fs.delete(q, True)
        return len(old)
