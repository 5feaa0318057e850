"""Tables as versioned Parquet folders with pointers that appear whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class IndexLocked(RuntimeError):
    pass


class IndexIncomplete(RuntimeError):
    pass


class Store:
    """``root/<table>/v<N>`` holds version N; the last ``root/<table>/pointer-<N>.json`` names the one in use.

    A pointer is written under another name and then renamed, so a crash leaves either
    the old pointer or the new one. All access goes through Hadoop's file systems, so the
    root may lie anywhere that Spark can write.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join((self.root, *p)))
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def _read_text(self, path) -> str | None:
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write_text(self, path, text: str, overwrite: bool) -> None:
        stream = self._fs.create(path, overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _pointers(self, table: str) -> list[int]:
        folder = self._path(table)
        if not self._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return sorted(int(n[8:-5]) for n in names if n.startswith("pointer-") and n.endswith(".json"))

    def _current(self, table: str) -> dict | None:
        found = self._pointers(table)
        return json.loads(self._read_text(self._path(table, f"pointer-{found[-1]}.json"))) if found else None

    def exists(self, table: str) -> bool:
        return self._current(table) is not None

    def version(self, table: str) -> int:
        now = self._current(table)
        return now["version"] if now else 0

    def epoch(self, table: str) -> int:
        now = self._current(table)
        return now["epoch"] if now else -1

    def read(self, table: str) -> DataFrame:
        now = self._current(table)
        if now is None:
            raise IndexIncomplete(f"table {table} has not been written")
        return self.spark.read.parquet(f"{self.root}/{table}/v{now['version']}")

    def write(self, table: str, rows: DataFrame, epoch: int = -1) -> None:
        """A new version beside the old one, which readers keep until the pointer appears."""
        version = self.version(table) + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/v{version}")
        new, pointer = self._path(table, f"new-{uuid.uuid4().hex}"), self._path(table, f"pointer-{version}.json")
        self._write_text(new, json.dumps({"version": version, "epoch": epoch}), False)
        if not self._fs.rename(new, pointer):
            raise OSError(f"the pointer of {table} could not be renamed")
        for old in self._pointers(table):
            if old < version:
                self._fs.delete(self._path(table, f"pointer-{old}.json"), False)
        stale = self._path(table, f"v{version - 2}")
        if version > 2 and self._fs.exists(stale):
            self._fs.delete(stale, True)

    def drop(self, table: str) -> None:
        self._fs.delete(self._path(table), True)

    def require_complete(self) -> None:
        """Raise unless the last scan wrote everything."""
        if not self.exists("scan_state") or not self.read("scan_state").where("key = 'last_scan_completed' AND value = '1'").count():
            raise IndexIncomplete("no completed index here; run a scan first")

    def lock(self, command: str) -> "Lock":
        return Lock(self, command)


class Lock:
    """Held while a scan writes; a second holder is an error at once."""

    def __init__(self, store: Store, command: str):
        self.store, self.command, self.path = store, command, store._path("index.lock")

    def __enter__(self) -> "Lock":
        import os

        try:
            self.store._write_text(self.path, json.dumps({"pid": os.getpid(), "command": self.command}), False)
        except Exception as e:
            raise IndexLocked(f"the index is in use: {self.store._read_text(self.path)}") from e
        return self

    def __exit__(self, *exc) -> None:
        self.store._fs.delete(self.path, False)
