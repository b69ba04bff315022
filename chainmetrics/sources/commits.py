"""A log of a table's states. Writers add a state after all files that it names are written; readers take the newest as a snapshot."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer committed the same version first; nothing of this one is visible."""


class Log:
    """States of the table at path, one file of JSON a version, on whatever file system the path names.

    One writer at a time is meant. A second one that commits the same version gets Conflict where the store renames
    atomically (not on plain object stores, where two writers need a lock of their own).
    """

    def __init__(self, spark: SparkSession, path: str, name: str = ""):
        self.dir = f"{path.rstrip('/')}/_commits{'/' + name if name else ''}"
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str = ""):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}" if name else self.dir)
        return path, path.getFileSystem(self._conf)

    def versions(self) -> list[int]:
        path, fs = self._path()
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int) -> dict[str, Any]:
        path, fs = self._path(f"{version}.json")
        stream = fs.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def newest(self) -> dict[str, Any]:
        """The newest state, with its number as `version`; without any commit only version 0."""
        versions = self.versions()
        return self.read(versions[-1]) if versions else {"version": 0}

    def commit(self, state: dict[str, Any]) -> int:
        """Add the state that follows state["version"]."""
        version = state["version"] + 1
        temporary, fs = self._path(f".{uuid.uuid4().hex}.tmp")
        target, _ = self._path(f"{version}.json")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(state | {"version": version}).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(temporary, target):
            fs.delete(temporary, False)
            raise Conflict(f"version {version} of {self.dir} exists")
        return version

    def folders(self, path: str) -> list[str]:
        """Names of the folders in path; none if it is not there."""
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self._conf)
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []

    def remove(self, path: str) -> None:
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self._conf).delete(at, True)

    def forget(self, keep: int) -> None:
        """Drop all but the newest `keep` states."""
        for version in self.versions()[:-keep]:
            self.remove(f"{self.dir}/{version}.json")
