"""Tables in versions: each write is a new directory, and a pointer is put in place at the end.

Readers follow the pointer, so they see the old version or the new one and nothing between. The
files are those of the session's file system, which all executors share.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

POINTER, PENDING, ENTRY, IDENTITY = "_current", "_pending", "_entry", "_identity"


class Store:
    """Index tables of repositories below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    @staticmethod
    def key(repository: str) -> str:
        """The first 12 hex digits of the path's MD5."""
        return hashlib.md5(repository.encode(), usedforsecurity=False).hexdigest()[:12]

    def _read(self, path: str) -> str | None:
        p = self._path(path)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        """The whole text under a name of its own, then renamed over ``path``."""
        draft = self._path(f"{path}.{time.time_ns()}.tmp")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        modes = self.spark.sparkContext._gateway.new_array(options, 1)
        modes[0] = options.OVERWRITE
        context.rename(draft, self._path(path), modes)

    def write(self, repository: str, tables: dict[str, DataFrame], partition_by: str | None = None) -> str:
        """Writes a version of a repository's tables and makes it the current one."""
        base, version = f"{self.root}/{self.key(repository)}", f"v{time.time_ns()}"
        self._write(f"{base}.{PENDING}", json.dumps({"repository": repository, "version": version}))
        for name, rows in tables.items():
            out = rows.write
            (out.partitionBy(partition_by) if partition_by else out).parquet(f"{base}/{version}/{name}")
        self._write(f"{base}/{ENTRY}", json.dumps({"path": repository, "tables": sorted(tables)}, sort_keys=True))
        self._write(f"{base}/{POINTER}", version)
        self._fs.delete(self._path(f"{base}.{PENDING}"), False)
        return version

    def load(self, repository: str, name: str) -> DataFrame | None:
        """A table's current version, or None if the repository has none."""
        base = f"{self.root}/{self.key(repository)}"
        version = self._read(f"{base}/{POINTER}")
        return None if version is None else self.spark.read.parquet(f"{base}/{version}/{name}")

    def catalog(self) -> dict[str, dict]:
        """Each repository's path, version and tables by its key.

        An entry is a file beside the repository's pointer, so that writers of different
        repositories don't share one. A repository without an entry has a null path.
        """
        out = {}
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            version = self._read(f"{self.root}/{name}/{POINTER}") if status.isDirectory() else None
            if version:
                out[name] = {"path": None, "tables": [], **json.loads(self._read(f"{self.root}/{name}/{ENTRY}") or "{}"), "version": version}
        return out

    def identity(self, adopt: bool = False) -> str:
        """The store's own id, given when it is first asked for.

        A root that already holds something but no id has to be adopted. Of several that ask at
        once one gives the id, and all get it.
        """
        path = f"{self.root}/{IDENTITY}"
        found = self._read(path)
        if found is None:
            if not adopt and self._fs.listStatus(self._path(self.root)):
                raise ValueError(f"{self.root} isn't empty; adopt it explicitly")
            try:
                stream = self._fs.create(self._path(path), False)
                stream.write(bytearray(uuid.uuid4().hex.encode()))
                stream.close()
            except Exception:  # another one was first
                pass
            found = self._read(path)
        return found

    def pending(self) -> list[str]:
        """Keys of repositories of which a write was begun and not ended."""
        return sorted(s.getPath().getName().removesuffix(f".{PENDING}") for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().endswith(f".{PENDING}"))

    def invalidate(self, repository: str) -> bool:
        """Takes a repository out; whether there was one."""
        found = self.key(repository) in self.catalog()
        self._fs.delete(self._path(f"{self.root}/{self.key(repository)}"), True)
        return found

    def repair(self) -> dict[str, dict]:
        """The catalog as the pointers have it: entries get the tables that are there, and markers of
        unfinished writes go."""
        for status in self._fs.listStatus(self._path(self.root)):
            if status.getPath().getName().endswith(f".{PENDING}"):
                self._fs.delete(status.getPath(), False)
        for name, entry in self.catalog().items():
            tables = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{name}/{entry['version']}")) if s.isDirectory())
            self._write(f"{self.root}/{name}/{ENTRY}", json.dumps({"path": entry["path"], "tables": tables}, sort_keys=True))
        return self.catalog()

    def clean(self) -> list[str]:
        """Takes out repositories whose root is gone; their paths."""
        gone = [v["path"] for v in self.catalog().values() if v["path"] and not self._fs.exists(self._path(v["path"]))]
        for path in gone:
            self.invalidate(path)
        return sorted(gone)


def resolved_root(spark: SparkSession, bound: str | None = None, default: str = ".strataloom") -> str:
    """Where the store lies: the bound root, else the session's strataloom.store, else the default."""
    return bound or spark.conf.get("strataloom.store", None) or default


def legacy_counts(spark: SparkSession, pattern: str) -> DataFrame:
    """path and number of symbols of old single-file JSON indexes; only these two members are read."""
    rows = spark.read.schema("repo_path string, symbols array<struct<id:string>>").json(pattern, multiLine=True)
    return rows.select(F.col("repo_path").alias("path"), F.size("symbols").alias("symbols"))
