"""A table kept as numbered versions, safe under several writers.

``<root>/data/<id>`` holds the Parquet files of one version and ``<root>/log/<n>.json``
names the id of version n.  A writer writes its data first and then puts the log line
of the next number, which fails if another writer has put it: the line is written
beside the log and renamed without overwriting, the way Structured Streaming keeps
its own logs.  ``update`` then reads what the other has committed and tries again, so
no writer's change is lost.  A writer that dies leaves data that no line names.

The store must rename without overwriting (HDFS, local folders, ABFS).  Readers need
no lock: a version never changes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has put the version."""


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, tail: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{tail}")

    def _store(self):
        return self._path("log").getFileSystem(self.conf)

    def version(self) -> int:
        """Number of the current version; 0 before the first."""
        store, log = self._store(), self._path("log")
        if not store.exists(log):  # any other error is raised
            return 0
        names = [f.getPath().getName() for f in store.listStatus(log)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The table of a version, by default the current one; empty before the first."""
        n = self.version() if version is None else version
        if not n:
            return self.spark.createDataFrame([], self.schema)
        stream = self._store().open(self._path(f"log/{n}.json"))
        try:
            line = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/data/{line['data']}")

    def commit(self, rows: DataFrame, after: int) -> int:
        """Write ``rows`` as the version after ``after``; raises Conflict if there is one already."""
        data = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/data/{data}")
        store, n = self._store(), after + 1
        store.mkdirs(self._path("log"))
        beside = self._path(f"log/.{data}.tmp")
        out = store.create(beside, True)
        out.write(bytearray(json.dumps({"version": n, "data": data}).encode()))
        out.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self.conf) if beside.toUri().getScheme() else \
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(beside, self._path(f"log/{n}.json"), none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            store.delete(beside, False)
            raise Conflict(f"{self.root}: version {n} is there") from None
        return n

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
        """Commit ``change(current)``; on a conflict, of what is current then."""
        for _ in range(tries):
            n = self.version()
            try:
                return self.commit(change(self.read(n)), n)
            except Conflict:
                continue
        raise Conflict(f"{self.root}: {tries} tries")
