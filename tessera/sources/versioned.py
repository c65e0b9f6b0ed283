"""A keyed table with versions: only the hash buckets that a batch touches are written anew.

A version is a manifest, one JSON file with the table's schema and the files of
each bucket; data files never change and are shared by versions.  A write puts
its files beside the others first and renames its manifest into place last,
so readers see the old version or the new one and a write that fails changes
nothing.  The rename fails if another writer took the number: that write is
lost as a whole and can be tried again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another write took the version's number."""


class VersionedTable:
    """The table below ``path``; rows are told apart by ``key``, and a null key is refused."""

    def __init__(self, spark: SparkSession, path: str, key: str, *, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        """Numbers of all versions, oldest first."""
        at = self._at("manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """What a version (None: the newest) is made of; None for a table without versions."""
        known = self.versions()
        if version is None and not known:
            return None
        if version is not None and version not in known:
            raise ValueError(f"no version {version} of {self.path}")
        stream = self._fs.open(self._at(f"manifests/{known[-1] if version is None else version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, found: dict) -> int:
        """Make a manifest the next version, or raise Conflict."""
        version, draft = found["version"], self._at(f"manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(found).encode()))
        finally:
            stream.close()
        to = self._at(f"manifests/{version:010d}.json")
        if self._fs.exists(to) or not self._fs.rename(draft, to):
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} is taken")
        return version

    def _rows(self, found: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(found["schema"])
        files = [f"{self.path}/{f}" for b, names in found["files"].items() if buckets is None or int(b) in buckets for f in names]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if found is None:
            raise ValueError(f"{self.path} has no version yet")
        return self._rows(found)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys; only the buckets that they fall into are read."""
        found = self.manifest()
        if found is None:
            raise ValueError(f"{self.path} has no version yet")
        wanted = keys.select(self.key).distinct()
        return self._rows(found, self._touched(wanted, found["buckets"])).join(wanted, self.key, "left_semi")

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int")

    def _touched(self, keys: DataFrame, buckets: int) -> set[int]:
        return {r[0] for r in keys.select(self._bucket(buckets)).distinct().collect()}  # as many as there are buckets, at most

    def upsert(self, new: DataFrame, order: str, *, deleted: DataFrame | None = None) -> int:
        """Put rows in place of those of the same keys and take keys out of ``deleted``; of several new rows of a key the last by ``order`` stays.

        Returns the version's number.  Equal keys meet by a shuffle of the new rows
        and of the touched buckets alone.
        """
        found = self.manifest() or {"version": 0, "schema": json.loads(new.schema.json()), "files": {}, "buckets": self.buckets}
        schema, buckets = StructType.fromJson(found["schema"]), found["buckets"]
        if set(new.columns) != set(schema.names):
            raise ValueError(f"columns {sorted(new.columns)} are not those of the table, {sorted(schema.names)}")
        checked = F.when(F.col(self.key).isNotNull(), F.col(self.key)).otherwise(F.raise_error(F.lit("a null key")))
        last = Window.partitionBy(self.key).orderBy(F.desc(order))
        new = new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields)).withColumn(self.key, checked)
        new = new.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
        gone = new.select(self.key) if deleted is None else new.select(self.key).unionByName(deleted.select(self.key))
        touched = self._touched(gone, buckets)
        old = self._rows(found, touched).join(gone.distinct(), self.key, "left_anti")
        if deleted is not None:
            new = new.join(deleted.select(self.key), self.key, "left_anti")
        part = f"data/{uuid.uuid4().hex}"
        merged = old.unionByName(new).withColumn(BUCKET, self._bucket(buckets))
        merged.repartition(F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.path}/{part}")
        files = {b: names for b, names in found["files"].items() if int(b) not in touched} | self._written(part)
        return self._commit({"version": found["version"] + 1, "schema": found["schema"], "buckets": buckets, "files": files})

    def _written(self, part: str) -> dict[str, list[str]]:
        """The files of each bucket below ``part``."""
        out: dict[str, list[str]] = {}
        for folder in self._fs.listStatus(self._at(part)):
            name = folder.getPath().getName()
            if name.startswith(f"{BUCKET}="):
                own = [f.getPath().getName() for f in self._fs.listStatus(folder.getPath())]
                out[name.partition("=")[2]] = [f"{part}/{name}/{n}" for n in sorted(own) if n.endswith(".parquet")]
        return out

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the ``keep`` newest versions and delete files that no version has; returns how many went.

        Files of a write that is still going on look like those of a failed one: not to be run beside a writer.
        """
        known = self.versions()
        for version in known[:-keep]:
            self._fs.delete(self._at(f"manifests/{version:010d}.json"), False)
        used = {f for v in known[-keep:] for names in self.manifest(v)["files"].values() for f in names}
        gone, data = 0, self._at("data")
        for part in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = f"data/{part.getPath().getName()}"
            stale = [f for names in self._written(name).values() for f in names if f not in used]
            for f in stale:
                gone += bool(self._fs.delete(self._at(f), False))
            if not any(f.startswith(f"{name}/") for f in used):
                self._fs.delete(part.getPath(), True)
        return gone
