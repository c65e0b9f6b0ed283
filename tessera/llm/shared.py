"""Storage that every executor sees, and the parquet tables kept there."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import shared_dir, ship

#: Spark's own switch: an execution's shuffle files go when it ends
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made = threading.local()


class Tables:
    """Intermediate tables of one run, in a folder of their own.

    A written table cuts the lineage: a lost executor costs a re-read and not the
    whole plan.  Nothing needs the shuffle files behind it any more, and they are
    released.  ``drop`` deletes tables that nothing reads any more; a table that
    a lazily returned result reads stays.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
        self.names = 0
        if getattr(_made, "tables", None) is not None:
            _made.tables.append(self)

    def write(self, df: DataFrame, *more: DataFrame) -> DataFrame:
        """The rows of ``df`` as a table; parts of one table (``more``, of the same columns) are written one after the other."""
        self.names += 1
        path = f"{self.base}/{self.names}"
        before = self.spark.conf.get(RELEASE, None)
        self.spark.conf.set(RELEASE, "true")
        try:
            df.write.parquet(path)
            for part in more:
                part.write.mode("append").parquet(path)
        finally:
            self.spark.conf.unset(RELEASE) if before is None else self.spark.conf.set(RELEASE, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_to = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``write`` returned."""
        for table in tables:
            self._delete(table._written_to)

    def clear(self) -> None:
        """Delete all tables of the run."""
        self._delete(self.base)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def recorded() -> Iterator[list[Tables]]:
    """The ``Tables`` that this thread makes inside the block."""
    before, _made.tables = getattr(_made, "tables", None), []
    try:
        yield _made.tables
    finally:
        _made.tables = before


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table of its own in the shared folder, which stays."""
    return Tables(df.sparkSession, label).write(df)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package made importable where it runs."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
