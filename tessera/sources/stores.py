"""Vector stores by name: documents with vectors in a versioned table, searched exactly or by an inverted file."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.index import _top, check_width, vector_topk
from ..operators.inverted import InvertedFile, build_inverted, inverted_topk
from .versioned import VersionedTable


class VectorStore:
    """Rows (id, embedding, ...) below ``path``; an upsert replaces rows of known ids, and vectors of another width are refused."""

    def __init__(self, spark: SparkSession, path: str, *, width: int | None = None):
        self.spark, self.path, self.width = spark, path.rstrip("/"), width
        self.table = VersionedTable(spark, f"{self.path}/rows", "id")

    def upsert(self, rows: DataFrame, order: str) -> int:
        """The version that has the rows."""
        return self.table.upsert(check_width(rows, self.width) if self.width else rows, order)

    def delete(self, ids: DataFrame, order: str) -> int:
        return self.table.upsert(self.rows().limit(0), order, deleted=ids)

    def rows(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def count(self) -> int:
        return self.rows().count() if self.table.versions() else 0

    def search(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """(qid, id, score, rank) of the k of highest cosine for each query (qid, vec)."""
        raise NotImplementedError


class ExactStore(VectorStore):
    """Every search reads the vectors that pass its filter."""

    def search(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        rows = self.rows()
        return vector_topk(rows if where is None else rows.where(where), queries, k)


class InvertedStore(VectorStore):
    """Searches by an inverted file, which is kept with the version that it was built from and built anew for a newer one.

    A filter comes after the search among ``widened`` times as many, so it may leave fewer than k.
    """

    widened = 4

    def _index(self) -> InvertedFile:
        version = self.table.versions()[-1]
        at = f"{self.path}/inverted/{version}"
        jvm = self.spark._jvm.org.apache.hadoop.fs
        done = jvm.Path(f"{at}/centres/_SUCCESS")
        if not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            index = build_inverted(self.rows(version))
            index.codes.write.mode("overwrite").partitionBy("part").parquet(f"{at}/codes")
            index.vectors.write.mode("overwrite").partitionBy("place").parquet(f"{at}/vectors")
            kinds = [df.schema.json() for df in (index.codes, index.vectors)]
            meta = json.dumps([index.centres.shape, index.places, *kinds])
            rows = [(-1, meta, [])] + [(n, "", c.tolist()) for n, c in enumerate(index.centres)]  # the square root of the table
            self.spark.createDataFrame(rows, "n int, meta string, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{at}/centres")
        rows = sorted(self.spark.read.parquet(f"{at}/centres").collect(), key=lambda r: r["n"])
        shape, places, *kinds = json.loads(rows[0]["meta"])
        codes, vectors = (self.spark.read.schema(StructType.fromJson(json.loads(kind))).parquet(f"{at}/{name}") for kind, name in zip(kinds, ("codes", "vectors")))
        return InvertedFile(codes, vectors, np.array([r["centre"] for r in rows[1:]], float).reshape(shape), places)

    def search(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        if where is None:
            return inverted_topk(self._index(), queries, k)
        found = inverted_topk(self._index(), queries, k * self.widened).drop("rank")
        return _top(found.join(self.rows().where(where).select("id"), "id", "left_semi"), k)


STORES: dict[str, type[VectorStore]] = {"exact": ExactStore, "inverted": InvertedStore}


def open_store(name: str, spark: SparkSession, path: str, *, width: int | None = None) -> VectorStore:
    """The store of a name; an unknown one is a ValueError."""
    if name not in STORES:
        raise ValueError(f"unknown store: {name!r}; there are {', '.join(sorted(STORES))}")
    return STORES[name](spark, path, width=width)
