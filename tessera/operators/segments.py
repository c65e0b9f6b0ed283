"""A BM25 index that takes batches: segments of postings, statistics that add up, tombstones and merges.

A batch of new or changed documents becomes a segment: its postings with their
lengths.  Earlier postings of the same ids are dead from then on, which the
segment's table of replaced ids says; nothing that is written changes.  A segment
also has what it adds to the statistics and what dies with it takes away, so
those of the living are sums over segments, and an index after any number of
batches scores like one built from the documents as they are.  A merge puts
the living postings of several segments into one.

The index is a list of segments in a ``VersionedTable`` of its own, so a batch
that fails leaves the index as it was, and older states can be read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.versioned import VersionedTable
from .index import Bm25Index, if_small, inverse_frequencies, token_counts


class SegmentedIndex:
    """Segments below ``path``; the id's type is that of the first batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.list = VersionedTable(spark, f"{self.path}/segments", "segment", buckets=1)

    def segments(self, version: int | None = None) -> list:
        """(segment, path) rows by segment, one for each batch that has not been merged."""
        return sorted(self.list.read(version).collect(), key=lambda r: r["segment"]) if self.list.versions() else []

    def add(self, docs: DataFrame, id_col: str, text_col: str, *, deleted: DataFrame | None = None) -> int:
        """Index a batch (one row an id); its ids and those of ``deleted`` (id) replace what was there.  Returns the segment's number."""
        known = self.segments()
        number = max((r["segment"] for r in known), default=0) + 1
        at = f"{self.path}/{number}-{uuid.uuid4().hex}"
        token_counts(docs, id_col, text_col).write.parquet(f"{at}/postings")
        own = self.spark.read.parquet(f"{at}/postings")
        ids = own.select("id").distinct()
        gone = ids if deleted is None else ids.unionByName(deleted.select(F.col("id").cast(ids.schema["id"].dataType)))
        gone.distinct().write.parquet(f"{at}/replaced")
        replaced = self.spark.read.parquet(f"{at}/replaced")
        changes = own.select("id", "tok", "dl", F.lit(1).alias("sign"))
        before = self._living(known)
        if before is not None:
            changes = changes.unionByName(before.join(if_small(replaced), "id", "left_semi").select("id", "tok", "dl", F.lit(-1).alias("sign")))
        changes.where("tok is not null").groupBy("tok").agg(F.sum("sign").alias("df")).where("df <> 0").write.parquet(f"{at}/frequencies")
        once = changes.groupBy("id", "sign").agg(F.max("dl").alias("dl"))
        once.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("dl") * F.col("sign")), F.lit(0)).alias("total")).write.parquet(f"{at}/totals")
        row = self.spark.createDataFrame([(number, at)], "segment long, path string")
        self.list.upsert(row, "segment")
        return number

    def _table(self, known: list, name: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{r['path']}/{name}" for r in known))

    def _living(self, known: list) -> DataFrame | None:
        """Postings that no later segment replaces, a row of null token for a document without any."""
        if not known:
            return None
        each, dead = None, None
        for r in known:
            own = self.spark.read.parquet(f"{r['path']}/postings").withColumn("segment", F.lit(r["segment"]))
            out = self.spark.read.parquet(f"{r['path']}/replaced").withColumn("by", F.lit(r["segment"]))
            each, dead = (own, out) if each is None else (each.unionByName(own), dead.unionByName(out))
        # a document is replaced in its first segment by itself: what counts is its last one
        last = dead.groupBy("id").agg(F.max("by").alias("by"))
        return each.join(if_small(last), "id").where("segment = by").drop("segment", "by")

    def index(self, version: int | None = None) -> Bm25Index:
        """The whole index as its batches have left it."""
        known = self.segments(version)
        if not known:
            raise ValueError(f"{self.path} has no segment yet")
        living = self._living(known)
        tf = living.where("tok is not null").select("id", "tok", "f", "dl")
        dl = living.groupBy("id").agg(F.max("dl").alias("dl"))
        stats = self._table(known, "totals").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("avgdl"))
        df = self._table(known, "frequencies").groupBy("tok").agg(F.sum("df").alias("df")).where("df > 0")
        return Bm25Index(tf, dl, inverse_frequencies(df, stats), stats)

    def merge(self, *, most: int = 1) -> int:
        """Put all but the ``most - 1`` newest segments into one; returns how many segments there are then.

        The merged segment replaces what its parts replaced, so deleted ids stay dead.
        """
        known = self.segments()
        old = known[: len(known) - (most - 1)]
        if len(old) < 2:
            return len(known)
        number, at = old[-1]["segment"], f"{self.path}/merged-{uuid.uuid4().hex}"
        self._living(old).write.parquet(f"{at}/postings")
        self._table(old, "replaced").distinct().write.parquet(f"{at}/replaced")
        self._table(old, "frequencies").groupBy("tok").agg(F.sum("df").alias("df")).where("df <> 0").write.parquet(f"{at}/frequencies")
        self._table(old, "totals").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).write.parquet(f"{at}/totals")
        row = self.spark.createDataFrame([(number, at)], "segment long, path string")
        gone = self.spark.createDataFrame([(r["segment"],) for r in old[:-1]], "segment long")
        self.list.upsert(row, "segment", deleted=gone)
        return len(known) - len(old) + 1
