"""The request limiter and letter ingestion as streams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ..functions import text as T
from ..sources.versioned import VersionedTable

STATE = StructType([StructField("count", LongType()), StructField("reset", DoubleType())])
#: what a slot keeps of its keys; ``seen``: when a key last had a request, by the clock, in milliseconds
SLOT_STATE = StructType([StructField("key", ArrayType(StringType())), StructField("count", ArrayType(LongType())), StructField("reset", ArrayType(DoubleType())), StructField("seen", ArrayType(LongType()))])
#: slots that a stream's keys are dealt to; a call into the worker and two for its state are a slot's, not a key's
SLOTS = 4096


class AnchoredWindow(StatefulProcessor):
    """A window that starts at a key's first request; at or after its end the next request starts another.

    Requests of one batch are taken in time order, batches in the order of their
    times.  The state of an idle key expires after two windows by the clock,
    unless the stream replays requests of another time.
    """

    def __init__(self, most: int, window: float, expires: bool = True):
        self.most, self.window, self.expires = most, window, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", STATE, ttlDurationMs=int(2000 * self.window) if self.expires else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, reset = self.state.get() if self.state.exists() else (0, float("-inf"))
        times = sorted(t for pdf in rows for t in pdf["at"])
        allowed, count, reset = self.decided(times, count, reset)
        self.state.update((count, reset))
        yield pd.DataFrame({"key": [key[0]] * len(times), "at": times, "allowed": allowed})

    def decided(self, times: list[float], count: int, reset: float) -> tuple[list[bool], int, float]:
        """Verdicts of one key's requests in time order, and its window after them."""
        allowed = []
        for t in times:
            if t >= reset:
                count, reset = 0, t + self.window
            count += 1
            allowed.append(count <= self.most)
        return allowed, count, reset

    def close(self) -> None:
        pass


class SlotWindows(AnchoredWindow):
    """The windows of all keys of a slot, which are decided key by key and kept as one state.

    Idle keys of a slot that has requests are dropped here, idle slots by Spark.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("windows", SLOT_STATE, ttlDurationMs=int(2000 * self.window) if self.expires else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.expires else 0
        held = {k: (count, reset, seen) for k, count, reset, seen in zip(*(self.state.get() or ((),) * 4)) if not self.expires or now - seen < 2000 * self.window}
        asked = pd.concat([pdf[["key", "at"]] for pdf in rows])
        codes, names = pd.factorize(asked["key"], use_na_sentinel=False)
        order = np.lexsort((asked["at"].to_numpy(), codes))
        times, names = asked["at"].to_numpy()[order].tolist(), [None if pd.isna(k) else k for k in names]
        ends, allowed, at = np.cumsum(np.bincount(codes, minlength=len(names))).tolist(), [], 0
        for name, end in zip(names, ends):
            count, reset, _ = held.get(name, (0, float("-inf"), 0))
            own, count, reset = self.decided(times[at:end], count, reset)
            held[name] = count, reset, now
            allowed += own
            at = end
        self.state.update((list(held), *map(list, zip(*held.values()))))
        yield pd.DataFrame({"key": asked["key"].to_numpy()[order], "at": times, "allowed": allowed})


def limit_stream(requests: DataFrame, most: int, window_seconds: float, *, replay: bool = False, slots: int = SLOTS) -> DataFrame:
    """(key, at, allowed) for a stream of (key string, at seconds double); needs the RocksDB state store.

    replay: the requests' times are not those of the clock, so no state expires.
    slots: parts of the keys that are decided and kept together; fixed for a checkpoint's life.
    """
    # the state's processor is also loaded beside the driver, where this package may not be on the path
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    own = SlotWindows(most, window_seconds, expires=not replay)
    dealt = requests.select("key", "at", F.pmod(F.xxhash64("key"), F.lit(slots)).alias("slot"))
    return dealt.groupBy("slot").transformWithStateInPandas(statefulProcessor=own, outputStructType="key string, at double, allowed boolean", outputMode="Append", timeMode="None" if replay else "ProcessingTime")


@contextmanager
def state_store(spark: SparkSession, provider: str = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider") -> Iterator[None]:
    """The state store that typed state needs, for streams started here."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_limiter(requests: DataFrame, path: str, checkpoint: str, most: int, window_seconds: float) -> None:
    """Decide all that a stream of requests (key, at) has now, append it to ``path`` and stop; a later run goes on where this one ended."""
    with state_store(requests.sparkSession):
        decided = limit_stream(requests, most, window_seconds, replay=True)
        decided.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def letter_stream(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """New text files as cleaned letters (year, source_file, text), each file once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(T.year_of_name(name).alias("year"), name.alias("source_file"), T.clean(T.decode_utf8_or_latin1(F.col("content"))).alias("text")).where("year is not null")


def ingest_letters(spark: SparkSession, path: str, store: VersionedTable, checkpoint: str, *, pattern: str = "*.txt", delay: str = "1 day") -> None:
    """Upsert the letters of all new files below ``path`` into ``store`` (key ``source_file``) and stop.

    A file is read once, as the checkpoint says; one that is delivered again under
    another path with the same name and content within ``delay`` is the same
    letter.  A batch that is tried again puts the same rows in place of themselves.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = files.select("modificationTime", name.alias("source_file"), F.sha2("content", 256).alias("digest"), T.year_of_name(name).alias("year"), T.clean(T.decode_utf8_or_latin1(F.col("content"))).alias("text")).where("year is not null")
    once = rows.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["source_file", "digest"])

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.upsert(batch.withColumnRenamed("modificationTime", "modified"), "modified")

    once.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
