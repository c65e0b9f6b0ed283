"""Session defaults, and the package itself for Python workers on other machines."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
CHECKPOINTS = "spark.checkpoint.dir"
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a local master gets a temporary folder (tests); a cluster
    gets its warehouse, which its executors share.
    """
    found = spark.conf.get(CHECKPOINTS, None) or spark.sparkContext.getConf().get(CHECKPOINTS)
    if not found:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        found = "file://" + tempfile.mkdtemp(prefix="tessera-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set(CHECKPOINTS, found)
    return found.rstrip("/")


def written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as a Parquet table of its own below ``folder`` in the shared folder: what reads it starts from there."""
    path = f"{shared_dir(df.sparkSession)}/tessera/{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults; conf overrides them (dots written as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), "tessera_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
