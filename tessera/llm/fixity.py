"""Fixity audit of archive replicas by Merkle trees over offset ranges.

Records of an archive file are leaves: the SHA-256 of their bytes, placed by
their offset.  A node of level 1 covers a range of ``range_bytes`` of offsets
and hashes its leaves with their offsets in order; a node of level k covers
``fanout`` nodes of level k - 1.  Two replicas are compared from the roots
down: only children of nodes that differ are joined, level by level, until the
records that differ are left.  Equal files cost one comparison of roots.

A range holds a bounded number of bytes and so of records; no file, however
large, is gathered in one place.  Built-in functions only.

Nulls and edges: a null payload hashes as empty bytes with its own mark, so it
differs from an empty one; records with a null file or offset cannot be placed
and are ignored; several records at one offset are hashed together, in order of
their hashes; a record or file that one replica lacks is reported as missing
or extra; equal or empty replicas give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import materialize

CRLF = "\r\n"


def warc_record(record_id: Column, url: Column, payload: Column) -> Column:
    """The text of a WARC/1.0 response record; its length in bytes is its octet length."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:record:"), record_id.cast("string"), F.lit(f">{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")))
    return F.concat(head, F.lit(f"{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2), body, F.lit(CRLF * 2))


def record_hash(payload: Column) -> Column:
    """A record's hash, in 64 digits; a null payload's is a mark of its own."""
    return F.coalesce(F.sha2(payload.cast("binary"), 256), F.lit("null"))


def record_bytes(payload: Column) -> Column:
    return F.coalesce(F.octet_length(payload.cast("binary")), F.lit(0)).cast("long")


def leaves(records: DataFrame) -> DataFrame:
    """(file, at, hash, bytes) from records (file, offset, payload), or from (file, offset, hash, bytes) of payloads hashed where they lie."""
    if "payload" in records.columns:
        records = records.select("file", "offset", record_hash(F.col("payload")).alias("hash"), record_bytes(F.col("payload")).alias("bytes"))
    one = records.where("file is not null and offset is not null").select("file", F.col("offset").cast("long").alias("at"), "hash", "bytes")
    same = one.groupBy("file", "at").agg(F.sort_array(F.collect_list("hash")).alias("hashes"), F.sum("bytes").alias("bytes"))
    return same.select("file", "at", F.when(F.size("hashes") == 1, F.col("hashes")[0]).otherwise(F.sha2(F.array_join("hashes", ","), 256)).alias("hash"), "bytes")


def parents(nodes: DataFrame, span: int) -> DataFrame:
    """The level above: ``span`` places of ``nodes`` to a node, children hashed in order."""
    kids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "hash"))), lambda x: F.concat(x["at"].cast("string"), F.lit(":"), x["hash"])), ",")
    return nodes.groupBy("file", F.floor(F.col("at") / span).alias("up")).agg(F.sha2(kids, 256).alias("hash")).select("file", F.col("up").alias("at"), "hash")


def merkle_levels(records: DataFrame, *, range_bytes: int, fanout: int, height: int) -> list[DataFrame]:
    """Leaves first, then each level, materialized; the last has one node a file."""
    levels = [materialize(leaves(records), "merkle-leaves")]
    for k in range(height):
        levels.append(materialize(parents(levels[-1], range_bytes if not k else fanout), f"merkle-{k + 1}"))
    return levels


def tree_height(*replicas: DataFrame, range_bytes: int, fanout: int) -> int:
    """Levels above the leaves that bring the longest file to one node."""
    longest = max((r.agg(F.max("offset")).first()[0] or 0) for r in replicas)
    height, span = 1, range_bytes
    while longest >= span:
        height, span = height + 1, span * fanout
    return height


def audit_replicas(left: DataFrame, right: DataFrame, *, range_bytes: int = 1 << 20, fanout: int = 16) -> DataFrame:
    """(file, offset, kind, left_hash, right_hash, left_bytes, right_bytes) of the records that differ.

    left and right: (file, offset, payload), or (file, offset, hash, bytes) with
    ``record_hash`` and ``record_bytes``, so that payloads need not move to be placed.
    kind: ``changed``, ``missing`` (left only) or ``extra`` (right only).
    """
    height = tree_height(left, right, range_bytes=range_bytes, fanout=fanout)
    options = {"range_bytes": range_bytes, "fanout": fanout, "height": height}
    a, b = merkle_levels(left, **options), merkle_levels(right, **options)
    bad = None
    for k in range(height, -1, -1):
        x, y = a[k], b[k]
        if bad is not None:
            span = range_bytes if k == 0 else fanout
            mine = [F.col("n.file") == F.col("p.file"), F.floor(F.col("n.at") / span) == F.col("p.at")]
            x, y = (n.alias("n").join(bad.alias("p"), mine, "left_semi") for n in (x, y))
        both = x.alias("x").join(y.alias("y"), ["file", "at"], "full_outer").where(~F.col("x.hash").eqNullSafe(F.col("y.hash")))
        bad = both.select("file", "at") if k else both
        if k and k < height:
            bad = materialize(bad, "merkle-differ")
    kind = F.when(F.col("x.hash").isNull(), "extra").when(F.col("y.hash").isNull(), "missing").otherwise("changed")
    return bad.select("file", F.col("at").alias("offset"), kind.alias("kind"), F.col("x.hash").alias("left_hash"), F.col("y.hash").alias("right_hash"), F.col("x.bytes").alias("left_bytes"), F.col("y.bytes").alias("right_bytes"))
