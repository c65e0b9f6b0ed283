"""Approximate vector search by an inverted file of 8-bit codes.

Centres grow with the square root of the table.  Every vector is filed under its
nearest centres as the residual's 8-bit code; files are partitioned by cell, so a
search reads the codes of the cells that its questions look into, a quarter of the
vectors' bytes.  The best of them by code are scored again by their whole vectors,
which lie apart, partitioned by a hash of the id: only those of the best are looked up.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import shared_dir, ship
from .index import QUERY_BLOCK, Kept, _top, _unit, fit_cells, nearest, normalized, tiles

#: partitions of either table; more cells than that share them
MOST_PARTS = 4096
#: vectors in a partition of the whole ones, about
PLACE = 4096
#: the share of the cells that a question looks into: what vectors without clusters need; clustered ones need fewer
PROBED = 0.48


@dataclass
class InvertedFile:
    """codes (part, cell, id, step, code), vectors (place, id, vec), the centres, and how many places there are."""

    codes: DataFrame
    vectors: DataFrame
    centres: np.ndarray
    places: int

    @property
    def parts(self) -> int:
        return max(1, min(len(self.centres), MOST_PARTS))


def _coded(centres: np.ndarray, copies: int, parts: int):
    """mapInPandas: (id, vec) -> a code in each of the nearest cells."""

    def run(batches):
        for pdf in batches:
            pdf = pdf[pdf.vec.notna()]
            if not len(pdf) or not len(centres):
                continue
            unit = _unit(np.array(pdf.vec.tolist(), float))
            cells = nearest(unit, centres)[:, None] if copies == 1 else np.concatenate([np.argsort(-(unit[t] @ centres.T), axis=1, kind="stable")[:, :copies] for t in tiles(len(unit), len(centres))])
            n = cells.shape[1]
            rest = np.repeat(unit, n, 0) - centres[cells.ravel()]
            step = np.maximum(np.abs(rest).max(1), 1e-12) / 127
            code = np.round(rest / step[:, None]).astype(np.int8)
            yield pd.DataFrame({"part": (cells.ravel() % parts).astype(np.int32), "cell": cells.ravel().astype(np.int32), "id": np.repeat(pdf.id.to_numpy(), n), "step": step.astype(np.float32), "code": [c.tobytes() for c in code]})

    return run


def build_inverted(vectors: DataFrame, *, id_col: str = "id", vec_col: str = "embedding", cells: int | None = None, copies: int = 1, sample: int = 20_000) -> InvertedFile:
    """File all vectors that are not null, in the shared folder.

    cells: 4 * sqrt(n) if not given; copies: in how many of its nearest cells a
    vector is filed; the centres are fitted on ``sample`` vectors at most, or 16 a cell.
    """
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where("vec is not null")
    n = own.count()
    cells = max(1, math.ceil(4 * math.sqrt(n))) if cells is None else cells
    centres = fit_cells(own, cells, vec_col="vec", sample=max(sample, 16 * cells)) if n else np.empty((0, 0))
    places, parts = max(1, min(MOST_PARTS, n // PLACE)), max(1, min(len(centres), MOST_PARTS))
    path = f"{shared_dir(spark)}/tessera/inverted-{uuid.uuid4().hex}"
    kind = own.schema["id"].dataType.simpleString()
    coded = own.mapInPandas(_coded(centres, copies, parts), f"part int, cell int, id {kind}, step float, code binary")
    coded.repartition("part", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("part", "cell").write.partitionBy("part").parquet(f"{path}/codes")
    placed = own.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(places)).cast("int"))
    placed.repartition("place", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4))).write.partitionBy("place").parquet(f"{path}/vectors")
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return InvertedFile(read("codes", f"cell int, id {kind}, step float, code binary, part int"), read("vectors", f"id {kind}, vec {own.schema['vec'].dataType.simpleString()}, place int"), centres, places)


def _scan(asked: np.ndarray, looked: dict[int, np.ndarray], centres: np.ndarray, keep: int):
    """mapInPandas: codes -> (n, id, score), each question's best of a task."""

    def run(batches):
        best = Kept(len(asked), keep, once=True)  # a vector of two cells counts by its better code
        for pdf in batches:
            for cell, own in pdf.groupby("cell", sort=False):
                qs = looked.get(int(cell))
                if qs is None:
                    continue
                ids, step = own.id.to_numpy(), own.step.to_numpy()
                code = np.frombuffer(b"".join(own.code), np.int8).reshape(len(own), -1)
                centre = asked[qs] @ centres[cell]
                for t in tiles(len(own), len(qs)):
                    score = ((asked[qs] @ code[t].T.astype(np.float32)) * step[t][None, :] + centre[:, None]).astype(float)
                    least = best.least(0)[qs]
                    if score.shape[1] > keep:
                        least = np.maximum(least, np.partition(score, -keep, axis=1)[:, -keep])
                    q, at = np.nonzero(score >= least[:, None])
                    best.add(qs[q], 0, ids[t][at], score[q, at])
        kept = best.best()
        if kept is not None:
            yield pd.DataFrame({"n": kept.q.astype("int64"), "id": kept.id, "score": kept.score})

    return run


def candidates(index: InvertedFile, queries: DataFrame, keep: int, probes: int | None = None) -> DataFrame:
    """(qid, id, score): each question's ``keep`` best by code; the questions (qid, vec) are a block of at most QUERY_BLOCK.

    probes: into how many cells a question looks, PROBED of them, and 8 at least, if not given.
    """
    spark = queries.sparkSession
    rows = queries.where("vec is not null").select("qid", "vec").collect()
    kind = queries.schema["qid"].dataType.simpleString()
    id_kind = index.codes.schema["id"].dataType.simpleString()
    asked = _unit(np.array([r["vec"] for r in rows], float).reshape(len(rows), -1))
    probes = max(8, math.ceil(len(index.centres) * PROBED)) if probes is None else probes
    near = np.argsort(-(asked @ index.centres.T), axis=1, kind="stable")[:, :probes] if rows and len(index.centres) else np.empty((len(rows), 0), int)
    looked = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
    wanted = spark.createDataFrame([(c % index.parts, c) for c in looked], "part int, cell int")
    own = index.codes.join(F.broadcast(wanted), ["part", "cell"], "left_semi")  # cells of a block of questions; their partitions alone are read
    found = own.mapInPandas(_scan(asked.astype(np.float32), looked, index.centres.astype(np.float32), keep), f"n long, id {id_kind}, score double")
    best = found.groupBy("n", "id").agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "id"))
    named = spark.createDataFrame([(n, r["qid"]) for n, r in enumerate(rows)], f"n long, qid {kind}")
    return best.withColumn("nth", nth).where(F.col("nth") <= keep).join(F.broadcast(named), "n").select("qid", "id", "score")  # a block of questions


def inverted_topk(index: InvertedFile, queries: DataFrame, k: int, *, probes: int | None = None, rescored: int | None = None) -> DataFrame:
    """(qid, id, score, rank): the k of highest cosine among the ``rescored`` (3 k if not given) best by code; ties by id.

    Questions (qid, vec) are the stated set, taken in blocks.
    """
    spark, keep = queries.sparkSession, 3 * k if rescored is None else rescored
    n = queries.count()
    passes = max(1, -(-n // QUERY_BLOCK))
    path = f"{shared_dir(spark)}/tessera/inverted-search-{uuid.uuid4().hex}"
    for p in range(passes):
        block = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p)
        found = candidates(index, block, keep, probes).drop("score")
        found.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(index.places)).cast("int")).write.parquet(f"{path}/{p}")
    best = spark.read.parquet(*(f"{path}/{p}" for p in range(passes)))
    score = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    asked = queries.select("qid", normalized(F.col("vec")).alias("q"))
    own = best.join(index.vectors, ["place", "id"]).select("qid", "id", normalized(F.col("vec")).alias("v"))
    return _top(own.join(asked, "qid").select("qid", "id", F.round(score, 12).alias("score")), k)
