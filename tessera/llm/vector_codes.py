"""Product codes of vectors: codebooks by integer k-means, nearest entries by kd-trees.

A vector's components become integers floor(scale * x) and are cut into equal
consecutive parts; each part position has a codebook of its own.  A round
builds a kd-tree for every codebook on the driver and broadcasts them, a bounded
number of integers; tasks search them for all their parts at once and send home
the integer sums and counts of each entry, so that what is added up does not
depend on how rows are dealt.  Then entries move to floor(sum / count).

The search is branch and bound.  A part goes down the nearer side first; the
other side is left out only if its box is farther than the best entry so far,
so a side at the same distance is visited and, of entries at equal distance,
the one of the lowest index stays.

Nulls and edges: rows whose vector is null or holds a null, NaN or infinite
component are dropped.  The width is that of the first seed; a vector of
another width, or any if the width cannot be cut into equal parts, keeps its row
with a null code and a null error.  Seeds are the first ``entries`` rows by id
(null ids last, equal ids by their vectors); with fewer rows the codebooks
are smaller.  Repeated rows are coded and counted each.  Null labels are one
label.  Components beyond what 64-bit sums of squares allow (for 64 dimensions,
half a million) are taken at that bound.  An empty table gives an empty one.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.index import if_small
from .shared import Tables, map_arrow

LEAF = 6


class KdTree:
    """Nearest entries of one codebook for many integer points at once."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._grow(np.arange(len(entries)))

    def _grow(self, own: np.ndarray) -> tuple:
        """(low, high, entry numbers) of a leaf, (low, high, dimension, split, left, right) of a node."""
        at = self.entries[own]
        low, high = at.min(0), at.max(0)
        wide = int(np.argmax(high - low)) if at.shape[1] else 0
        if len(own) <= LEAF or not at.shape[1] or low[wide] == high[wide]:
            return low, high, np.sort(own)
        values = np.unique(at[:, wide])
        split = values[(len(values) - 1) // 2]
        below = at[:, wide] <= split
        return low, high, wide, split, self._grow(own[below]), self._grow(own[~below])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest entry of each point, the lowest of several, and its squared distance."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        number = np.full(len(points), len(self.entries))

        def visit(node: tuple, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if len(node) == 3:
                own = node[2]
                away = ((points[rows, None, :] - self.entries[own]) ** 2).sum(-1)
                least = away.argmin(1)
                away, found = away[np.arange(len(rows)), least], own[least]
                better = (away < best[rows]) | (away == best[rows]) & (found < number[rows])
                best[rows[better]], number[rows[better]] = away[better], found[better]
                return
            _, _, wide, split, left, right = node
            near = points[rows, wide] <= split
            a, b = rows[near], rows[~near]
            visit(left, a)
            visit(right, b)
            visit(right, a[_box(right, points[a]) <= best[a]])
            visit(left, b[_box(left, points[b]) <= best[b]])

        visit(self.root, np.arange(len(points)))
        return number, best


def _box(node: tuple, points: np.ndarray) -> np.ndarray:
    """Squared distance of each point to a node's box."""
    return (np.maximum(np.maximum(node[0] - points, points - node[1]), 0) ** 2).sum(1)


def _most(width: int) -> int:
    """Components within this bound keep every sum of squared differences below 2**62."""
    return 1 << (62 - max(1, width - 1).bit_length()) // 2 - 1


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    most = _most(values.shape[1])
    return np.clip(np.floor(values.astype(float) * scale), -most, most).astype(np.int64)


def _rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of this width, and their components."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == width)
    return at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), width)


def _nearest(trees: list[KdTree], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and squared distances, a column for each part."""
    step = whole.shape[1] // len(trees)
    found = [tree.nearest(whole[:, k * step : (k + 1) * step]) for k, tree in enumerate(trees)]
    return np.stack([n for n, _ in found], 1), np.stack([d for _, d in found], 1)


def _sums(trees: Broadcast, width: int, scale: int):
    """mapInArrow: (vec) -> (part, entry, n, total), one row for each entry in use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trees.value
        entries, step = len(own[0].entries), width // len(own)
        total, n = np.zeros((len(own), entries, step), np.int64), np.zeros((len(own), entries), np.int64)
        for batch in batches:
            whole = _integers(_rows(batch.column(0), width)[1], scale)
            numbers, _ = _nearest(own, whole)
            for k in range(len(own)):
                np.add.at(total[k], numbers[:, k], whole[:, k * step : (k + 1) * step])
                n[k] += np.bincount(numbers[:, k], minlength=entries)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    return run


def _codes(trees: Broadcast, width: int, scale: int):
    """mapInArrow: (vec_id, label, vec) -> (vec_id, label, code, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            if trees is not None and batch.num_rows:
                at, values = _rows(batch.column(2), width)
                numbers, away = _nearest(trees.value, _integers(values, scale))
                digits = numbers.astype(np.uint8).tobytes().hex()
                size = 2 * numbers.shape[1]
                code[at] = [digits[k * size : (k + 1) * size] for k in range(len(at))]
                error[at] = away.sum(1).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def is_whole(vec: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vec.isNotNull() & ~F.exists(vec.cast("array<double>"), odd)


def fit_codebooks(vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> list[np.ndarray]:
    """A codebook (entries x width / parts, integers) for each part of vectors (vec_id, vec), which are whole.

    None where no vector can be cut.  What reaches the driver is the seeds and,
    each round, a row for each entry.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code's digits tell 1 to 256 entries apart")
    order = F.col("vec_id").asc_nulls_last(), F.col("vec")
    first = vectors.orderBy(*order).limit(1).collect()
    width = len(first[0]["vec"]) if first else 0
    if not width or width % parts:
        return []
    same = vectors.where(F.size("vec") == width)
    seeds = np.array([r["vec"] for r in same.orderBy(*order).limit(entries).collect()], float)
    books = np.split(_integers(seeds, scale), parts, axis=1)
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        trees = context.broadcast([KdTree(b) for b in books])
        sent = map_arrow(same.select("vec"), _sums(trees, width, scale), "part int, entry int, n long, total array<long>")
        each = sent.select("part", "entry", "n", F.posexplode("total").alias("pos", "x")).groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        books = [b.copy() for b in books]
        for r in each.collect():  # entries x width rows at most
            books[r["part"]][r["entry"], r["pos"]] = r["x"] // r["n"]
        trees.unpersist()
    return books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Of all components as decimal numbers by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every whole vector.

    A label's errors are summed in tasks first, and the sums join the rows: by a
    broadcast while a count shows them to be few, else by a join that Spark splits.
    """
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec")).where(is_whole(F.col("vec")))
    books = fit_codebooks(own.select("vec_id", "vec"), parts=parts, entries=entries, rounds=rounds, scale=scale)
    width = sum(b.shape[1] for b in books)
    trees = vectors.sparkSession.sparkContext.broadcast([KdTree(b) for b in books]) if books else None
    kinds = dict(own.dtypes)
    coded = map_arrow(own, _codes(trees, width, scale), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    coded = Tables(vectors.sparkSession, "vector-codes").write(coded)
    totals = if_small(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "of")
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
