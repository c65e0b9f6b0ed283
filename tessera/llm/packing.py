"""Best-fit packing of tokenised documents after dominance reduction.

Documents are cut into pieces of at most ``capacity`` tokens.  How to pack
them depends only on how many pieces there are of each length, so the plan is
made from that histogram: at most ``capacity`` numbers, whatever the corpus.

* Reduction (after Martello and Toth, 1990): a set of lengths dominates when
  every other way to fill its largest member's sequence can be exchanged for
  it without needing more sequences.  Fixed for good, whole multiplicities at
  a time, are: a length that nothing else fits beside; a pair that fills a
  sequence exactly; a pair whose second member is the largest that fits, when
  no two others fit, or no two that fit together exceed it and no three fit.
  What remains shrinks, and the rules are tried again until none applies.
* The remainder is packed best-fit decreasing, on groups of equal sequences.

The plan is a list of patterns (a few runs of lengths) with multiplicities.
Its size is bounded by the capacity: every length splits at most two groups,
and a pattern has fewer than sqrt(2 * capacity) runs.  A piece finds its place
by its rank among the pieces of its length.  Ranks come from a count kept
within each task and the sums over earlier tasks, so a length that a third of
the pieces share is ranked in parallel.

Nulls and edges: a null or empty text is the end token alone; repeated rows are
packed as often as they occur; an empty table packs to an empty table; other
columns of the input are not read.  A token stream longer than the capacity is
cut every ``capacity`` tokens and nowhere else.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .shared import map_arrow, materialize

Pattern = tuple[tuple[int, int], ...]


def reduce_dominated(counts: Counter, capacity: int) -> tuple[list[tuple[Pattern, int]], Counter]:
    """Patterns that can be fixed without loss, and the lengths that remain."""
    left = Counter({w: c for w, c in counts.items() if c > 0})
    fixed: list[tuple[Pattern, int]] = []

    def take(w: int, k: int | None, times: int) -> None:
        fixed.append((((w, 1),) if k is None else ((w, 2),) if k == w else ((w, 1), (k, 1)), times))
        for x in (w,) if k is None else (w, k):
            left[x] -= times
            if not left[x]:
                del left[x]

    changed = True
    while changed:
        changed = False
        for w in sorted(left, reverse=True):
            while left.get(w):
                room = capacity - w
                lengths = sorted(left)
                smallest = _smallest(lengths, left, w, 3)
                if not smallest or smallest[0] > room:
                    take(w, None, left[w])
                    changed = True
                    continue
                k = _largest(lengths, left, w, room)
                few = len(smallest) < 2 or smallest[0] + smallest[1] > room
                pairs = not few and (len(smallest) < 3 or sum(smallest) > room) and _best_pair(lengths, left, w, room) <= k
                if k != room and not few and not pairs:
                    break
                take(w, k, left[w] // 2 if k == w else min(left[w], left[k]))
                changed = True
    return fixed, left


def _smallest(lengths: list[int], left: Counter, w: int, n: int) -> list[int]:
    """The n smallest members other than one w."""
    out: list[int] = []
    for x in lengths:
        out += [x] * min(n, left[x] - (x == w))
        if len(out) >= n:
            break
    return out[:n]


def _largest(lengths: list[int], left: Counter, w: int, room: int) -> int:
    i = bisect_right(lengths, room) - 1
    return lengths[i - 1] if lengths[i] == w and left[w] == 1 else lengths[i]


def _best_pair(lengths: list[int], left: Counter, w: int, room: int) -> int:
    """The largest sum within room of two members other than one w."""
    free = [x for x in lengths if left[x] > (x == w)]
    best, i, j = 0, 0, len(free) - 1
    while i <= j:
        a, b = free[i], free[j]
        if a + b > room or (i == j and left[a] - (a == w) < 2):
            j -= 1
            continue
        best = max(best, a + b)
        i += 1
    return best


def best_fit_decreasing(counts: Counter, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit of the lengths in decreasing order, on groups of equal sequences."""
    groups: dict[int, list[tuple[Pattern, int]]] = {}
    mask = 0  # bit r: there is a group with r tokens of room

    def add(room: int, pattern: Pattern, times: int) -> None:
        nonlocal mask
        if times:
            groups.setdefault(room, []).append((pattern, times))
            mask |= 1 << room

    for w in sorted(counts, reverse=True):
        c = counts[w]
        while c:
            fits = mask >> w
            if not fits:
                k = capacity // w
                add(capacity - k * w, ((w, k),), c // k)
                if c % k:
                    add(capacity - c % k * w, ((w, c % k),), 1)
                break
            room = w + (fits & -fits).bit_length() - 1
            pattern, times = groups[room].pop()
            if not groups[room]:
                mask ^= 1 << room
            k = room // w
            full = min(times, c // k)
            add(room - k * w, (*pattern, (w, k)), full)
            c -= full * k
            if full < times:
                add(room - c * w, (*pattern, (w, c)) if c else pattern, 1)
                add(room, pattern, times - full - 1)
                c = 0
    return [x for found in groups.values() for x in found]


def plan_sequences(counts: Counter, capacity: int) -> list[tuple[Pattern, int]]:
    """(pattern, multiplicity); a pattern is runs of (length, how many)."""
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit_decreasing(rest, capacity)


def _places(plan: Iterable[tuple[Pattern, int]]) -> np.ndarray:
    """Rows of length, first rank, first sequence, offset, run; ordered by the first two."""
    used: Counter = Counter()
    rows, base = [], 0
    for pattern, times in plan:
        offset = 0
        for w, k in pattern:
            rows.append((w, used[w], base, offset, k))
            used[w] += times * k
            offset += w * k
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _pieces(tokenizer_path: str | None, capacity: int, end_id: int, with_ids: bool):
    """mapInArrow: (doc_id, text) -> pieces with their rank in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .word_ids import word_ids

        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        words, end = word_ids(path), np.array([end_id], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for part in slices(batch):
                docs, texts = part.column(0), part.column(1).to_pylist()
                row, piece, start, length, crc, rank, kept = [], [], [], [], [], [], []
                for i, ids in enumerate(words.encode(texts)):
                    ids += end
                    for p in range(0, len(ids), 4 * capacity):
                        own = ids[p : p + 4 * capacity]
                        n = len(own) // 4
                        row.append(i)
                        piece.append(p // (4 * capacity))
                        start.append(p // 4)
                        length.append(n)
                        crc.append(zlib.crc32(own))
                        rank.append(seen[n])
                        seen[n] += 1
                        if with_ids:
                            kept.append(own)
                columns = [docs.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(row), pa.int64()), pa.array(rank, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                if with_ids:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("ids_le32")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def slices(batch: pa.RecordBatch, text_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so much data each, one row at least."""
    if batch.num_rows:
        step = max(1, int(batch.num_rows * text_bytes / max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def _seat(places: np.ndarray):
    """mapInArrow: adds sequence_id and offset to ranked pieces."""
    wide = 48  # ranks stay below 2**48
    keys = (places[:, 0] << wide) + places[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = places[np.searchsorted(keys, (length << wide) + rank, "right") - 1]
            nth = rank - at[:, 1]
            seat = [pa.array(at[:, 2] + nth // at[:, 4]), pa.array(at[:, 3] + nth % at[:, 4] * length)]
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + seat, [*keep, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids_le32]) for every piece.

    The tokenizer file is read where the tasks run; None takes the installed
    public one.  ``with_ids`` adds the ids as little-endian 32-bit bytes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task long, nth long" + ", ids_le32 binary" * with_ids
    ranked = map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), _pieces(tokenizer_path, capacity, end_id, with_ids), schema)
    pieces = materialize(ranked, "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(by_task.select("length", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")), "piece-ranks")
    histogram = Counter({r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()})  # at most ``capacity`` rows
    places = _places(plan_sequences(histogram, capacity))
    rows = pieces.join(starts.drop("n"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids_le32"] * with_ids), (F.col("earlier") + F.col("nth")).alias("rank"))
    return map_arrow(rows, _seat(places), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids_le32 binary" * with_ids + ", sequence_id long, offset long")
