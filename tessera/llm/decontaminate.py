"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents may be long, so the Jaccard similarity of an
item and a document that holds it is near zero and a fixed sketch would miss
it.  As in LSH Ensemble (Zhu et al., 2016), documents are partitioned by size
and the containment threshold is turned into a search suited to each
partition's upper size: partition p holds documents of up to 2**p shingles and
uses a one-permutation MinHash of ``OVERSAMPLE`` * 2**p buckets, each with the
least hash that falls in it, banded by single buckets.  An item is sketched at
the resolution of every partition.  A shingle that item and document share is
the least of its bucket on both sides with chance 0.88 at least, so an item of
which a document holds 8 shingles is missed with chance 4e-8; agreeing buckets
over the item's buckets estimate the containment.  Each candidate is verified:
an item is reported where at least ``percent`` hundredths of its distinct
shingles occur in the document, counted exactly.

Items are the stated query set.  Their sketches go to the executors in blocks
of at most ``block_shingles`` shingles (hash and place: about 16 bytes each and
partition in use), one pass over the documents a block; nothing else is
broadcast, and nothing is shuffled.

Items of which a document need hold fewer than ``SKETCHED`` shingles are not left
to that chance: their shingles are keys themselves, every shingle of a document
is looked up, and none is missed.

Words are runs of letters and digits in any case and script, so marks and
spacing do not hide a passage.  Nulls and edges: null or empty texts, and items
of fewer than ``width`` words, have no shingles and match nothing; repeated
items and documents are each reported; an empty table on either side gives an
empty result; columns other than those named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .packing import slices
from .shared import map_arrow
from .shingles import U, WordHashes, grams, kept, mix

WORD = re.compile(r"[^\W_]+")
OVERSAMPLE = 4
#: shingles that must be shared for the sketches to be relied on
SKETCHED = 8

def text_shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of the ``width``-word shingles, sorted; too few words: none."""
    return np.unique(grams(kept("text", WordHashes).of(WORD.findall((text or "").lower())), width))


def size_partition(n: int) -> int:
    """The least p with 2**p >= n."""
    return max(0, int(n - 1).bit_length())


def minhash(shingles: np.ndarray, partition: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, least hash) of the buckets that hold a shingle, at a partition's resolution."""
    x = mix(shingles, 3)
    bits = partition + OVERSAMPLE.bit_length() - 1
    bucket = x >> U(64 - bits)
    order = np.argsort(x)  # buckets in order, and the least hash of each first
    bucket, least = bucket[order], x[order]
    first = np.r_[True, bucket[1:] != bucket[:-1]] if len(x) else np.empty(0, bool)
    return bucket[first], least[first]


class ItemIndex:
    """Sketches and shingle sets of a block of items."""

    def __init__(self, ids: list, sets: list[np.ndarray], percent: int):
        self.ids, self.sets = ids, sets
        self.partitions: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.exact = np.array([-(-percent * len(s) // 100) < SKETCHED for s in sets], bool)
        few = [i for i in range(len(sets)) if self.exact[i]]
        self.filter = self._filter([s for i, s in enumerate(sets) if not self.exact[i]])  # passes every least hash of an item
        self.few_filter = self._filter([sets[i] for i in few])
        keys = mix(np.concatenate([sets[i] for i in few]), 3) if few else np.empty(0, U)
        order = np.argsort(keys, kind="stable")
        self.few = keys[order], np.repeat(np.array(few, np.int64), [len(sets[i]) for i in few])[order]

    @staticmethod
    def _filter(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(1 << 22, bool)
        if sets:
            out[(mix(np.concatenate(sets), 3) & U((1 << 22) - 1)).astype(np.int64)] = True
        return out

    def at(self, partition: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted least hashes of all items' buckets, and whose they are."""
        if partition not in self.partitions:
            least, owner = [], []
            for i in np.flatnonzero(~self.exact):
                s = self.sets[i]
                _, h = minhash(s, partition)
                least.append(h)
                owner.append(np.full(len(h), i))
            least, owner = (np.concatenate(least), np.concatenate(owner)) if least else (np.empty(0, U), np.empty(0, np.int64))
            order = np.argsort(least, kind="stable")
            self.partitions[partition] = least[order], owner[order]
        return self.partitions[partition]

    def candidates(self, shingles: np.ndarray) -> list[tuple[int, float]]:
        """(item, estimated containment) of the items that agree with the document in a bucket."""
        if not len(shingles) or not self.sets:
            return []
        found = np.zeros(len(self.sets), np.int64)
        if len(self.few[0]):
            found += self._owners(mix(shingles, 3), self.few_filter, *self.few)
        if not self.exact.all():
            p = size_partition(len(shingles))
            # equal least hashes are in equal buckets: the bucket is the hash's upper bits
            found += self._owners(minhash(shingles, p)[1], self.filter, *self.at(p))
        return [(i, found[i] / len(self.sets[i])) for i in np.flatnonzero(found)]

    def _owners(self, hashes: np.ndarray, passes: np.ndarray, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """How many of the hashes are keys of each item."""
        hashes = hashes[passes[(hashes & U((1 << 22) - 1)).astype(np.int64)]]
        low, high = np.searchsorted(keys, hashes, "left"), np.searchsorted(keys, hashes, "right")
        hits = high - low
        if not hits.any():
            return np.zeros(len(self.sets), np.int64)
        at = np.repeat(low - np.r_[0, np.cumsum(hits)[:-1]], hits) + np.arange(hits.sum())
        return np.bincount(owner[at], minlength=len(self.sets))

    def verified(self, text: str | None, width: int, percent: int) -> list[tuple[int, int, float]]:
        """(item, shingles found, estimate) of the items that the text holds."""
        own, out = text_shingles(text, width), []
        for i, guess in self.candidates(own):
            at = np.searchsorted(own, self.sets[i])
            at[at == len(own)] = 0
            n = int(np.count_nonzero(own[at] == self.sets[i]))
            if 100 * n >= percent * len(self.sets[i]):
                out.append((i, n, min(1.0, guess)))
        return out


def _search(ids: list, sets: list[np.ndarray], width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(ids, sets, percent)
        for batch in batches:
            for part in slices(batch):
                hits = [(k, i, n, guess) for k, t in enumerate(part.column(1).to_pylist()) for i, n, guess in index.verified(t, width, percent)]
                rows, items, founds, guesses = zip(*hits) if hits else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array([ids[i] for i in items], pa.int64()), pa.array([len(sets[i]) for i in items], pa.int64()), pa.array(founds, pa.int64()), pa.array(guesses, pa.float64())],
                    ["doc_id", "item_id", "n_shingles", "n_found", "estimate"],
                )

    return run


def _clean(column: int, ids: list, sets: list[np.ndarray], width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(ids, sets, percent)
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([not index.verified(t, width, percent) for t in part.column(column).to_pylist()], pa.bool_()))

    return run


def _blocks(items: DataFrame, id_col: str, text_col: str, width: int, block_shingles: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The items with their shingles, in blocks of at most so many (an item alone may have more)."""
    asked = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # a word has two characters with its space at least: the bound of a block holds for any text
    total = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (2 * block_shingles)))
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else asked
        ids, sets = [], []
        for r in sorted(block.collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"])):
            s = text_shingles(r["text"], width)
            if len(s):
                ids.append(r["item_id"])
                sets.append(s)
        yield ids, sets


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = 5, percent: int = 80, block_shingles: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, estimate) of every item found in a document."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {kind}, item_id long, n_shingles long, n_found long, estimate double"
    return reduce(DataFrame.unionByName, (map_arrow(rows, _search(*block, width, percent), schema) for block in _blocks(items, item_id_col, item_text_col, width, block_shingles)))


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = 5, percent: int = 80, block_shingles: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their columns as they were."""
    for block in _blocks(items, item_id_col, item_text_col, width, block_shingles):
        docs = map_arrow(docs, _clean(docs.columns.index(text_col), *block, width, percent), docs.schema)
    return docs
