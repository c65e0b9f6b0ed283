"""Near-duplicate documents by HyperMinHash sketches, exactly verified.

Sketch (after Yu and Weber, "HyperMinHash", 2017): every bucket keeps the least
hash of the shingles that fall in it, as its count of leading zeros and the
``MANTISSA`` bits that follow.  Shingles are dealt to buckets again with other
hashes, round after round, until no bucket is empty (after Dahlgaard et al.,
"Fast Similarity Sketching", 2017): a bucket keeps its first round, so short
texts have full sketches and equal registers still mean what they mean for
MinHash.

Search.  Texts of equal shingle sets are one node, found by a 128-bit digest of
the set.  Registers are banded; a band's bytes are a bucket key.  In each bucket
all members of a like size are compared with one of them (a star), which is
linear in its size; the centre is the member whose buckets are fullest, which
among copies with changes is the text nearest to what they were made from.  Stars that verify are joined into components.  Where a bucket still has
members of several components, and only there, members of different components
are compared with each other, so no link is lost to the star: pair by pair in
small buckets, and in large ones by counting along shared shingles within
bounded blocks, which makes no pairs.  Before a
comparison of sets comes the estimate from the registers, corrected for
registers that agree by chance; it spares only pairs far below the threshold
(``MARGIN`` standard deviations).  A link is confirmed on the whole sets.

With 40 bands of 8 registers a pair at similarity 0.85 is missed with chance
3e-6, at 0.9 with 2e-10.

Nulls and edges: null texts and texts without words have the empty set, which
links with nothing; rows with a null id are returned as nodes of their own
(component null); repeated rows give repeated results; rows that share an id
are one node, compared by one of their texts; an empty table gives an empty result; columns
other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .packing import slices
from .shared import Tables, map_arrow
from .shingles import U, WordHashes, intersection, kept, mix, shingle_set

BANDS, ROWS, MANTISSA, ROUNDS = 40, 8, 10, 8
REGISTERS = BANDS * ROWS
MARGIN = 5.5
#: chance that two unrelated registers of sets of like size agree, times 2**MANTISSA (Yu and Weber, 2017)
CHANCE = 0.169919487159739093975315012348630288992889 * 4
#: members compared in one task with a copy of the node that they are compared with
CHUNK = 256
#: buckets of up to this many members are compared pair by pair, larger ones block by block
SMALL, BLOCK, BLOCK_SHINGLES = 16, 512, 2_000_000

def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case."""
    return kept("bytes", WordHashes).of((text or "").encode("utf-8", "replace").lower().split())


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of non-empty sets: one row of REGISTERS 16-bit numbers each."""
    m = REGISTERS
    empty = ~U(0)
    least = np.full(len(sets) * m, empty, U)
    stage = np.zeros(len(sets) * m, np.int8)
    for t in range(ROUNDS):
        todo = np.arange(len(sets)) if not t else np.flatnonzero((least.reshape(-1, m) == empty).any(1))
        if not len(todo):
            break
        x = np.concatenate([sets[i] for i in todo])
        row = np.repeat(todo * m, [len(sets[i]) for i in todo])
        h = mix(x, 100 + t)
        at = row + (h % U(m)).astype(np.int64)
        now = np.full_like(least, empty) if t else least
        np.minimum.at(now, at, mix(h, 7) >> U(1))
        if t:
            fill = least == empty
            least[fill] = now[fill]
            stage[fill & (now != empty)] = t
    # what is empty yet: the least over the whole set, by a hash for each bucket
    gaps = np.flatnonzero(least == empty)
    if len(gaps):
        size = np.array([len(s) for s in sets])
        doc = gaps // m
        for part in np.array_split(np.arange(len(gaps)), max(1, int(size[doc].sum() // 4_000_000))):
            if not len(part):
                continue
            own = doc[part]
            x = np.concatenate([sets[i] for i in own])
            bucket = np.repeat((gaps[part] % m).astype(U), size[own])
            h = mix(x ^ mix(bucket, 31), 500) >> U(1)
            least[gaps[part]] = np.minimum.reduceat(h, np.r_[0, np.cumsum(size[own])[:-1]])
        stage[gaps] = ROUNDS
    zeros = (62 - np.floor(np.log2(np.maximum(least, U(1)).astype(np.float64)))).clip(0, 62).astype(np.int64)
    body = (least << (zeros.astype(U) + U(2))) >> U(64 - MANTISSA)
    # two rounds never agree: the round is folded into the mantissa
    return ((zeros << MANTISSA) | (body.astype(np.int64) ^ (stage.astype(np.int64) * 37 % (1 << MANTISSA)))).astype("<u2").reshape(-1, m)


def estimated_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate of two sketches less the registers that agree by chance."""
    expected = CHANCE / (1 << MANTISSA)
    return max(0.0, (np.count_nonzero(a == b) / REGISTERS - expected) / (1 - expected))


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(word_hashes(t), width) for t in part.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                registers: list = [None] * len(sets)
                if full:
                    for i, r in zip(full, sketch([sets[i] for i in full])):
                        registers[i] = r.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([d and int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()), pa.array([d and int.from_bytes(d[8:], "little", signed=True) for d in digests], pa.int64()), pa.array(registers, pa.binary())],
                    ["doc_id", "n_shingles", "d1", "d2", "registers"],
                )

    return run


def _verifier(width: int, percent: int):
    """Streams rows (c, part, other, id, registers, text); a node comes before those compared with it."""
    j = percent / 100
    floor = j - MARGIN * (j * (1 - j) / REGISTERS) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, own, kept = None, None, None, {}
        for batch in batches:
            for part in slices(batch):
                us, vs = [], []
                for c, p, other, i, r, t in zip(*(part.column(k).to_pylist() for k in range(6))):
                    if (c, p) != group:
                        group, first, own, kept = (c, p), None, None, {}
                    regs = np.frombuffer(r, "<u2")
                    if not other:
                        first, own = regs, shingle_set(word_hashes(t), width)
                    elif first is not None and estimated_similarity(first, regs) >= floor:
                        s = shingle_set(word_hashes(t), width)
                        both = intersection(own, s)
                        if 100 * both >= percent * (len(own) + len(s) - both):
                            us.append(i)
                            vs.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int, tables: Tables) -> DataFrame:
    """The pairs (u, v) whose sets are as similar as asked.

    pairs: distinct, a written table.  A node v that many are compared with is
    copied once for every CHUNK of them, and each copy is a group of its own.
    """
    sizes = pairs.groupBy("v").agg(F.count("*").alias("n"))
    near = pairs.join(sizes, "v").select(F.col("v").alias("c"), F.pmod(F.xxhash64("u"), F.ceil(F.col("n") / CHUNK)).alias("part"), "u")
    near = tables.write(near)
    members = near.select("c", "part", F.lit(1).alias("other"), F.col("u").alias("id")).unionByName(near.select("c", "part", F.lit(0).alias("other"), F.col("c").alias("id")).distinct())
    rows = members.join(texts, "id").select("c", "part", "other", "id", "registers", "text")
    rows = rows.repartition("c", "part").sortWithinPartitions("c", "part", "other")
    links = tables.write(map_arrow(rows, _verifier(width, percent), "u long, v long"))
    tables.drop(near)
    return links


def _block_links(width: int, percent: int):
    """Streams rows (key, a, b, side, id, root, text): links between members of different components.

    A group is a block of a bucket, or two; intersections are counted along the
    postings of each shingle, so no pair is ever made.
    """

    def links(sets: list, ids: list, roots: list, sides: list, cross: bool) -> Iterator[tuple[int, int]]:
        size = np.array([len(s) for s in sets])
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        ids, roots, sides = np.array(ids), np.array(roots), np.array(sides)
        values, counts = np.unique(roots, return_counts=True)
        ask = sides == 0 if cross else roots != values[counts.argmax()]
        for x in np.flatnonzero(ask):
            low, high = np.searchsorted(token, sets[x], "left"), np.searchsorted(token, sets[x], "right")
            n = high - low
            at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            near = (100 * both >= percent * (size[x] + size - both)) & (roots != roots[x])
            if cross:
                near &= sides == 1
            for y in np.flatnonzero(near):
                yield int(ids[x]), int(ids[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, ([], [], [], [])

        def flush() -> pa.RecordBatch:
            found = list(links(*held, cross=group[1] != group[2])) if len(held[0]) > 1 else []
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])

        for batch in batches:
            for part in slices(batch):
                for key, a, b, side, i, root, text in zip(*(part.column(k).to_pylist() for k in range(7))):
                    if (key, a, b) != group:
                        if group is not None:
                            yield flush()
                        group = key, a, b
                    for x, value in zip(held, (shingle_set(word_hashes(text), width), i, root, side)):
                        x.append(value)
        if group is not None:
            yield flush()

    return run


def _within(rest: DataFrame, texts: DataFrame, width: int, percent: int, tables: Tables) -> DataFrame:
    """Links between members of different components of each bucket.

    A bucket of many members or long texts is cut into blocks by a hash of the
    id, and each pair of blocks is a group of its own: a group holds two blocks.
    """
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = rest.withColumn("blocks", blocks).withColumn("own", own).select("key", "id", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "id", "root")
    rows = dealt.join(texts.select("id", "text"), "id").select("key", "a", "b", "side", "id", "root", "text")
    rows = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return tables.write(map_arrow(rows, _block_links(width, percent), "u long, v long").distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their
    sets of ``width``-word shingles; a component's id is its smallest doc_id,
    and the document of that id is kept.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tables, results = Tables(docs.sparkSession, "neardup"), Tables(docs.sparkSession, "neardup-sets")
    whole = tables.write(map_arrow(rows, _sketches(width), "doc_id long, n_shingles long, d1 long, d2 long, registers binary"))
    own = results.write(whole.drop("registers"))
    least = results.write(own.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("id")))
    alike = whole.where("n_shingles > 0 and doc_id is not null")
    nodes = alike.join(least.withColumnRenamed("id", "doc_id"), ["d1", "d2", "doc_id"]).select(F.col("doc_id").alias("id"), "n_shingles", "registers")
    nodes = tables.write(nodes)
    tables.drop(whole)

    bands = nodes.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("registers"), b * 2 * ROWS + 1, F.lit(2 * ROWS))))).alias("key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = tables.write(bands.join(buckets, "key"))
    # a text that many others were made from is in their buckets more often than they are in each other's
    standing = tables.write(met.groupBy("id").agg(F.sum("size").alias("standing")).join(nodes.select("id", "n_shingles"), "id"))
    seated = tables.write(met.join(standing, "id"))
    tables.drop(met)
    texts = tables.write(rows.join(standing.select("id"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")).join(nodes.select("id", "registers"), "id"))
    tables.drop(nodes, standing)
    close = "100 * least(x.n_shingles, y.n_shingles) >= {p} * greatest(x.n_shingles, y.n_shingles)".format(p=percent)

    first = F.max_by(F.struct("id", "n_shingles"), F.struct("standing", -F.col("id")))
    centres = seated.groupBy("key").agg(first.alias("f")).select("key", "f.*")
    stars = seated.alias("x").join(centres.alias("y"), "key").where("x.id <> y.id").where(close).select(F.col("x.id").alias("u"), F.col("y.id").alias("v")).distinct()
    stars = tables.write(stars)
    links = _verified(stars, texts, width, percent, tables)
    found = connected_components(links)

    # buckets whose members are not all together yet: those of different components with each other
    many = seated.where("size > 2").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    split = many.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.sum("n_shingles").alias("weight")).where("a <> b").select("key", "weight")
    rest = tables.write(many.join(split, "key").select("key", "id", "root", "n_shingles", "size", "weight"))
    tables.drop(seated)
    few = rest.where(F.col("size") <= SMALL)
    across = (
        few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") > F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & F.expr(close))
        .select(F.col("x.id").alias("u"), F.col("y.id").alias("v")).distinct()
    )
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    across = tables.write(across.join(both, ["u", "v"], "left_anti"))
    more = _verified(across, texts, width, percent, tables).unionByName(_within(rest.where(F.col("size") > SMALL), texts, width, percent, tables))
    if not more.isEmpty():
        found = connected_components(links.unionByName(more))
    tables.clear()

    # rows of one set, or of one id, belong together: sets are nodes named by their smallest id
    sets = own.where("d1 is not null").join(least, ["d1", "d2"], "left").join(found.withColumnRenamed("node", "id"), "id", "left")
    # empty sets are linked with nothing: they meet no join, where their null keys would be one task's work
    named = sets.select("doc_id", "n_shingles", F.coalesce("root", "id").alias("root")).unionByName(own.where("d1 is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("root")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` less all but the first document of each component."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, width=width, percent=percent)
    gone = found.where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
