"""BM25 by impact-bounded posting blocks: what cannot reach the k-th score is skipped, and the result is exact.

Indexing reads every text once.  A task gathers its documents into shards of a
bounded number of documents and postings, numbers them in order of their ids, and
turns a shard's postings into blocks: one row for up to ``BLOCK`` postings of a
token, as arrays, with the range of their documents and the highest frequency
and least length among them, from which a bound of their scores follows under
any statistics.  One more row has the shard's documents.  The table is bucketed
by shard, so that a search has a shard's rows together without a shuffle, and
only these compact rows are ever shuffled, once, to write them.

A search scores a shard's postings for one question after another, highest
bound first.  The k-th score so far only rises.  A block is skipped where the best
document in its range, the block's bound and the bounds of the tokens still to come
together stay below it; in other blocks the postings of documents that stay below
it are.  What leaves a task is k rows a question and shard.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import bm25_tokens
from ..session import shared_dir, ship
from .index import B, K1, QUERY_BLOCK, Bm25Index, if_small, inverse_frequencies

BLOCK = 128
SHARD_DOCUMENTS, SHARD_POSTINGS = 8192, 2_000_000
MOST_BUCKETS = 4096
#: what two sums of the same scores in another order may differ by
SLACK = 1e-9
TOKEN = re.compile(rb"[A-Za-z0-9']+")


@dataclass
class ImpactIndex:
    """shards (bucket, shard, tok, lo, hi, most, least, no, f, docs), and idf and stats as in a ``Bm25Index``.

    A row of null tok has a shard's documents: docs is an array of (id, dl, carried).
    """

    shards: DataFrame
    idf: DataFrame
    stats: DataFrame

    def documents(self) -> DataFrame:
        """(bucket, shard, no, id, dl, carried) of every document."""
        return self.shards.where("tok is null").select("bucket", "shard", F.posexplode("docs").alias("no", "d")).select("bucket", "shard", "no", "d.id", "d.dl", "d.carried")

    def postings(self, tokens: DataFrame | None = None) -> DataFrame:
        """(id, tok, f, dl) of all tokens or of those in ``tokens`` (tok); blocks and documents meet by bucket, without a shuffle."""
        own = self.shards.where("tok is not null")
        if tokens is not None:
            own = own.join(tokens, "tok", "left_semi")
        each = own.select("bucket", "shard", "tok", F.inline(F.arrays_zip("no", "f")))
        return each.join(self.documents(), ["bucket", "shard", "no"]).select("id", "tok", "f", "dl")

    def whole(self) -> Bm25Index:
        """The same index as plain tables of postings and lengths, read from the blocks."""
        return _Blocks(self)


class _Blocks(Bm25Index):
    def __init__(self, impact: ImpactIndex):
        super().__init__(impact.postings(), impact.documents().select("id", "dl"), impact.idf, impact.stats)
        self.impact = impact

    def postings(self, tokens: DataFrame) -> DataFrame:
        return self.impact.postings(if_small(tokens.select("tok")))


class _Shard:
    """A task's documents and postings until there are enough of them."""

    def __init__(self, kind: pa.DataType, carried: pa.DataType):
        self.kind, self.carried = kind, carried
        self.clear()

    def clear(self) -> None:
        self.ids, self.dl, self.more, self.codes = [], [], [], {}
        self.tok, self.f, self.n = array("i"), array("i"), []

    @property
    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCUMENTS or len(self.tok) >= SHARD_POSTINGS

    def add(self, i, text: bytes | None, more) -> None:
        words = [w.lower() for w in TOKEN.findall(text or b"")]
        own = Counter(words)
        self.ids.append(i)
        self.dl.append(len(words))
        self.more.append(more)
        self.tok.extend([self.codes.setdefault(w, len(self.codes)) for w in own])
        self.f.extend(own.values())
        self.n.append(len(own))

    def rows(self, shard: int) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] if self.ids[k] is not None else 0, k))
        # numbers of postings are of 32 bits, and none but these arrays is as long as the postings
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        no = np.repeat(place, self.n)
        by = np.lexsort((no, np.frombuffer(self.tok, np.int32)))
        no, tok, f = no[by], np.frombuffer(self.tok, np.int32)[by], np.frombuffer(self.f, np.int32)[by]
        del by
        dl = np.array(self.dl, np.int64)[order]
        # a block starts with a token and every BLOCK postings after
        first = np.flatnonzero(np.diff(tok, prepend=np.int32(-1))) if len(tok) else np.empty(0, np.int64)
        blocks = -(-np.diff(np.append(first, len(tok))) // BLOCK)
        starts = np.repeat(first, blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        ends = np.append(starts[1:], len(tok))
        words = np.array(list(self.codes), object)
        n = len(starts)
        offsets = pa.array(np.append(starts, [len(tok)] * 2 if n else [0, 0]), pa.int32())
        docs = pa.StructArray.from_arrays([pa.array([self.ids[k] for k in order], self.kind), pa.array(dl), pa.array([self.more[k] for k in order], self.carried)], ["id", "dl", "carried"])
        reduced = lambda f, x: np.append(f.reduceat(x, starts), 0) if n else np.zeros(1, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + 1, shard)),
                pa.array([w.decode() for w in words[tok[starts]]] + [None], pa.string()),
                pa.array(np.append(no[starts], 0), pa.int32()),
                pa.array(np.append(no[ends - 1] if n else [], 0).astype(np.int32)),
                pa.array(reduced(np.maximum, f).astype(np.int32)),
                pa.array(reduced(np.minimum, dl.astype(np.int32)[no]).astype(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(no)),
                pa.ListArray.from_arrays(offsets, pa.array(f)),
                pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(order)], pa.int32()), docs),
            ],
            ["shard", "tok", "lo", "hi", "most", "least", "no", "f", "docs"],
        )


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (id, text, carried) -> the rows of this task's shards."""
    task, k, held = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        held = held or _Shard(batch.column(0).type, batch.column(2).type)
        for i, text, more in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
            held.add(i, text.as_py(), more)
            if held.full:
                yield held.rows((task << 24) + k)
                held.clear()
                k += 1
    if held is not None and held.ids:
        yield held.rows((task << 24) + k)


def build_impact(docs: DataFrame, id_col: str, text_col: str, path: str, *, carried: dict[str, Column] | None = None) -> ImpactIndex:
    """Index documents, one row an id, below ``path``; carried: columns for filters by name.

    A document without tokens counts in the statistics.  Very long texts end a shard early.
    """
    spark, table = docs.sparkSession, f"tessera_impact_{uuid.uuid4().hex}"
    ship(spark)
    buckets = max(1, min(MOST_BUCKETS, -(-docs.count() // SHARD_DOCUMENTS)))
    more = F.struct(*(c.alias(name) for name, c in (carried or {"none": F.lit(None).cast("int")}).items()))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), more.alias("carried"))
    kind, inner = (own.schema[c].dataType.simpleString() for c in ("id", "carried"))
    rows = own.mapInArrow(_gather, f"shard long, tok string, lo int, hi int, most int, least long, no array<int>, f array<int>, docs array<struct<id: {kind}, dl: bigint, carried: {inner}>>")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("shard"), F.lit(buckets)).cast("int"))
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "shard", "tok", "lo").write.bucketBy(buckets, "bucket").sortBy("bucket", "shard", "tok", "lo").option("path", f"{path}/shards").saveAsTable(table)
    shards = spark.table(table)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    lengths = shards.where("tok is null").select(F.explode("docs.dl").alias("dl"))
    stats = kept(lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), "stats")
    df = kept(shards.where("tok is not null").groupBy("tok").agg(F.sum(F.size("no")).alias("df")), "frequencies")
    return ImpactIndex(shards, kept(inverse_frequencies(df, stats), "idf"), stats)


def _gain(f: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))


class ShardSearch:
    """The k best documents of a shard for each question; postings and scored tell how many there were and were read."""

    def __init__(self, dl: np.ndarray, slot: np.ndarray, avgdl: float, k: int):
        self.dl, self.slot, self.avgdl, self.k = dl, slot, avgdl, k
        self.members = {int(s): np.flatnonzero(slot == s) for s in np.unique(slot[slot >= 0])}
        self.postings = self.scored = 0

    def _reached(self, score: np.ndarray, seen: np.ndarray) -> float:
        """The lowest of the slots' k-th scores."""
        out = np.inf
        for own in self.members.values():
            held = score[own[seen[own]]]
            if len(held) < self.k:
                return -np.inf
            out = min(out, np.partition(held, -self.k)[-self.k])
        return out

    def best(self, tokens: list[tuple[float, list[tuple]]]) -> list[tuple[int, int, float]]:
        """(slot, document, score).  tokens: (weight, blocks of (lo, hi, most, least, no, f))."""
        score, seen = np.zeros(len(self.dl)), np.zeros(len(self.dl), bool)
        bounds = [[max(0.0, w) * _gain(b[2], b[3], self.avgdl) for b in blocks] for w, blocks in tokens]
        order = sorted(range(len(tokens)), key=lambda t: -max(bounds[t]))
        rest = sum(max(bounds[t]) for t in order)
        falls = any(w < 0 for w, _ in tokens)  # then scores may go down again and nothing is skipped
        reached = -np.inf
        for t in order:
            w, blocks = tokens[t]
            rest -= max(bounds[t])
            for (lo, hi, _, _, no, f), bound in zip(blocks, bounds[t]):
                self.postings += len(no)
                if reached > -np.inf:
                    least = reached - SLACK * (1 + abs(reached)) - bound - rest
                    if score[lo : hi + 1].max() < least:
                        continue
                    if least > 0:  # new documents come too late, and of those met only some can still win
                        wins = score[no] >= least
                        no, f = no[wins], f[wins]
                self.scored += len(no)
                score[no] += w * _gain(f, self.dl[no], self.avgdl)
                seen[no] = True
            if not falls:
                reached = self._reached(score, seen)
        out = []
        for s, own in self.members.items():
            held = own[seen[own]]
            # documents are in order of their ids; scores that differ by rounding alone are ties
            if len(held) > self.k:
                held = held[np.lexsort((held, -np.round(score[held], 9)))[: self.k]]
            out += [(s, int(d), float(score[d])) for d in held]
        return out


def _search(asked: dict, avgdl: float, k: int, counts: bool):
    """applyInArrow for a shard: asked is token -> [(question's number, weight)]."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        names = rows.column("tok").to_pylist()
        docs = rows.column("docs").combine_chunks().flatten()
        slot, ids = (docs.field(docs.type.get_field_index(c)) for c in ("slot", "id"))
        search = ShardSearch(docs.field(docs.type.get_field_index("dl")).to_numpy(zero_copy_only=False).astype(float), slot.to_numpy(zero_copy_only=False), avgdl, k)
        column = lambda c: rows.column(c).combine_chunks()
        at = np.concatenate([[0], np.cumsum(column("no").value_lengths().fill_null(0).to_numpy())])
        no, f = (column(c).flatten().to_numpy() for c in ("no", "f"))
        f = f.astype(float)
        by_token: dict[str, list[tuple]] = {}
        for i, (tok, lo, hi, most, least) in enumerate(zip(names, *(rows.column(c).to_pylist() for c in ("lo", "hi", "most", "least")))):
            if tok is not None:
                by_token.setdefault(tok, []).append((lo, hi, most, least, no[at[i] : at[i + 1]], f[at[i] : at[i + 1]]))
        questions: dict[int, list[tuple]] = {}
        for tok, own in by_token.items():
            for q, w in asked[tok]:
                questions.setdefault(q, []).append((w, own))
        found = [(q, *hit) for q, tokens in questions.items() for hit in search.best(tokens)]
        if counts:
            return pa.table({"shard": pa.array([key[1].as_py()], pa.int64()), "postings": pa.array([search.postings], pa.int64()), "scored": pa.array([search.scored], pa.int64())})
        return pa.table({"n": pa.array([q for q, *_ in found], pa.int64()), "slot": pa.array([s for _, s, _, _ in found], pa.int64()), "id": ids.take(pa.array([d for _, _, d, _ in found], pa.int64())), "score": pa.array([x for *_, x in found], pa.float64())})

    return run


def _block(impact: ImpactIndex, queries: DataFrame, k: int, slot: Callable[[Column], Column], counts: bool) -> DataFrame:
    """One block of questions against all shards."""
    spark = queries.sparkSession
    ship(spark)
    weights = queries.select("qid", F.explode(bm25_tokens(F.col("query"))).alias("tok")).groupBy("qid", "tok").agg(F.count("*").alias("qf")).join(impact.idf, "tok").select("qid", "tok", (F.col("qf") * F.col("idf")).alias("w")).collect()  # of a block of questions
    number = {q: n for n, q in enumerate(sorted({r["qid"] for r in weights}, key=str))}
    asked: dict[str, list] = {}
    for r in weights:
        asked.setdefault(r["tok"], []).append((number[r["qid"]], r["w"]))
    kind_q, kind_id = queries.schema["qid"].dataType.simpleString(), impact.shards.schema["docs"].dataType.elementType["id"].dataType.simpleString()
    named = spark.createDataFrame([(n, q) for q, n in number.items()], f"n long, qid {kind_q}")
    wanted = spark.createDataFrame([(t,) for t in asked] + [(None,)], "wanted string")
    stats = impact.stats.first()
    own = impact.shards.join(F.broadcast(wanted), F.col("tok").eqNullSafe(F.col("wanted")), "left_semi")  # tokens of a block of questions, and the documents
    docs = F.transform("docs", lambda d: F.struct(d["id"].alias("id"), d["dl"].alias("dl"), F.coalesce(slot(d["carried"]).cast("long"), F.lit(-1)).alias("slot")))
    own = own.withColumn("docs", F.when(F.col("tok").isNull(), docs))
    schema = "shard long, postings long, scored long" if counts else f"n long, slot long, id {kind_id}, score double"
    met = own.groupBy("bucket", "shard").applyInArrow(_search(asked, float(stats["avgdl"] or 1.0), k, counts), schema)
    return met if counts else met.join(F.broadcast(named), "n").select("qid", "slot", "id", "score")  # a block of questions


def impact_best(impact: ImpactIndex, queries: DataFrame, k: int, *, slot: Callable[[Column], Column] | None = None, counts: bool = False) -> DataFrame:
    """(qid, slot, id, score): each question's k best documents of every shard and slot, among which are its k best of all.

    slot: from a document's carried columns a non-negative number by which the best
    are told apart (a decade, say); a document without one is left out.  Scores
    are those of all documents' statistics.  Questions (qid, query) are the
    stated set: beyond QUERY_BLOCK of them each block is a pass whose rows
    are written to the shared folder.  counts: (shard, postings, scored) instead.
    """
    slot = slot or (lambda c: F.lit(0))
    n = queries.count()
    if n <= QUERY_BLOCK:
        return _block(impact, queries, k, slot, counts)
    passes = -(-n // QUERY_BLOCK)
    path, spark = f"{shared_dir(queries.sparkSession)}/tessera/impact-{uuid.uuid4().hex}", queries.sparkSession
    for p in range(passes):
        part = _block(impact, queries.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p), k, slot, counts)
        part.write.parquet(f"{path}/pass={p}")
    return spark.read.schema(part.schema).parquet(*(f"{path}/pass={p}" for p in range(passes)))
