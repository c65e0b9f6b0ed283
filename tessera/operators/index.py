"""Lexical and vector indexes as tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import bm25_tokens
from ..session import ship

# Constants of Okapi BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: queries scored against all vectors in one pass; more take more passes
QUERY_BLOCK = 2048
#: products of vectors that a task has at once
TILE = 1 << 20
#: hits that wait to be sorted
HELD = 1 << 18
#: rows up to which a table of query tokens or weights is broadcast; a larger one is joined by a shuffle
BROADCAST_ROWS = 500_000


@dataclass
class Bm25Index:
    """tf (id, tok, f, dl), dl (id, dl), idf (tok, df, idf), stats (one row: n, avgdl).  Statistics are global."""

    tf: DataFrame
    dl: DataFrame
    idf: DataFrame
    stats: DataFrame

    def postings(self, tokens: DataFrame) -> DataFrame:
        """Those of ``tokens`` (tok, each once)."""
        return self.tf.join(if_small(tokens.select("tok")), "tok", "left_semi")

    def write(self, path: str) -> None:
        for name in ("tf", "dl", "idf", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark, path: str) -> "Bm25Index":
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("tf", "dl", "idf", "stats")))


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tok, f, dl) of each document's distinct tokens, counted where its text is read; tok is null for one without any."""
    toks = docs.select(F.col(id_col).alias("id"), F.array_sort(bm25_tokens(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("toks"))
    # in order, a token's count is from its first place to the next token's
    firsts = F.filter(F.sequence(F.lit(1), F.size("toks")), lambda i: (i == 1) | (F.get("toks", i - 1) != F.get("toks", i - 2)))
    cut = toks.withColumn("at", F.when(F.size("toks") > 0, firsts).otherwise(F.array().cast("array<int>")))
    each = cut.select("id", F.size("toks").cast("long").alias("dl"), "toks", "at", F.posexplode_outer("at").alias("k", "first"))
    count = F.coalesce(F.get("at", F.col("k") + 1), F.size("toks") + 1) - F.col("first")
    return each.select("id", F.get("toks", F.col("first") - 1).alias("tok"), F.coalesce(count, F.lit(1)).cast("long").alias("f"), "dl")


def build_bm25(docs: DataFrame, id_col: str, text_col: str, path: str | None = None) -> Bm25Index:
    """Documents without tokens count in n and avgdl.

    With a ``path`` the tables are written there step by step and read back: texts are
    cut into tokens once, and every later search starts from the postings.
    """
    spark = docs.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        if path is None:
            return df
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    counted = kept(token_counts(docs, id_col, text_col), "postings")
    tf = counted.where("tok is not null").select("id", "tok", "f", "dl")
    # a document's first row, whichever it is, stands for it
    dl = kept(counted.groupBy("id").agg(F.max("dl").alias("dl")), "dl")
    stats = kept(dl.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), "stats")
    df = kept(tf.groupBy("tok").agg(F.count("*").alias("df")), "frequencies")
    return Bm25Index(tf, dl, kept(inverse_frequencies(df, stats), "idf"), stats)


def inverse_frequencies(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(tok, df, idf) from (tok, df) and one row of (n, ...); what is negative becomes a share of the mean."""
    raw = df.crossJoin(F.broadcast(stats.select("n"))).select("tok", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))  # one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("tok", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # one row


def if_small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if a count shows that it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def bm25_scores(index: Bm25Index, queries: DataFrame) -> DataFrame:
    """(qid, id, score) of documents that hold a token of the query (qid, query); a repeated token counts again.

    The postings of the queries' tokens are dealt by id, so that a document's
    scores for all queries are summed where its postings are.  Whoever wants the
    best k alone asks ``impact_best``, which does not score every document.
    """
    toks = queries.select("qid", F.explode(bm25_tokens(F.col("query"))).alias("tok")).groupBy("qid", "tok").agg(F.count("*").alias("qf"))
    weights = if_small(toks.join(index.idf, "tok").select("qid", "tok", (F.col("qf") * F.col("idf")).alias("w")))
    hit = index.postings(toks.select("tok").distinct()).repartition("id").join(weights, "tok").crossJoin(F.broadcast(index.stats))
    part = F.col("w") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("qid", "id").agg(F.sum(part).alias("score"))


def bm25_topk(index: Bm25Index, queries: DataFrame, k: int, *, keep: DataFrame | None = None, best: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank): the k best for each query, ties by id, rank from 0.

    Documents without a token of the query score 0 and fill up k: of those only
    the k smallest ids can matter, so no more than k a query are added.  keep:
    ids that pass a filter, which comes after scoring; best: (qid, id, score) that
    hold each question's k best, such as ``impact_best`` finds them.
    """
    score = bm25_scores(index, queries) if best is None else best
    ids = index.dl.select("id")
    if keep is not None:
        score, ids = score.join(keep.select("id"), "id", "left_semi"), ids.join(keep.select("id"), "id", "left_semi")
    toks = queries.select("qid", F.explode(bm25_tokens(F.col("query"))).alias("tok")).distinct()
    # a document of the first k + hits is always among the k smallest without a hit; the sizes are k a query
    rest = ids.orderBy("id").limit(2 * k)
    held = index.postings(toks.select("tok").distinct()).select("id", "tok").join(F.broadcast(rest), "id", "left_semi").join(if_small(toks), "tok").select("qid", "id").distinct()  # 2k ids
    fill = rest.crossJoin(if_small(toks.select("qid").distinct())).join(held, ["qid", "id"], "left_anti").select("qid", "id", F.lit(0.0).alias("score"))
    return _top(_top(score, k).select("qid", "id", "score").unionByName(fill), k)


def _top(scores: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k best of each question; a limit on the bare row number is one that tasks apply before they shuffle."""
    w = Window.partitionBy(*(by or ["qid"])).orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def check_width(vectors: DataFrame, width: int, col: str = "embedding") -> DataFrame:
    """The same rows; a vector of another width fails the job."""
    return vectors.withColumn(col, F.when(F.size(col) == width, F.col(col)).otherwise(F.raise_error(F.concat(F.lit(f"expected {width} dimensions, got "), F.size(col).cast("string")))))


def normalized(c):
    """A vector over its length; a zero vector stays as it is."""
    return F.transform(F.array(F.transform(c, lambda x: x.cast("double"))), lambda v: F.transform(F.array(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))).getItem(0)).getItem(0)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", vec_col: str = "embedding", slot_col: str | None = None) -> DataFrame:
    """(qid, id, score, rank): the k of highest cosine for each query (qid, vec), ties by id.

    slot_col: with it the k best of each query and slot, (qid, slot, id, score, rank).

    Queries are the stated set.  A block of them is multiplied with vectors by
    tiles of bounded size; a task returns its k best a query, and the ranks are merged.
    """
    ship(vectors.sparkSession)
    rows = queries.select("qid", "vec").collect()
    rows.sort(key=lambda r: str(r["qid"]))
    parts = []
    by = ["qid"] if slot_col is None else ["qid", "slot"]
    own = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), (F.lit(0) if slot_col is None else F.col(slot_col)).cast("int").alias("slot")).where("slot is not null")
    qtype, itype = (df.schema[c].dataType.simpleString() for df, c in ((queries, "qid"), (own, "id")))
    for at in range(0, max(1, len(rows)), QUERY_BLOCK):
        block = rows[at : at + QUERY_BLOCK]
        ids = [r["qid"] for r in block]
        asked = _unit(np.array([r["vec"] for r in block], float).reshape(len(block), -1))
        parts.append(own.mapInPandas(_best(ids, asked, k), f"qid {qtype}, slot int, id {itype}, score double"))
    return _top(reduce(DataFrame.unionByName, parts).select(*by, "id", "score"), k, by)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def tiles(rows: int, width: int) -> Iterator[slice]:
    """Runs of rows whose matrix of ``width`` columns has about TILE numbers."""
    step = max(1, TILE // max(1, width))
    return (slice(at, at + step) for at in range(0, rows, step))


def nearest(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The first centre of highest product for each row."""
    found = [np.argmax(unit[t] @ centres.T, axis=1) for t in tiles(len(unit), len(centres))]
    return np.concatenate(found) if found else np.empty(0, np.int64)


class Kept:
    """The k best (q, slot, id, score) of each question and slot, ties by id, of hits that come in parts.

    ``least`` has the k-th score so far, below which a hit is too late; hits wait until
    there are HELD of them, or as many as are kept, and are then sorted once.
    """

    def __init__(self, questions: int, k: int, once: bool = False):
        self.questions, self.k, self.once = questions, k, once
        self.kept: pd.DataFrame | None = None
        self.wait, self.n = [], 0
        self.floor: dict[int, np.ndarray] = {}

    def least(self, slot: int) -> np.ndarray:
        return self.floor.setdefault(slot, np.full(self.questions, -np.inf))

    def add(self, q: np.ndarray, slot: int, ids: np.ndarray, score: np.ndarray) -> None:
        if len(q):
            self.wait.append(pd.DataFrame({"q": q.astype(np.int32), "slot": np.int32(slot), "id": ids, "score": score}))
            self.n += len(q)
            if self.n >= max(HELD, 0 if self.kept is None else len(self.kept)):
                self.best()

    def best(self) -> pd.DataFrame | None:
        if self.wait:
            every = pd.concat(self.wait if self.kept is None else [self.kept, *self.wait], ignore_index=True)
            self.wait, self.n = [], 0
            every = every.sort_values(["q", "slot", "score", "id"], ascending=[True, True, False, True])
            if self.once:  # an id that comes again counts by its best score
                every = every.drop_duplicates(["q", "slot", "id"])
            nth = every.groupby(["q", "slot"]).cumcount()
            self.kept = every[nth < self.k]
            last = every[nth == self.k - 1]
            for slot, own in last.groupby("slot"):
                self.least(int(slot))[own.q] = own.score
        return self.kept


def _best(ids: list, asked: np.ndarray, k: int):
    def run(batches):
        best = Kept(len(ids), k)
        for pdf in batches:
            pdf = pdf[pdf.vec.notna()]
            if not len(pdf) or not len(ids):
                continue
            # by slot, so that a tile has few of them
            pdf = pdf.sort_values("slot", kind="stable")
            unit, own, slots = _unit(np.array(pdf.vec.tolist(), float)), pdf.id.to_numpy(), pdf.slot.to_numpy()
            for t in tiles(len(pdf), len(ids)):
                # rounded so that a tile's shape does not change a score's last bits
                s = np.round(asked @ unit[t].T, 12)
                cuts = np.flatnonzero(np.diff(slots[t], prepend=slots[t][0] - 1))
                for a, b in zip(cuts, [*cuts[1:], s.shape[1]]):
                    part, slot = s[:, a:b], int(slots[t][a])
                    # the k best of each query and what ties with the last of them
                    least = best.least(slot)
                    if part.shape[1] > k:
                        least = np.maximum(least, np.partition(part, -k, axis=1)[:, -k])
                    q, at = np.nonzero(part >= least[:, None])
                    best.add(q, slot, own[t][a + at], part[q, at])
        kept = best.best()
        if kept is not None:
            yield pd.DataFrame({"qid": [ids[q] for q in kept.q], "slot": kept.slot.astype("int32"), "id": kept.id, "score": kept.score})

    return run


def fit_cells(vectors: DataFrame, cells: int, *, vec_col: str = "embedding", sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Unit centroids of spherical k-means over ``sample`` vectors at most, drawn by a hash of the vector."""
    n = vectors.where(F.col(vec_col).isNotNull()).count()
    share = min(1.0, sample / max(1, n))
    drawn = vectors.where(F.col(vec_col).isNotNull() & (F.pmod(F.xxhash64(vec_col), F.lit(1 << 30)) < int(share * (1 << 30)))).select(vec_col).limit(2 * sample)
    m = _unit(np.array(sorted(tuple(r[0]) for r in drawn.collect()), float))
    if not len(m):
        return np.empty((0, 0))
    centres = m[np.random.default_rng(1).choice(len(m), min(cells, len(m)), replace=False)]
    for _ in range(rounds):
        own = nearest(m, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
    return centres


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Old rows with those of a new key replaced or added; of several new ones the last by ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    last = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return old.join(last.select(key), key, "left_anti").unionByName(last)
