"""Ranking operators over (qid, src, id, rank, score) tables.  Ranks count from 0."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import bm25_tokens, dedup_tokens

# The fusion constant, and the similarities from which a hit repeats another.
RRF_K, JACCARD, CONTAINED = 60, 0.85, 0.92
STRATEGIES = ("naive", "vector", "metadata", "hybrid", "hybrid_multi")


def ranked(scores: DataFrame, k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    return first_rows(scores, k, Window.partitionBy(*by).orderBy(F.desc("score"), "id"))


def first_rows(df: DataFrame, k: int, w) -> DataFrame:
    """The first k rows of each window with their ``rank`` from 0; tasks keep k rows a window before they shuffle."""
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def rrf(rankings: DataFrame, k: int, *, by: tuple[str, ...] = ("qid",), constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (by..., src, id, rank[, weight]); src is the ranking's number.

    One aggregation; ties go to what appears first, by src and then rank.
    """
    weight = F.col("weight") if "weight" in rankings.columns else F.lit(1.0)
    fused = rankings.groupBy(*by, "id").agg(F.sum(weight / (constant + F.col("rank") + 1)).alias("score"), F.min(F.struct("src", "rank")).alias("seen"))
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 12)), "seen", "id")
    return first_rows(fused, k, w).select(*by, "id", "score", "rank")


def minmax_rerank(raw: DataFrame, k: int) -> DataFrame:
    """Candidates (qid, id, raw) by raw score, scaled to 0..1 over each query's set (1 where all are equal)."""
    w = Window.partitionBy("qid")
    low, high = F.min("raw").over(w), F.max("raw").over(w)
    scored = raw.withColumn("score", F.when(high == low, 1.0).otherwise((F.col("raw") - low) / (high - low)))
    return ranked(scored, k)


def rerank_pool(k: int) -> int:
    """How many reranked hits go into deduplication for k results."""
    return max(2 * k, k + 4)


def is_repeat(a: Column, b: Column) -> Column:
    """Whether two distinct-token arrays are alike; empty ones never are."""
    both = F.size(F.array_intersect(a, b))
    union, smaller = F.size(a) + F.size(b) - both, F.least(F.size(a), F.size(b))
    return (both / F.greatest(union, F.lit(1)) >= JACCARD) | (both / F.greatest(smaller, F.lit(1)) >= CONTAINED)


def drop_repeats(hits: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Greedy in rank order: a hit goes if it repeats one that is kept.  hits: a bounded pool (by..., id, rank, score, text)."""
    item = F.struct("rank", "id", "score", "text", dedup_tokens(F.col("text")).alias("toks"))
    pool = hits.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("pool"))
    kind = pool.schema["pool"].dataType.simpleString()
    kept = F.aggregate("pool", F.array().cast(kind), lambda a, x: F.when(F.exists(a, lambda y: is_repeat(y["toks"], x["toks"])), a).otherwise(F.array_append(a, x)))
    return pool.select(*by, F.posexplode(kept).alias("rank", "h")).select(*by, "h.id", "rank", "h.score", "h.text")


def repeated_pairs(hits: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(by..., a, b, jaccard) of a query's hits (by..., id, text) that repeat one another, found by a token in common."""
    toks = hits.select(*by, "id", dedup_tokens(F.col("text")).alias("toks"))
    each = toks.select(*by, "id", F.explode("toks").alias("tok"), F.size("toks").alias("n"))
    x, y = (each.select(*by, "tok", F.col("id").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    both = x.join(y, [*by, "tok"]).where("a < b").groupBy(*by, "a", "b", "n_a", "n_b").agg(F.count("*").alias("n"))
    union = F.col("n_a") + F.col("n_b") - F.col("n")
    return both.where((F.col("n") / union >= JACCARD) | (F.col("n") / F.least("n_a", "n_b") >= CONTAINED)).select(*by, "a", "b", (F.col("n") / union).alias("jaccard"))


def rerank_by(hits: DataFrame, scorer, k: int) -> DataFrame:
    """A query's candidates (qid, id, query, text) by a model: ``scorer`` is a Column function of query and text, as of a pandas UDF."""
    return minmax_rerank(hits.select("qid", "id", scorer(F.col("query"), F.col("text")).alias("raw")), k)


def batched_scorer(score, at_once: int = 32):
    """A scorer for ``rerank_by`` from a model: ``score`` takes lists of queries and of texts and returns a list of numbers.

    Pairs of an Arrow batch go to the model by ``at_once``, ordered by length, so that
    those of one call are about as long; their results return to their rows.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in parts:
            q, t = queries.fillna("").tolist(), texts.fillna("").tolist()
            order = sorted(range(len(t)), key=lambda i: len(q[i]) + len(t[i]))
            out = [0.0] * len(t)
            for k in range(0, len(order), at_once):
                own = order[k : k + at_once]
                for i, x in zip(own, score([q[i] for i in own], [t[i] for i in own])):
                    out[i] = float(x)
            yield pd.Series(out, dtype=float)

    return run


def window_scores(hits: DataFrame) -> DataFrame:
    """(qid, id, raw) of a query's candidates (qid, id, query, text) by where the query's words stand.

    raw: how many of the query's distinct words the text has, and one over the length
    of the smallest run of words that holds all of those.  Positions of the
    candidates' words meet the query's words, and one pass over them keeps each
    word's last place.
    """
    words = hits.select("qid", "id", F.array_distinct(bm25_tokens(F.col("query"))).alias("asked"), bm25_tokens(F.coalesce("text", F.lit(""))).alias("toks"))
    places = F.filter(F.transform("toks", lambda t, i: F.struct(i.alias("i"), F.array_position("asked", t).cast("int").alias("n"))), lambda x: x["n"] > 0)
    # one-element arrays bind the places and their count, so that a step of the fold does not compute them again
    start = F.struct(F.create_map().cast("map<int,int>").alias("last"), F.lit(1 << 30).alias("least"))

    def scored(x: Column) -> Column:
        def step(a: Column, y: Column) -> Column:
            last = F.map_concat(F.map_filter(a["last"], lambda k, v: k != y["n"]), F.create_map(y["n"], y["i"]))
            size = y["i"] - F.array_min(F.map_values(last)) + 1
            return F.struct(last.alias("last"), F.when((F.size(last) == x["m"]) & (size < a["least"]), size).otherwise(a["least"]).alias("least"))

        return F.when(x["m"] > 0, x["m"] + 1 / F.aggregate(x["p"], start, step)["least"]).otherwise(0.0)

    counted = F.transform(F.array(places), lambda p: F.struct(p.alias("p"), F.size(F.array_distinct(F.transform(p, lambda y: y["n"]))).alias("m")))
    return words.select("qid", "id", F.transform(counted, scored).getItem(0).alias("raw"))


def topk_by_decade(scores: DataFrame, decades: list[int], k: int = 3) -> DataFrame:
    """The k best of each decade for each query in one pass; a decade without hits keeps a row of nulls."""
    best = ranked(scores.where(F.col("decade").isin(decades)), k, ("qid", "decade"))
    grid = scores.select("qid").distinct().select("qid", F.explode(F.array(*map(F.lit, decades))).alias("decade"))
    return grid.join(best, ["qid", "decade"], "left")


def with_periods(queries: DataFrame, periods: Column) -> DataFrame:
    """A row for each period of each query: (qid, ..., period, lo, hi)."""
    return queries.select("*", F.posexplode(periods).alias("period", "p")).select("*", "p.lo", "p.hi").drop("p")


def effective_strategy(strategy: str, compares: bool) -> str:
    """The strategy that runs; an unknown one is a ValueError."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    return "hybrid_multi" if strategy in ("hybrid", "hybrid_multi") and compares else "hybrid" if strategy == "hybrid_multi" else strategy


def in_periods(scores: DataFrame, years: DataFrame, periods: DataFrame) -> DataFrame:
    """Candidates (qid, id, score) in each period (qid, period, lo, hi) of their question."""
    placed = scores.join(years, "id").join(F.broadcast(periods), "qid").where("year between lo and hi")  # questions are the stated set
    return placed.select("qid", "period", "id", "score")


def multi_period(vector: DataFrame, lexical: DataFrame, k: int, fetch: int = 30) -> DataFrame:
    """Candidates (qid, period, id, score) of both sources fused for each period, and the periods fused once more."""
    by = ("qid", "period")
    parts = [ranked(x, fetch, by).select(*by, F.lit(n).alias("src"), "id", "rank") for n, x in enumerate((vector, lexical))]
    each = rrf(parts[0].unionByName(parts[1]), fetch, by=by)
    return rrf(each.select("qid", F.col("period").alias("src"), "id", "rank"), k)


def search(strategy: str, vector: DataFrame, lexical: DataFrame, years: DataFrame, ranges: DataFrame, k: int, fetch: int = 30, periods: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank) under a strategy.

    vector, lexical: scored candidates (qid, id, score); years: (id, year);
    ranges: (qid, lo, hi), null without a year filter.  ``naive`` filters
    nothing; ``vector`` and ``metadata`` filter by year; ``hybrid`` fuses both
    sources, the filtered ranking counting twice beside the whole one.
    Questions with ``periods`` (qid, period, lo, hi) are comparisons: both hybrid
    strategies search each of their periods and fuse those, and are ``hybrid``
    for the other questions.
    """
    effective = effective_strategy(strategy, periods is not None)
    if effective == "hybrid_multi":
        comparing = periods.select("qid").distinct()
        rest = [x.join(comparing, "qid", "left_anti") for x in (vector, lexical)]
        placed = [in_periods(x.join(comparing, "qid", "left_semi"), years, periods) for x in (vector, lexical)]
        single = search("hybrid", *rest, years, ranges.join(comparing, "qid", "left_anti"), k, fetch)
        return single.unionByName(multi_period(*placed, k, fetch))
    if strategy == "naive":
        return ranked(vector, k).select("qid", "id", "score", "rank")
    fits = lambda df: df.join(ranges, "qid", "left").join(years, "id").where("lo is null or year between lo and hi").drop("lo", "hi", "year")
    if strategy in ("vector", "metadata"):
        return ranked(fits(vector), k).select("qid", "id", "score", "rank")

    def fused(v: DataFrame, t: DataFrame) -> DataFrame:
        parts = [ranked(x, fetch).select("qid", F.lit(n).alias("src"), "id", "rank") for n, x in enumerate((v, t))]
        return rrf(parts[0].unionByName(parts[1]), fetch)

    inside, whole = fused(fits(vector), fits(lexical)), fused(vector, lexical)
    asked = ranges.where("lo is not null").select("qid")
    boosted = inside.join(asked, "qid", "left_semi").select("qid", F.lit(0).alias("src"), "id", "rank", F.lit(2.0).alias("weight"))
    return rrf(boosted.unionByName(whole.select("qid", F.lit(1).alias("src"), "id", "rank", F.lit(1.0).alias("weight"))), k)
