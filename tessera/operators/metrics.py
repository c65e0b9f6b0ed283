"""Retrieval metrics over ranked hits, and the limiter's batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written


def relevance(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """hits (qid, rank, year, text) with ``year_hit`` and ``relevant`` by gold (qid, target_years, must_contain_any)."""
    year = F.array_contains("target_years", F.col("year"))
    word = F.exists("must_contain_any", lambda k: F.instr(F.lower("text"), F.lower(k)) > 0)
    return hits.join(gold, "qid").withColumns({"year_hit": F.coalesce(year, F.lit(False)), "relevant": F.coalesce(year & word, F.lit(False))})


def per_query(flags: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Year hit rate and recall at each k, and MRR.  flags: (by..., rank, year_hit, relevant)."""
    out = []
    for k in ks:
        near = F.col("rank") < k
        out.append((F.count_if(near & F.col("year_hit")) / F.greatest(F.count_if(near), F.lit(1))).alias(f"year_hit_rate_at_{k}"))
        out.append(F.max((near & F.col("relevant")).cast("double")).alias(f"recall_at_{k}"))
    first = F.min(F.when(F.col("relevant"), F.col("rank") + 1))
    return flags.groupBy(*by).agg(*out, F.coalesce(1 / first, F.lit(0.0)).alias("mrr"))


def means(metrics: DataFrame, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Each metric's mean over queries, a missing one as 0, and how many queries there are."""
    names = [c for c in metrics.columns if c not in (*by, "qid")]
    return metrics.groupBy(*by).agg(F.countDistinct("qid").alias("n_queries"), *(F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in names))


def keyword_rate(answer: Column, keywords: Column) -> Column:
    """Share of the keywords found in the answer; null where there are none."""
    found = F.size(F.filter(keywords, lambda k: F.instr(F.lower(answer), F.lower(k)) > 0))
    return F.when(F.size(keywords) > 0, found / F.size(keywords))


#: windows in a time range: a key's requests of one range are one task's work
RANGE_WINDOWS = 64


def seconds_of(requests: DataFrame, at: str = "at") -> Column:
    """A time column as seconds."""
    if dict(requests.dtypes)[at] in ("double", "float", "bigint", "int"):
        return F.col(at).cast("double")
    return F.unix_micros(F.col(at).cast("timestamp")) / 1e6


def next_anchors(times: DataFrame, window_seconds: float) -> DataFrame:
    """(key, at, next) for distinct (key, at): the key's first request at or after the end of a window from ``at``.

    Keys are cut into time ranges of RANGE_WINDOWS windows.  A window's end falls
    into one range, where it meets the requests; if none follows there, the next
    range that has any has it first.
    """
    ranged = lambda t: F.floor(t / (RANGE_WINDOWS * window_seconds))
    rows = times.select("key", F.col("at").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("of"))
    ends = times.select("key", (F.col("at") + window_seconds).alias("t"), F.lit(0).alias("kind"), F.col("at").alias("of"))
    both = rows.unionByName(ends).withColumn("range", ranged(F.col("t")))
    following = Window.partitionBy("key", "range").orderBy("t", "kind").rowsBetween(0, Window.unboundedFollowing)
    placed = both.withColumn("next", F.min(F.when(F.col("kind") == 1, F.col("t"))).over(following)).where("kind = 0")
    # a row for each range of a key
    later = Window.partitionBy("key").orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    beyond = both.groupBy("key", "range").agg(F.min(F.when(F.col("kind") == 1, F.col("t"))).alias("first")).select("key", "range", F.min("first").over(later).alias("beyond"))
    return placed.join(beyond, ["key", "range"]).select("key", F.col("of").alias("at"), F.coalesce("next", "beyond").alias("next"))


def window_anchors(times: DataFrame, window_seconds: float) -> DataFrame:
    """(key, at): the requests that start a window, found by pointer doubling.

    Each round doubles how far pointers go and adds what they reach from the anchors
    known so far, so the rounds are as many as the logarithm of the most windows of
    a key; rows are dealt by key and time, so a key of many requests is many tasks.
    """
    jump = written(next_anchors(times, window_seconds).where("next is not null"), "anchors")
    reached = written(times.groupBy("key").agg(F.min("at").alias("at")), "anchors")
    while True:
        new = written(reached.join(jump, ["key", "at"]).select("key", F.col("next").alias("at")), "anchors")
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new)
        far = jump.select("key", F.col("at").alias("next"), F.col("next").alias("then"))
        jump = written(jump.join(far, ["key", "next"]).select("key", "at", F.col("then").alias("next")), "anchors")


def rate_verdicts(requests: DataFrame, most: int, window_seconds: float, *, id_col: str | None = None) -> DataFrame:
    """(key, at, anchor, nth, allowed[, id]) for every request (key, at) by windows that start at the key's first one.

    At or after a window's end the next request starts another; ``nth`` counts from 1
    in the window, denied requests too, by time and then by id.  at is in
    seconds in the result.  Requests without key or time are left out.
    """
    more = [] if id_col is None else [F.col(id_col).alias("id")]
    rows = requests.select("key", seconds_of(requests).alias("at"), *more).where("key is not null and at is not null")
    times = written(rows.select("key", "at").distinct(), "anchors")
    anchors = window_anchors(times, window_seconds).withColumn("anchor", F.col("at"))
    # a time's window starts at the last anchor up to it: within its range, or the last of the ranges before
    ranged = F.floor(F.col("at") / (RANGE_WINDOWS * window_seconds))
    marked = times.join(anchors, ["key", "at"], "left").withColumn("range", ranged)
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("key", "range").agg(F.max("anchor").alias("last")).select("key", "range", F.max("last").over(before).alias("carried"))
    upto = Window.partitionBy("key", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.withColumn("own", F.max("anchor").over(upto)).join(carried, ["key", "range"]).select("key", "at", F.coalesce("own", "carried").alias("anchor"))
    nth = F.row_number().over(Window.partitionBy("key", "anchor").orderBy("at", *(["id"] * bool(more))))
    told = rows.join(owned, ["key", "at"]).withColumn("nth", nth).withColumn("allowed", F.col("nth") <= most)
    return told.select("key", "at", "anchor", "nth", "allowed", *(["id"] * bool(more)))


def rate_limit(requests: DataFrame, most: int, window_seconds: float) -> DataFrame:
    """(key, n, denied, windows) of each key's requests."""
    told = rate_verdicts(requests, most, window_seconds)
    return told.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("allowed")).alias("denied"), F.count_if(F.col("nth") == 1).alias("windows"))
