"""Registered queries of indexes, ranking, answers and metrics."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import query as Q, text as T
from ..operators import answer as A, impact as X, index as I, metrics as M, retrieve as R, segments as G
from ..session import shared_dir, written
from ..sources.versioned import VersionedTable
from ..streaming import limiter as L
from .catalog import LETTERS, LIT, QUERIES, SQL, S_CHUNKS, S_LINKED, S_PARSED, S_PERIODS, S_QUESTIONS, _chunks, _linked, _questions, letters, picked, register, table  # noqa: F401

R6 = lambda c: F.round(c, 6)

# ---------------------------------------------------------------- vectors

S_VEC = (
    "vq as (select vec_id as qid, list_transform(embedding, lambda x: x::double) as qv from embeddings where vec_id % 100 = 0), v as (select vec_id as id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), "
    "s as (select qid, id, label, round(list_cosine_similarity(qv, v), 12) as score from vq, v)"
)


def _vector_queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))


@register(f"with {S_VEC} select qid, id, round(score, 6) as score, r - 1 as rank from (select *, row_number() over (partition by qid order by score desc, id) as r from s) where r <= 10")
def vec_topk(spark, sf_dir):
    """Every vector whose id is divisible by 100, against all vectors."""
    own = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return I.vector_topk(own, _vector_queries(spark, sf_dir), 10).select("qid", "id", R6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@register(f"with {S_VEC} select qid, id, round(score, 6) as score from (select *, row_number() over (partition by qid order by score desc, id) as r from s where label < 5) where r <= 5")
def vec_filter(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").where("label < 5").withColumnRenamed("vec_id", "id")
    return I.vector_topk(own, _vector_queries(spark, sf_dir), 5).select("qid", "id", R6("score").alias("score"))


@register("select vec_id, round(case when n > 0 then e[1] / n else e[1] end, 6) as first, round(sqrt(list_sum(list_transform(e, lambda x: (x / case when n > 0 then n else 1 end) ** 2))), 6) as norm from (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from (select vec_id, list_transform(embedding, lambda x: x::double * 3) as e from embeddings))")
def vec_norm(spark, sf_dir):
    v = I.normalized(F.transform("embedding", lambda x: x.cast("double") * 3))
    return table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).select("vec_id", R6(F.col("v")[0]).alias("first"), R6(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"))


@register("select count(*) as n, count(*) filter (len(embedding) <> 64) as wrong from embeddings")
def store_dimcheck(spark, sf_dir):
    checked = I.check_width(table(spark, sf_dir, "embeddings"), 64)
    return checked.agg(F.count("*").alias("n"), F.count_if(F.size("embedding") != 64).alias("wrong"))


# ---------------------------------------------------------------- BM25

QUESTION = "the thinking of then and that onthe with"
S_BM25 = (
    "tokens as (select doc_id as id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x))) as tok from documents), tf as materialized (select id, tok, count(*) as f from tokens group by all), "
    "dl as materialized (select doc_id as id, len(regexp_extract_all(text, '[A-Za-z0-9'']+')) as dl from documents), st as (select count(*) as n, avg(dl) as avgdl from dl), "
    "raw as materialized (select tok, df, ln(n - df + 0.5) - ln(df + 0.5) as raw from (select tok, count(*) as df from tf group by 1), st), idf as materialized (select tok, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw)"
)
S_SCORES = (
    S_BM25 + ", qt as (select qid, tok, count(*) as qf from (select qid, unnest(list_transform(regexp_extract_all(query, '[A-Za-z0-9'']+'), lambda x: lower(x))) as tok from qs) group by all), "
    "sc as materialized (select qid, id, sum(qf * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from tf join qt using (tok) join idf using (tok) join dl using (id), st group by all)"
)


_indexes: dict = {}


def _state(docs):
    """What tells a table's files from those of another time: how many there are, and a sum over paths, sizes and times."""
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return tuple(files.agg(F.count("*"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time") % (1 << 40))).first())


def _impact(spark, sf_dir):
    """The BM25 index of ``documents``, written to the shared folder once a session and state of the table; it carries the letters' years."""
    docs = table(spark, sf_dir, "documents")
    key = spark.sparkContext.applicationId, sf_dir, _state(docs)
    if key not in _indexes:
        own = letters(spark, sf_dir)
        _indexes[key] = X.build_impact(own, "id", "text", f"{shared_dir(spark)}/tessera/bm25-{uuid.uuid4().hex}", carried={"year": F.col("year")})
    return _indexes[key]


def _index(spark, sf_dir):
    return _impact(spark, sf_dir).whole()


def _best(spark, sf_dir, queries, k, slot=None):
    """(qid, slot, id, score): candidates that hold the k best of each slot, with the scores' last bits off."""
    return X.impact_best(_impact(spark, sf_dir), queries, k, slot=slot).withColumn("score", F.round("score", 9))


def _one_question(spark):
    return spark.createDataFrame([(0, QUESTION)], "qid int, query string")


@register(f"with {S_BM25} select tok, df, round(idf, 6) as idf from idf")
def bm25_build(spark, sf_dir):
    index = _index(spark, sf_dir)
    return index.idf.select("tok", "df", R6("idf").alias("idf"))


@register(f"with qs as (select 0 as qid, {LIT(QUESTION)} as query), {S_SCORES}, a as (select dl.id, coalesce(round(score, 9), 0) as score from dl left join sc using (id)) select a.id, cast(1977 + a.id % 48 as integer) as year, round(score, 6) as score, cast(r - 1 as bigint) as rank, case when length(text) > 240 then replace(left(text, 240), chr(10), ' ') || '...' else replace(text, chr(10), ' ') end as preview from (select *, row_number() over (order by score desc, id) as r from a) a join documents on doc_id = a.id where r <= 10")
def bm25_topk(spark, sf_dir):
    """The ten best documents for a fixed question, with their years and snippets."""
    own = letters(spark, sf_dir)
    best = _bm25_top(spark, sf_dir, _one_question(spark), 10)
    return best.join(own, "id").select("id", "year", R6("score").alias("score"), F.col("rank").cast("long").alias("rank"), T.snippet(F.col("text")).alias("preview"))


def _bm25_top(spark, sf_dir, queries, k):
    return I.bm25_topk(_index(spark, sf_dir), queries, k, best=_best(spark, sf_dir, queries, k))


S_BENCH = "qs as (select item_id as qid, text as query from benchmark)"


def _bench(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


@register(f"with {S_BENCH}, {S_SCORES} select qid, id, round(score, 6) as score from (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as r from sc) where r <= 5")
def bm25_score(spark, sf_dir):
    """Every benchmark item as a question against all documents."""
    return R.ranked(_best(spark, sf_dir, _bench(spark, sf_dir), 5), 5).select("qid", "id", R6("score").alias("score"))


S_GOLD = "rel as (select item_id as qid, doc_id as id from benchmark b join documents d on contains(d.text, b.text)), hit as (select qid from rel group by 1)"
S_RANKS = (
    "v1 as (select qid, id, row_number() over (partition by qid order by round(score, 9) desc, id) - 1 as rank from sc), "
    "v2 as (select qid, id, row_number() over (partition by qid order by round(score, 9) desc, id) - 1 as rank from sc where id % 48 between 8 and 40)"
)


def _whole(spark, sf_dir, k=30):
    """BM25 over all letters."""
    return R.ranked(_best(spark, sf_dir, _bench(spark, sf_dir), k), k)


def _by_year(spark, sf_dir, k):
    """(qid, id, score): each question's k best of every year, which hold those of any range of years."""
    return _best(spark, sf_dir, _bench(spark, sf_dir), k, lambda d: d["year"]).drop("slot")


def _two_rankings(spark, sf_dir, k=30):
    """BM25 over all letters, and over those of 1985 to 2017, both with the statistics of all."""
    inside = _best(spark, sf_dir, _bench(spark, sf_dir), k, lambda d: F.when(d["year"].between(1985, 2017), 0))
    return _whole(spark, sf_dir, k), R.ranked(inside, k)


S_FUSED = "fused as (select qid, id, round(sum(w / (60 + rank + 1)), 12) as score, min(src * 1000 + rank) as seen from u group by all), top as (select *, row_number() over (partition by qid order by score desc, seen, id) as r from fused)"


@register(f"with {S_BENCH}, {S_SCORES}, {S_RANKS}, u as (select 0 as src, 1.0::double as w, * from v2 where rank < 30 union all select 1, 1.0::double, * from v1 where rank < 30), {S_FUSED} select qid, id, round(score, 6) as score, r - 1 as rank from top where r <= 10")
def rrf(spark, sf_dir):
    whole, inside = _two_rankings(spark, sf_dir)
    both = inside.select("qid", F.lit(0).alias("src"), "id", "rank").unionByName(whole.select("qid", F.lit(1).alias("src"), "id", "rank"))
    return R.rrf(both, 10).select("qid", "id", R6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@register(f"with {S_BENCH}, {S_SCORES}, {S_RANKS}, u as (select 0 as src, 2.0::double as w, * from v2 where rank < 30 union all select 1, 1.0::double, * from v1 where rank < 30), {S_FUSED} select qid, id, round(score, 6) as score, r - 1 as rank from top where r <= 10")
def rrf_weighted(spark, sf_dir):
    whole, inside = _two_rankings(spark, sf_dir)
    both = inside.select("qid", F.lit(0).alias("src"), "id", "rank", F.lit(2.0).alias("weight")).unionByName(whole.select("qid", F.lit(1).alias("src"), "id", "rank", F.lit(1.0).alias("weight")))
    return R.rrf(both, 10).select("qid", "id", R6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@register(f"with {S_BENCH}, {S_SCORES}, y as (select *, cast((1977 + id % 48) // 10 * 10 as integer) as decade from sc), t as (select *, row_number() over (partition by qid, decade order by round(score, 9) desc, id) as r from y), g as (select qid, d.decade from (select distinct qid from sc), (select unnest([1980, 1990, 2000, 2010, 2020])::integer as decade) d) select g.qid, g.decade, id, round(score, 6) as score from g left join (select * from t where r <= 3) t using (qid, decade)")
def topk_decade(spark, sf_dir):
    best = _best(spark, sf_dir, _bench(spark, sf_dir), 3, lambda d: T.decade(d["year"])).withColumn("decade", F.col("slot").cast("int"))
    return R.topk_by_decade(best, [1980, 1990, 2000, 2010, 2020]).select("qid", "decade", "id", R6("score").alias("score"))


@register(f"with {S_BENCH}, {S_SCORES}, {S_RANKS}, c as (select qid, id, round(score, 9) as raw from sc qualify row_number() over (partition by qid order by round(score, 9) desc, id) <= 30), m as (select *, min(raw) over (partition by qid) as lo, max(raw) over (partition by qid) as hi from c) select qid, id, round(case when hi = lo then 1 else (raw - lo) / (hi - lo) end, 6) as score from m qualify row_number() over (partition by qid order by round(case when hi = lo then 1 else (raw - lo) / (hi - lo) end, 9) desc, id) <= 8")
def rerank(spark, sf_dir):
    """Min-max scores over each question's 30 candidates, the BM25 score standing in for a model's."""
    whole = _whole(spark, sf_dir)
    return R.ranked(R.minmax_rerank(whole.select("qid", "id", F.col("score").alias("raw")), 30).withColumn("score", F.round("score", 9)).drop("rank"), 8).select("qid", "id", R6("score").alias("score"))


@register(
    f"with {S_BENCH}, {S_SCORES}, {S_RANKS}, h as (select qid, rank, id, round(score, 9) as score, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) as toks from v1 join sc using (qid, id) join documents on doc_id = id where rank < 30), "
    "l as (select qid, list([{'id': id, 'score': score, 'toks': toks}] order by rank) as xs from h group by 1), "
    "k as (select qid, list_reduce(xs, lambda a, b: case when len(list_filter(a, lambda y: len(list_intersect(y.toks, b[1].toks)) / greatest(len(y.toks) + len(b[1].toks) - len(list_intersect(y.toks, b[1].toks)), 1) >= 0.85 or len(list_intersect(y.toks, b[1].toks)) / greatest(least(len(y.toks), len(b[1].toks)), 1) >= 0.92)) > 0 then a else list_concat(a, b) end) as kept from l) "
    "select qid, x.id as id, (n - 1)::integer as rank, round(x.score, 6) as score from (select qid, unnest(kept) as x, generate_subscripts(kept, 1) as n from k)"
)
def dedup(spark, sf_dir):
    """Greedy removal of repeats among each question's 30 candidates, in rank order."""
    whole = _whole(spark, sf_dir)
    hits = whole.join(letters(spark, sf_dir).select("id", "text"), "id")
    return R.drop_repeats(hits).select("qid", "id", "rank", R6("score").alias("score"))


def _s_fused(name, rows, by):
    """SQL of the 30 best ranks of each source in ``rows`` (src, by, id, score), fused: <name>(by, id, rank)."""
    return (
        f"{name}1 as (select *, row_number() over (partition by src, {by} order by score desc, id) - 1 as rank from {rows}), "
        f"{name}2 as (select {by}, id, round(sum(1.0::double / (60 + rank + 1)), 12) as score, min(src * 1000 + rank) as seen from {name}1 where rank < 30 group by all), "
        f"{name} as (select {by}, id, row_number() over (partition by {by} order by score desc, seen, id) - 1 as rank from {name}2 qualify rank < 30)"
    )


S_TOP10 = "select qid, id, r - 1 as rank, round(score, 6) as score from top where r <= 10"


@register(
    f"with {LETTERS}, {S_BENCH}, {S_SCORES}, {S_VEC}, vt as (select qid // 100 as qid, id, score from s qualify row_number() over (partition by qid order by score desc, id) <= 30), "
    f"c as (select 0 as src, * from vt union all select 1, qid, id, round(score, 9) from sc), i as (select c.* from c join letters using (id) join qs using (qid) where qid % 2 = 0 and year between 1985 and 1999), {_s_fused('whole', 'c', 'qid')}, {_s_fused('inside', 'i', 'qid')}, "
    f"u as (select 0 as src, 2.0::double as w, * from inside union all select 1, 1.0::double, * from whole), {S_FUSED} {S_TOP10}"
)
def hybrid(spark, sf_dir):
    """Vectors and BM25 fused, with a boost for the years that the question names; ids of both tables meet."""
    own = letters(spark, sf_dir)
    lexical = _by_year(spark, sf_dir, 30)
    asked = _vector_queries(spark, sf_dir).select((F.col("qid") / 100).cast("long").alias("qid"), "vec")
    vector = I.vector_topk(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), asked, 30).drop("rank")
    # either source is fused whole and by year: it is searched once
    vector, lexical = written(vector, "candidates"), written(lexical, "candidates")
    ranges = _bench(spark, sf_dir).select("qid", F.when(F.col("qid") % 2 == 0, 1985).alias("lo"), F.when(F.col("qid") % 2 == 0, 1999).alias("hi"))
    return R.search("hybrid", vector, lexical, own.select("id", "year"), ranges, 10).select("qid", "id", F.col("rank").cast("long").alias("rank"), R6("score").alias("score"))


@register(
    f"with {LETTERS}, {S_BENCH}, {S_SCORES}, {S_VEC}, pr(period, lo, hi) as (values (0, 1977, 1999), (1, 2000, 2024)), "
    "c as (select 0 as src, qs.qid, period, s.id, s.score from s join qs on qs.qid = s.qid // 100 join letters on letters.id = s.id join pr on year between lo and hi "
    "union all select 1, qid, period, sc.id, round(score, 9) from sc join letters on letters.id = sc.id join pr on year between lo and hi), "
    f"{_s_fused('each', 'c', 'qid, period')}, u as (select period as src, 1.0::double as w, qid, id, rank from each), {S_FUSED} {S_TOP10}"
)
def multi_period(spark, sf_dir):
    """Each question over two periods: vectors and BM25 fused for each, and the periods fused once more."""
    own = letters(spark, sf_dir)
    years = own.select("id", "year")
    lexical = _by_year(spark, sf_dir, 30)
    two = ((0, 1977, 1999), (1, 2000, 2024))
    spans = spark.createDataFrame(two, "period int, lo int, hi int")
    periods = _bench(spark, sf_dir).select("qid").crossJoin(F.broadcast(spans))
    asked = _vector_queries(spark, sf_dir).select((F.col("qid") / 100).cast("long").alias("qid"), "vec").join(_bench(spark, sf_dir).select("qid"), "qid", "left_semi")
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id").join(years, "id")
    # each period has its own nearest vectors: those of all years may leave it with few
    best = [I.vector_topk(vectors.where(F.col("year").between(lo, hi)), asked, 30).select("qid", F.lit(n).alias("period"), "id", "score") for n, lo, hi in two]
    found = R.multi_period(best[0].unionByName(best[1]), R.in_periods(lexical, years, periods), 10)
    return found.select("qid", "id", F.col("rank").cast("long").alias("rank"), R6("score").alias("score"))


# SQL: candidates c of the items' questions from both sources, the years that a question names, and the periods that it compares
S_ASKED = (
    f"{LETTERS}, {S_QUESTIONS}, {S_PARSED}, {S_PERIODS}, qs as (select qid, query from q), {S_SCORES}, {S_VEC}, "
    "yr as (select qid, case when y1 is not null then least(y1, y2) when d1 is not null then d1.lo when d is not null then d.lo when len(ys) > 0 then list_min(ys) end as lo, case when y1 is not null then greatest(y1, y2) when d1 is not null then d2.hi when d is not null then d.hi when len(ys) > 0 then list_max(ys) end as hi from p), "
    "c as materialized (select 0 as src, s.qid // 100 as qid, s.id, s.score, year from s join letters on letters.id = s.id where s.qid // 100 in (select qid from qs) union all select 1, sc.qid, sc.id, round(sc.score, 9), year from sc join letters on letters.id = sc.id), "
    f"i as (select c.* from c join yr using (qid) where year between lo and hi), ep as (select c.*, period from c join e using (qid) where year between e.lo and e.hi), fv as (select c.* from c join yr using (qid) where src = 0 and (lo is null or year between lo and hi)), "
    f"{_s_fused('whole', 'c', 'qid')}, {_s_fused('inside', 'i', 'qid')}, {_s_fused('each', 'ep', 'qid, period')}, "
    "u as (select period as src, 1.0::double as w, qid, id, rank from each union all select 0, 2.0::double, * from inside where qid not in (select qid from e) union all select 1, 1.0::double, * from whole where qid not in (select qid from e)), "
    f"{S_FUSED}, found as materialized (select 'naive' as strategy, qid, id, row_number() over (partition by qid order by score desc, id) - 1 as rank, score from c where src = 0 "
    "union all select st, qid, id, row_number() over (partition by st, qid order by score desc, id) - 1, score from fv, (values ('vector'), ('metadata')) k(st) union all select 'hybrid', qid, id, r - 1, score from top)"
)


def _candidates(spark, sf_dir):
    """Both sources' candidates (qid, id, score) of the items' questions, searched and written once for all strategies."""
    asked = _questions(spark, sf_dir)
    years = letters(spark, sf_dir).select("id", "year")
    # the best of every year hold those of any range of years
    lexical = _best(spark, sf_dir, asked, 30, lambda d: d["year"]).drop("slot")
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id").join(years, "id")
    own = _vector_queries(spark, sf_dir).select((F.col("qid") / 100).cast("long").alias("qid"), "vec").join(asked.select("qid"), "qid", "left_semi")
    vector = I.vector_topk(vectors, own, 30, slot_col="year").select("qid", "id", "score")
    return written(vector, "candidates"), written(lexical, "candidates")


def _asked(spark, sf_dir, strategy, k, vector, lexical):
    """(qid, id, rank, score) of the items' questions under a strategy, by the years that they name and the periods that they compare."""
    asked = _questions(spark, sf_dir)
    years = letters(spark, sf_dir).select("id", "year")
    named = Q.year_range(F.col("query"))
    ranges = asked.select("qid", named.alias("r")).select("qid", "r.lo", "r.hi")
    periods = R.with_periods(asked, Q.comparison_periods(F.col("query"))).select("qid", "period", "lo", "hi")
    return R.search(strategy, vector, lexical, years, ranges, k, 30, periods if strategy.startswith("hybrid") else None).select("qid", "id", "rank", "score")


STRATEGIES = ("naive", "vector", "metadata", "hybrid")


@register(f"with {S_ASKED} select strategy, qid, id, rank, round(score, 6) as score from found where rank < 10")
def search_all(spark, sf_dir):
    """Every item's question under each strategy; hybrid searches each period of a question that compares."""
    sources = _candidates(spark, sf_dir)
    runs = [_asked(spark, sf_dir, name, 10, *sources).select(F.lit(name).alias("strategy"), "*") for name in STRATEGIES]
    return reduce(DataFrame.unionByName, runs).select("strategy", "qid", "id", F.col("rank").cast("long").alias("rank"), R6("score").alias("score"))


@register(
    f"with {S_ASKED}, m as (select strategy, false as rerank, qid, id, rank from found where rank < 10 union all select strategy, true, qid, id, row_number() over (partition by strategy, qid order by length(text), id) - 1 from found join documents on doc_id = id where rank < 20 qualify row_number() over (partition by strategy, qid order by length(text), id) <= 10), "
    "fl as (select strategy, rerank, qid, rank, cast(1977 + id % 48 as integer) // 10 * 10 = 1980 + qid % 4 * 10 as year_hit, contains(lower(text), 'the') as word from m join documents on doc_id = id), "
    "per as (select strategy, rerank, qid, count(*) filter (year_hit and rank < 5) / greatest(count(*) filter (rank < 5), 1) as y5, max((year_hit and word and rank < 5)::int::double) as r5, coalesce(1.0 / min(case when year_hit and word then rank + 1 end), 0) as mrr from fl group by all) "
    "select strategy, rerank, count(distinct qid) as n_queries, round(avg(r5), 4) as recall_at_5, round(avg(y5), 4) as year_hit_rate_at_5, round(avg(mrr), 4) as mrr from per group by all"
)
def m_strategies(spark, sf_dir):
    """Mean metrics of every strategy, plain and with its rerank pool in another scorer's order (the shortest first)."""
    texts = letters(spark, sf_dir).select("id", "year", "text")
    first = (1980 + F.col("qid") % 4 * 10).cast("int")
    gold = _bench(spark, sf_dir).select("qid", F.sequence(first, first + 9).alias("target_years"), F.array(F.lit("the")).alias("must_contain_any"))
    runs, sources = [], _candidates(spark, sf_dir)
    for name in STRATEGIES:
        pool = written(_asked(spark, sf_dir, name, R.rerank_pool(10), *sources).select("qid", "id", "rank"), "strategies").join(texts, "id").join(_questions(spark, sf_dir), "qid")
        again = R.rerank_by(pool, lambda q, t: -F.length(t), 10).select("qid", "id", "rank").join(texts, "id")
        runs += [found.select(F.lit(name).alias("strategy"), F.lit(flag).alias("rerank"), "qid", "rank", "year", "text") for flag, found in ((False, pool.where("rank < 10")), (True, again))]
    flags = M.relevance(reduce(DataFrame.unionByName, runs), gold)
    means = M.means(M.per_query(flags, (1, 5), by=("strategy", "rerank", "qid")), ("strategy", "rerank"))
    return means.select("strategy", "rerank", "n_queries", *(F.round(c, 4).alias(c) for c in ("recall_at_5", "year_hit_rate_at_5", "mrr")))


# ---------------------------------------------------------------- metrics

S_FLAGS = f"fl as (select v1.qid, v1.rank, rel.id is not null as rel from v1 join hit using (qid) left join rel on rel.qid = v1.qid and rel.id = v1.id where v1.rank < 10)"


def _held_items(spark, sf_dir):
    """(qid) of the items that some document holds.

    A document that holds an item has all its tokens but the first and last, which
    may go on in the document: the rarest of those finds the documents to look at.
    """
    asked = _bench(spark, sf_dir).where("query is not null").withColumn("toks", T.bm25_tokens(F.col("query")))
    inner = asked.where("size(toks) > 2").select("qid", "query", F.explode(F.slice("toks", F.lit(2), F.size("toks") - 2)).alias("tok"))
    index = _index(spark, sf_dir)
    rarest = inner.join(index.idf, "tok").groupBy("qid").agg(F.min_by(F.struct("tok", "query"), F.struct("df", "tok")).alias("r")).select("qid", "r.*")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    # an item with a token that no document has is held by none, and its rarest token finds nothing that holds it
    met = index.postings(rarest.select("tok").distinct()).select("id", "tok").join(I.if_small(rarest), "tok")
    found = met.select("qid", "id", "query").join(docs, "id").where(F.contains("text", F.col("query"))).select("qid")
    short = asked.where("size(toks) <= 2").select("qid", "query")  # the stated query set against all rows
    if not short.isEmpty():
        found = found.union(docs.join(I.if_small(short), F.contains("text", F.col("query"))).select("qid"))
    return found.distinct()


def _flags(spark, sf_dir):
    """The ten best for each item that some document holds; relevant documents hold the item."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    whole = _whole(spark, sf_dir, 10)
    held = whole.join(docs, "id").join(_bench(spark, sf_dir), "qid").withColumn("relevant", F.contains("text", F.col("query")))
    return held.join(_held_items(spark, sf_dir), "qid", "left_semi").select("qid", "rank", "relevant", F.col("relevant").alias("year_hit"))


@register(f"with {S_BENCH}, {S_SCORES}, {S_RANKS}, {S_GOLD}, {S_FLAGS} select qid, max((rel and rank < 1)::int::double) as recall_at_1, max((rel and rank < 5)::int::double) as recall_at_5, round(count(*) filter (rel and rank < 5) / greatest(count(*) filter (rank < 5), 1), 6) as year_hit_rate_at_5, round(coalesce(1.0 / min(case when rel then rank + 1 end), 0), 6) as mrr from fl group by 1")
def m_recall(spark, sf_dir):
    """Recall, hit rate and MRR of each benchmark item that a document holds."""
    return M.per_query(_flags(spark, sf_dir), (1, 5)).select("qid", "recall_at_1", "recall_at_5", R6("year_hit_rate_at_5").alias("year_hit_rate_at_5"), R6("mrr").alias("mrr"))


@register("with m as (" + SQL["m_recall"] + ") select 'bm25' as strategy, count(*) as n_queries, round(avg(recall_at_1), 4) as recall_at_1, round(avg(recall_at_5), 4) as recall_at_5, round(avg(mrr), 4) as mrr from m")
def agg_metrics(spark, sf_dir):
    per = M.per_query(_flags(spark, sf_dir), (1, 5)).withColumn("strategy", F.lit("bm25")).withColumn("mrr", R6("mrr"))
    return M.means(per).select("strategy", "n_queries", *(F.round(c, 4).alias(c) for c in ("recall_at_1", "recall_at_5", "mrr")))


@register("select qid, round(case when len(kw) > 0 then len(list_filter(kw, lambda k: contains(lower(text), k))) / len(kw) end, 6) as rate from (select doc_id as qid, text, case when doc_id % 5 = 0 then []::varchar[] else ['the', 'und', 'zz'] end as kw from documents)")
def m_keyword(spark, sf_dir):
    words = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, ("the", "und", "zz"))))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), R6(M.keyword_rate(F.col("text"), words)).alias("rate"))


@register(f"with {LETTERS}, {S_CHUNKS} select year, count(*) as n, repeat('█', cast(count(*) // 5 as integer)) as bar from chunks group by 1")
def agg_year_count(spark, sf_dir):
    return _chunks(spark, sf_dir).groupBy("year").agg(F.count("*").alias("n")).select("year", "n", F.expr("repeat('█', cast(n div 5 as int))").alias("bar"))


@register(f"with {LETTERS}, {S_CHUNKS} select (select count(*) from letters) as total_letters, count(*) as total_chunks, round(count(*) / greatest((select count(*) from letters), 1), 6) as avg_chunks, min(year) as first_year, max(year) as last_year from chunks")
def agg_run_meta(spark, sf_dir):
    n = letters(spark, sf_dir).agg(F.count("*").alias("total_letters"))
    c = _chunks(spark, sf_dir).agg(F.count("*").alias("total_chunks"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return n.crossJoin(c).select("total_letters", "total_chunks", R6(F.col("total_chunks") / F.greatest("total_letters", F.lit(1))).alias("avg_chunks"), "first_year", "last_year")  # one row each


@register("select count(*) as total, min(year) as first_year, max(year) as last_year from (select cast(nullif(doc_id % 9, 0) + 1976 as integer) as year from documents)")
def agg_stats(spark, sf_dir):
    year = F.when(F.col("doc_id") % 9 != 0, F.col("doc_id") % 9 + 1976).cast("int")
    return table(spark, sf_dir, "documents").select(year.alias("year")).agg(F.count("*").alias("total"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@register("select 'ok' as status, count(*) as indexed from documents")
def health(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("indexed")).select(F.lit("ok").alias("status"), "indexed")


@register("with t as (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations), l as (select conv_id, turn, case when lower(role) = 'user' then 'User: ' else 'Assistant: ' end as who, left(regexp_replace(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), 600) as said from t where n <= 6) select conv_id, coalesce(string_agg(who || said, chr(10) order by turn, who || said) filter (said <> ''), '') as history from l group by 1")
def win_history(spark, sf_dir):
    return A.history_block(table(spark, sf_dir, "conversations"))




def _s_rates(most, seconds):
    """SQL: vd(event_id, key, t, anchor, nth, allowed) of the events as requests."""
    return (
        "rq as materialized (select event_id, user_id || ':' || event_type as key, epoch_us(ts) / 1e6 as t from events), "
        f"ac as (select key, min(t) as t from rq group by 1 union all select ac.key, min(rq.t) from ac join rq on rq.key = ac.key and rq.t >= ac.t + {seconds} group by ac.key, ac.t), "
        f"ve as (select event_id, rq.key, rq.t, anchor, row_number() over (partition by rq.key, anchor order by rq.t, event_id) as nth from (select rq.*, max(ac.t) as anchor from rq join ac on ac.key = rq.key and ac.t <= rq.t group by all) rq), "
        f"vd as (select *, nth <= {most} as allowed from ve)"
    )


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("ts").alias("at"), "event_id")


@register(f"with recursive {_s_rates(2, 60.0)} select key, count(*) as n, count(*) filter (not allowed) as denied, count(*) filter (nth = 1) as windows from vd group by 1")
def rate_limit(spark, sf_dir):
    """At most two requests of a user and type in a minute from the first."""
    return M.rate_limit(_requests(spark, sf_dir), 2, 60.0)


@register(f"with recursive {_s_rates(1, 86400.0)} select event_id, key, round(t, 6) as \"at\", round(anchor, 6) as anchor, nth, allowed from vd")
def rate_verdicts(spark, sf_dir):
    """A verdict for every request: one of a user and type in a day from the first."""
    told = M.rate_verdicts(_requests(spark, sf_dir), 1, 86400.0, id_col="event_id")
    return told.select(F.col("id").alias("event_id"), "key", R6("at").alias("at"), R6("anchor").alias("anchor"), F.col("nth").cast("long").alias("nth"), "allowed")


@register(f"with recursive {_s_rates(1, 86400.0)} select key, round(t, 6) as \"at\", allowed from vd")
def rate_stream(spark, sf_dir):
    """The same limit by a stream that is stopped and started again twice, each time with more of the events."""
    rows = _requests(spark, sf_dir)
    rows = written(rows.select("key", M.seconds_of(rows).alias("at")).where("key is not null and at is not null"), "requests")
    low, high = rows.agg(F.min("at"), F.max("at")).first()
    base = f"{shared_dir(spark)}/tessera/rates-{uuid.uuid4().hex}"
    third = F.least(F.lit(2), F.floor((F.col("at") - F.lit(low)) / F.lit(max((high or 0) - (low or 0), 1e-6) / 3)))
    for n in range(3):
        rows.where(third == n).write.mode("append").parquet(f"{base}/in")
        requests = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        L.run_limiter(requests, f"{base}/out", f"{base}/checkpoint", 1, 86400.0)
    return spark.read.schema("key string, at double, allowed boolean").parquet(f"{base}/out").select("key", R6("at").alias("at"), "allowed")


# ---------------------------------------------------------------- joins, context, answers


@register("with o as (select doc_id as id, source as v from documents), n as (select doc_id as id, 'new' || max(doc_id % 7 + 1) over (partition by doc_id) as v from documents where doc_id % 3 = 0 union all select doc_id + 1000000, 'added' from documents where doc_id % 5 = 0) select * from o where id not in (select id from n) union all select * from n")
def j_upsert(spark, sf_dir):
    own = table(spark, sf_dir, "documents")
    old = own.select(F.col("doc_id").alias("id"), F.col("source").alias("v"))
    first = own.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.lit("early").alias("v"), F.lit(0).alias("at"))
    later = own.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("new"), (F.col("doc_id") % 7 + 1).cast("string")).alias("v"), F.lit(1).alias("at"))
    added = own.where("doc_id % 5 = 0").select((F.col("doc_id") + 1000000).alias("id"), F.lit("added").alias("v"), F.lit(0).alias("at"))
    return I.upsert(old.withColumn("at", F.lit(-1)), first.unionByName(later).unionByName(added), "id", "at").select("id", "v")


@register(
    "with a as (select doc_id as id, source as v from documents where doc_id % 2 = 0), b as (select doc_id as id, 'new' || doc_id % 7 as v from documents where doc_id % 3 = 0), "
    "c as (select * from a where id not in (select id from b) union all select * from b) "
    "select 1 as version, * from a union all select 2, * from c union all select 3, * from c where id % 5 <> 0"
)
def store_versions(spark, sf_dir):
    """A versioned table after an insert, an upsert and a deletion, read at each of its three versions."""
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("v")).where("id is not null")
    store = VersionedTable(spark, f"{shared_dir(spark)}/tessera/store-{uuid.uuid4().hex}", "id")
    store.upsert(own.where("id % 2 = 0"), "v")
    store.upsert(own.where("id % 3 = 0").withColumn("v", F.concat(F.lit("new"), (F.col("id") % 7).cast("string"))), "v")
    store.upsert(own.limit(0), "v", deleted=own.where("id % 5 = 0"))
    versions = [store.read(n).select(F.lit(n).alias("version"), "id", "v") for n in (1, 2, 3)]
    return versions[0].unionByName(versions[1]).unionByName(versions[2])


@register(f"with documents as (select * from documents where doc_id % 7 <> 0), {S_BM25} select tok, df, round(idf, 6) as idf from idf")
def bm25_segments(spark, sf_dir):
    """Statistics of an index that took four batches, the last a deletion, and was merged in between: those of an index built at once."""
    own = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = G.SegmentedIndex(spark, f"{shared_dir(spark)}/tessera/segments-{uuid.uuid4().hex}")
    index.add(own.where("doc_id % 2 = 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("draft "), F.left("text", F.lit(50)))).otherwise(F.col("text"))), "doc_id", "text")
    index.add(own.where("doc_id % 2 = 1"), "doc_id", "text")
    index.merge()
    index.add(own.where("doc_id % 6 = 0"), "doc_id", "text")
    index.add(own.limit(0), "doc_id", "text", deleted=own.where("doc_id % 7 = 0").select(F.col("doc_id").alias("id")))
    return index.index().idf.select("tok", "df", R6("idf").alias("idf"))


@register("select h.id, d.source, d.text is not null as found from (select doc_id * 2 as id from documents) h left join documents d on d.doc_id = h.id")
def j_lookup(spark, sf_dir):
    own = table(spark, sf_dir, "documents")
    hits = own.select((F.col("doc_id") * 2).alias("id"))
    return hits.join(own.select(F.col("doc_id").alias("id"), "source", "text"), "id", "left").select("id", "source", F.col("text").isNotNull().alias("found"))


@register(f"with {LETTERS}, {S_CHUNKS}, {S_LINKED} select l.id, p.text as before, n.text as after from linked l left join linked p on p.id = l.previous_chunk_id left join linked n on n.id = l.next_chunk_id")
def j_neighbor(spark, sf_dir):
    found = A.neighbor_texts(_linked(spark, sf_dir), 1)
    return found.select("id", F.try_element_at("before", F.lit(1)).alias("before"), F.try_element_at("after", F.lit(1)).alias("after"))


_CTX = "case when length(t) >= 900 then left(t, 900) else array_to_string(list_filter([regexp_replace(case when (900 - length(t)) // 2 > 0 then right(b, (900 - length(t)) // 2) else '' end, '^\\s+|\\s+$', '', 'g'), t, regexp_replace(left(a, 900 - length(t) - (900 - length(t)) // 2), '^\\s+|\\s+$', '', 'g')], lambda x: x <> ''), chr(10) || chr(10)) end"


@register(f"with {LETTERS}, {S_CHUNKS}, {S_LINKED}, x as (select l.id, l.text as t, coalesce(p.text, '') as b, coalesce(n.text, '') as a from linked l left join linked p on p.id = l.previous_chunk_id left join linked n on n.id = l.next_chunk_id) select id, {_CTX} as context from x")
def ctx_expand(spark, sf_dir):
    return A.neighbor_texts(_linked(spark, sf_dir), 1).select("id", A.compose_context(F.col("before"), F.col("text"), F.col("after"), 900).alias("context"))


# SQL: the three best documents of every item, at a chunk that the item names; in every fifth document the links form a circle
S_HIT3 = "h3 as (select qid, id as doc_id, round(score, 6) as score, row_number() over (partition by qid order by round(score, 9) desc, id) - 1 as rank from sc qualify rank < 3), ch as (select h3.*, doc_id || '_' || (qid % total_chunks) as id from h3 join (select distinct doc_id, total_chunks from linked) using (doc_id))"
S_RING = "ring as (select id, text, doc_id, chunk_index, case when doc_id % 5 = 0 and chunk_index = 0 then doc_id || '_' || (total_chunks - 1) else previous_chunk_id end as prev, case when doc_id % 5 = 0 and chunk_index = total_chunks - 1 then doc_id || '_0' else next_chunk_id end as next from linked)"
_CTX3 = "case when length(t) >= 2600 then left(t, 2600) else array_to_string(list_filter([regexp_replace(case when (2600 - length(t)) // 2 > 0 then right(b, (2600 - length(t)) // 2) else '' end, '^\\s+|\\s+$', '', 'g'), t, regexp_replace(left(a, 2600 - length(t) - (2600 - length(t)) // 2), '^\\s+|\\s+$', '', 'g')], lambda x: x <> ''), chr(10) || chr(10)) end"


@register(
    f"with recursive {LETTERS}, {S_CHUNKS}, {S_LINKED}, {S_BENCH}, {S_SCORES}, {S_HIT3}, {S_RING}, "
    "walk as (select id as start, side, 0 as hop, case when side = 0 then prev else next end as nxt, [id] as seen, text from ring, (values (0), (1)) sd(side) where id in (select id from ch) "
    "union all select start, side, hop + 1, case when side = 0 then r.prev else r.next end, list_append(seen, r.id), r.text from walk join ring r on r.id = nxt where hop < 3 and not list_contains(seen, r.id)), "
    "tx as (select start, coalesce(string_agg(text, chr(10) || chr(10) order by hop desc) filter (side = 0 and hop > 0), '') as b, coalesce(string_agg(text, chr(10) || chr(10) order by hop) filter (side = 1 and hop > 0), '') as a from walk group by 1), "
    f"x as (select ch.qid, ch.rank, ch.id, ch.score, ring.text as t, b, a, case when chunk_index % 2 = 0 then 'part ' || chunk_index else '' end as title from ch join ring using (id) join tx on start = ch.id) select qid, rank, id, score, {_CTX3} as text, title as section_title, true as expanded from x"
)
def ctx_hits(spark, sf_dir):
    """Each item's three best hits with up to three neighbours on each side: scores stay, titles and marks come."""
    top = written(_whole(spark, sf_dir, 3), "hits").withColumnRenamed("id", "doc_id")
    # links stay within a document: those of the hits' documents are all that a walk can meet, and are cut once for all its steps
    linked = written(_linked(spark, sf_dir, top.select(F.col("doc_id").alias("id")).distinct()), "linked")
    at = F.col("doc_id") % 5 == 0
    end = lambda n: F.concat_ws("_", F.col("doc_id").cast("string"), n.cast("string"))
    ring = linked.select(
        "id", "text", "doc_id", "total_chunks", F.when(at & (F.col("chunk_index") == 0), end(F.col("total_chunks") - 1)).otherwise(F.col("previous_chunk_id")).alias("previous_chunk_id"),
        F.when(at & (F.col("chunk_index") == F.col("total_chunks") - 1), end(F.lit(0))).otherwise(F.col("next_chunk_id")).alias("next_chunk_id"),
        F.when(F.col("chunk_index") % 2 == 0, F.concat(F.lit("part "), F.col("chunk_index").cast("string"))).alias("section_title"),
    )
    totals = linked.groupBy("doc_id").agg(F.max("total_chunks").alias("total"))
    best = top.join(totals, "doc_id")
    hits = best.select("qid", F.col("rank").cast("long").alias("rank"), end(F.col("qid") % F.col("total")).alias("id"), R6("score").alias("score"), F.lit("").alias("text"))
    return A.expand_hits(hits, ring, hops=3)


@register(
    f"with {S_BENCH}, {S_SCORES}, c as (select qid, id from sc qualify row_number() over (partition by qid order by round(score, 9) desc, id) <= 30), "
    "tk as (select qid, id, list_transform(regexp_extract_all(d.text, '[A-Za-z0-9'']+'), lambda x: lower(x)) as toks, list_distinct(list_transform(regexp_extract_all(query, '[A-Za-z0-9'']+'), lambda x: lower(x))) as asked from c join documents d on doc_id = id join qs using (qid)), "
    "ps as materialized (select qid, id, tok, list(i order by i) as pl from (select qid, id, unnest(toks) as tok, unnest(range(1, len(toks) + 1)) as i, asked from tk) where list_contains(asked, tok) group by all), "
    "al as materialized (select qid, id, list(pl) as terms, count(*) as m from ps group by all), "
    "wn as (select al.qid, al.id, m, e - list_min(list_transform(terms, lambda t: list_max(list_filter(t, lambda p: p <= e)))) + 1 as size from al join (select qid, id, unnest(pl) as e from ps) using (qid, id) where len(list_filter(terms, lambda t: t[1] <= e)) = m), "
    "rw as (select qid, id, max(m) + 1.0 / min(size) as raw from wn group by all union all select qid, id, 0 from c where (qid, id) not in (select (qid, id) from al)), "
    "sx as (select qid, id, round(case when hi = lo then 1 else (raw - lo) / (hi - lo) end, 9) as score from (select *, min(raw) over (partition by qid) as lo, max(raw) over (partition by qid) as hi from rw)) "
    "select qid, id, round(score, 6) as score, r - 1 as rank from (select *, row_number() over (partition by qid order by score desc, id) as r from sx) where r <= 8"
)
def rerank_window(spark, sf_dir):
    """Each item's 30 candidates by how many of its words they have and how close together."""
    texts = letters(spark, sf_dir).select("id", "text")
    pool = _whole(spark, sf_dir).select("qid", "id").join(texts, "id").join(_bench(spark, sf_dir), "qid")
    scored = R.minmax_rerank(R.window_scores(pool), 30).withColumn("score", F.round("score", 9)).drop("rank")
    return R.ranked(scored, 8).select("qid", "id", R6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


SQL["ctx_compose"], QUERIES["ctx_compose"] = SQL["ctx_expand"], QUERIES["ctx_expand"]


@register("select source as qid, string_agg('[' || r || '] (year=' || (1977 + doc_id % 48) || ', source=' || source || ')' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) order by r) as passages from (select *, row_number() over (partition by source order by doc_id) as r from documents) where r <= 8 group by 1")
def passage_block(spark, sf_dir):
    """The first eight letters of each source as numbered passages."""
    w = Window.partitionBy("source_file").orderBy("id")
    hits = R.first_rows(letters(spark, sf_dir), 8, w).withColumn("qid", F.col("source_file"))
    return A.passage_block(hits)


ANSWERS = (
    "The float grew. [1] It was cheap [2, 3].",
    "Nothing is cited here. At all.",
    "Bad marker [9] and good [1].",
    "[0] starts badly. Then [1,9] and [1 , 2].",
    "",
    "One",
    "Then the ending of text [3]. And more [2]! Is it so? \"Yes\" [1].",
)
S_ANSWERS = "an(qid, answer) as (values " + ", ".join(f"({i}, {LIT(x)})" for i, x in enumerate(ANSWERS)) + ")"


def _answers(spark):
    return spark.createDataFrame(list(enumerate(ANSWERS)), "qid int, answer string")


# every turn of the conversations as an answer: one of the stated ones and what was said
S_SAID = f"an as (select conv_id, turn, ([{', '.join(map(LIT, ANSWERS))}])[1 + (conv_id + turn) % {len(ANSWERS)}] || ' ' || coalesce(text, '') as answer from conversations)"


def _said(spark, sf_dir):
    told = picked(ANSWERS, F.col("conv_id") + F.col("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(told, F.lit(" "), F.coalesce("text", F.lit(""))).alias("answer"))


@register(f"with {S_SAID}, m as (select conv_id, turn, unnest(regexp_extract_all(answer, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1)) as m, generate_subscripts(regexp_extract_all(answer, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), 1) as pos from an) select conv_id, turn, cast(pos - 1 as integer) as pos, list_transform(regexp_split_to_array(m, '\\s*,\\s*'), lambda x: x::integer) as raw_numbers, list_transform(list_filter(list_transform(regexp_split_to_array(m, '\\s*,\\s*'), lambda x: x::integer), lambda n: n between 1 and 3), lambda n: n - 1) as passage_indices from m")
def cite_parse(spark, sf_dir):
    each = _said(spark, sf_dir).select("conv_id", "turn", F.posexplode(A.parse_citations(F.col("answer"), F.lit(3))).alias("pos", "c"))
    return each.select("conv_id", "turn", "pos", "c.raw_numbers", "c.passage_indices")


def _s_strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _s_split(x, ahead):
    """SQL: the stripped parts of ``x`` between an end of sentence and white space before one of ``ahead``, empty ones too."""
    return f"list_transform(string_split(regexp_replace({_s_strip(x)}, '([.!?])\\s+([{ahead}])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda y: {_s_strip('y')})"


S_SENTENCES = f"list_filter({_s_split('answer', 'A-Z0-9&')}, lambda y: y <> '')".replace("&", '"\'\'')
S_MARKS = "list_transform(regexp_extract_all({}, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda m: list_transform(regexp_split_to_array(m, '\\s*,\\s*'), lambda x: x::integer))"


@register(
    f"with {S_ANSWERS}, h as (select row_number() over (order by doc_id) as n, regexp_extract_all(lower(text), '[A-Za-z0-9'']+') as p from documents order by doc_id limit 3), "
    f"o as (select qid, {S_SENTENCES} as sents, {S_MARKS.format('answer')} as marks from an), "
    f"st as (select qid, unnest(sents) as sentence, generate_subscripts(sents, 1) as pos from o), "
    f"ci as (select qid, pos, regexp_extract_all(lower(sentence), '[A-Za-z0-9'']+') as s, unnest(list_distinct(flatten({S_MARKS.format('sentence')}))) as n from st), "
    "pp as (select qid, pos, s, p, list_distinct(list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1])) as sp, list_distinct(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1])) as pw from ci join h using (n)), "
    "su as (select qid, pos, max(case when len(s) < 2 or len(p) < 2 then case when len(s) = 0 then 0 else len(list_intersect(list_distinct(s), p)) / len(list_distinct(s)) end else len(list_intersect(sp, pw)) / len(sp) end) as support from pp group by all), "
    "tt as (select qid, count(*) as n_cited, avg(support) as mean_support from su group by 1) "
    "select qid, cast(len(sents) as integer) as n_sentences, coalesce(n_cited, 0) as n_cited, round(case when len(sents) > 0 then coalesce(n_cited, 0) / len(sents) else 0 end, 6) as citation_coverage, "
    "round(case when len(sents) > 0 and len(marks) > 0 then len(list_filter(marks, lambda m: len(list_filter(m, lambda x: x < 1 or x > 3)) > 0)) / len(marks) else 0 end, 6) as invalid_citation_rate, "
    "round(coalesce(mean_support, 0), 6) as mean_support from o left join tt using (qid)"
)
def faith(spark, sf_dir):
    """Coverage, invalid rate and support of the stated answers over three documents."""
    hits = table(spark, sf_dir, "documents").orderBy("doc_id").limit(3).select((F.row_number().over(Window.orderBy("doc_id")) - 1).alias("rank"), "text")  # the three passages are the feature
    each = hits.crossJoin(F.broadcast(_answers(spark).select("qid")))
    return A.faithfulness(_answers(spark), each).select("qid", "n_sentences", "n_cited", *(R6(c).alias(c) for c in ("citation_coverage", "invalid_citation_rate", "mean_support")))


# SQL: three passages of every item, its best documents, and an answer from them by the number of the item
S_PASSAGES = "hp as (select qid, id, row_number() over (partition by qid order by round(score, 9) desc, id) as n from sc qualify n <= 3), h as (select qid, n, text, regexp_extract_all(lower(text), '[A-Za-z0-9'']+') as p from hp join documents on doc_id = id)"
S_GIVEN = "gv as (select qs.qid, coalesce(left(h.text, 120), '') || ' [1]. ' || " + f"([{', '.join(map(LIT, ANSWERS))}])[1 + qs.qid % {len(ANSWERS)}]" + " as answer from qs left join h on h.qid = qs.qid and n = 1)"
S_FAITH = (
    f"o as (select qid, {S_SENTENCES} as sents, {S_MARKS.format('answer')} as marks, (select count(*) from h where h.qid = an.qid) as nh from an), "
    f"sy as (select qid, unnest(sents) as sentence, generate_subscripts(sents, 1) as pos from o), "
    f"ci as (select qid, pos, regexp_extract_all(lower(sentence), '[A-Za-z0-9'']+') as s, unnest(list_distinct(flatten({S_MARKS.format('sentence')}))) as n from sy), "
    "pp as (select qid, pos, s, p, list_distinct(list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1])) as sp, list_distinct(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1])) as pw from ci join h using (qid, n)), "
    "su as (select qid, pos, max(case when len(s) < 2 or len(p) < 2 then case when len(s) = 0 then 0 else len(list_intersect(list_distinct(s), p)) / len(list_distinct(s)) end else len(list_intersect(sp, pw)) / len(sp) end) as support from pp group by all), "
    "tt as (select qid, count(*) as n_cited, avg(support) as mean_support from su group by 1), "
    "fa as (select qid, cast(len(sents) as integer) as n_sentences, coalesce(n_cited, 0) as n_cited, round(case when len(sents) > 0 then coalesce(n_cited, 0) / len(sents) else 0 end, 6) as citation_coverage, "
    "round(case when len(sents) > 0 and len(marks) > 0 then len(list_filter(marks, lambda m: len(list_filter(m, lambda x: x < 1 or x > nh)) > 0)) / len(marks) else 0 end, 6) as invalid_citation_rate, "
    "round(coalesce(mean_support, 0), 6) as mean_support from o left join tt using (qid))"
)


def _echo(prompt: str) -> str:
    """A provider that gives its prompt back, is busy for some and refuses others."""
    if prompt.startswith("!"):
        raise RuntimeError("refused")
    return prompt


@register(
    f"with {S_BENCH}, {S_SCORES}, {S_PASSAGES}, {S_GIVEN}, an as (select * from gv where qid % 10 <> 3), {S_FAITH} "
    "select gv.qid, case when gv.qid % 10 <> 3 then md5(gv.answer) end as answer, case when gv.qid % 10 = 3 then 'RuntimeError: refused' end as error, case when gv.qid % 10 = 3 then 2 else 1 end as tries, "
    "case when gv.qid % 10 <> 3 then round((contains(lower(gv.answer), 'the')::int + contains(lower(gv.answer), 'zz')::int) / 2, 6) end as keyword_rate, n_sentences, n_cited, citation_coverage, invalid_citation_rate, mean_support from gv left join fa using (qid)"
)
def eval_answers(spark, sf_dir):
    """Answers to all items judged by their three best documents; questions whose provider fails keep its error."""
    hits = _whole(spark, sf_dir, 3).join(letters(spark, sf_dir).select("id", "text"), "id").select("qid", "rank", "text")
    first = hits.where("rank = 0").select("qid", F.left("text", F.lit(120)).alias("first"))
    told = F.element_at(F.array(*map(F.lit, ANSWERS)), (1 + F.col("qid") % len(ANSWERS)).cast("int"))
    asked = _bench(spark, sf_dir).select("qid").join(first, "qid", "left")
    prompts = asked.select("qid", F.concat(F.when(F.col("qid") % 10 == 3, "!").otherwise(""), F.coalesce("first", F.lit("")), F.lit(" [1]. "), told).alias("prompt"))
    answers = A.answer_all(prompts, _echo)
    gold = _bench(spark, sf_dir).select("qid", F.array(F.lit("the"), F.lit("zz")).alias("answer_keywords"))
    scores = A.evaluate_answers(answers, hits, gold)
    return scores.join(answers.select("qid", "tries"), "qid").select("qid", F.md5("answer").alias("answer"), "error", "tries", R6("keyword_rate").alias("keyword_rate"), "n_sentences", "n_cited", *(R6(c).alias(c) for c in ("citation_coverage", "invalid_citation_rate", "mean_support")))


def _next_ids(ids, span=1024):
    """(doc_id, pair): the next id in order.  Ids are ordered within spans of so many; a span's last id goes on with the next span's first."""
    spans = ids.where("doc_id is not null").withColumn("span", F.floor(F.col("doc_id") / span))
    firsts = spans.groupBy("span").agg(F.min("doc_id").alias("first"))
    groups = firsts.groupBy(F.floor(F.col("span") / span).alias("group")).agg(F.min("first").alias("first"))
    # a row for each million of ids is left for one task
    groups = groups.withColumn("beyond", F.lead("first").over(Window.orderBy("group"))).select("group", "beyond")
    firsts = firsts.withColumn("group", F.floor(F.col("span") / span)).join(groups, "group")
    firsts = firsts.select("span", F.coalesce(F.lead("first").over(Window.partitionBy("group").orderBy("span")), "beyond").alias("beyond"))
    within = F.lead("doc_id").over(Window.partitionBy("span").orderBy("doc_id"))
    return spans.withColumn("pair", within).join(firsts, "span").select("doc_id", F.coalesce("pair", "beyond").alias("pair"))


@register("select doc_id, round(case when len(s) < 2 or len(p) < 2 then case when len(s) = 0 then 0 else len(list_intersect(list_distinct(s), p)) / len(list_distinct(s)) end else len(list_intersect(sp, pp)) / len(sp) end, 6) as support from (select doc_id, s, p, list_distinct(list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1])) as sp, list_distinct(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1])) as pp from (select doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9'']+') as s, regexp_extract_all(lower(lead(text, 1, '') over (order by doc_id)), '[A-Za-z0-9'']+') as p from documents))")
def lex_support(spark, sf_dir):
    """Each whole document against the next one."""
    own = table(spark, sf_dir, "documents")
    after = _next_ids(own.select("doc_id"))
    texts = own.select(F.col("doc_id").alias("pair"), F.col("text").alias("next"))
    return own.join(after, "doc_id").join(texts, "pair", "left").select("doc_id", R6(A.lexical_support(F.col("text"), F.coalesce("next", F.lit("")))).alias("support"))


@register(
    f"select doc_id, cast(len({S_SENTENCES.replace('answer', 'text')}) as integer) as n_sentences, "
    + "cast(len(list_filter({}, lambda y: length(y) >= {})) as integer) as n_long from documents".format(_s_split("regexp_replace(text, '\\s+', ' ', 'g')", "A-Z\"''("), A.LEAST_CHARS)
)
def sent_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(A.split_sentences(F.col("text"))).alias("n_sentences"), F.size(A.answer_sentences(F.col("text"))).alias("n_long"))


@register()
def local_answer(spark, sf_dir):
    """An extractive answer to every benchmark item from its best passages."""
    whole = _whole(spark, sf_dir, 8)
    hits = whole.join(letters(spark, sf_dir).select("id", "text"), "id").select("qid", "rank", "text")
    return A.extractive_answers(_bench(spark, sf_dir), hits)


@register("select qid, " + LIT(A.CONTRACT) + " || chr(10) || chr(10) || '<passages>' || chr(10) || passages || chr(10) || '</passages>' || chr(10) || chr(10) || '<question>' || chr(10) || " + LIT(QUESTION) + " || chr(10) || '</question>' || chr(10) as prompt from (" + SQL["passage_block"] + ")")
def build_prompt(spark, sf_dir):
    w = Window.partitionBy("source_file").orderBy("id")
    hits = R.first_rows(letters(spark, sf_dir), 8, w).withColumn("qid", F.col("source_file"))
    return A.passage_block(hits).select("qid", A.build_prompt(F.lit(QUESTION), F.col("passages")).alias("prompt"))


_NOISY = "'<|im_start|>' || text || '[INST]<s> 【1, 2】 x［3］</s>'"


@register(f"select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_NOISY}, '<\\|.*?\\|>', '', 'g'), '\\[/?INST\\]', '', 'g'), '</?s>', '', 'g'), '[【［]\\s*(\\d+(?:\\s*,\\s*\\d+)*)\\s*[】］]', '[\\1]', 'g'), '^\\s+|\\s+$', '', 'g') as out from documents")
def strip_artifacts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_artifacts(F.expr(_NOISY)).alias("out"))


S_LISTED = "'Points: 1. ' || text || ', 2. more, 3. end' || chr(10) || 'after' || chr(10) || '- a' || chr(10) || '- b' || chr(10) || 'last'"
S_ITEM = "regexp_matches({}, '^\\s*([-*]|\\d+\\.)\\s')"


@register(
    f"with s as (select doc_id, list_transform(string_split({S_LISTED}, chr(10)), lambda l: string_split(regexp_replace(l, ',\\s*(\\d+\\.\\s)', chr(1) || '\\1', 'g'), chr(1))) as cut, string_split({S_LISTED}, chr(10)) as raw from documents), "
    "l as (select doc_id, flatten(list_transform(cut, lambda p, i: case when len(list_filter(p[:-2], lambda x: regexp_matches(x, '\\d+\\.\\s+.'))) > 0 then p else [raw[i]] end)) as ls from s) "
    f"select doc_id, regexp_replace(array_to_string(list_transform(ls, lambda x, i: case when i > 1 and trim(ls[i - 1]) <> '' and trim(x) <> '' and ({S_ITEM.format('x')} or {S_ITEM.format('ls[i - 1]')}) then chr(10) else '' end || x), chr(10)), '^\\s+|\\s+$', '', 'g') as out from l"
)
def fmt_list(spark, sf_dir):
    listed = F.concat(F.lit("Points: 1. "), F.col("text"), F.lit(", 2. more, 3. end\nafter\n- a\n- b\nlast"))
    return table(spark, sf_dir, "documents").select("doc_id", T.format_list(listed).alias("out"))


@register("select doc_id, case when length(text) > 240 then replace(left(text, 240), chr(10), ' ') || '...' else replace(text, chr(10), ' ') end as out from documents")
def snippet240(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("out"))


@register("select doc_id, left(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), 320) || case when length(text) > 320 then '...' else '' end as out from documents")
def preview320(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("out"))


@register("select doc_id, list_slice(list_filter(list_transform(string_split(source || ', ,' || lang || ',a , b', ','), lambda x: trim(x)), lambda x: x <> ''), 1, 4) as chips from documents")
def topic_chips(spark, sf_dir):
    parts = F.transform(F.split(F.concat("source", F.lit(", ,"), "lang", F.lit(",a , b")), ","), lambda x: F.trim(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.slice(F.filter(parts, lambda x: x != ""), 1, 4).alias("chips"))


@register("select vec_id, round(least(100, greatest(0, embedding[1]::double * 100)), 3) as width from embeddings")
def score_bar(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("embedding")[0].cast("double") * 100)), 3).alias("width"))


_ERR = "case doc_id % 8 when 0 then 'Insufficient_Quota' when 1 then 'Incorrect API key' when 2 then 'Unauthorized' when 3 then 'api_key is required' when 4 then 'model does not exist' when 5 then 'HTTP 429' when 6 then 'Overloaded' else 'boom' end"


@register("with e as (select doc_id, lower(" + _ERR + ") as r from documents) select doc_id, case " + " ".join("when " + " or ".join(f"contains(r, {LIT(m)})" for m in marks) + f" then {LIT(text)}" for marks, text in zip(T.ERROR_MARKS, T.MESSAGES)) + f" else {LIT(T.NO_ANSWER)} end as message from e")
def err_map(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.error_message(F.expr(_ERR)).alias("message"))


_BLOCK = "case doc_id % 4 when 0 then '- a' || chr(10) || '* ' || source when 1 then '1. a' || chr(10) || chr(10) || '2. b' when 2 then '- one' else text end"


@register(f"with b as (select doc_id, list_filter(string_split({_BLOCK}, chr(10)), lambda x: regexp_matches(x, '\\S')) as ls from documents) select doc_id, case when len(ls) >= 2 and len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*[-*]\\s+'))) = len(ls) then 'bullet' when len(ls) >= 2 and len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*\\d+\\.\\s+'))) = len(ls) then 'numbered' else 'paragraph' end as kind from b")
def block_kind(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.block_kind(F.expr(_BLOCK)).alias("kind"))


@register(f"with {LETTERS} select id, chunk_index, text from (select *, row_number() over (partition by year order by id) - 1 as chunk_index from letters where year = 1990) where chunk_index < 5")
def first5(spark, sf_dir):
    """The first five rows of a year: the limit is the feature."""
    w = Window.partitionBy("year").orderBy("id")
    return R.first_rows(letters(spark, sf_dir).where("year = 1990"), 5, w).select("id", F.col("rank").cast("long").alias("chunk_index"), "text")


@register()
def sample(spark, sf_dir):
    """Twenty rows drawn at random with a seed: a sampling operator."""
    return table(spark, sf_dir, "documents").orderBy(F.rand(7)).limit(20).select("doc_id", "source")
