"""Registered queries of files, filters, evaluation reports, embeddings and approximate search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import query as Q, text as T
from ..operators import answer as A, chunk as C, embed as E, index as I, inverted as V, metrics as M, retrieve as R
from ..session import shared_dir
from ..sources import files, stores
from .catalog import LETTERS, LIT, S_CHUNKS, _chunks, letters, register, table
from .retrieval import R6, S_BENCH, S_RANKS, S_SAID, S_SCORES, S_VEC, _bench, _said, _two_rankings, _vector_queries

# ---------------------------------------------------------------- files

_RECORDS = f"with {LETTERS}, {S_CHUNKS} select doc_id || '_' || chunk_index as id, year, source_file, chunk_index, text from chunks"


def _records(spark, sf_dir):
    return _chunks(spark, sf_dir).select(F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), "year", "source_file", "chunk_index", "text")


def _chunk_file(spark, sf_dir):
    path = f"{shared_dir(spark)}/tessera/chunks-{uuid.uuid4().hex}"
    files.write_chunks(_records(spark, sf_dir), path)
    return path


@register(_RECORDS)
def src_jsonl(spark, sf_dir):
    """All chunks written as JSON lines and read back."""
    return files.read_chunks(spark, _chunk_file(spark, sf_dir)).select("id", "year", "source_file", "chunk_index", "text")


@register(f"select year, count(*) as n, sum(length(text)) as chars from ({_RECORDS}) where year = 1990 group by 1")
def year_scan(spark, sf_dir):
    found = files.read_chunks(spark, _chunk_file(spark, sf_dir), 1990)
    return found.groupBy("year").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@register(f"with r as ({_RECORDS}), f as (select distinct year, source_file from (with {LETTERS} select * from letters)), n as (select year, source_file, count(*) as c from r group by all) select count(*) as total_letters, cast(sum(coalesce(c, 0)) as bigint) as total_chunks, min(year) as first_year, max(year) as last_year, '2' as version from f left join n using (year, source_file)")
def sink_meta(spark, sf_dir):
    """The run's metadata by the library's own function; a letter is a year's file."""
    own = letters(spark, sf_dir).select("year", "source_file", F.lit("txt").alias("file_type")).distinct()
    meta = files.run_metadata(own, _records(spark, sf_dir), size=C.SIZE, overlap=C.OVERLAP, least=C.LEAST)
    return meta.select("total_letters", "total_chunks", F.col("year_range")[0].alias("first_year"), F.col("year_range")[1].alias("last_year"), "version")


@register(f"with {LETTERS}, {S_CHUNKS}, l as (select count(*) as n from letters), c as (select count(*) as n, min(year) as lo, max(year) as hi from chunks) select unnest(['letters', 'chunks', 'years', 'chunks a letter']) as label, unnest([l.n::varchar, c.n::varchar, lo || '-' || hi, (c.n // l.n)::varchar]) as value from l, c")
def run_summary(spark, sf_dir):
    n = letters(spark, sf_dir).agg(F.count("*").alias("l"))
    c = _chunks(spark, sf_dir).agg(F.count("*").alias("c"), F.concat_ws("-", F.min("year").cast("string"), F.max("year").cast("string")).alias("y"))
    return n.crossJoin(c).selectExpr("stack(4, 'letters', cast(l as string), 'chunks', cast(c as string), 'years', y, 'chunks a letter', cast(c div l as string)) as (label, value)")  # one row each


@register(f"with {LETTERS}, {S_CHUNKS}, y as (select year, count(*) as n from chunks group by 1) select year, n, round(100.0 * n / sum(n) over (), 4) as percent from y")
def data_summary(spark, sf_dir):
    """Chunks of each year and their share of all."""
    by_year = _chunks(spark, sf_dir).groupBy("year").agg(F.count("*").alias("n"))
    whole = by_year.agg(F.sum("n").alias("all"))
    return by_year.crossJoin(F.broadcast(whole)).select("year", "n", F.round(100.0 * F.col("n") / F.col("all"), 4).alias("percent"))  # one row


@register("select doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as v1, 'caf' || chr(233) || ' ' || lang as v2 from documents where text is not null")
def src_text(spark, sf_dir):
    """Bytes to text: UTF-8 by both readers, and ISO-8859-1 where the bytes are no UTF-8."""
    own = table(spark, sf_dir, "documents").where("text is not null")
    latin = F.encode(F.concat(F.lit("café "), "lang"), "ISO-8859-1")
    return own.select("doc_id", T.decode_utf8_or_empty(F.col("text").cast("binary")).alias("v1"), T.decode_utf8_or_latin1(latin).alias("v2"))


@register("select doc_id, list_filter(['doc_id=' || doc_id, 'lang=' || lang, 'topics=' || case when doc_id % 3 = 0 then null else source || ',' || lang end], lambda x: x is not null) as fields from documents")
def meta_sanitize(spark, sf_dir):
    topics = F.when(F.col("doc_id") % 3 != 0, F.concat_ws(",", F.array("source", "lang")))
    fields = files.sanitize_metadata({"doc_id": F.col("doc_id"), "lang": F.col("lang"), "topics": topics})
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(F.map_entries(fields), lambda e: F.concat_ws("=", e["key"], e["value"])).alias("fields"))


# ---------------------------------------------------------------- filters

_FIELD = "case doc_id % 7 when 0 then 'year' when 1 then 'decade' when 2 then 'source_file' when 3 then lang when 4 then 'topics' when 5 then source else 'chunk_index' end"
_OP = "case doc_id % 8 when 0 then '$eq' when 1 then '$gte' when 2 then '$lte' when 3 then '$gt' when 4 then '$lt' when 5 then '$in' when 6 then '$ne' else '$' || lang end"


@register(
    f"with f as (select doc_id, {_FIELD} as field, {_OP} as op, doc_id % 3 = 0 as listed from documents) select doc_id, case when field not in ({', '.join(map(LIT, Q.FIELDS))}) then 'unknown filter field: ' || field "
    f"when op not in ({', '.join(map(LIT, Q.OPERATORS))}) then 'unknown filter operator: ' || op when op = '$in' and not listed then '$in needs a collection' end as fault from f"
)
def where_validate(spark, sf_dir):
    """What is wrong with each of the documents' conditions."""
    return table(spark, sf_dir, "documents").select("doc_id", Q.filter_fault(F.expr(_FIELD), F.expr(_OP), F.col("doc_id") % 3 == 0).alias("fault"))


@register("select doc_id, case doc_id % 6 when 0 then 'year:' || (1977 + doc_id % 48) || '–' || (1980 + doc_id % 48) when 1 then 'year:?–' || (1980 + doc_id % 48) when 2 then 'year:' || (1977 + doc_id % 48) when 3 then 'decade:' || (1970 + doc_id % 5 * 10) || 's' when 4 then 'custom' else 'none' end as label from documents")
def filter_label(spark, sf_dir):
    """The filter of each document in a few words."""
    k, year = F.col("doc_id") % 6, 1977 + F.col("doc_id") % 48
    label = Q.label_column(F.when(k == 2, year), F.when(k == 0, year), F.when(k < 2, year + 3), F.when(k == 3, 1970 + F.col("doc_id") % 5 * 10), k == 4)
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("label"))


_NAME = "case doc_id % 6 when 0 then source when 1 then '_' || lang || doc_id when 2 then doc_id || lang when 3 then source || '-' || lang when 4 then repeat('a', cast(doc_id % 70 as int)) else lang || chr(10) end"


@register(f"select doc_id, regexp_full_match({_NAME}, '{Q.IDENTIFIER}') as ok from documents")
def pg_ident(spark, sf_dir):
    """Whether each of the documents' names may name a table."""
    return table(spark, sf_dir, "documents").select("doc_id", Q.identifier_ok(F.expr(_NAME)).alias("ok"))


@register(f"with {LETTERS} select id from letters where year = 1990 and decade = 1990")
def cli_filter(spark, sf_dir):
    """Year and decade together are a conjunction."""
    return letters(spark, sf_dir).where(Q.filter_column({"year": 1990, "decade": 1990})).select("id")


@register(f"with {LETTERS} select scope, id from letters, (values ('all'), ('year'), ('decade')) s(scope) where scope = 'all' or (scope = 'year' and year = 1985) or (scope = 'decade' and decade = 2000)")
def where_ui(spark, sf_dir):
    """A scope of the search form is a filter: everything, a year or a decade."""
    scopes = {"all": None, "year": {"year": 1985}, "decade": {"decade": 2000}}
    own = letters(spark, sf_dir)
    hit = F.array(*(F.when(Q.filter_column(w), F.lit(name)) for name, w in scopes.items()))
    return own.select(F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("scope"), "id")


# ---------------------------------------------------------------- answers

_MARK = r"\[\d+(?:\s*,\s*\d+)*\]"


@register(f"with {S_SAID} select conv_id, turn, regexp_extract_all(answer, '{_MARK}|[^\\[]+|\\[') as tokens from an")
def cite_tokens(spark, sf_dir):
    """An answer as its citation marks and the text between them."""
    return _said(spark, sf_dir).select("conv_id", "turn", F.regexp_extract_all("answer", F.lit(_MARK + r"|[^\[]+|\["), F.lit(0)).alias("tokens"))


@register(f"select doc_id, case when doc_id % 3 = 0 then text else {LIT(A.REFUSAL)} || ' Sorry.' end as first, case when doc_id % 3 = 0 then text else source end as answer from documents")
def refusal_retry(spark, sf_dir):
    first = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.lit(A.REFUSAL + " Sorry."))
    return table(spark, sf_dir, "documents").select("doc_id", first.alias("first"), A.refusal_retry(first, F.col("source")).alias("answer"))


@register("select conv_id, turn, lower(role) as role, left(coalesce(text, ''), 1500) as text from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 200")
def history_buf(spark, sf_dir):
    """The last 200 messages of each conversation, cut at 1500 characters: both limits are the feature."""
    return A.history_buffer(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")


# ---------------------------------------------------------------- evaluation

_SETTINGS = "(values ('all years'), ('1985-2017')) s(strategy)"
_BOTH = (
    f"with {S_BENCH}, {S_SCORES}, {S_RANKS}, c as (select 'all years' as strategy, qid, id, rank from v1 where rank < 30 union all select '1985-2017', qid, id, rank from v2 where rank < 30), "
    "m as (select strategy, false as rerank, qid, id, rank from c where rank < 10 union all select strategy, true, qid, id, row_number() over (partition by strategy, qid order by length(text) , id) - 1 from c join documents on doc_id = id qualify row_number() over (partition by strategy, qid order by length(text), id) <= 10), "
    "fl as (select strategy, rerank, qid, rank, cast(1977 + id % 48 as integer) // 10 * 10 = 1980 + qid % 4 * 10 as year_hit, contains(lower(text), 'the') as word from m join documents on doc_id = id), "
    "per as (select strategy, rerank, qid, count(*) filter (year_hit and rank < 5) / greatest(count(*) filter (rank < 5), 1) as y5, max((year_hit and word and rank < 5)::int::double) as r5, coalesce(1.0 / min(case when year_hit and word then rank + 1 end), 0) as mrr from fl group by all) "
)


def _gold(spark, sf_dir):
    """Gold rows of the benchmark items: the years of a decade, and a word that a passage must have."""
    first = (1980 + F.col("qid") % 4 * 10).cast("int")
    return _bench(spark, sf_dir).select("qid", F.sequence(first, first + 9).alias("target_years"), F.array(F.lit("the")).alias("must_contain_any"))


def _matrix(spark, sf_dir):
    """Both rankings, plain and reranked by a scorer (the shortest first), judged by gold years and words."""
    texts = letters(spark, sf_dir).select("id", "year", "text")
    runs = None
    for name, hits in zip(("all years", "1985-2017"), _two_rankings(spark, sf_dir)):
        pool = hits.select("qid", "id", "rank").join(texts, "id").join(_bench(spark, sf_dir), "qid")
        again = R.rerank_by(pool, lambda q, t: -F.length(t), 10).select("qid", "id", "rank").join(texts, "id")
        for flag, found in ((False, pool.where("rank < 10")), (True, again)):
            one = found.select(F.lit(name).alias("strategy"), F.lit(flag).alias("rerank"), "qid", "rank", "year", "text")
            runs = one if runs is None else runs.unionByName(one)
    return M.per_query(M.relevance(runs, _gold(spark, sf_dir)), (1, 5), by=("strategy", "rerank", "qid"))


@register(_BOTH + "select strategy, rerank, count(distinct qid) as n_queries, round(avg(r5), 4) as recall_at_5, round(avg(y5), 4) as year_hit_rate_at_5, round(avg(mrr), 4) as mrr from per group by all")
def m_matrix(spark, sf_dir):
    """Mean metrics of each strategy with and without reranking."""
    means = M.means(_matrix(spark, sf_dir), ("strategy", "rerank"))
    return means.select("strategy", "rerank", "n_queries", *(F.round(c, 4).alias(c) for c in ("recall_at_5", "year_hit_rate_at_5", "mrr")))


@register(_BOTH + "select strategy, rerank, qid, round(y5, 6) as year_hit_rate_at_5, r5 as recall_at_5, round(mrr, 6) as mrr from per")
def j_gold(spark, sf_dir):
    """Relevance by gold years and words for every question, strategy and rerank setting."""
    return _matrix(spark, sf_dir).select("strategy", "rerank", "qid", R6("year_hit_rate_at_5").alias("year_hit_rate_at_5"), "recall_at_5", R6("mrr").alias("mrr"))


_POOL = f"with {S_BENCH}, {S_SCORES}, {S_RANKS}, h as (select qid, id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) as toks from v1 join documents on doc_id = id where rank < 30), "


@register(_POOL + "p as (select x.qid, x.id as a, y.id as b, len(list_intersect(x.toks, y.toks)) as n, len(x.toks) as m, len(y.toks) as o from h x join h y on x.qid = y.qid and x.id < y.id) select qid, a, b, round(n / (m + o - n), 6) as jaccard from p where n > 0 and (n / (m + o - n) >= 0.85 or n / least(m, o) >= 0.92)")
def dedup_pairs(spark, sf_dir):
    """Pairs of each question's 30 candidates that repeat one another."""
    whole, _ = _two_rankings(spark, sf_dir)
    hits = whole.select("qid", "id").join(letters(spark, sf_dir).select("id", "text"), "id")
    return R.repeated_pairs(hits).select("qid", "a", "b", R6("jaccard").alias("jaccard"))


# ---------------------------------------------------------------- embeddings

S_LETTERS = "list_transform(range(26), lambda k: length(lower({0})) - length(replace(lower({0}), chr((97 + k)::integer), '')))"
S_UNIT = "list_transform({0}, lambda x: round(cast(cast(case when {1} > 0 then x / sqrt({1}) else x end as float) as double), 6))"
_S_EMBED = f"select {{}}, {S_UNIT.format('c', 'list_sum(list_transform(c, lambda x: x * x))')} as vec from (select {{}}, {S_LETTERS.format('t')} as c from (select {{}}, {{}} as t from {{}}))"


def _rounded(vec):
    return F.transform(vec, lambda x: F.round(x.cast("double"), 6))


@register(_S_EMBED.format("doc_id", "doc_id", "doc_id", "text", "documents"))
def emb_doc(spark, sf_dir):
    """Every document's unit vector by an encoder that needs no model."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", _rounded(E.embed(docs, F.col("text"), E.letter_counts)).alias("vec"))


@register(_S_EMBED.format("qid", "qid", "item_id as qid", "'Represent this question: ' || text", "benchmark"))
def emb_query(spark, sf_dir):
    """The same encoder on questions, behind their instruction."""
    asked = _bench(spark, sf_dir)
    return asked.select("qid", _rounded(E.embed(asked, F.col("query"), E.letter_counts, prefix="Represent this question: ")).alias("vec"))


@register(f"with {S_VEC} select qid, id, round(score, 6) as score, r - 1 as rank from (select *, row_number() over (partition by qid order by score desc, id) as r from s where id % 7 <> 0 and label < 6) where r <= 5")
def store_search(spark, sf_dir):
    """A store that took all vectors in two batches, the second over the first, and lost some: searched with a filter."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    store = stores.open_store("exact", spark, f"{shared_dir(spark)}/tessera/vectors-{uuid.uuid4().hex}", width=64)
    store.upsert(own.where("id % 3 <> 0").withColumn("label", F.when(F.col("id") % 2 == 0, F.col("label")).otherwise(99)), "label")
    store.upsert(own.where("id % 3 = 0 or id % 2 <> 0"), "label")
    store.delete(own.where("id % 7 = 0").select("id"), "label")
    found = store.search(_vector_queries(spark, sf_dir), 5, F.col("label") < 6)
    return found.select("qid", "id", R6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@register()
def vec_ann(spark, sf_dir):
    """Every vector whose id is divisible by 100 by an inverted file of codes; every vector is indexed."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = V.inverted_topk(V.build_inverted(own), _vector_queries(spark, sf_dir), 10)
    return found.select("qid", "id", R6("score").alias("score"), F.col("rank").cast("long").alias("rank"))
