"""The registered queries, each over whole tables, with SQL where SQL can say it.

``documents`` stand in for letters: the year is 1977 + doc_id % 48, the file its
source.  ``benchmark`` items are questions; a document is relevant to the item
that it holds.  Literal questions and answers are stated once, for both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import query as Q, text as T
from ..operators import answer as A, chunk as C, index as I, metrics as M, retrieve as R, topics as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = (1977 + F.col("doc_id") % 48).cast("int")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", year.alias("year"), T.decade(year).alias("decade"), F.col("source").alias("source_file"), "lang")


LETTERS = "letters as (select doc_id as id, text, cast(1977 + doc_id % 48 as integer) as year, cast((1977 + doc_id % 48) // 10 * 10 as integer) as decade, source as source_file, lang from documents)"
LIT = lambda s: "'" + s.replace("'", "''") + "'"
W = r"[\p{L}\p{N}_]"

# ---------------------------------------------------------------- cleaning



def _fill(template: str, expr: str) -> str:
    return template.replace("@@", expr)


MESSY = "replace(replace(text, 'an ', 'an-' || chr(10)), '. ', '.' || chr(10) || chr(10) || chr(10) || chr(10) || ' 12 ' || chr(10) || chr(9) || ' Page 3 of 9' || chr(10) || '  ')"
S_DEHYPH = rf"regexp_replace(@@, '({W}+)-\n({W}+)', '\1\2', 'g')"
S_STRIP = r"regexp_replace(@@, '^\s+|\s+$', '', 'g')"
S_BOILER = r"array_to_string(list_filter(string_split(@@, chr(10)), lambda l: not regexp_matches(l, '(?i)^\s*(BERKSHIRE HATHAWAY INC\.?|\d{1,3}|-\s*\d{1,3}\s*-|Page\s+\d+\s+of\s+\d+)\s*$')), chr(10))"
S_NL = r"regexp_replace(@@, '\n{3,}', chr(10) || chr(10), 'g')"
S_SQUEEZE = _fill(S_STRIP, r"array_to_string(list_transform(string_split(@@, chr(10)), lambda l: regexp_replace(regexp_replace(l, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), chr(10))")


def _messy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(MESSY).alias("t"))


def _clean_sql(expr: str) -> str:
    return f"with m as (select doc_id, {MESSY} as t from documents) select doc_id, {expr} as out from m"


@register(_clean_sql(_fill(S_DEHYPH, "t")))
def clean_dehyph(spark, sf_dir):
    return _messy(spark, sf_dir).select("doc_id", T.dehyphenate(F.col("t")).alias("out"))


@register(_clean_sql(_fill(S_BOILER, "t")))
def clean_boiler(spark, sf_dir):
    return _messy(spark, sf_dir).select("doc_id", T.drop_boilerplate(F.col("t")).alias("out"))


@register(_clean_sql(_fill(S_NL, "t")))
def clean_nl(spark, sf_dir):
    return _messy(spark, sf_dir).select("doc_id", T.collapse_newlines(F.col("t")).alias("out"))


@register(_clean_sql(_fill(S_SQUEEZE, "t")))
def clean_ws(spark, sf_dir):
    return _messy(spark, sf_dir).select("doc_id", T.squeeze_lines(F.col("t")).alias("out"))


@register(_clean_sql(_fill(S_SQUEEZE, _fill(S_NL, _fill(S_BOILER, _fill(S_DEHYPH, "t"))))))
def clean_all(spark, sf_dir):
    return _messy(spark, sf_dir).select("doc_id", T.clean(F.col("t")).alias("out"))


@register(_clean_sql(r"regexp_replace(t, '\s+', ' ', 'g')"))
def ws_collapse(spark, sf_dir):
    return _messy(spark, sf_dir).select("doc_id", T.collapse_space(F.col("t")).alias("out"))


@register("select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[ \\t\\n\\r\\f]+', ' ', 'g')) as out from pages")
def src_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("out"))


@register("select doc_id, try_cast(nullif(regexp_extract(case when doc_id % 7 = 0 then 'notes.txt' else 'letter_' || (1977 + doc_id % 48) || '.txt' end, '(\\d{4})', 1), '') as integer) as year from documents")
def src_year(spark, sf_dir):
    name = F.when(F.col("doc_id") % 7 == 0, "notes.txt").otherwise(F.concat(F.lit("letter_"), (1977 + F.col("doc_id") % 48).cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select("doc_id", T.year_of_name(name).alias("year"))


# ---------------------------------------------------------------- chunks

S_CHUNKS = (
    "flat as (select id, year, source_file, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') as t from letters where text <> ''), "
    "chunks as (select id as doc_id, year, source_file, cast(p as integer) as chunk_index, substr(t, p * 450 + 1, 500) as text from "
    "(select *, unnest(range(0, case when length(t) <= 500 then 1 else (length(t) + 449) // 450 end)) as p from flat))"
)


def _chunks(spark, sf_dir, only=None):
    """Chunks of all letters, or of those in ``only`` (id)."""
    own = letters(spark, sf_dir)
    if only is not None:
        own = own.join(I.if_small(only), "id", "left_semi")
    return own.select(F.col("id").alias("doc_id"), "year", "source_file", F.posexplode(C.fixed_windows(F.col("text"))).alias("chunk_index", "text"))


@register(f"with {LETTERS}, {S_CHUNKS} select doc_id, chunk_index, text from chunks")
def chunk_fixed(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", "text")


def _linked(spark, sf_dir, only=None):
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    ided = _chunks(spark, sf_dir, only).withColumn("id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    return ided.withColumns({"previous_chunk_id": F.lag("id").over(w), "next_chunk_id": F.lead("id").over(w), "total_chunks": F.count("*").over(Window.partitionBy("doc_id"))})


S_LINKED = (
    "linked as (select *, doc_id || '_' || chunk_index as id, lag(doc_id || '_' || chunk_index) over w as previous_chunk_id, lead(doc_id || '_' || chunk_index) over w as next_chunk_id, "
    "count(*) over (partition by doc_id) as total_chunks from chunks window w as (partition by doc_id order by chunk_index))"
)


@register(f"with {LETTERS}, {S_CHUNKS}, {S_LINKED} select id, previous_chunk_id, next_chunk_id, total_chunks, (chunk_index + 1) || '/' || total_chunks as chunk_id from linked")
def chunk_links(spark, sf_dir):
    chunk_id = F.concat((F.col("chunk_index") + 1).cast("string"), F.lit("/"), F.col("total_chunks").cast("string"))
    return _linked(spark, sf_dir).select("id", "previous_chunk_id", "next_chunk_id", "total_chunks", chunk_id.alias("chunk_id"))


@register()
def chunk_recursive(spark, sf_dir):
    own = letters(spark, sf_dir)
    return own.select("id", F.posexplode(C.recursive_chunks(own, F.col("text"))).alias("chunk_index", "text"))


@register()
def chunk_record(spark, sf_dir):
    own = letters(spark, sf_dir).withColumn("source_file", F.concat_ws("/", "source_file", F.col("id").cast("string")))
    return C.chunk_table(own, C.recursive_chunks(own, T.clean(F.col("text"))), F.concat_ws("_", F.col("year").cast("string"), F.col("id").cast("string")))


S_BARE = r"list_transform(list_slice(regexp_split_to_array(text, '\r\n|\n|\r'), 1, 8), lambda x: regexp_replace(x, '^[ \-*\t]+|[ \-*\t]+$', '', 'g'))"
S_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s+'), lambda w: w <> '')"
S_ALPHA = r"list_filter(regexp_split_to_array(x, '\s+'), lambda w: regexp_matches(w, '\p{L}'))"
S_TITLE = (
    f"list_filter({S_BARE}, lambda x: length(x) between 4 and 90 and not regexp_matches(x, '(?i)^\\(?in \\$ millions\\)?$|^\\*+$|^shown for the [a-z ]+\\.$') "
    "and length(regexp_replace(x, '[^0-9]', '', 'g')) <= greatest(2, length(x) // 4) and not regexp_matches(x, '[.,;:]$') "
    f"and len({S_WORDS}) <= 9 and len({S_ALPHA}) > 0 and (upper(x) = x or len(list_filter({S_ALPHA}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= greatest(1, len({S_ALPHA}) - 1)))[1]"
)


@register(f"with {LETTERS}, {S_CHUNKS} select doc_id, chunk_index, {S_TITLE} as title from chunks")
def title_detect(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", T.section_title(F.col("text")).alias("title"))


@register(
    f"with {LETTERS}, {S_CHUNKS}, titled as (select doc_id, chunk_index, {S_TITLE} as title from chunks) "
    "select doc_id, chunk_index, coalesce(last_value(title ignore nulls) over (partition by doc_id order by chunk_index rows between unbounded preceding and current row), '') as title from titled"
)
def title_ffill(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", F.coalesce(F.last(T.section_title(F.col("text")), ignorenulls=True).over(w), F.lit("")).alias("title"))


@register("select doc_id, cast(coalesce(ceil(length(text) / 450.0), 0) as bigint) as n_chunks, coalesce(text, '') = '' as failed from (select doc_id, case when doc_id % 11 <> 0 then text end as text from documents)")
def letter_fault(spark, sf_dir):
    """Letters that cannot be read are listed with no chunks, and the others are done."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("text"))
    return own.select("doc_id", F.ceil(F.coalesce(F.length("text"), F.lit(0)) / F.lit(450.0)).alias("n_chunks"), (F.coalesce("text", F.lit("")) == "").alias("failed"))


# topics of words that the invented prose has; plurals and longer words must not match
PROSE_TOPICS = {"links": ("and", "und", "et", "y"), "articles": ("the", "der", "la", "de la"), "places": ("in", "en", "on", "sur"), "being": ("is", "was", "est"), "giving": ("to", "for", "pour"), "saying": ("that this", "que")}
ASCII_TEXT = r"regexp_replace(text, '[\x{C0}-\x{24F}]', '0', 'g')"


def _topic_sql(topics: dict) -> str:
    rows = ", ".join(f"{{'k': -len(regexp_extract_all(a, {LIT('(?i)' + chr(92) + 'b(?:' + '|'.join(k) + ')' + chr(92) + 'b')})), 'i': {i}, 'name': '{t}'}}" for i, (t, k) in enumerate(topics.items()))
    return f"with d as (select doc_id, {ASCII_TEXT} as a from documents) select doc_id, list_transform(list_slice(list_sort(list_filter([{rows}], lambda x: x.k < 0)), 1, 4), lambda x: x.name) as topics from d"


@register(_topic_sql(PROSE_TOPICS))
def topic_tag(spark, sf_dir):
    found = K.topics_of(table(spark, sf_dir, "documents"), K.keyword_table(spark, PROSE_TOPICS))
    return found.select(F.col("id").alias("doc_id"), "topics")


# SQL: the runs of words of a text, as keywords(topic, place, keyword, nth) are long, and each topic's hits from the left
S_HITS = (
    rf"wd as materialized (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') as w, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+([^\p{{L}}\p{{N}}_]*)', 1) as gap from documents), "
    rf"sz as (select distinct len(regexp_extract_all(keyword, '[\p{{L}}\p{{N}}_]+')) as size from keywords), "
    "rn as (select doc_id, a, size, array_to_string(list_transform(range(a, a + size), lambda i: w[i] || case when i < a + size - 1 then gap[i] else '' end), '') as keyword from (select *, unnest(range(1, len(w) + 1)) as a from wd), sz where a + size - 1 <= len(w)), "
    "mt as (select doc_id, topic, place, list([a, nth, size] order by a, nth) as met from rn join keywords using (keyword) group by all), "
    "ht as (select doc_id, topic, place, (list_reduce(list_prepend([0::bigint, 0, 1], met), lambda s, x: case when x[1] >= s[3] then [0::bigint, s[2] + 1, x[1] + x[3]] else s end))[2] as hits from mt), "
    "tp as (select doc_id, list(topic order by hits desc, place, topic) as topics from (select * from ht qualify row_number() over (partition by doc_id order by hits desc, place, topic) <= 4) group by 1)"
)


def _s_keywords(topics):
    return "keywords(topic, place, keyword, nth) as (values " + ", ".join(f"({LIT(t)}, {i}, {LIT(k.lower())}, {n}::bigint)" for i, (t, keys) in enumerate(topics.items()) for n, k in enumerate(keys)) + ")"


# the invented prose has none of the shipped keywords: each document's "the" becomes one of them
SHIPPED = tuple(k for keys in T.TOPICS.values() for k in keys)


@register(f"with docs0 as (select doc_id, replace(text, ' the ', ' ' || ([{', '.join(map(LIT, SHIPPED))}])[1 + doc_id % {len(SHIPPED)}] || ' ') as text from documents), documents as (select * from docs0), {_s_keywords(T.TOPICS)}, {S_HITS} select doc_id, topic, hits from ht")
def topic_hits(spark, sf_dir):
    """Hits of the shipped topics in every document."""
    word = F.element_at(F.array(*map(F.lit, SHIPPED)), (1 + F.col("doc_id") % len(SHIPPED)).cast("int"))
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit(" the "), F.concat(F.lit(" "), word, F.lit(" "))))
    found = K.keyword_hits(docs, K.keyword_table(spark, T.TOPICS))
    return found.select(F.col("id").alias("doc_id"), "topic", F.col("hits").cast("long").alias("hits"))


@register(
    r"with bw as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from benchmark), "
    "kk as (select distinct unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as keyword from bw), "
    "keywords as materialized (select 't' || length(keyword) % 14 as topic, (length(keyword) % 14)::integer as place, keyword, row_number() over (partition by length(keyword) % 14 order by md5(keyword)) as nth from kk), "
    f"{S_HITS} select doc_id, coalesce(topics, []::varchar[]) as topics from documents left join tp using (doc_id)"
)
def topic_keywords(spark, sf_dir):
    """Topics of every document by a table of thousands of keywords: all words and pairs of words of the benchmark."""
    w = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit(K.WORD), F.lit(0)).alias("w")).where("size(w) > 0")
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    place = F.length("keyword") % 14
    nth = F.row_number().over(Window.partitionBy("place").orderBy(F.md5("keyword")))
    keys = w.select(F.explode(F.concat("w", pairs)).alias("keyword")).distinct().withColumn("place", place)
    keys = keys.select(F.concat(F.lit("t"), F.col("place").cast("string")).alias("topic"), "place", "keyword", nth.alias("nth"))
    return K.topics_of(table(spark, sf_dir, "documents"), keys).select(F.col("id").alias("doc_id"), "topics")


@register(f"with t as ({_topic_sql(PROSE_TOPICS)}) select cast((1977 + doc_id % 48) // 10 * 10 as integer) as decade, topic, count(*) as n from (select doc_id, unnest(topics) as topic from t) group by all")
def topic_explode(spark, sf_dir):
    own = letters(spark, sf_dir)
    tags = K.topics_of(own, K.keyword_table(spark, PROSE_TOPICS), id_col="id")
    return own.select("id", "decade").join(tags, "id").select("decade", F.explode("topics").alias("topic")).groupBy("decade", "topic").agg(F.count("*").alias("n"))


@register("select cast(1977 + doc_id % 48 as integer) as year, cast((1977 + doc_id % 48) // 10 * 10 as integer) as decade, count(*) as n from documents group by all")
def decade_bucket(spark, sf_dir):
    return letters(spark, sf_dir).groupBy("year", "decade").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- tokens


def _tokens(name: str, expr, sql: str) -> None:
    def f(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", expr(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))

    f.__name__ = name
    register(f"select doc_id, cast(len(t) as bigint) as n, md5(array_to_string(t, ' ')) as digest from (select doc_id, {sql} as t from documents)")(f)


STOP_SQL = "[" + ", ".join(map(LIT, T.STOP_WORDS)) + "]"
_tokens("tok_bm25", T.bm25_tokens, "list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x))")
_tokens("tok_faith", T.support_tokens, "regexp_extract_all(lower(text), '[A-Za-z0-9'']+')")
_tokens("tok_dedup", lambda c: F.array_sort(T.dedup_tokens(c)), "list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')))")
_tokens("tok_content", T.content_words, f"list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda w: length(w) > 2 and not list_contains({STOP_SQL}, w))")

# ---------------------------------------------------------------- filters and questions

WHERE = {"year": {"$gte": 1985, "$lt": 2005}, "decade": {"$in": [1980, 1990]}, "source_file": "src0"}


@register(f"with {LETTERS} select id, year, decade, source_file from letters where year >= 1985 and year < 2005 and decade in (1980, 1990) and source_file = 'src0'")
def where_eval(spark, sf_dir):
    return letters(spark, sf_dir).where(Q.filter_column(WHERE)).select("id", "year", "decade", "source_file")


@register(SQL["where_eval"])
def where_sql(spark, sf_dir):
    clause, args = Q.filter_sql(WHERE)
    return spark.sql("select id, year, decade, source_file from {letters}" + clause, args=args, letters=letters(spark, sf_dir))


QUESTIONS = (
    "How did the float grow from 1985 to 1999?",
    "between 2010 and 1990 what changed?",
    "What was said in the nineties to the 2010s about debt?",
    "Views of the 1980s",
    "late 1970s and early 1980s prices",
    "In 2008, what happened?",
    "Compare 1999, 2003 and 2008",
    "What about 2008 and 2008 again?",
    "the 2008s are no year",
    "How has technology changed from the 1990s to the 2020s?",
    "Contrasted the Seventies with the seventies, what changed?",
    "It evolved from 1980 to 2010",
    "It evolved from 1980 to 1985",
    "nothing here",
    "1969 is too early",
    "Has thinking shifted over time between 1977 and 2024?",
    "the eighties through the nineties",
    "changed in the 2000s versus the 2010s and the 1990s",
    "",
)
REPLIES = ("float, Reserve; premium, FLOAT, 'loss ratio'", "The passages do not mention it, underwriting", "", "a, b, c, d, e, f, g, h, i, j", "one two three four five, ok\nsecond line, no", " - dash -, [bracket], \"quoted\".; question mark, x" + "y" * 41, "NULL-like, null , Null")
_PICK = lambda texts, n: f"([{', '.join(map(LIT, texts))}])[1 + {n} % {len(texts)}]"  # noqa: E731  SQL: one of the texts by a number
# every benchmark item asks one of the questions about its own text
S_QUESTIONS = f"q as (select item_id as qid, {_PICK(QUESTIONS, 'item_id')} || ' ' || coalesce(text, '') as query from benchmark)"
S_MAP = "map {" + ", ".join(f"'{k}': {{'lo': {a}, 'hi': {b}}}" for k, (a, b) in Q.DECADES.items()) + "}"


def picked(texts, n):
    """One of the texts by a number."""
    return F.element_at(F.array(*map(F.lit, texts)), (1 + n % len(texts)).cast("int"))


def _questions(spark, sf_dir):
    own = table(spark, sf_dir, "benchmark")
    return own.select(F.col("item_id").alias("qid"), F.concat(picked(QUESTIONS, F.col("item_id")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("query"))


def _replies(spark, sf_dir):
    """Every turn of the conversations as a reply: one of the stated ones, and what was said behind every other."""
    n = F.col("conv_id") + F.col("turn")
    said = F.when(n % 2 == 0, F.concat(F.lit(", "), F.coalesce("text", F.lit("")))).otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(picked(REPLIES, n), said).alias("reply"))


S_PARSED = (
    f"p as (select qid, query, try_cast(regexp_extract(query, {LIT(Q.SPAN)}, 1) as integer) as y1, try_cast(regexp_extract(query, {LIT(Q.SPAN)}, 2) as integer) as y2, "
    f"{S_MAP}[lower(regexp_extract(query, {LIT('(?i)' + chr(92) + 'b' + Q.DECADE_SPAN + chr(92) + 'b')}, 1))] as d1, {S_MAP}[lower(regexp_extract(query, {LIT('(?i)' + chr(92) + 'b' + Q.DECADE_SPAN + chr(92) + 'b')}, 2))] as d2, "
    f"{S_MAP}[lower(regexp_extract(query, {LIT('(?i)' + Q.DECADE_WORD)}, 1))] as d, list_transform(regexp_extract_all(query, {LIT(Q.YEAR)}), lambda y: y::integer) as ys, "
    f"list_transform(regexp_extract_all(query, {LIT('(?i)' + Q.DECADE_WORD)}), lambda y: lower(y)) as words, regexp_matches(query, {LIT('(?i)' + Q.CHANGE)}) as change from q)"
)


@register(
    f"with {S_QUESTIONS}, {S_PARSED} select qid, cast(case when y1 is not null then least(y1, y2) when d1 is not null then d1.lo when d is not null then d.lo when len(ys) > 0 then list_min(ys) end as integer) as lo, "
    "cast(case when y1 is not null then greatest(y1, y2) when d1 is not null then d2.hi when d is not null then d.hi when len(ys) > 0 then list_max(ys) end as integer) as hi from p"
)
def q_yearfilter(spark, sf_dir):
    return _questions(spark, sf_dir).select("qid", Q.year_range(F.col("query")).alias("r")).select("qid", "r.lo", "r.hi")


S_PERIODS = (
    "pu as (select *, list_reduce(list_prepend([]::varchar[], list_transform(words, lambda w: [w])), lambda a, b: case when list_contains(a, b[1]) then a else list_concat(a, b) end) as dw from p), "
    f"e as (select qid, 0 as period, {S_MAP}[dw[1]].lo as lo, {S_MAP}[dw[1]].hi as hi from pu where change and len(dw) >= 2 union all select qid, 1, {S_MAP}[dw[2]].lo, {S_MAP}[dw[2]].hi from pu where change and len(dw) >= 2 "
    "union all select qid, 0, least(y1, y2), (y1 + y2) // 2 from pu where change and len(words) < 2 and abs(y1 - y2) >= 10 union all select qid, 1, (y1 + y2) // 2 + 1, greatest(y1, y2) from pu where change and len(words) < 2 and abs(y1 - y2) >= 10)"
)


@register(f"with {S_QUESTIONS}, {S_PARSED}, {S_PERIODS} select qid, cast(period as integer) as period, cast(lo as integer) as lo, cast(hi as integer) as hi from e")
def q_temporal(spark, sf_dir):
    return R.with_periods(_questions(spark, sf_dir), Q.comparison_periods(F.col("query"))).select("qid", "period", "lo", "hi")


@register(f"with {LETTERS}, {S_QUESTIONS}, {S_PARSED}, {S_PERIODS} select qid, cast(period as integer) as period, count(*) as n from e join letters on year between lo and hi group by all")
def j_period(spark, sf_dir):
    periods = R.with_periods(_questions(spark, sf_dir), Q.comparison_periods(F.col("query"))).select("qid", "period", "lo", "hi")
    years = letters(spark, sf_dir).groupBy("year").agg(F.count("*").alias("n"))  # a row a year before the range join
    return years.join(I.if_small(periods), F.col("year").between(F.col("lo"), F.col("hi"))).groupBy("qid", "period").agg(F.sum("n").alias("n"))


S_KEYWORDS = (
    f"rp as (select conv_id, turn, {_PICK(REPLIES, '(conv_id + turn)')} || case when (conv_id + turn) % 2 = 0 then ', ' || coalesce(text, '') else '' end as reply from conversations), "
    "pt as (select conv_id, turn, list_transform(regexp_split_to_array(regexp_split_to_array(regexp_replace(reply, '^\\s+|\\s+$', '', 'g'), '\\r\\n|\\n|\\r')[1], '[,;]'), "
    f"lambda x: regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), {LIT(Q.KEYWORD_ENDS)}, '', 'g')) as parts from rp), "
    f"gd as (select conv_id, turn, list_filter(parts, lambda x: x <> '' and length(x) <= {Q.KEYWORD_CHARS} and len(regexp_split_to_array(trim(x), '\\s+')) <= {Q.KEYWORD_WORDS} and not regexp_matches(x, {LIT(Q.NO_KEYWORD)})) as good from pt), "
    f"kw as (select conv_id, turn, list_slice(list_filter(good, lambda x, i: list_position(list_transform(good, lambda y: lower(y)), lower(x)) = i), 1, {Q.MOST_KEYWORDS}) as keywords from gd)"
)


@register(f"with {S_KEYWORDS} select conv_id, turn, keywords from kw")
def q_expand_parse(spark, sf_dir):
    return _replies(spark, sf_dir).select("conv_id", "turn", Q.expansion_keywords(F.col("reply")).alias("keywords"))


@register(f"with {S_QUESTIONS}, {S_KEYWORDS}, fk as (select conv_id as qid, arg_min(keywords, turn) as keywords from kw group by 1) select qid, query || case when len(keywords) > 0 then ' ' || array_to_string(keywords, ' ') else '' end as expanded from q left join fk using (qid)")
def q_expand(spark, sf_dir):
    """Each question with the keywords of the first reply in the conversation of its number."""
    first = _replies(spark, sf_dir).groupBy(F.col("conv_id").alias("qid")).agg(F.min_by("reply", "turn").alias("reply"))
    return _questions(spark, sf_dir).join(first, "qid", "left").select("qid", Q.expand_query(F.col("query"), Q.expansion_keywords(F.col("reply"))).alias("expanded"))


@register(f"with {S_QUESTIONS}, {S_PARSED} select qid, case when qid % 3 = 0 then 'caller' when y1 is not null or d is not null or len(ys) > 0 then 'detected' else 'none' end as used from p")
def q_where_override(spark, sf_dir):
    found = Q.year_range(F.col("query"))
    return _questions(spark, sf_dir).select("qid", F.when(F.col("qid") % 3 == 0, "caller").when(found.isNotNull(), "detected").otherwise("none").alias("used"))
