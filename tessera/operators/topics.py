"""Topics by a table of keywords, however many, in one pass over the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .index import if_small

#: a word and what separates it from the next
WORD, GAP, NO_WORD = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]*", r"[^\p{L}\p{N}_]+"
#: first words of keywords that are looked up in the arrays; with more, every word begins a run
MOST_FIRSTS = 20_000


def keyword_table(spark: SparkSession, topics: dict[str, tuple[str, ...]]) -> DataFrame:
    """(topic, place, keyword, nth) of a taxonomy: topics and their keywords in its order."""
    rows = [(t, i, k.lower(), n) for i, (t, keys) in enumerate(topics.items()) for n, k in enumerate(keys)]
    return spark.createDataFrame(rows, "topic string, place int, keyword string, nth int")


def _words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)))


def _runs(size: int) -> Column:
    """(at, size, keyword) of the runs of ``size`` words that begin with one of ``begun`` (at, word)."""
    fit = F.filter("begun", lambda x: x["at"] + size <= F.size("w"))
    return F.transform(fit, lambda x: F.struct(x["at"].alias("at"), F.lit(size).alias("size"), F.array_join(F.slice("mixed", 2 * x["at"] + 1, F.lit(2 * size - 1)), "").alias("keyword")))


def keyword_hits(docs: DataFrame, keywords: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, topic, place, hits): whole-word hits of each topic's keywords that do not overlap.

    The runs of words of a text, as long as keywords are, meet the keywords by
    equality, so a text is read once for any number of topics.  Within a topic the
    leftmost hit counts, at one place that of the first keyword, and the next
    begins behind it.  A keyword starts and ends with a letter, digit or
    underscore; what stands between its words must be the same in the text.
    """
    keyed = keywords.select(_words(F.col("keyword")).alias("size"), F.regexp_extract("keyword", WORD, 0).alias("word"))
    lengths = [r[0] for r in keyed.select("size").distinct().collect()]  # of keywords in words: a few numbers
    firsts = [r[0] for r in keyed.select("word").distinct().limit(MOST_FIRSTS + 1).collect()]
    # only runs that begin with a keyword's first word are put together and leave their text's arrays
    words = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("low")).select("id", "low", F.filter(F.split("low", NO_WORD), lambda x: x != "").alias("w"))
    placed = F.transform("w", lambda x, at: F.struct(at.alias("at"), x.alias("word")))
    begun = words.select("id", "low", "w", (F.filter(placed, lambda x: x["word"].isin(firsts)) if len(firsts) <= MOST_FIRSTS else placed).alias("begun"))
    gaps = F.when(F.size("begun") > 0, F.regexp_extract_all("low", F.lit(f"{WORD}({GAP})"), F.lit(1)))
    mixed = begun.select("id", "w", "begun", gaps.alias("gap")).select("id", "w", "begun", F.flatten(F.zip_with("w", "gap", lambda w, gap: F.array(w, gap))).alias("mixed"))
    runs = mixed.select("id", F.inline(F.flatten(F.array(*(_runs(n) for n in lengths or [1])))))
    found = runs.join(if_small(keywords.select("keyword", "topic", "place", "nth")), "keyword")
    order = F.array_sort(F.collect_list(F.struct("at", "nth", "size")))
    start = F.struct(F.lit(0).alias("hits"), F.lit(0).alias("end"))
    step = lambda a, x: F.when(x["at"] >= a["end"], F.struct((a["hits"] + 1).alias("hits"), (x["at"] + x["size"]).alias("end"))).otherwise(a)
    return found.groupBy("id", "topic", "place").agg(order.alias("met")).select("id", "topic", "place", F.aggregate("met", start, step)["hits"].alias("hits"))


def topics_of(docs: DataFrame, keywords: DataFrame, most: int = 4, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, topics) of every document: the topics of most hits, ties in the taxonomy's order; none is an empty array."""
    hits = keyword_hits(docs, keywords, id_col=id_col, text_col=text_col)
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("hits"), "place", "topic"))).where(F.col("r") <= most)
    told = ranked.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "topic"))), lambda x: x["topic"]).alias("topics"))
    return docs.select(F.col(id_col).alias("id")).join(told, "id", "left").select("id", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))
