"""URL filters against dated lists: a temporal join of captures and list entries.

List entries are events: at a time, an entry (list, pattern) is added or
removed.  They become validity intervals [valid_from, valid_to), each entry's
state holding until its next event.  A capture is evaluated as of its fetch
time: it meets every entry whose pattern fits its URL and whose interval holds
that time.  Patterns are a domain, which fits the host and all hosts below it,
or a domain with a path, which fits the paths that begin with its segments.  A
capture's host and path give a short list of keys (its parent domains, its
leading segments), so the join is an equality on the key and a range on time.

The most specific active pattern decides (the longest key; on a tie, an allow
list wins).  Built-in functions only; a key that a third of the captures share
meets a few entries, and adaptive execution splits its side of the join.

Nulls and edges: a capture without a URL, host or fetch time meets nothing and
has the decision ``none``; events with a null field are ignored and repeated
ones count once; of an addition and a removal at one time the removal is later;
a host's case, port, user, leading ``www.`` and final dot do not matter;
repeated captures are each evaluated; an empty list decides nothing; an empty
capture table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[^:/?#]+://[^/?#]*/([^?#]*)"


def url_host(url: Column) -> Column:
    host = F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), HOST, 1), r"^www\.|\.$", "")
    return F.when(host != "", host)


def url_keys(url: Column) -> Column:
    """The parent domains of a URL's host, itself included, and host with each leading path."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.array_remove(F.split(F.regexp_extract(F.trim(url), PATH, 1), "/"), "")
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def validity_intervals(events: DataFrame) -> DataFrame:
    """(list_name, verdict, pattern, valid_from, valid_to) from events (list_name, verdict, pattern, action, at).

    verdict is ``block`` or ``allow``, action ``add`` or ``remove``; valid_to is
    null while nothing ends the entry.
    """
    clean = events.select("list_name", "verdict", F.lower("pattern").alias("pattern"), "action", "at").dropna().distinct()
    w = Window.partitionBy("list_name", "verdict", "pattern").orderBy("at", "action")
    held = clean.withColumn("valid_to", F.lead("at").over(w)).where("action = 'add' and (valid_to is null or valid_to > at)")
    return held.select("list_name", "verdict", "pattern", F.col("at").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, events: DataFrame, *, id_col: str = "capture_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(capture_id, fetched_at, host, n_active, lists, pattern, decision) for every capture.

    lists: the names of the lists with an active entry, sorted; pattern: the one that decides.
    """
    own = captures.select(F.col(id_col).alias("capture_id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched_at")).withColumn("host", url_host(F.col("url")))
    keyed = own.where("fetched_at is not null").select("capture_id", "url", "fetched_at", F.explode(url_keys(F.col("url"))).alias("pattern")).distinct()
    entries = validity_intervals(events)
    met = keyed.join(entries, "pattern").where("valid_from <= fetched_at and (valid_to is null or fetched_at < valid_to)")
    rank = F.struct(F.length("pattern"), (F.col("verdict") == "allow").cast("int"), "pattern")
    found = met.groupBy("capture_id", "url", "fetched_at").agg(
        F.count("*").alias("n_active"), F.sort_array(F.collect_set("list_name")).alias("lists"), F.max_by(F.struct("pattern", "verdict"), rank).alias("best")
    )
    same = own.alias("c").join(found.alias("f"), F.expr("c.capture_id <=> f.capture_id and c.url = f.url and c.fetched_at = f.fetched_at"), "left")
    return same.select(
        "c.capture_id", "c.fetched_at", "c.host", F.coalesce("f.n_active", F.lit(0)).alias("n_active"), F.coalesce("f.lists", F.array().cast("array<string>")).alias("lists"), F.col("f.best.pattern").alias("pattern"), F.coalesce("f.best.verdict", F.lit("none")).alias("decision")
    )
