"""Sources and sinks: letters from files, chunk files, run metadata and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..functions.query import valid_identifier

CHUNK_SCHEMA = (
    "id string, text string, year int, decade int, source_file string, chunk_index int, total_chunks int, chunk_id string, section_title string, "
    "topics array<string>, n_topics int, previous_chunk_id string, next_chunk_id string"
)
MOST_PDF_CHARS_TO_RETRY = 200


def read_letters(spark: SparkSession, path: str, *, prefix: str = "", pdf: Callable[[Column], Column] | None = None, pdf_fallback: Callable[[Column], Column] | None = None, latin1: bool = True) -> DataFrame:
    """(year, source_file, file_type, text) of text and PDF files, by year, text before PDF.

    A file's year is the first four digits of its name; a file without one is
    left out.  Text is UTF-8, with ISO-8859-1 (or nothing) where it is not.
    pdf: bytes -> text, such as a pandas UDF around a library; its fallback is
    taken where it finds under 200 characters.  Without one, PDFs have null text.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*.{{txt,pdf}}").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    kind = F.when(F.lower(name).endswith(".pdf"), "pdf").otherwise("text")
    raw = pdf(F.col("content")) if pdf else F.lit(None).cast("string")
    if pdf and pdf_fallback:
        raw = F.when(F.length(T.strip(F.coalesce(raw, F.lit("")))) < MOST_PDF_CHARS_TO_RETRY, pdf_fallback(F.col("content"))).otherwise(raw)
    text = F.when(kind == "pdf", raw).otherwise(T.decode_utf8_or_latin1(F.col("content")) if latin1 else T.decode_utf8_or_empty(F.col("content")))
    rows = files.select(T.year_of_name(name).alias("year"), name.alias("source_file"), kind.alias("file_type"), text.alias("text"), F.col("length").alias("bytes"))
    return rows.where("year is not null").orderBy("year", F.desc("file_type"), "source_file")


def read_chunks(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """A chunk file of JSON lines, all years or one."""
    found = spark.read.schema(CHUNK_SCHEMA).json(path)
    return found if year is None else found.where(F.col("year") == year)


def newest(*paths: str, spark: SparkSession) -> str:
    """The first of several paths that exists, in the store that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
    raise FileNotFoundError(", ".join(paths))


def write_chunks(chunks: DataFrame, path: str, *, one_file: bool = False) -> None:
    """JSON lines; in one file they are in order of year and number."""
    out = chunks.coalesce(1).sortWithinPartitions("year", "source_file", "chunk_index") if one_file else chunks
    out.write.mode("overwrite").json(path)


def run_metadata(letters: DataFrame, chunks: DataFrame, *, size: int, overlap: int, least: int, version: str = "2") -> DataFrame:
    """One row: totals, years, the chunk settings and each year's file, type and chunks.

    The map has an entry a year; of several files of a year the last by name stands.
    """
    n = chunks.groupBy("year", "source_file").agg(F.count("*").alias("chunks"))
    each = letters.select("year", "source_file", "file_type").join(n, ["year", "source_file"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    by_year = each.groupBy("year").agg(F.max_by(F.struct(F.col("source_file").alias("file"), F.col("file_type").alias("type"), "chunks"), "source_file").alias("v"), F.count("*").alias("n"), F.sum("chunks").alias("all"))
    return by_year.agg(
        F.sum("n").alias("total_letters"), F.sum("all").alias("total_chunks"), F.array(F.min("year"), F.max("year")).alias("year_range"), (F.sum("all") / F.greatest(F.sum("n"), F.lit(1))).alias("avg_chunks_per_letter"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("year").cast("string"), "v")))).alias("year_statistics"),
    ).select("*", F.struct(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), F.lit(least).alias("min_chunk_chars")).alias("chunk_config"), F.lit(version).alias("version"))


def write_metadata(meta: DataFrame, path: str) -> None:
    meta.coalesce(1).write.mode("overwrite").json(path)


def write_report(per_query: DataFrame, means: DataFrame, path: str) -> None:
    """Per-query metrics as JSON; means as CSV with columns by name, rounded to four places."""
    per_query.write.mode("overwrite").json(f"{path}/per_query")
    keys = [c for c in ("strategy", "rerank", "n_queries") if c in means.columns]
    rest = sorted(c for c in means.columns if c not in keys)
    means.select(*keys, *(F.round(c, 4).alias(c) for c in rest)).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/means")


def write_store(docs: DataFrame, table: str, *, width: int | None = None, vec_col: str = "embedding") -> None:
    """Documents with vectors as a table partitioned by decade; a vector of another width fails."""
    from ..operators.index import check_width

    valid_identifier(table)
    out = check_width(docs, width, vec_col) if width else docs
    out.write.mode("overwrite").partitionBy("decade").saveAsTable(table)


def sanitize_metadata(fields: dict[str, Column]) -> Column:
    """A string map without nulls; lists are joined by commas by the caller's cast."""
    pairs = [x for k, c in fields.items() for x in (F.lit(k), c.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last by ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
