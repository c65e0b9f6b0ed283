"""Texts into linked chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..session import ship

# Separators from the coarsest to single characters, and sizes.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")
SIZE, OVERLAP, LEAST = 800, 120, 160
#: texts cut at once
SLICE = 64


def fixed_windows(c: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of ``size`` characters of the collapsed text, each ``size - overlap`` after the last."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    t = T.strip(T.collapse_space(c))
    cut = F.transform(F.array(t), lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.length(x) - 1, F.lit(0)), F.lit(size - overlap)), lambda s: F.substring(x, s + 1, F.lit(size)))).getItem(0)
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).when(F.length(t) <= size, F.array(t)).otherwise(cut)


def split_recursive(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most about ``size`` characters, cut at the coarsest separator that does.

    A separator stays in front of the piece after it; pieces are joined while
    they fit, and each chunk repeats up to ``overlap`` characters of the last.
    """
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    sep, finer = separators[at], separators[at + 1 :]
    raw = text.split(sep) if sep else list(text)
    pieces = [p for p in (raw[:1] + [sep + p for p in raw[1:]] if sep else raw) if p]
    out: list[str] = []
    run: list[str] = []
    for piece in [*pieces, None]:
        if piece is not None and len(piece) < size:
            run.append(piece)
            continue
        out += _join(run, size, overlap)
        run = []
        if piece is not None:
            out += split_recursive(piece, size, overlap, finer) if finer else [piece]
    return out


def _join(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    total = 0
    for piece in pieces:
        n = len(piece)
        if held and total + n > size:
            out.append("".join(held).strip())
            while total > overlap or (total + n > size and total > 0):
                total -= len(held.pop(0))
        held.append(piece)
        total += n
    if held:
        out.append("".join(held).strip())
    return [x for x in out if x]


def merge_short(chunks: Column, least: int = LEAST, target: int = SIZE + OVERLAP) -> Column:
    """Short chunks join a neighbour: the next one at the start, later the one before if it fits."""
    blank = F.lit("\n\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("wait"))

    def step(a: Column, c: Column) -> Column:
        done, n = a["done"], F.size(a["done"])
        whole = F.when(a["wait"] != "", F.concat(a["wait"], blank, c)).otherwise(c)
        last = F.when(n > 0, F.element_at(done, F.greatest(n, F.lit(1)))).otherwise("")
        fits = (F.length(c) < least) & (n > 0) & (F.length(last) + F.length(c) + 2 <= target)
        joined = F.array_append(F.slice(done, F.lit(1), F.greatest(n - 1, F.lit(0))), F.concat(last, blank, c))
        waits = (F.length(whole) < least) & (n == 0)
        return F.when(waits, F.struct(done.alias("done"), whole.alias("wait"))).when(fits, F.struct(joined.alias("done"), F.lit("").alias("wait"))).otherwise(F.struct(F.array_append(done, whole).alias("done"), F.lit("").alias("wait")))

    return F.aggregate(chunks, start, step, lambda a: F.when(a["wait"] != "", F.array_append(a["done"], a["wait"])).otherwise(a["done"]))


def split_batch(texts: pa.Array, size: int = SIZE, overlap: int = OVERLAP) -> pa.Array:
    """The pieces of each text, SLICE texts at a time: strings of Python stand beside the batch for those alone."""
    kind = pa.list_(pa.string())
    parts = [pa.array([[x for x in (y.strip() for y in split_recursive(t, size, overlap)) if x] if t else [] for t in texts.slice(at, SLICE).to_pylist()], kind) for at in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def recursive_chunks(df: DataFrame, c: Column, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Recursive splitting (an Arrow-batched function: recursion is beyond expressions), then the merge."""
    ship(df.sparkSession)

    @F.arrow_udf(ArrayType(StringType()))
    def split(texts: pa.Array) -> pa.Array:
        return split_batch(texts, size, overlap)

    return merge_short(split(F.coalesce(c, F.lit(""))), least, size + overlap)


def chunk_table(letters: DataFrame, chunks: Column, name: Column | None = None) -> DataFrame:
    """The chunk records of letters (year, source_file, ...): numbers, tags, titles and links.

    A chunk's id is its letter's ``name`` and its number; the name is the year, which
    tells letters apart where each year has one file.  A letter without chunks gives no row here; count letters from ``letters``.
    """
    w = Window.partitionBy("year", "source_file").orderBy("chunk_index")
    name = F.col("year") if name is None else name
    one = letters.select("year", "source_file", name.cast("string").alias("name"), F.posexplode(chunks).alias("chunk_index", "text"))
    ided = one.withColumns(
        {
            "id": F.concat_ws("_", "name", F.col("chunk_index").cast("string")),
            "decade": T.decade(F.col("year")),
            "total_chunks": F.count("*").over(Window.partitionBy("year", "source_file")).cast("int"),
            "topics": T.topic_tags(F.col("text")),
        }
    )
    return ided.drop("name").withColumns(
        {
            "chunk_id": F.concat((F.col("chunk_index") + 1).cast("string"), F.lit("/"), F.col("total_chunks").cast("string")),
            "n_topics": F.size("topics"),
            "section_title": F.coalesce(F.last(T.section_title(F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")),
            "previous_chunk_id": F.lag("id").over(w),
            "next_chunk_id": F.lead("id").over(w),
        }
    )
