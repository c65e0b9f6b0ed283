"""Spelling variants by anagram hashing.

A word's key is the sum of its code points' fifth powers (modulo a prime), so
anagrams share a key and one edit moves it by a value of one or two letters.
Words that differ by one letter are found by equality joins of such keys:

* removal and addition: the longer word's key less one of its letters is the
  shorter one's key;
* exchange: both keys, less the letters that differ, are the same number.

A key is blind to the order of letters, so a family of anagrams would meet as a
whole.  One edit leaves the first or the second half of a word as it is; that
half is part of the join, and what meets agrees in it to the letter.  Each
pair that meets is then verified by its edit distance, and is counted for one
half only.  The true neighbours of a word are bounded by its length and the alphabet.

Counting reads every text once in Arrow functions, which sum up the words of a
task before they send anything.  A form has at least ``ratio`` times its
word's occurrences, so chains of forms are short (the logarithm of the largest
count): they are followed by doubling, a join of words with forms a step.

Nulls and edges: a null or empty text has no words; a null id reads as an
empty string in the hash; repeated rows count each; a run of any length is one
word; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import Tables, map_arrow

RUN = re.compile("[a-zÀ-ÿ]+")
#: a prime above all sums of two letters; keys stay below it
MODULUS = (1 << 61) - 1
SLIPS = 199


def letter_value(letter: Column) -> Column:
    c = F.ascii(letter).cast("long")
    return c * c * c * c * c


def _letters(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit("."), F.lit(0))


def anagram_key(word: Column) -> Column:
    return F.aggregate(_letters(word), F.lit(0).cast("long"), lambda a, x: (a + letter_value(x)) % MODULUS)


def _count(slips: int, least_letters: int, held_bytes: int):
    """mapInArrow: (doc_id, text) -> (word, n), summed up within the task while there is room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def sent() -> pa.RecordBatch:
            words = [w for w in total if len(w) >= least_letters and total[w]]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], ["word", "n"])
            total.clear()
            return out

        held = known = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for k, raw in enumerate(batch.column(1).cast(pa.binary())):
                words = RUN.findall((raw.as_py() or b"").lower().decode())  # bytes: lower() changes A-Z alone
                if not words:
                    continue
                own, start = set(words), crc32(f"{'' if ids[k] is None else ids[k]}:".encode())
                total.update(words)
                for w in [w for w in own if not crc32(w.encode(), start) % slips] if slips else ():
                    n, at = words.count(w), crc32(w.encode(), start) % len(w)
                    total[w] -= n
                    total[w[:at] + w[at + 1 :]] += n
                if len(total) > known:
                    held += sum(map(len, own)) // 4 + 120 * (len(total) - known)
                    known = len(total)
                if held > held_bytes:
                    yield sent()
                    held = known = 0
        yield sent()

    return run


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least: int = 5, slips: int = 0, held_bytes: int = 96 << 20) -> DataFrame:
    """(word, n): lower-cased runs of Latin letters with their occurrences in all texts.

    slips: a run whose hash this number divides loses the letter that the hash
    names, which plants misspellings; 0 plants none.
    """
    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = map_arrow(own, _count(slips, least_letters, held_bytes), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _halves(length: Column, word: Column) -> Column:
    """Both halves of a word as it was before an edit left it ``length`` letters."""
    h = F.floor(length / 2).cast("int")
    return F.array(F.struct(F.lit(0).alias("half"), F.left(word, h).alias("part")), F.struct(F.lit(1).alias("half"), F.right(word, length - h).alias("part")))


def unsent(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle: the vocabulary grows with the texts, and a broadcast would hold it on the driver."""
    return df.hint("merge")


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n): both directions of every pair of distinct words (word, n) that one edit parts."""
    size = F.length("word")
    keyed = words.select("word", "n", size.alias("size"), anagram_key(F.col("word")).alias("key"))
    holes = keyed.select("word", "n", "size", "key", F.explode(F.array_distinct(_letters(F.col("word")))).alias("letter"))
    holes = holes.select("word", "n", "size", "letter", F.pmod(F.col("key") - letter_value(F.col("letter")), F.lit(MODULUS)).alias("key"))
    at = ["key", "size", "half", "part"]

    def halved(df: DataFrame, length: Column, *more: str) -> DataFrame:
        return df.select("word", "n", *more, "key", length.alias("size"), F.inline(_halves(length, F.col("word"))))

    def pairs(left: DataFrame, right: DataFrame, *rest: Column) -> DataFrame:
        other = right.select(*at, *(F.col(c).alias(f"other_{c}") for c in right.columns if c not in at))
        met = left.join(unsent(other), at)
        for c in rest:
            met = met.where(c)
        return met.where(F.levenshtein("word", "other_word", 1) == 1).select("word", "n", "other_word", "other_n")

    same_half = halved(holes, F.col("size"), "letter")
    exchanged = pairs(same_half, same_half, F.col("word") < F.col("other_word"), F.col("letter") != F.col("other_letter"))
    # both halves can stay where a letter is doubled: such a pair counts for the first
    h = F.floor(F.col("size") / 2).cast("int")
    removed = pairs(halved(holes, F.col("size") - 1), halved(keyed, F.col("size")), (F.col("half") == 0) | (F.left("word", h) != F.left("other_word", h)))
    found = exchanged.unionByName(removed)
    both = F.array(F.struct("word", F.col("other_word").alias("other"), F.col("other_n")), F.struct(F.col("other_word").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return found.select(F.inline(both))


def spelling_forms(words: DataFrame, *, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words (word, n), each of which stands once.

    form: the near word of most occurrences, if it has ``ratio`` times the word's
    or more, of several the first by code points; root: where forms end.
    """
    tables = Tables(words.sparkSession, "spelling")
    words = tables.write(words)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    led = words.join(unsent(near), "word", "left").withColumn("led", F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False)))
    led = led.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("led"), F.col("best.other")).alias("form"), F.when(F.col("led"), -F.col("best.less")).alias("form_n"))
    led = tables.write(led)
    step = tables.write(led.where("form is not null").select("word", F.col("form").alias("to")))
    while True:
        on = step.join(unsent(step.select(F.col("word").alias("to"), F.col("to").alias("then"))), "to", "left").select("word", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved"))
        on = tables.write(on)
        tables.drop(step)
        step = on.select("word", "to")
        step._written_to = on._written_to
        if on.where("moved").isEmpty():
            break
    return led.join(unsent(step), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("to", "word").alias("root"))


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least: int = 5, ratio: int = 5, slips: int = SLIPS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of all texts, with planted slips."""
    return spelling_forms(count_words(docs, id_col=id_col, text_col=text_col, least_letters=least_letters, least=least, slips=slips), ratio=ratio)
