"""Token counts of whole texts: lengths only, no ids leave a task.

An Arrow function cuts its texts into pieces and gathers pieces of several
texts into batches of about ``batch_bytes`` each; a longer text is cut into
several pieces, so that neither one long text nor many short ones make a batch
large.  A cut is made only where the tokenizer cannot tell: what stands on its
two sides gets the same tokens apart as together.

* Byte-level BPE with its usual pattern (``.json``): before a space with no
  white space behind it.  The pattern gives that space to what follows, and
  white space before it ends as it does at a text's end.
* sentencepiece (``.model``): at a space between two other characters, if no
  piece of the vocabulary crosses one; the dummy prefix of the right side stands
  for the space.
* Any other file: nowhere; its texts are encoded whole, in the same batches.

Within a piece the same cuts give words.  A word's count is remembered in the
worker up to a limit of bytes, and what a batch has new is encoded by one batch
call; forgetting changes no count.  Special strings inside texts are what the
library makes of them by default.  Nothing is truncated or padded.

Nulls and edges: a null text counts as an empty one, with no bytes and no
tokens; repeated rows are counted each; an empty table gives an empty one; a null
id stays null; other columns are not read.  A text without any place to cut (no
space at all) is encoded as one piece.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import map_arrow
from .shingles import kept

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024
#: a space that starts a word, whatever stands before it
BEFORE_WORD = re.compile(r" (?=\S)")
#: a space between two characters that are neither white space nor the sign that stands for it
BETWEEN_WORDS = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
#: Latin letters and the ASCII punctuation behind them, which no pre-token crosses (an apostrophe may belong to either)
LETTERS_AND_SIGNS = re.compile(r"(\n?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]+)")


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare name is a file of the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Counts(dict):
    """word -> how many tokens, remembered up to a limit of bytes.

    ``cut`` is where texts part (None: nowhere); ``encode`` counts the tokens of
    many strings in one call.  A word is kept without the space in front of it;
    one that had none, at a start of a text or line, has a line feed there.
    """

    #: bytes of an entry besides the word's own
    ENTRY = 150

    def __init__(self, encode: Callable[[list[str]], list[int]], cut: re.Pattern | None, limit_bytes: int = 200 << 20):
        super().__init__()
        self.encode, self.cut, self.limit, self.used = encode, cut, limit_bytes, 0

    def words(self, text: str, first: bool) -> list[str]:
        """Words whose counts add up to that of the text; first: whether it starts a text or stands behind a cut."""
        if self.cut is BETWEEN_WORDS:
            return self.cut.split(text)
        if text.replace("\n", " ") != " ".join(text.split()):  # some white space touches more of it, or an end, or is of another kind
            out = self.cut.split(text)
            out[0] = "\n" + out[0] if first else out[0]
            return out
        lines = text.split("\n")
        out = ["\n\n"] * (len(lines) - 1)
        for n, line in enumerate(lines):
            head, *rest = line.split(" ")
            out.append("\n" + head if n or first else head)
            out += rest
        return out

    def learn(self, new: list[str]) -> None:
        self.used += sum(map(len, new)) + self.ENTRY * len(new)
        if self.cut is BETWEEN_WORDS:
            self.update(zip(new, self.encode(new)))
            return
        parts = [(w, *found.groups()) for w in new if (found := LETTERS_AND_SIGNS.fullmatch(w))]
        compound = {w for w, _, _ in parts}
        plain = {w for w in new if w not in compound}
        plain.update(x for _, letters, signs in parts for x in (letters, "\n" + signs))
        plain = list(filterfalse(self.__contains__, plain))
        self.update(zip(plain, self.encode([w[1:] if w[0] == "\n" else " " + w for w in plain])))
        self.update((w, self[letters] + self["\n" + signs]) for w, letters, signs in parts)

    def of(self, pieces: list[str], first: list[bool]) -> np.ndarray:
        """Tokens of each piece."""
        if self.cut is None:
            return np.array(self.encode(pieces), np.int64)
        if self.used > self.limit:
            self.clear()
            self.used = 0
        cut = [self.words(p, f) for p, f in zip(pieces, first)]
        self.learn(list(filterfalse(self.__contains__, set().union(*cut))))
        return np.fromiter((sum(map(self.__getitem__, w)) for w in cut), np.int64, len(cut))


def _byte_level(path: str) -> bool:
    """Whether a file is a byte-level BPE whose words part before spaces."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    pre = found.get("pre_tokenizer") or {}
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])) for t in found.get("added_tokens", []))
    return plain and found.get("normalizer") is None and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space")


def counts(name: str) -> Counts:
    """The memory of this worker for a tokenizer file."""
    path = tokenizer_path(name)

    def make() -> Counts:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            crossing = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
            # a text's start is like a space: its first word has the same pieces as behind one
            prefixed = model.encode("a b", out_type=str) == model.encode("a", out_type=str) + model.encode("b", out_type=str)
            return Counts(lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)] if texts else [], BETWEEN_WORDS if prefixed and not crossing else None)
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        return Counts(lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)], BEFORE_WORD if _byte_level(path) else None)

    return kept(f"token counts {path}", make)


def pieces_of(text: str, most: int, cut: re.Pattern | None) -> Iterator[str]:
    """A text in parts of about ``most`` characters, cut at safe places only; the space of a cut goes with it."""
    at = 0
    while cut is not None and len(text) - at > most:
        found = cut.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


def _count(name: str, batch_bytes: int):
    """mapInArrow: (doc_id, text) -> (doc_id, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        memory = counts(name)
        for batch in batches:
            total = np.zeros(batch.num_rows, np.int64)
            row: list[int] = []
            pieces: list[str] = []
            first: list[bool] = []
            held = 0
            for k, value in enumerate(batch.column(1)):
                for n, piece in enumerate(pieces_of(value.as_py() or "", batch_bytes, memory.cut)):
                    row.append(k)
                    pieces.append(piece)
                    first.append(n == 0)
                    held += len(piece)
                    if held >= batch_bytes:
                        np.add.at(total, row, memory.of(pieces, first))
                        row, pieces, first, held = [], [], [], 0
            if pieces:
                np.add.at(total, row, memory.of(pieces, first))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total)], ["doc_id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT, batch_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, in one pass and without a shuffle.

    tokenizer: a path that every executor has, or the name of an installed public
    file; over_limit: whether a text has more than ``limit`` tokens.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the length travels beside the id, so that the text need not come back
    packed = own.select(F.struct("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).alias("doc_id"), "text")
    counted = map_arrow(packed, _count(tokenizer, batch_bytes), f"doc_id struct<doc_id: {kind}, n_bytes: bigint>, n_tokens long")
    return counted.select("doc_id.doc_id", "doc_id.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
