"""Token ids by a public tokenizer whose pieces never cross white space.

Texts are cut at ASCII white space and every distinct word is encoded once per
worker: for a tokenizer that drops white space, a text's ids are its words'
ids in a row.  The memory of words is a speed-up only and is emptied when it
holds ``limit_bytes``; it never changes an id.
"""

from __future__ import annotations

import re
from itertools import filterfalse

import numpy as np

from .shingles import kept

#: a line of lower-case Latin letters of ASCII and Latin-1 in UTF-8, which are one pre-token, and an end of ``.`` or ``,``
LETTERS = re.compile(rb"(?m)^((?:[a-z]++|\xc3[\x9f-\xb6\xb8-\xbf])++)([.,]*+)$")
SPECIAL = b"<|"


class WordIds(dict):
    """word (bytes) -> its ids as little-endian unsigned 32-bit bytes."""

    #: bytes of an entry besides the word's own
    ENTRY = 200

    def __init__(self, path: str, limit_bytes: int = 160 << 20):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit, self.sized, self.used, self.long = Tokenizer.from_file(path), limit_bytes, 0, 0, 0
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def learn(self, words: set[bytes]) -> None:
        """Encode what is not known yet; words with an end of ``.`` or ``,`` reuse the rest."""
        new = set(filterfalse(self.__contains__, words))
        if not new:
            return
        self.long += 5 * sum(n for n in map(len, new) if n > 40)  # the word and its ids
        shaped = LETTERS.findall(b"\n".join(new))
        tails = [x for x in shaped if x[1]]
        self._letters(list(filterfalse(self.__contains__, {core for core, _ in shaped})))
        other = new.difference([core for core, tail in shaped if not tail], [core + tail for core, tail in tails])
        other.update({tail for _, tail in tails})
        rest = list(filterfalse(self.__contains__, other))
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)):
            self[w] = np.array(e.ids, "<u4").tobytes()
        for core, tail in tails:
            self[core + tail] = self[core] + self[tail]

    def _letters(self, words: list[bytes], at_once: int = 20_000) -> None:
        """Many words as one text; a word's ids end where a token ends a word."""
        for k in range(0, len(words), at_once):
            part = words[k : k + at_once]
            (found,) = self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(part):
                raise ValueError("this tokenizer does not end every word with </w>")
            raw = ids.tobytes()
            self.update((w, raw[i:j]) for w, i, j in zip(part, [0, *stops], stops))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null: none."""
        self.used += (len(self) - self.sized) * self.ENTRY + self.long
        self.sized, self.long = len(self), 0
        if self.used > self.limit:
            self.clear()
            self.sized = self.used = 0
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        # ids do not depend on case, but special tokens are found before case is folded
        words = [(b if SPECIAL in b else b.lower()).split() for b in raw]
        self.learn(set().union(*words))
        return [b"".join(map(self.__getitem__, w)) for w in words]


def word_ids(path: str) -> WordIds:
    return kept(path, lambda: WordIds(path))
