"""Licence scan: sparse TF-IDF cosine to templates, then inheritance by directory.

Every block of a text is compared with whole licence headers, licence texts and
titles: its header (the leading comment lines), each paragraph of several lines
and, in a licence file, the whole text.  The block of the highest cosine names
the licence; where none reaches ``threshold`` every line is compared with
every template statement, and the best line does.  A line or short block that says
something is not licensed names nothing.  A tag line ``SPDX-License-Identifier``
outside all of these is exact: its first identifier is the licence, with score 1,
whatever else the text has.  Terms are
lower-case runs of letters and digits, a term weighs its count times
ln((1 + N) / (1 + df)) + 1, with N and df counted over all documents; terms
that no template has weigh as if in one document.  Only the products of shared
terms are formed (sparse).  ``line_no`` is the first line of what names the
licence.  A file with no licence of its own takes that of the nearest directory at
or above it that has a licence file with one, found by joining the file's
ancestor paths with the directories of licence files.

Nulls and edges: a null or empty text has no licence of its own; a null path
has no ancestors; of several licence files of one directory the highest cosine,
then the first path, speaks; equal cosines take the first template by name;
repeated rows are each reported; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .license_texts import FULL_TEXTS
from .packing import slices
from .shared import map_arrow, materialize

TERM = re.compile(r"[^\W_]+")
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"
LICENSE_NAME = re.compile(LICENSE_FILE)

#: Statements by which public licences are named or granted.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under Apache 2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Released under the ISC License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Licensed under MIT"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)


def _gnu(name: str, version: str) -> list[str]:
    """The standard header of the GNU licences, and its first paragraph alone."""
    grant = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    rest = f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    return [grant, f"{grant} {rest} You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."]


_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Whole headers, whole short licence texts, and the titles of licence files.
BLOCKS: tuple[tuple[str, str], ...] = (
    *(("AGPL-3.0", x) for x in _gnu("Affero General Public License", "3")),
    *(("GPL-2.0", x) for x in _gnu("General Public License", "2")),
    *(("GPL-3.0", x) for x in _gnu("General Public License", "3")),
    *(("LGPL-2.1", x) for x in _gnu("Lesser General Public License", "2.1")),
    *(("LGPL-3.0", x) for x in _gnu("Lesser General Public License", "3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_END}"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org"),
)
#: the tag that names a licence by its identifier, and what an identifier may end in
SPDX = re.compile(r"SPDX-License-Identifier:\s*\(*\s*([A-Za-z0-9][A-Za-z0-9.+-]*)")
SPDX_ENDS = re.compile(r"(-only|-or-later|\+)$")
#: words that take a licence back; whole licence texts have them too, so they count in blocks of few terms
NEGATED = re.compile(r"\b(?:not|never|no longer)\s+(?:\w+\s+)?(?:licen[cs]ed|released|covered|available|dedicated|permitted)\b|\bnot\s+subject\s+to\b", re.I)
SHORT = 60
COMMENT = re.compile(r"\s*(#|//|/\*|\*|--|;|%|<!--|\"{3}|'{3}|\(\*|\{-|rem\b|dnl\b)", re.I)
OPENS = (("/*", "*/"), ("<!--", "-->"), ('"' * 3, '"' * 3), ("'" * 3, "'" * 3), ("(*", "*)"), ("{-", "-}"))


def header_lines(lines: list[str]) -> int:
    """How many leading lines are comments or blank."""
    closes, k = "", 0
    for k, line in enumerate(lines):
        if closes:
            if closes in line:
                closes = ""
            continue
        text = line.strip()
        if text and not COMMENT.match(line):
            return k
        for start, stop in OPENS:
            if text.startswith(start):
                closes = stop if stop not in text[len(start) :] else ""
                break
    return k + 1 if lines and not closes else 0


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


class TemplateIndex:
    """Weighted template vectors and their postings."""

    def __init__(self, df: dict[str, int], n: int, templates: tuple[tuple[str, str], ...] = TEMPLATES, counted: tuple[tuple[str, str], ...] = ()):
        self.names = [name for name, _ in (*templates, *counted)]
        counts = [Counter(terms(text)) for _, text in templates] + [_counts(text) for _, text in counted]
        self.weight = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for c in counts for t in c}
        self.other = math.log((1 + n) / 2) + 1
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for k, c in enumerate(counts):
            norm = math.sqrt(sum((f * self.weight[t]) ** 2 for t, f in c.items()))
            for t, f in c.items():
                self.postings.setdefault(t, []).append((k, f * self.weight[t] / norm))
        self.vocabulary = frozenset(self.weight)

    def best(self, line: list[str]) -> tuple[float, str | None]:
        """Highest cosine of a line's terms with a template, and its name."""
        shared = self.vocabulary.intersection(line)
        if not shared:
            return 0.0, None
        counts = Counter(line)
        square, dots = 0.0, {}
        for t, f in counts.items():
            w = f * self.weight.get(t, self.other)
            square += w * w
            if t in shared:
                for k, v in self.postings[t]:
                    dots[k] = dots.get(k, 0.0) + w * v
        return self._nearest(dots, square)

    def _nearest(self, dots: dict[int, float], square: float) -> tuple[float, str | None]:
        k = min(dots, key=lambda k: (-dots[k], self.names[k]))
        return min(1.0, dots[k] / math.sqrt(square)), self.names[k]

    def near(self, block: list[str], enough: float) -> tuple[float, str | None]:
        """As ``best`` if that can reach ``enough``: the terms that no template has alone may rule it out."""
        counts = Counter(block)
        known = other = 0.0
        for t, f in counts.items():
            w = self.weight.get(t)
            if w is None:
                other += (f * self.other) ** 2
            else:
                known += (f * w) ** 2
        return self.best(block) if known >= enough * enough * (known + other) * (1 - 1e-9) else (0.0, None)

    def scan(self, text: str | None, enough: float, blocks: TemplateIndex | None = None, whole: bool = False) -> tuple[str | None, float, int | None]:
        """(licence, cosine, line number) of a text's best block, or else its best line, that reaches ``enough``."""
        found: tuple[str | None, float, int | None] = (None, 0.0, None)
        lines = text.split("\n") if text else []
        if text and "SPDX-License-Identifier" in text:
            for i, line in enumerate(lines):
                if tag := SPDX.search(line):
                    return SPDX_ENDS.sub("", tag[1].rstrip(".-")), 1.0, i
        each = [terms(line) for line in lines]
        if blocks:
            for start, end in _spans(lines, each, whole):
                if sum(map(len, each[start:end])) < SHORT and NEGATED.search(" ".join(lines[start:end])):
                    continue
                score, name = blocks.near([t for ts in each[start:end] for t in ts], enough)
                if score >= enough and score > found[1]:
                    found = name, score, start
            if found[0]:
                return found
        for i, line in enumerate(each):
            score, name = self.best(line)
            if score >= enough and score > found[1] and not (len(line) < SHORT and NEGATED.search(lines[i])):
                found = name, score, i
        return found


def _counts(text: str) -> Counter:
    """The counter of "term count term count ..."."""
    words = text.split()
    return Counter(dict(zip(words[::2], map(int, words[1::2]))))


def _spans(lines: list[str], each: list[list[str]], whole: bool) -> list[tuple[int, int]]:
    """[first, end) of the whole text of a licence file, the header, and the paragraphs of several lines."""
    out, start = [(0, len(lines))] if whole and lines else [], 0
    head = header_lines(lines)
    if head:
        out.append((0, head))
    for i in range(len(lines) + 1):
        if i == len(lines) or not each[i]:
            if i - start > 1:
                out.append((start, i))
            start = i + 1
    return list(dict.fromkeys(out))


def _frequencies(vocabulary: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = Counter(), 0
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    n += 1
                    df.update(vocabulary.intersection(terms(text or "")))
        yield pa.RecordBatch.from_arrays([pa.array(["", *df], pa.string()), pa.array([n, *df.values()], pa.int64())], ["term", "n"])

    return run


def _scan(index: TemplateIndex, blocks: TemplateIndex, enough: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [index.scan(t, enough, blocks, bool(p and LICENSE_NAME.search(p))) for p, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.int32())], ["doc_id", "path", "license", "score", "line_no"])

    return run


def scan_licenses(files: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, path, license, score, line_no, origin, from_path) for every file.

    origin: ``own``, ``inherited`` or ``none``; from_path: the licence file inherited from.
    """
    kind = files.schema[id_col].dataType.simpleString()
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    vocabulary = frozenset(t for _, text in (*TEMPLATES, *BLOCKS) for t in terms(text)).union(*(_counts(text) for _, text in FULL_TEXTS))
    counted = map_arrow(rows.select("text"), _frequencies(vocabulary), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term of the templates
    df = {r["term"]: r["n"] for r in counted}
    n = df.pop("", 0)
    index, blocks = TemplateIndex(df, n), TemplateIndex(df, n, BLOCKS, FULL_TEXTS)
    own = materialize(map_arrow(rows, _scan(index, blocks, threshold), f"doc_id {kind}, path string, license string, score double, line_no int"), "licenses")

    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    holders = own.where(F.col("license").isNotNull() & F.col("path").rlike(LICENSE_FILE)).select(folder.alias("dir"), F.struct((-F.col("score")).alias("s"), "path", "license", "score").alias("x"))
    holders = holders.groupBy("dir").agg(F.min("x").alias("x"))
    # distinct folders meet their ancestors, so a folder of very many files costs no more than another
    folders = own.where("license is null and path is not null").select(folder.alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("dir"))
    nearest = above.join(holders, "dir").groupBy("folder").agg(F.max_by("x", F.length("dir")).alias("x"))
    # files with a licence of their own take no part in the join, where their null folder would be one task's work
    bare = own.where("license is null").withColumn("folder", folder).join(nearest, "folder", "left").select(*own.columns, "x")
    out = bare.unionByName(own.where("license is not null").withColumn("x", F.lit(None).cast(nearest.schema["x"].dataType)))
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("x").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("license", "x.license").alias("license"), F.when(F.col("license").isNotNull(), F.col("score")).otherwise(F.coalesce("x.score", F.lit(0.0))).alias("score"), "line_no", origin.alias("origin"), F.when(F.col("license").isNull(), F.col("x.path")).alias("from_path"))
