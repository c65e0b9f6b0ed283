"""Edges of HTML extraction, fixity and near duplicates."""

import hashlib
import itertools
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import fixity, html_text, neardup

BODY = " ".join(f"word{i}" for i in range(40))
WEIGHTS = html_text.tag_weights(Counter())
LINKS = "".join(f"<li><a href=x>l{i}</a></li>" for i in range(60))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><p>{BODY}</p><section class='share-price'><p>Price rose.</p></section><section id='social-history'>Past.</section><div id='search'>Search it.</div></article>", f"{BODY}\nPrice rose.\nPast.\nSearch it."),
        (f"<article><h2 class='article-banner'>Head</h2><p>{BODY} <em class='highlight ad'>here</em>.</p></article>", f"Head\n{BODY} here."),
        (f"<article><p>{BODY}</p><aside class='pull-quote'>Quoted.</aside><aside>Side</aside></article>", f"{BODY}\nQuoted."),
        (f"<article><p>{BODY}</p><div class='share-buttons'>Tweet</div><div class='ad-slot'>Buy</div><div class='ad'>Buy</div><div class='ad-300x250'>Buy</div><div class='article-comments'>me</div><ul id='comments'><li>me</li></ul></article>", BODY),
        (f"<article><p>{BODY}</p><ul>{LINKS}</ul><p>Closing words.</p></article>", "\n".join([BODY, *(f"l{i}" for i in range(60)), "Closing words."])),
        (f"<article><p>Short one.</p></article><div>{BODY} {BODY}</div>", "Short one."),
        (f"<main><article><p>{BODY}</p></article><section><p>Elsewhere too.</p></section></main>", BODY),
        (f"<main><article>Teaser</article><p>{BODY}</p></main>", f"Teaser\n{BODY}"),
        (f"<article></article><p>{BODY}</p>", BODY),
        (f'<article><p>{BODY}</p></article><a href="x', BODY),
        (f"<article><p>{BODY}</p><p title='oops>More text.</p></article>", f"{BODY}\nMore text."),
        ("1 < 2 and <3", "1 < 2 and <3"),
    ],
)
def test_what_stays_of_a_page(page, want):
    assert html_text.main_text(page, WEIGHTS) == want


@pytest.mark.parametrize("unit", ['<a "', "<x a='", "<!--", "<", "</p", "<script>", "<div class='", "<article>", "&amp;<b>"])
def test_hostile_pages_take_linear_time(unit):
    began = time.process_time()
    html_text.main_text(unit * 100_000, WEIGHTS)
    assert time.process_time() - began < 10


def test_best_region_is_the_best():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice((-3.0, -1.0, 0.0, 1.0, 2.0)) for _ in range(rng.randrange(1, 12))]
        a, b = html_text.best_region(scores)
        best = max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1))
        assert sum(scores[a:b]) == best


def test_pages_with_other_columns_and_repeats(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "t", 3), (1, "u", f"<article>{BODY}</article>", "t", 3), (2, None, None, None, None), (None, "u", "<p>x</p>" * 50_000, "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    out = html_text.extract_text(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r["page_id"] or 0, r["n_chars"]) for r in out.collect())) == sorted([(1, len(BODY)), (1, len(BODY)), (2, 0), (0, 2 * 50_000 - 1)])


def test_hashes_stand_for_payloads(spark):
    """Records hashed before they are placed give the same audit; several at one offset and null payloads too."""
    rng = random.Random(1)
    left = [(f"f{k % 3}", 100 * k, f"p{k}") for k in range(60)] + [("f0", 0, "twice"), ("f1", 100, None), (None, 1, "x"), ("f2", None, "x")]
    right = [r for r in left if rng.random() > 0.1] + [("f9", 5, "extra"), ("f0", 300, "other")]
    df = lambda rows: spark.createDataFrame(rows, "file string, offset long, payload string")
    hashed = lambda d: d.select("file", "offset", fixity.record_hash(F.col("payload")).alias("hash"), fixity.record_bytes(F.col("payload")).alias("bytes"))
    audit = lambda a, b: sorted(map(tuple, fixity.audit_replicas(a, b, range_bytes=512, fanout=2).collect()), key=str)
    found = audit(hashed(df(left)), hashed(df(right)))
    assert found == audit(df(left), df(right)) and found

    def one(rows):
        out = {}
        for f, at, p in rows:
            if f is not None and at is not None:
                out.setdefault((f, at), []).append("null" if p is None else hashlib.sha256(p.encode()).hexdigest())
        return {k: v[0] if len(v) == 1 else hashlib.sha256(",".join(sorted(v)).encode()).hexdigest() for k, v in out.items()}

    a, b = one(left), one(right)
    assert {(f, at) for f, at, *_ in found} == {k for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    assert audit(df(left), df(left).limit(0)) and audit(df(left).limit(0), df(left).limit(0)) == []


def test_null_ids_and_repeats_among_near_duplicates(spark):
    """Rows of a null id have no component, whatever texts others have; equal texts and rows are one component."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (None, text), (None, None), (5, text), (5, text), (7, ""), (8, None), (9, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"d1": F.lit("x"), "id": F.lit(3), "root": F.lit(4)})
    found = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, width=3, percent=85).collect() if r["doc_id"] is not None)
    assert found == [("1", 1, True), ("5", 1, False), ("5", 1, False), ("7", 7, True), ("8", 8, True), ("9", 9, True)]
    nulls = [(r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, width=3, percent=85).collect() if r["doc_id"] is None]
    assert nulls == [(None, None)] * 2
    assert len(list(itertools.chain(found, nulls))) == len(rows)


# ---------------------------------------------------------------- licences


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("// SPDX-License-Identifier: MIT\nint x;", ("MIT", 0)),
        ("x\n/* SPDX-License-Identifier: GPL-2.0-or-later */", ("GPL-2.0", 1)),
        ("# SPDX-License-Identifier: (BSD-3-Clause OR MIT)\n", ("BSD-3-Clause", 0)),
        ("Our library\n\nLicensed under MIT.", ("MIT", 2)),
        ("This file is not licensed under the Apache License, Version 2.0", (None, None)),
        ("It is no longer available.\nLicensed under the Apache License, Version 2.0", ("Apache-2.0", 1)),
        (None, (None, None)),
    ],
)
def test_what_names_a_licence(text, want):
    from tessera.llm import licenses as N

    index, blocks = N.TemplateIndex({}, 1000), N.TemplateIndex({}, 1000, N.BLOCKS, N.FULL_TEXTS)
    name, _, line = index.scan(text, 0.8, blocks)
    assert (name, line) == want


def test_cosines_match_dense_vectors():
    import math

    from tessera.llm import licenses as N

    rng = random.Random(3)
    df = {t: rng.randrange(1, 900) for _, text in N.TEMPLATES for t in N.terms(text)}
    index = N.TemplateIndex(df, 1000)
    weigh = lambda t: math.log(1001 / (1 + df[t])) + 1 if t in df else math.log(1001 / 2) + 1

    def cosine(a, b):
        x, y = ({t: n * weigh(t) for t, n in Counter(c).items()} for c in (a, b))
        return sum(v * y.get(t, 0) for t, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    for _ in range(200):
        line = rng.sample(N.terms(rng.choice(N.TEMPLATES)[1]), 3) + rng.choices(["the", "zzz", "licensed", "under"], k=rng.randrange(4))
        score, name = index.best(line)
        each = [(round(cosine(line, N.terms(text)), 9), n) for n, text in N.TEMPLATES]
        top = max(c for c, _ in each)
        assert round(score, 9) == top and name == min(n for c, n in each if c == top)


def test_licences_come_from_the_nearest_folder(spark):
    from tessera.llm import licenses as N

    mit, apache = "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: Apache-2.0"
    rows = [(1, "a/LICENSE", mit), (2, "a/x.c", "code"), (3, "a/b/y.c", "code"), (4, "a/b/COPYING", apache), (5, "a/b/c/z.c", "code"), (6, "ab/x.c", "code"), (7, None, "code"), (8, "top.c", None), (9, "a/b/own.c", mit), (2, "a/x.c", "code"), (10, "a/b/LICENSE.txt", mit)]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({"license": F.lit("x"), "score": F.lit(9), "folder": F.lit("f")})
    found = sorted((r["doc_id"], r["license"], r["origin"], r["from_path"]) for r in N.scan_licenses(docs).collect())
    assert found == sorted([(1, "MIT", "own", None), (2, "MIT", "inherited", "a/LICENSE"), (2, "MIT", "inherited", "a/LICENSE"), (3, "Apache-2.0", "inherited", "a/b/COPYING"), (4, "Apache-2.0", "own", None), (5, "Apache-2.0", "inherited", "a/b/COPYING"), (6, None, "none", None), (7, None, "none", None), (8, None, "none", None), (9, "MIT", "own", None), (10, "MIT", "own", None)], key=lambda r: (r[0], str(r)))
    assert N.scan_licenses(docs.limit(0)).count() == 0
