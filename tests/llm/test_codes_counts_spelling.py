"""Token counts, vector codes and spelling variants against plain Python, with nulls, ties, repeats and empty tables."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import spelling, token_counts, vector_codes

DOCS = "doc_id long, text string, lang string, n_bytes long, n_tokens long, word string, n long"


def docs_of(spark, texts):
    return spark.createDataFrame([(None if i == 2 else i, t, "en", 1, 1, "w", 1) for i, t in enumerate(texts)], DOCS)


# ---------------------------------------------------------------- token counts


def reference(name, text):
    path = token_counts.tokenizer_path(name)
    if path.endswith(".model"):
        import sentencepiece

        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(2)
    parts = ["a", "Berg", "é", "99", "'s", " ", "  ", "\n", "\n\n", " ", "\t", "。", "中文", "<|endoftext|>", "　", "\x1c", "!", "...", "don't", "​", "😀", "\x85", "</s>", "▁", "word,", "end.\nNext"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(150)]
    return [None, "", "x", " ", "\n", "one two", *made, "word " * 30_000, "nospace" * 3_000, "a<|endoftext|> b", made[0], made[0]]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts_are_the_library_s(spark, odd_texts, name):
    """Whatever the batches: long texts in pieces, words from memory, special strings as the library takes them."""
    df = docs_of(spark, odd_texts)
    for size in (1 << 20, 64):
        if size == 64:
            df = docs_of(spark, odd_texts[:-6])
        found = sorted(((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(df, tokenizer=name, batch_bytes=size).collect()))
        want = [(len((t or "").encode()), reference(name, t or "")) for t in (odd_texts if size > 64 else odd_texts[:-6])]
        assert found == sorted((b, n, n > 1024) for b, n in want)


def test_token_count_rows(spark, odd_texts):
    out = token_counts.count_tokens(docs_of(spark, odd_texts))
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and [t for _, t in out.dtypes] == ["bigint", "bigint", "bigint", "boolean"]
    rows = out.collect()
    assert len(rows) == len(odd_texts) and sum(r["doc_id"] is None for r in rows) == 1
    assert token_counts.count_tokens(docs_of(spark, ["x"]).limit(0)).count() == 0
    named = spark.createDataFrame([("k", "one two")], "doc_id string, text string")
    assert token_counts.count_tokens(named).first()["doc_id"] == "k"


def test_forgetting_changes_no_count():
    memory = token_counts.counts("byte_bpe_50k.json")
    small = token_counts.Counts(memory.encode, memory.cut, limit_bytes=500)
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(200)}" for _ in range(20)) for _ in range(30)]
    for k in range(0, 30, 3):
        assert small.of(texts[k : k + 3], [True] * 3).tolist() == [reference("byte_bpe_50k.json", t) for t in texts[k : k + 3]]


def test_pieces_put_together_are_the_text():
    for text in ("", "a b c dd eee ffff", "nospaces", " x  y "):
        for most in (1, 3, 100):
            assert " ".join(token_counts.pieces_of(text, most, token_counts.BEFORE_WORD)) == text


# ---------------------------------------------------------------- vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """rows: (vec_id, vector, label).  The definition, one vector after another."""
    whole = [(i, [int(np.floor(scale * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole.sort(key=lambda r: (r[0] is None, r[0]))
    step = len(whole[0][1]) // parts
    cut = lambda v: [v[k * step : (k + 1) * step] for k in range(parts)]
    books = [[cut(v)[k] for _, v, _ in whole[:entries]] for k in range(parts)]

    def nearest(k, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(books[k]))

    for _ in range(rounds):
        moved = []
        for k in range(parts):
            own = [[] for _ in books[k]]
            for _, v, _ in whole:
                own[nearest(k, cut(v)[k])[1]].append(cut(v)[k])
            moved.append([[sum(c) // len(xs) for c in zip(*xs)] if xs else books[k][n] for n, xs in enumerate(own)])
        books = moved
    out = [(i, "".join(f"{nearest(k, x)[1]:02x}" for k, x in enumerate(cut(v))), sum(nearest(k, x)[0] for k, x in enumerate(cut(v))), label) for i, v, label in whole]
    by = Counter()
    for _, _, e, label in out:
        by[label] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, e, by[label], sha) for i, code, e, label in out), key=str)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<float>, label int, code string, error long")


def test_codes_match_plain_python(spark):
    """Ties, repeated vectors, nulls and numbers that are none; a label of null."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-3, 3, 32) / 64], int(i % 3) if i % 7 else None) for i in range(150)]
    rows += [(200 + i, rows[i][1], 1) for i in range(30)] + [(300, None, 1), (301, [float("nan")] * 32, 1), (302, [float("inf")] + [0.0] * 31, 0), (303, [None] + [0.0] * 31, 0), (-5, [0.0] * 32, 9)]
    found = sorted((tuple(r) for r in vector_codes.compress_vectors(table_of(spark, rows).repartition(5)).collect()), key=str)
    assert found == plain_codes(rows)
    few = rows[:5]
    assert sorted((tuple(r) for r in vector_codes.compress_vectors(table_of(spark, few)).collect()), key=str) == plain_codes(few)


def test_codes_of_odd_tables(spark):
    assert vector_codes.compress_vectors(table_of(spark, []).limit(0)).count() == 0
    mixed = [(1, [0.5] * 16, 0), (2, [0.25] * 32, 0), (3, [0.5] * 16, None), (None, [0.75] * 16, 0)]
    found = {r["vec_id"]: r for r in vector_codes.compress_vectors(table_of(spark, mixed)).collect()}
    assert len(found) == 4 and found[2]["code"] is None and found[2]["error"] is None and found[1]["code"] == "00" * 16
    assert found[None]["code"] is not None and found[1]["label_error"] == 0
    odd = [(1, [0.5] * 17, 0), (2, [], 0)]
    assert {r["code"] for r in vector_codes.compress_vectors(table_of(spark, odd)).collect()} == {None}
    huge = [(i, [3e38 if i % 2 else -3e38] * 16, 0) for i in range(70)]
    assert vector_codes.compress_vectors(table_of(spark, huge)).count() == 70
    with pytest.raises(ValueError):
        vector_codes.fit_codebooks(table_of(spark, mixed).select("vec_id", F.col("embedding").alias("vec")), entries=300)


def test_tree_keeps_the_lowest_of_equals():
    rng = np.random.default_rng(0)
    for n, d, spread in ((1, 3, 4), (64, 4, 2), (64, 4, 200), (200, 1, 9), (40, 2, 1)):
        entries, points = rng.integers(-spread, spread, (n, d)), rng.integers(-spread - 2, spread + 2, (500, d))
        number, away = vector_codes.KdTree(entries).nearest(points)
        every = ((points[:, None] - entries[None]) ** 2).sum(-1)
        assert (number == every.argmin(1)).all() and (away == every.min(1)).all()


# ---------------------------------------------------------------- spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_forms(n, ratio=5):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return out


def forms_of(spark, n):
    rows = spelling.spelling_forms(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert len(rows) == len(n)
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}


def test_forms_match_brute_force(spark):
    """Anagram families, doubled letters, accents, capitals beyond ASCII, ties, chains and hubs."""
    rng = random.Random(6)
    words = {"".join(p) for p in itertools.permutations("abcdef")} | {"".join(rng.choice("abc") for _ in range(rng.randrange(6, 9))) for _ in range(300)}
    words |= {"straße", "strasse", "Äpfeln", "äpfeln", "÷×øùúû", "÷×øùúü", "aaaaaa", "aaaaaaa", "aaaaaaaa", "lonely" * 40}
    words |= {"letters"[:k] + c + "letters"[k + 1 :] for k in range(7) for c in "xyz"} | {"letters"}
    n = {w: rng.choice((5, 6, 25, 30, 150, 750, 4000)) for w in sorted(words)}
    assert forms_of(spark, n) == plain_forms(n)


def test_long_chains_end_at_their_root(spark):
    n = {"a" * k: 5**k for k in range(6, 24)}
    assert forms_of(spark, n) == plain_forms(n)


def test_words_of_texts(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(5, 8))) for _ in range(40)]
    texts = [None, "", "12 345 --", "ABCDEF abcdef Éa-b"] + [rng.choice(" \n.,;9").join(rng.choice((w, w.upper(), w.title())) for w in rng.choices(vocabulary, k=rng.randrange(400))) for _ in range(60)]
    texts += ["verylong" * 20_000] * 5 + [texts[-1]] * 2
    want = Counter()
    for i, t in enumerate(texts):
        for run in spelling.RUN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")):
            h = zlib.crc32(f"{'' if i == 2 else i}:{run}".encode())
            want[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = {w: k for w, k in want.items() if len(w) >= 6 and k >= 5}
    df = docs_of(spark, texts).repartition(4)
    for held in (96 << 20, 1000):
        assert {r["word"]: r["n"] for r in spelling.count_words(df, slips=199, held_bytes=held).collect()} == want
    plain = Counter(w for t in texts for w in spelling.RUN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))
    assert {r["word"]: r["n"] for r in spelling.count_words(df).collect()} == {w: k for w, k in plain.items() if len(w) >= 6 and k >= 5}
    found = {tuple(r) for r in spelling.spelling_variants(docs_of(spark, texts)).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert found == plain_forms(want)
    assert spelling.spelling_variants(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_letter_values_tell_exchanges_apart():
    """No two exchanges move a key by the same amount, so a pair meets by the letters that differ alone."""
    letters = [*range(97, 123), *range(0xC0, 0x100)]
    moves = [a**5 - b**5 for a in letters for b in letters if a != b]
    assert len(set(moves)) == len(moves) and 2 * max(moves) < spelling.MODULUS


# ---------------------------------------------------------------- quality rules on the given tables


def test_quality_cutoffs_are_live(spark):
    """Cutoffs are found where labels allow them, and reject what the base rules leave."""
    from tessera.llm import quality

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality_rules(docs, labels).join(docs.select("doc_id", "lang"), "doc_id")
    rejected = {r["lang"]: r["n"] for r in found.where("not kept and not base_failed").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert {"en", "fr", "de"} <= set(rejected) and min(rejected.values()) > 50
    good = found.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id").where("not base_failed")
    assert good.where("not kept").count() <= 0.05 * good.count()
    small = "/root/testdata/sf0.01"
    few = quality.strata_report(*(spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels")), joint=True)
    assert {r["stratum"]: r["n_cutoffs"] for r in few.collect()}["en"] > 0
