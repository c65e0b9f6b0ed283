"""The corpus operators against brute force on small fixtures, with nulls, ties, repeats and empty tables."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, decontaminate, fixity, html_text, lang_id, licenses, line_dedup, neardup, packing, quality, url_lists, word_ids

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, key string"


def docs_of(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", "s", len(t or ""), "r", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(3)
    base = [words(rng, 120) for _ in range(6)]
    out = [None, "", "  \n ", "one", "ONE", "one two", words(rng, 3000)]
    for b in base:
        for k in (0, 0, 1, 2, 5, 9):
            w = b.split(" ")
            for _ in range(k):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_near_duplicates(spark, near_texts):
    found = {r["doc_id"]: r for r in neardup.near_duplicates(docs_of(spark, near_texts), width=3, percent=85).collect()}
    sets = [shingles(t, 3) for t in near_texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(sets)), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * i >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert {i: (len(s), root(i), root(i) == i) for i, s in enumerate(sets)} == {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in found.items()}
    kept = neardup.keep_one(docs_of(spark, near_texts), width=3, percent=85)
    assert kept.columns == docs_of(spark, ["x"]).columns
    assert kept.count() == sum(root(i) == i for i in range(len(sets)))
    assert neardup.near_duplicates(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_block_links_equal_pairs(spark, near_texts):
    """Large buckets: the block path finds what pairs find."""
    df = docs_of(spark, near_texts)
    old = neardup.SMALL, neardup.BLOCK
    neardup.SMALL, neardup.BLOCK = 0, 2
    try:
        a = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df, width=3, percent=85).collect()}
    finally:
        neardup.SMALL, neardup.BLOCK = old
    assert a == {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df, width=3, percent=85).collect()}


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = np.unique(x[:800]), np.unique(x[100:])
    r = neardup.sketch([a, b, a[:3]])
    assert abs(neardup.estimated_similarity(r[0], r[1]) - 700 / 900) < 0.12
    assert (r != 0).all() or r.shape == (3, neardup.REGISTERS)


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(50, 40), (60, 50), (70, 70)]
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    want = {i: 0 for i in range(31)} | {40: 40, 50: 40, 60: 40}
    assert {r["node"]: r["root"] for r in found.collect()} == want
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = [None, "", "a b", "a b c a b c", "x y z x y z q\n# $\n# $\n \n", " ".join("ab"[rng.random() < 0.5] for _ in range(300)), "é" * 70, words(rng, 40_000, 60)]
    out = {r["doc_id"]: r for r in quality.quality_rules(docs_of(spark, texts), spark.createDataFrame([], "doc_id long, quality int")).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        at = Counter()
        places = {}
        for k in range(len(w) - 2):
            places.setdefault(tuple(w[k : k + 3]), []).append(k)
        covered = {p + k for v in places.values() if len(v) > 1 for p in v for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r["kept"] == (not r["base_failed"]), at


def test_repeated_windows_are_exact(spark):
    """Whatever the hash: where it collides the words decide."""
    rng = random.Random(17)
    texts = [words(rng, n, v) for n, v in ((3, 2), (4, 1), (40, 3), (400, 9), (400, 30), (5000, 25))]
    df = spark.createDataFrame([(t.split(" "),) for t in texts], "w array<string>")
    for hashed in ("xxhash64(w[i], w[i + 1], w[i + 2])", "0L", "cast(length(w[i]) as bigint) * 1000003"):
        found = [r["n"] for r in df.selectExpr(quality._repeat_words().replace("xxhash64(w[i], w[i + 1], w[i + 2])", hashed) + " as n").collect()]
        for t, n in zip(texts, found):
            w = t.split(" ")
            at = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
            assert n == len({p + k for p in range(len(w) - 2) if at[tuple(w[p : p + 3])] > 1 for k in range(3)})


def test_quality_cutoffs_reject_bad_and_keep_good(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(2600):
        w = [f"{rng.randrange(10**6)}word" for _ in range(60)]
        bad = i % 4 == 0
        texts.append(" ".join(x + "%%%" * bad for x in w))
        labels.append((i, 0 if bad else 1))
    labels += [(0, 0), (None, 1), (5, None)]
    found = quality.quality_rules(docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = {r["doc_id"] for r in found.where("kept").collect()}
    assert kept == {i for i in range(2600) if i % 4}
    few = quality.quality_rules(docs_of(spark, texts[:80]), spark.createDataFrame(labels[:80], "doc_id long, quality int"))
    assert few.where("kept").count() == 80  # too few labels prove nothing
    filtered = quality.quality_filter(docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert filtered.count() == len(kept) and filtered.columns == docs_of(spark, ["x"]).columns


def test_binomial_tail(spark):
    from math import comb, exp

    for n, k, p in ((50, 0, 0.01), (200, 3, 0.05), (30, 30, 0.2)):
        got = spark.sql(f"select {quality._log_tail(f'{n}L', f'{k}L', p)} x").first()["x"]
        assert abs(exp(got) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9


def brute_bins(items, cap):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins) if b + items[i] <= cap}.values():
            bins[j] += items[i]
            go(i + 1, bins)
            bins[j] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_reduction_loses_nothing():
    rng = random.Random(5)
    for _ in range(150):
        cap = rng.choice([10, 20, 30])
        items = [rng.randint(1, cap) for _ in range(rng.randint(1, 9))]
        fixed, rest = packing.reduce_dominated(Counter(items), cap)
        left = list(rest.elements())
        assert sum(m for _, m in fixed) + (brute_bins(left, cap) if left else 0) == brute_bins(items, cap), items
        got = Counter()
        for pattern, m in packing.plan_sequences(Counter(items), cap):
            assert sum(w * k for w, k in pattern) <= cap
            for w, k in pattern:
                got[w] += k * m
        assert got == Counter(items)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path("word_bpe_49k.json"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


TRICKY = ["", "it's DON'T we'll,", "Éa über. naïve…ok ΑΣ ΟΔΟΣ", "a<|endoftext|>b <|STARTOFTEXT|>", "é x y\x1fz 4.0, 12", "a" * 300, "..,., ,a,", "́a ½ Ⅷ"]


def test_word_ids_equal_the_tokenizer(tokenizer):
    path, t = tokenizer
    got = word_ids.WordIds(path).encode([None, *TRICKY])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[]] + [t.encode(x, add_special_tokens=False).ids for x in TRICKY]


def test_packing_round_trip(spark, tokenizer):
    rng = random.Random(4)
    texts = [None, *TRICKY, words(rng, 3000), words(rng, 40), words(rng, 40)]
    out = packing.pack_documents(docs_of(spark, texts), capacity=64, with_ids=True).collect()
    for i, t in enumerate(texts):
        ids = np.array(tokenizer[1].encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["piece"])
        assert b"".join(bytes(r["ids_le32"]) for r in own) == ids.tobytes()
        assert [r["start"] for r in own] == list(range(0, len(ids), 64)) and all(zlib.crc32(bytes(r["ids_le32"])) == r["ids_crc32"] for r in own)
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == list(itertools.accumulate([0] + [n for _, n in s]))[:-1] and sum(n for _, n in s) <= 64
    assert packing.pack_documents(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_contamination(spark):
    rng = random.Random(6)
    items = [words(rng, 20, 5000), words(rng, 40, 5000), "too short", None, words(rng, 12, 5000)]
    texts = [None, "", words(rng, 8000, 5000), items[0].upper().replace(" ", "  ,"), words(rng, 4000, 5000) + " " + items[1] + " " + words(rng, 4000, 5000), " ".join(items[1].split()[:20]), items[4] + " " + items[4], "too short"]
    asked = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    grams = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)})(re.findall(r"[^\W_]+", (t or "").lower()))
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if grams(x) and 100 * len(grams(x) & grams(t)) >= 80 * len(grams(x))}
    for block in (1_000_000, 30):
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(spark, texts), asked, block_shingles=block).collect()} == want
    clean = decontaminate.decontaminate(docs_of(spark, texts), asked)
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in want} and clean.columns == docs_of(spark, ["x"]).columns
    assert decontaminate.contaminated(docs_of(spark, texts), asked.limit(0)).count() == 0


def test_line_dedup(spark):
    rng = random.Random(7)
    line = [" ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(40)) for _ in range(5)]
    near = line[0].replace(line[0].split()[5], line[0].split()[5] + "s", 1)
    texts = [None, "", "---\n---", f"{line[0]}\n{line[1]}\n\nHi there", f"{near}\nHi, THERE!\n{line[2]}", f"{line[1]}\n{line[1]}", f"{line[3]}\npage 12\npage 7"]
    out = {r["doc_id"]: r["dropped"] for r in line_dedup.repeated_lines(docs_of(spark, texts)).collect()}
    assert out == {0: [], 1: [], 2: [], 3: [], 4: [0, 1], 5: [0, 1], 6: [2]}
    new = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(docs_of(spark, texts)).collect()}
    assert set(new) == {0, 1, 2, 3, 4, 6} and new[6]["text"] == f"{line[3]}\npage 12" and new[6]["n_chars"] == len(new[6]["text"]) and new[0]["text"] is None


def test_edit_similarity():
    def lev(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    rng = random.Random(8)
    for _ in range(600):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(2))
        m = max(len(a), len(b))
        assert line_dedup.edit_similar(a, b, 80) == (100 * (m - lev(a, b)) >= 80 * m)


def test_html():
    w = html_text.tag_weights(Counter())
    page = "<html><head><title>x</title></head><body><header><h1>Site</h1></header><nav><a href=x>one</a></nav><div class='cookie-notice'>We use cookies a lot</div><div class=post><h1>Title here</h1><p>First para with words &amp; more&nbsp;text.<ul><li>a b</li><li>c</li></ul><p>Second <b>bold</b>thing</div><aside>Side</aside><section id=comments><p>Great post!</p></section><form>name<input></form><script>var a='</p>'</script><footer>me</footer></body></html>"
    assert html_text.main_text(page, w) == "Title here\nFirst para with words & more text.\na b\nc\nSecond boldthing"
    assert [html_text.main_text(p, w) for p in (None, "", "<p>x", "just text", "<nav>open <p>Hi there", "a < b")] == ["", "", "x", "just text", "open\nHi there", "a < b"]
    assert html_text.best_region([-1, 2, -1, 3, -5, 4]) == (1, 4) and html_text.best_region([-1.0]) == (0, 0)


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<body><nav>menu menu</nav><article><h1>A b</h1><p>c d.<br>e</article><footer>f</footer>"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    out = html_text.extract_text(pages).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in out) == [(1, "A b\nc d. e", 10), (2, "", 0), (2, "", 0)]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_language(spark):
    rng = random.Random(9)
    sound = {"aa": "bcd", "bb": "xyz"}
    make = lambda g: " ".join("".join(rng.choice(sound[g] + "ae") for _ in range(6)) for _ in range(40))
    langs = [("aa", "bb")[i % 2] for i in range(120)] + [None, "aa", "bb"]
    texts = [make(g) for g in langs[:120]] + [make("aa"), None, " 12 !"]
    out = {r["doc_id"]: r for r in lang_id.identify_languages(docs_of(spark, texts, langs)).collect()}
    assert sum(out[i]["lang_pred"] == langs[i] for i in range(120) if out[i]["held_out"]) / sum(out[i]["held_out"] for i in range(120)) > 0.95
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in out)
    assert out[120]["lang_pred"] == "aa" and out[121]["lang_pred"] == out[122]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in out.values())
    none = lang_id.identify_languages(docs_of(spark, ["abc"], [None])).first()
    assert none["lang_pred"] == "und"


def test_url_lists(spark):
    events = spark.createDataFrame([("l", "block", "bad.com", "add", 10), ("l", "block", "bad.com", "remove", 20), ("l", "block", "bad.com", "add", 20), ("w", "allow", "bad.com/ok", "add", 5), ("l", "block", None, "add", 1)], "list_name string, verdict string, pattern string, action string, at int")
    urls = [("http://www.Bad.com./x", 9), ("https://a.bad.com:80/x", 10), ("http://bad.com/ok/page?q", 15), ("http://bad.com/x", 20), ("http://notbad.com/", 15), (None, 15), ("nonsense", 15), ("http://bad.com/", None)]
    caps = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(urls)], "capture_id long, url string, fetched_at int")
    out = {r["capture_id"]: r["decision"] for r in url_lists.filter_captures(caps, events).collect()}
    assert out == {0: "none", 1: "block", 2: "allow", 3: "none", 4: "none", 5: "none", 6: "none", 7: "none"}
    assert url_lists.filter_captures(caps, events.limit(0)).where("decision <> 'none'").count() == 0


def test_fixity(spark):
    rows = [("f", i * 100, f"payload {i}" * 3) for i in range(200)] + [("g", 0, None), (None, 1, "x")]
    left = spark.createDataFrame(rows, "file string, offset long, payload string")
    assert fixity.audit_replicas(left, left, range_bytes=500, fanout=4).count() == 0
    damaged = [(f, o, "broken" if o == 700 and f else p) for f, o, p in rows if o != 12_300] + [("f", 55, "more"), ("h", 0, "new")]
    right = spark.createDataFrame(damaged, "file string, offset long, payload string")
    out = {(r["file"], r["offset"], r["kind"]) for r in fixity.audit_replicas(left, right, range_bytes=500, fanout=4).collect()}
    assert out == {("f", 700, "changed"), ("f", 12_300, "missing"), ("f", 55, "extra"), ("h", 0, "extra")}


def test_licenses(spark):
    rows = [(1, "p/LICENSE", "MIT License\nReleased under the MIT License."), (2, "p/a/b.py", "x"), (3, "p/c/LICENSE.txt", "Licensed under CC BY-NC 4.0"), (4, "p/c/d/e.py", None), (5, "q/f.py", "no"), (6, "p/c/g.py", "# Licensed under the Apache License, Version 2.0."), (7, None, "text")]
    out = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert out == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("CC-BY-NC-4.0", "own"), 4: ("CC-BY-NC-4.0", "inherited"), 5: (None, "none"), 6: ("Apache-2.0", "own"), 7: (None, "none")}


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, sf).columns == docs.columns, name
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_line_dedup_finds_small_edits(spark):
    """Brute-force edit similarity and the buckets agree for lines of all lengths, from one word on."""
    rng = random.Random(11)
    texts = []
    for n in [1, 2, 3, 4] * 3 + [5, 8, 12, 20, 35, 60, 120]:
        w = ["".join(rng.choice("abcdefghijklmnop") for _ in range(12 if n == 1 else 7)) for _ in range(n)]
        line = " ".join(w)
        at = rng.randrange(len(line))
        texts += [line, line[:at] + "z" + line[at + 1 :]]
        if n >= 12:
            w[n // 2] = "other"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    norms = [" ".join(line_dedup.line_words(t)) for t in texts]
    parent = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if line_dedup.edit_similar(norms[a], norms[b], 90):
            x, y = sorted((parent[a], parent[b]))
            parent = [x if p == y else p for p in parent]
    out = {r["doc_id"]: r["n_dropped"] for r in line_dedup.repeated_lines(docs_of(spark, texts)).collect()}
    assert out == {i: int(p != i) for i, p in enumerate(parent)} and sum(out.values()) > 20


def edited(rng, text, changes, letters="abc"):
    b = list(text)
    for _ in range(changes):
        at = rng.randrange(len(b))
        b[at : at + rng.randint(0, 1)] = rng.choice(("", rng.choice(letters), rng.choice(letters)))
    return "".join(b)


def test_short_lines_share_a_piece():
    """Every pair of similar lines below SHORT characters has a key in common, whatever the edits."""
    rng = random.Random(12)
    for _ in range(3000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(10, 39)))
        b = edited(rng, a, rng.randint(1, len(a) // 10))
        if line_dedup.edit_similar(a, b, 90) and max(len(a), len(b)) < line_dedup.SHORT and a != b:
            assert line_dedup.piece_keys(a, 90) & line_dedup.piece_keys(b, 90), (a, b)


def line_signatures(norms):
    codes, lengths = line_dedup.normalised(norms)
    starts = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    grams = line_dedup.window_hashes(codes)
    keys = [{} for _ in norms]
    for k, key, place in zip(*(x.tolist() for x in line_dedup.line_keys(codes, starts, lengths, 90, grams))):
        keys[k][key] = np.uint64(place << 12)
    tail = np.concatenate([grams[4], line_dedup.mix(codes[len(grams[4]) :].astype(np.uint64), 6)])
    return keys, line_dedup.signatures(tail, starts, lengths)


@pytest.mark.parametrize("low, high", [(12, 40), (36, 48), (40, 80), (72, 90), (90, 250), (250, 700), (2000, 4000)])
def test_recall_of_the_line_search(low, high):
    """Of the pairs that brute-force edit similarity links, the search finds 0.9 at ten edits in a hundred characters and nearly all at five."""
    rng = random.Random(low)
    for per_hundred, least in ((1, 0.995), (5, 0.98), (10, 0.9)):
        lines = ["".join(rng.choice("abcdefghijklmno ") for _ in range(rng.randint(low, high))).strip() for _ in range(300)]
        lines = [" ".join(x.split()) for x in lines]
        pairs = [(a, b) for a in lines for b in [" ".join(edited(rng, a, max(1, len(a) * per_hundred // 100)).split())] if a != b and line_dedup.edit_similar(a, b, 90)]
        (ka, sa), (kb, sb) = (line_signatures(list(x)) for x in zip(*pairs))
        found = [any(line_dedup.alike(a | x[k], b | y[k], 90) for k in x.keys() & y.keys()) for x, y, a, b in zip(ka, kb, sa, sb)]
        assert len(pairs) > 100 and np.mean(found) >= least, per_hundred


def test_the_line_filter_is_exact():
    rng = random.Random(13)
    for n in (3, 20, 90, 900):
        a = ["".join(rng.choice("abcd ") for _ in range(n)) for _ in range(60)]
        b = [edited(rng, x, rng.randint(0, max(1, n // 9))) for x in a]
        ok = line_dedup._may_be_similar(line_dedup._gram_counts(a), line_dedup._gram_counts(b), np.array([max(len(x), len(y)) for x, y in zip(a, b)]), 90)
        assert all(ok[k] for k in range(60) if line_dedup.edit_similar(a[k], b[k], 90))


def test_normalised_lines_equal_the_plain_ones():
    texts = ["", "  ", "12 34 ab_c", "É x½ 7", " a  b  ", "ΑΣ 1a2b", "----", "İx ǅ", "١٢ a", "x" * 3000]
    codes, lengths = line_dedup.normalised(texts)
    at = np.r_[0, np.cumsum(lengths + 1)]
    assert [codes[s : s + n].astype("<u4").tobytes().decode("utf-32-le") for s, n in zip(at, lengths)] == [" ".join(line_dedup.line_words(x)) for x in texts]


def test_line_dedup_edges(spark):
    """String ids, repeated rows, clashing columns, very long lines, large buckets and empty tables."""
    rng = random.Random(16)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))
    long, base = text(20_000), text(30)
    group = [base[:k] + "z" + base[k + 1 :] for k in rng.sample(range(len(base)), 40)]
    rows = [("b", long, 1, "x", "y"), ("c", long[:900] + "q" + long[901:], 2, "x", "y"), ("a", "kept\n" + text(12), 3, "x", None), ("a", "kept\n" + text(12), 3, "x", None), (None, long, 4, None, None)]
    rows += [(f"g{k:02}", x, 5, "x", "y") for k, x in enumerate(group)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n_chars long, dropped string, row string")
    old = line_dedup.SMALL, line_dedup.BLOCK, line_dedup.HELD
    for line_dedup.SMALL, line_dedup.BLOCK, line_dedup.HELD in (old, (4, 8, 1024), (4, 8, 10)):
        out = {r["doc_id"]: r["dropped"] for r in line_dedup.repeated_lines(docs).collect()}
        assert out == {"a": [], "b": [], "c": [0], "g00": []} | {f"g{k:02}": [0] for k in range(1, 40)}
    line_dedup.SMALL, line_dedup.BLOCK, line_dedup.HELD = old
    new = line_dedup.drop_repeated_lines(docs)
    assert new.columns == docs.columns and sorted((r["doc_id"] or "", r["dropped"] or "", r["row"] or "") for r in new.collect()) == [("", "", ""), ("a", "x", ""), ("a", "x", ""), ("b", "x", "y"), ("g00", "x", "y")]
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0 and line_dedup.repeated_lines(docs_of(spark, ["a b"]).limit(0)).count() == 0


def test_html_wrappers_keep_the_article():
    """A mark on what wraps the content hides nothing; marks beside it still do."""
    w = html_text.tag_weights(Counter())
    body = " ".join(f"word{i}" for i in range(40))
    for wrap in ("div class='site has-sidebar'", "div id=content class='no-comments'", "section class=commentary", "div class='with-widget'", "div class='sidebar'", "form id=aspnet", "div role=form", "nav"):
        name = wrap.split()[0]
        for inner in (f"<article><p>{body}</p></article>", f"<main><p>{body}</p></main>") + ((f"<p>{body}</p>",) if name != "nav" else ()):
            page = f"<body><{wrap}>{inner}</{name}><div class='ad'>buy this</div><footer>me</footer></body>"
            assert html_text.main_text(page, w) == body, (wrap, inner)
    thread = "".join(f"<article class=comment-body>{body}</article>" for _ in range(3))
    assert html_text.main_text(f"<article><p>{body}</p></article><div id=comments>{thread}</div>", w) == body
    assert html_text.main_text(f"<article><p>{body}</p></article><div hidden>{body}</div><aside>Side</aside>", w) == body


def test_licence_blocks(spark):
    """Wrapped headers and whole licence files are compared as one, in comments and without a title line."""
    import textwrap

    full = {name: text for name, text in licenses.BLOCKS if len(text) > 150}
    wrap = lambda text, mark="": "\n".join(mark + x for x in textwrap.wrap(text, 60))
    rows = [(k, f"h{k}.py", f"{mark}Copyright (C) 2020 A. Person\n{mark}\n{wrap(text, mark)}\n\nimport os\nx = 1\n") for k, (text, mark) in enumerate((t, m) for t in full.values() for m in ("# ", " * ", "// "))]
    want = {k: name for k, name in enumerate(n for n in full for _ in range(3))}
    titles = {100: ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Preamble\n"), 101: ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nmore"), 102: ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nmore"), 103: ("BSD-3-Clause", "Copyright 2020 X\n\n" + wrap(full["BSD-3-Clause"])), 104: ("BSD-2-Clause", "Copyright 2020 X\n\n" + wrap(full["BSD-2-Clause"]))}
    for k, (name, text) in titles.items():
        rows += [(k, f"d{k}/LICENSE", text), (k + 100, f"d{k}/a/b.py", "x = 1")]
        want |= {k: name, k + 100: name}
    for k, (name, counts) in enumerate(licenses.FULL_TEXTS):
        words = counts.split()
        rows.append((300 + k, f"e{k}/COPYING", wrap(" ".join(" ".join([t] * int(n)) for t, n in zip(words[::2], words[1::2])))))
        want[300 + k] = name
    out = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert out == {k: (name, "inherited" if 200 <= k < 300 else "own") for k, name in want.items()}


def test_quality_filter_with_few_labels(spark):
    """Joint cutoffs hold in strata that the separate tests leave without a rule."""
    rng = random.Random(13)
    texts, labels, langs = [], [], []
    for i in range(1000):
        bad = i % 4 == 0
        texts.append(" ".join(f"{rng.randrange(10**6)}word" + "%%%" * bad for _ in range(60)))
        labels.append((i, 0 if bad else 1))
        langs.append("en" if i < 900 else None)
    docs, marks = docs_of(spark, texts, langs), spark.createDataFrame(labels, "doc_id long, quality int")
    joint = {r["stratum"]: (r["n_docs"], r["n_cutoffs"] > 0) for r in quality.strata_report(docs, marks, joint=True).collect()}
    assert joint == {"en": (900, True), None: (100, False)}
    assert all(r["n_cutoffs"] == 0 for r in quality.strata_report(docs, marks).collect())
    kept = {r["doc_id"] for r in quality.quality_filter(docs, marks).collect()}
    good = {i for i in range(900) if i % 4}
    assert not any(i % 4 == 0 for i in kept if i < 900) and len(good - kept) <= 0.05 * len(good) and set(range(900, 1000)) <= kept


def test_contamination_by_short_items():
    """Items of five words on are found in every document that holds them."""
    rng = random.Random(14)
    items = [words(rng, 5 + k % 9, 10**6) for k in range(45)]
    index = decontaminate.ItemIndex(list(range(45)), [decontaminate.text_shingles(x, 5) for x in items], 80)
    for _ in range(20):
        text = " . ".join(y for x in items for y in (words(rng, rng.randint(3, 60), 10**6), x))
        assert [i for i, *_ in index.verified(text, 5, 80)] == list(range(45))


def test_pipeline_equals_plain_python(spark, tokenizer, tmp_path):
    """run() against brute-force stages on planted junk, copies, shared lines and benchmark passages."""
    import corpus_pipeline

    rng = random.Random(15)
    line = lambda n=25: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))
    texts = ["\n".join(line() for _ in range(3)) for _ in range(12)]
    item = line(20)
    near = texts[0].split("\n")[1]
    texts.append(f"{line()}\n{near[:40]}q{near[41:]}\n{line(40)}")
    w = texts[2].split()
    texts += [" ".join(w[:37]) + "\n" + " ".join(w[37:]), texts[3], f"{line(30)} {item} {line(30)}\n{line()}", "too short", "a b c " * 40, None]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, line(20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def fine(t):
        w = t.split()
        at = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {p + k for p in range(len(w) - 2) if at[tuple(w[p : p + 3])] > 1 for k in range(3)}
        return len(w) >= 50 and 2 * len(covered) <= len(w)

    left = {i: t for i, t in enumerate(texts) if t and fine(t)}
    quality_left = set(left)
    seen, cut = [], {}
    for i, t in left.items():  # groups here are pairs: a line goes if an earlier one is like it
        keep = []
        for x in t.split("\n"):
            norm = " ".join(line_dedup.line_words(x))
            if not any(line_dedup.edit_similar(norm, y, 90) for y in seen):
                keep.append(x)
            seen.append(norm)
        if keep:
            cut[i] = "\n".join(keep)
    assert set(cut) < quality_left and cut[12] != texts[12]
    apart = {}
    for i, t in cut.items():
        s = shingles(t, 5)
        if not any(100 * len(s & shingles(y, 5)) >= 80 * len(s | shingles(y, 5)) for y in apart.values()):
            apart[i] = t
    grams = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(len(w) - 4)}
    clean = {i: t for i, t in apart.items() if 100 * len(grams(item) & grams(t)) < 80 * len(grams(item))}
    assert set(cut) - set(apart) == {13} and set(apart) - set(clean) == {15}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total = Counter()
    for r in out:
        total[r["doc_id"]] += r["length"]
    assert total == {i: len(tokenizer[1].encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    for _, rows in itertools.groupby(sorted(out, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        rows = list(rows)
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:k]) for k in range(len(rows))]


def test_pair_counts_are_an_exact_filter():
    rng = random.Random(18)
    for n in (1, 12, 90, 700):
        a = ["".join(rng.choice("abcde ") for _ in range(n)).strip() or "a" for _ in range(60)]
        a = [" ".join(x.split()) for x in a]
        b = [" ".join(edited(rng, x, rng.randint(0, max(1, n // 9))).split()) or "b" for x in a]
        counts = []
        for side in (a, b):
            codes, lengths = line_dedup.normalised(side)
            counts.append(line_dedup.pair_counts(codes, np.r_[0, np.cumsum(lengths + 1)[:-1]], lengths))
        ok = line_dedup._pairs_allow(*counts, np.array([max(len(x), len(y)) for x, y in zip(a, b)]), 90)
        assert all(ok[k] for k in range(60) if line_dedup.edit_similar(a[k], b[k], 90))


def test_line_pairs_are_compared_side_by_side():
    """Bands of one number and of several say what full edit distance says, for any mix of lengths and letters."""
    import random

    from tessera.llm import line_dedup as LD

    rnd, a, b = random.Random(5), [], []
    for n in (1, 2, 9, 10, 11, 39, 64, 65, 200, 319, 320, 321, 639, 640, 1300, 2600) * 12:
        letters = rnd.choice(("ab", "abcdefgh ij", "αβγ δé", "".join(map(chr, range(0x4E00, 0x5000)))))
        line = [rnd.choice(letters) for _ in range(n)]
        a.append("".join(line))
        for _ in range(int(n * rnd.choice((0, 0.05, 0.09, 0.1, 0.11, 0.3))) + rnd.randrange(2)):
            at = rnd.randrange(len(line))
            line[at : at + rnd.randrange(2)] = rnd.choice(("", rnd.choice(letters))) if len(line) > 1 else rnd.choice(letters)
        b.append("".join(line))
    for percent in (90, 80, 100):
        most = [(100 - percent) * max(len(x), len(y)) // 100 for x, y in zip(a, b)]
        assert LD.all_edit_similar(a, b, percent).tolist() == [LD._levenshtein(*sorted((x, y), key=len)) <= k for x, y, k in zip(a, b, most)]


def both_signatures(norms):
    codes, lengths = line_dedup.normalised(norms)
    starts, grams = np.r_[0, np.cumsum(lengths + 1)[:-1]], line_dedup.window_hashes(codes)
    tail = np.concatenate([grams[4], line_dedup.mix(codes[len(grams[4]) :].astype(np.uint64), 6)])
    return line_dedup.signatures(tail, starts, lengths), line_dedup.second_signatures(codes, tail, starts, lengths)


@pytest.mark.parametrize("low, high, least", [(12, 80, 0.99), (72, 90, 0.97), (90, 250, 0.96), (250, 700, 0.95), (700, 3000, 0.9)])
def test_second_signatures_keep_similar_lines(low, high, least):
    """Counts miss no similar line, and both SimHashes few at ten edits in a hundred characters."""
    rng = random.Random(high)
    lines = [" ".join("".join(rng.choice("abcdefghijklmno ") for _ in range(rng.randint(low, high))).split()) for _ in range(400)]
    pairs = [(a, b) for a in lines for b in [" ".join(edited(rng, a, max(1, len(a) // 10)).split())] if line_dedup.edit_similar(a, b, 90)]
    (sa, ma), (sb, mb) = (both_signatures(list(x)) for x in zip(*pairs))
    assert len(pairs) > 150 and np.mean(line_dedup.alike(sa, sb, 90, ma, mb)) >= least
    short = np.array([max(map(len, x)) < line_dedup.LONG for x in pairs])
    assert (np.bitwise_count(ma ^ mb)[short] <= 2 * np.array([max(map(len, x)) // 10 for x in pairs])[short]).all()


@pytest.mark.parametrize("low, high, most", [(40, 80, 0.2), (250, 400, 0.2)])
def test_lines_that_meet_by_chance_leave_their_bucket(low, high, most):
    """Of lines that share a window and nothing else, few pairs go further; the same with SQL's conditions as in the bucket."""
    rng = random.Random(low)
    lines = [" ".join("".join(rng.choice("abcdefghijklmno ") for _ in range(rng.randint(low, high))).split()) for _ in range(24)]
    lines += [lines[0][:-1] + "z", lines[1][:-1] + "z"]
    sig, more = both_signatures(lines)
    node = np.arange(len(lines))
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(lines), np.int64)), pa.array(node), pa.array(sig.view(np.int64)), pa.array(more.view(np.int64))], ["key", "h1", "sig", "more"])
    out = [n for b in line_dedup._buckets(90)([rows]) for n in b.column(1).to_pylist()]
    assert {0, 1, 24, 25} <= set(out) and len(out) <= 4 + most * len(lines)


def test_signatures_agree_in_sql(spark):
    rng = random.Random(21)
    lines = [" ".join("".join(rng.choice("abcde ") for _ in range(n)).split()) for n in (9, 45, 74, 79, 82, 120, 300, 700) for _ in range(6)]
    lines += [edited(rng, x, rng.randint(1, 1 + len(x) // 8), "abcde") or "a" for x in lines]
    sig, more = (x.view(np.int64) for x in both_signatures(lines))
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(zip(sig.tolist(), more.tolist()))], "node int, sig long, more long")
    near = rows.alias("x").join(rows.alias("y")).where(line_dedup._close(90)).selectExpr("x.node as a", "y.node as b").collect()
    u, v = sig.view(np.uint64), more.view(np.uint64)
    ok = line_dedup.alike(u[:, None], u[None, :], 90, v[:, None], v[None, :])
    assert {(r["a"], r["b"]) for r in near} == set(zip(*(x.tolist() for x in np.nonzero(ok)))) and len(near) > 2 * len(lines) - len(lines) // 2


def test_rows_of_a_block_stay_in_the_lowest_bucket():
    """Two similar lines that meet in two buckets are rows of one of them, before any text is fetched."""
    import pyarrow as pa

    sig, more = (np.repeat(x.view(np.int64), 2) for x in both_signatures(["abcdefg " * 12]))
    names = ["key", "a", "b", "side", "node", "root", "sig", "more", "keys"]
    zero = np.zeros(2, np.int32)
    blocks = [pa.RecordBatch.from_arrays([pa.array(np.full(2, key)), *map(pa.array, (zero, zero, zero)), pa.array([1, 2]), pa.array([1, 2]), pa.array(sig), pa.array(more), pa.array([[7, 5], [5, 7, 9]])], names) for key in (5, 7)]
    out = [x for b in line_dedup._alike(90)(blocks) for x in zip(b.column(0).to_pylist(), b.column(4).to_pylist())]
    assert out == [(5, 1), (5, 2)]
