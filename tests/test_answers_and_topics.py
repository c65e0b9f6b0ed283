"""Context of hits, reranking, answers that fail, topics and filters as data, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import query as Q, text as T
from tessera.operators import answer as A, metrics as M, retrieve as R, topics as K


def test_hits_keep_score_and_title(spark):
    """Three hops, a circle of links, a missing neighbour, a hit that is no chunk."""
    rows = [(f"c{i}", f"t{i}", f"c{i - 1}" if i else None, f"c{i + 1}" if i < 9 else "gone", f"T{i}" if i % 2 else None) for i in range(10)]
    rows += [("r0", "x", "r1", "r1", None), ("r1", "y", "r0", "r0", None)]
    chunks = spark.createDataFrame(rows, "id string, text string, previous_chunk_id string, next_chunk_id string, section_title string")
    hits = spark.createDataFrame([(0, 0, "c5", 0.9, "old", "mine"), (0, 1, "c9", 0.8, "old", None), (1, 0, "r0", 0.7, "old", None), (1, 1, "zz", 0.6, "kept", None), (1, 2, "c5", 0.5, "old", None)], "qid int, rank int, id string, score double, text string, section_title string")
    got = {(r["qid"], r["rank"]): tuple(r)[2:] for r in A.expand_hits(hits, chunks, hops=3, most=1000).collect()}
    join = "\n\n".join
    assert got == {
        (0, 0): ("c5", 0.9, join(f"t{i}" for i in range(2, 9)), "mine", True),
        (0, 1): ("c9", 0.8, join(f"t{i}" for i in range(6, 10)), "T9", True),
        (1, 0): ("r0", 0.7, join("yxy"), "", True),
        (1, 1): ("zz", 0.6, "kept", None, False),
        (1, 2): ("c5", 0.5, join(f"t{i}" for i in range(2, 9)), "T5", True),
    }
    plain = {(r["qid"], r["rank"]): (r["text"], r["section_title"], r["expanded"]) for r in A.expand_hits(hits.drop("section_title"), chunks, hops=0).collect()}
    assert plain[0, 0] == ("old", None, False) and len(plain) == 5


def smallest_window(asked, toks):
    have = set(asked) & set(toks)
    if not have:
        return 0.0
    best = min(j - i + 1 for i in range(len(toks)) for j in range(i, len(toks)) if have <= set(toks[i : j + 1]))
    return len(have) + 1 / best


def test_smallest_window(spark):
    rng = random.Random(1)
    rows = [(q, d, " ".join(rng.choices("abcdef", k=rng.randrange(0, 4))), " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 15)))) for q in range(5) for d in range(12)]
    rows = [(q, d, next(x[2] for x in rows if x[0] == q), t) for q, d, _, t in rows] + [(9, 0, "a b", None)]
    found = {(r["qid"], r["id"]): round(r["raw"], 9) for r in R.window_scores(spark.createDataFrame(rows, "qid int, id int, query string, text string")).collect()}
    assert found == {(q, d): round(smallest_window(a.split(), (t or "").split()), 9) for q, d, a, t in rows}


def test_model_scores_return_to_their_rows(spark):
    """Calls get pairs of like length; ranks do not depend on how they were batched."""
    rows = [(0, i, "q", "x" * (i * 7 % 50)) for i in range(50)] + [(1, 0, "q", None)]
    hits = spark.createDataFrame(rows, "qid int, id int, query string, text string").repartition(3)

    def model(queries, texts):
        assert len(queries) == len(texts) <= 8 and max(map(len, texts)) - min(map(len, texts)) <= 30
        return [len(t) - len(q) for q, t in zip(queries, texts)]

    best = R.rerank_by(hits, R.batched_scorer(model, 8), 5).orderBy("qid", "rank").collect()
    assert [r["id"] for r in best if r["qid"] == 0] == sorted(range(50), key=lambda i: (-(i * 7 % 50), i))[:5]
    assert [(r["id"], r["score"]) for r in best if r["qid"] == 1] == [(0, 1.0)]


def test_failed_answers_are_kept_and_tried_again(spark, tmp_path):
    """A failing question yields its error, the others their scores; only failed rows are asked again."""
    log = tmp_path / "calls"
    log.mkdir()

    def provider(prompt):
        import os
        import uuid

        calls = len([f for f in os.listdir(log) if f.startswith(prompt[:2])])
        (log / f"{prompt[:2]}-{uuid.uuid4().hex}").touch()
        if prompt.startswith("p1") or (prompt.startswith("p2") and not calls):
            raise ValueError("busy " + "x" * 400)
        return "The cat sat here [1]. Unknown [7]."

    prompts = spark.createDataFrame([(0, "p0"), (1, "p1"), (2, "p2")], "qid int, prompt string")
    answers = A.answer_all(prompts, provider, tries=3)
    told = {r["qid"]: (r["answer"] is None, r["error"], r["tries"]) for r in answers.collect()}
    assert told[0] == (False, None, 1) and told[2] == (False, None, 2) and told[1][0] and told[1][1].startswith("ValueError: busy") and len(told[1][1]) == 300 and told[1][2] == 3
    assert sorted(f.name[:2] for f in log.iterdir()) == ["p0", "p1", "p1", "p1", "p2", "p2"]
    hits = spark.createDataFrame([(q, 0, "the cat sat") for q in range(3)], "qid int, rank int, text string")
    gold = spark.createDataFrame([(0, ["cat", "dog"]), (1, ["cat"]), (2, [])], "qid int, answer_keywords array<string>")
    rows = {r["qid"]: r for r in A.evaluate_answers(answers, hits, gold).collect()}
    assert rows[0]["keyword_rate"] == 0.5 and rows[0]["citation_coverage"] == 0.5 and rows[0]["invalid_citation_rate"] == 0.5
    assert rows[1]["keyword_rate"] is None and rows[1]["n_sentences"] is None and rows[1]["error"].startswith("ValueError")
    assert rows[2]["keyword_rate"] is None and rows[2]["n_sentences"] == 2


TAXONOMY = {"money": ("cash", "Cash Flow", "flow"), "risk": ("risk", "s&p 500", "float"), "none": ("zebra",)}


def plain_hits(text, topics):
    out = {}
    for i, (t, keys) in enumerate(topics.items()):
        n = len(re.findall(r"(?<!\w)(?:" + "|".join(map(re.escape, keys)) + r")(?!\w)", text or "", re.I))
        if n:
            out[t] = (i, n)
    return out


def test_keyword_hits_match_a_pattern(spark):
    """The leftmost keyword counts, hits do not overlap, and words are whole, beside accents too."""
    rng = random.Random(8)
    parts = ["cash", "Cash flow", "cash  flow", "flow", "flows", "S&P 500", "s & p 500", "risk", "risky", "café", "risé", "x", ",", ". ", "_risk", "float"]
    texts = [None, "", "..."] + [" ".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(120)] + ["cash flow " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = K.keyword_table(spark, TAXONOMY)
    found = {}
    for r in K.keyword_hits(docs, keys).collect():
        found.setdefault(r["id"], {})[r["topic"]] = (r["place"], r["hits"])
    want = {i: plain_hits(t, TAXONOMY) for i, t in enumerate(texts)}
    assert found == {i: w for i, w in want.items() if w}
    tags = {r["id"]: r["topics"] for r in K.topics_of(docs, keys, 1).collect()}
    assert tags == {i: [t for t, _ in sorted(w.items(), key=lambda x: (-x[1][1], x[1][0]))][:1] for i, w in want.items()}


def test_conditions_as_data(spark):
    rows = [("year", "$eq", False), ("year", "$in", False), ("year", "$in", True), ("colour", "$eq", True), ("topics", "$ne", True), (None, None, None)]
    df = spark.createDataFrame(rows, "f string, o string, l boolean")
    faults = [r[0] for r in df.select(Q.filter_fault(F.col("f"), F.col("o"), F.col("l"))).collect()]
    assert faults[0] is None and faults[2] is None and all(faults[k] for k in (1, 3, 4, 5))
    names = ["ok", "_9", "9", "a" * 63, "a" * 64, "a\n", "", None]
    out = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(Q.identifier_ok(F.col("n"))).collect()]
    assert out == [True, True, False, True, False, False, False, False]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Points: 1. a, 2. b", "Points: 1. a\n\n2. b"),
        ("x\n- a\n- b\ny", "x\n\n- a\n\n- b\n\ny"),
        ("1. a\n\n2. b\nend", "1. a\n\n2. b\n\nend"),
        ("in 3, 4. May", "in 3, 4. May"),
        ("no list\nat all", "no list\nat all"),
        ("z, 1. a, 2. b, 3. c", "z\n\n1. a\n\n2. b\n\n3. c"),
        ("", ""),
    ],
)
def test_lists_stand_alone(spark, given, want):
    assert spark.createDataFrame([(given,)], "c string").select(T.format_list(F.col("c"))).first()[0] == want


def test_best_of_each_slot_of_vectors(spark):
    from tessera.operators import index as I

    rows = [(i, [1.0, i / 20], i % 3 if i else None) for i in range(20)]
    own = spark.createDataFrame(rows, "id int, embedding array<double>, s int").repartition(3)
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "qid int, vec array<double>")
    got = sorted((r["slot"], r["rank"], r["id"]) for r in I.vector_topk(own, asked, 2, slot_col="s").collect())
    assert got == [(0, 0, 3), (0, 1, 6), (1, 0, 1), (1, 1, 4), (2, 0, 2), (2, 1, 5)]


def test_totals_of_verdicts(spark):
    rows = [("a", float(t)) for t in (0, 1, 2, 60, 61)] + [("b", 5.0)]
    got = {r["key"]: (r["n"], r["denied"], r["windows"]) for r in M.rate_limit(spark.createDataFrame(rows, "key string, at double"), 2, 60.0).collect()}
    assert got == {"a": (5, 1, 2), "b": (1, 0, 1)}
