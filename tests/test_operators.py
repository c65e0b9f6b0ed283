"""Ranking, answers, metrics and the limiter against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import answer as A, index as I, metrics as M, retrieve as R
from tessera.sources import files as S
from tessera.streaming import limiter as L


def test_bm25_fills_with_zero_scores(spark):
    docs = spark.createDataFrame([(1, "insurance float"), (2, "weather"), (3, "float float"), (4, ""), (5, "x"), (6, "y")], "id long, text string")
    best = I.bm25_topk(I.build_bm25(docs, "id", "text"), spark.createDataFrame([(0, "float"), (1, "")], "qid int, query string"), 4).collect()
    assert [r["id"] for r in sorted(best, key=lambda r: r["rank"])] == [3, 1, 2, 4]


def test_vectors_match_numpy(spark):
    r = np.random.default_rng(0)
    m = r.normal(size=(60, 8))
    m[5] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>")
    found = I.vector_topk(df, df.where("id < 3").select(F.col("id").alias("qid"), F.col("embedding").alias("vec")), 4).collect()
    u = m / np.where(np.linalg.norm(m, axis=1) == 0, 1, np.linalg.norm(m, axis=1))[:, None]
    for q in range(3):
        s = np.round(u @ u[q], 12)
        assert [x["id"] for x in sorted((x for x in found if x["qid"] == q), key=lambda x: x["rank"])] == sorted(range(60), key=lambda i: (-s[i], i))[:4]
    with pytest.raises(Exception, match="expected 9 dimensions"):
        I.check_width(df, 9).collect()


def test_rrf_and_repeats(spark):
    ranks = spark.createDataFrame([(0, 0, "a", 0), (0, 0, "b", 1), (0, 1, "b", 0), (0, 1, "c", 1)], "qid int, src int, id string, rank int")
    assert [r["id"] for r in R.rrf(ranks, 3).orderBy("rank").collect()] == ["b", "a", "c"]
    words = [f"w{i}" for i in range(20)]
    hits = [(0, 0, "a", 1.0, " ".join(words)), (0, 1, "b", 0.9, " ".join(words[:19])), (0, 2, "c", 0.8, "other text"), (0, 3, "d", 0.7, ""), (0, 4, "e", 0.6, "")]
    kept = R.drop_repeats(spark.createDataFrame(hits, "qid int, rank int, id string, score double, text string"))
    assert [r["id"] for r in kept.orderBy("rank").collect()] == ["a", "c", "d", "e"]
    assert R.effective_strategy("hybrid", True) == "hybrid_multi"
    with pytest.raises(ValueError):
        R.effective_strategy("best", False)


def test_minmax(spark):
    raw = spark.createDataFrame([(0, "a", 1.0), (0, "b", 3.0), (1, "c", 2.0)], "qid int, id string, raw double")
    assert {(r["id"], r["score"]) for r in R.minmax_rerank(raw, 5).collect()} == {("a", 0.0), ("b", 1.0), ("c", 1.0)}


def test_context_budget(spark):
    df = spark.createDataFrame([(["bbbb"], "cccc", ["aaaa"])], "b array<string>, c string, a array<string>")
    text = lambda n: df.select(A.compose_context(F.col("b"), F.col("c"), F.col("a"), n).alias("x")).first()["x"]
    assert text(7) == "b\n\ncccc\n\naa" and text(5) == "cccc\n\na" and text(3) == "ccc" and text(100) == "bbbb\n\ncccc\n\naaaa"


def test_faithfulness(spark):
    answers = spark.createDataFrame([(0, "The cat sat here [1]. Nothing else is known. Bad one [9]."), (1, "")], "qid int, answer string")
    hits = spark.createDataFrame([(0, 0, "the cat sat"), (1, 0, "x")], "qid int, rank int, text string")
    r = {x["qid"]: x for x in A.faithfulness(answers, hits).collect()}
    assert r[0]["n_sentences"] == 3 and r[0]["n_cited"] == 1 and r[0]["invalid_citation_rate"] == 0.5
    assert abs(r[0]["mean_support"] - 2 / 4) < 1e-9 and r[1]["citation_coverage"] == 0.0


def test_extractive_answer(spark):
    text = "Insurance float grew to a very large amount this year. The weather was fine and nothing else happened then."
    q = spark.createDataFrame([(0, "How did insurance float grow?"), (1, "of the")], "qid int, query string")
    hits = spark.createDataFrame([(0, 0, text), (1, 0, text)], "qid int, rank int, text string")
    r = {x["qid"]: x["answer"] for x in A.extractive_answers(q, hits).collect()}
    assert r[0] == "Insurance float grew to a very large amount this year. [1]" and r[1] == A.REFUSAL


def test_rate_limit_matches_a_loop(spark):
    r = np.random.default_rng(1)
    rows = [(f"k{r.integers(4)}", float(r.integers(0, 300))) for _ in range(400)]
    want = {}
    for k in {k for k, _ in rows}:
        reset, count, denied, windows = float("-inf"), 0, 0, 0
        for t in sorted(t for x, t in rows if x == k):
            if t >= reset:
                reset, count, windows = t + 60, 0, windows + 1
            count += 1
            denied += count > 3
        want[k] = (denied, windows)
    found = M.rate_limit(spark.createDataFrame(rows, "key string, at double"), 3, 60.0).collect()
    assert {x["key"]: (x["denied"], x["windows"]) for x in found} == want


def test_limiter_state():
    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

    import pandas as pd

    p = L.AnchoredWindow(1, 60)
    p.state = Value()
    run = lambda *t: list(pd.concat(p.handleInputRows(("k",), iter([pd.DataFrame({"at": t})]), None)).allowed)
    assert run(0.0, 10.0) == [True, False] and run(59.0, 60.0) == [False, True]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "letter_1978.txt").write_text("Second letter.\n" * 80)
    (tmp_path / "in" / "letter_1977.txt").write_bytes("naïve first letter".encode("latin-1"))
    (tmp_path / "in" / "notes.txt").write_text("no year")
    from tessera.operators import chunk as C

    letters = S.read_letters(spark, str(tmp_path / "in"))
    assert [r["year"] for r in letters.collect()] == [1977, 1978]
    chunks = C.chunk_table(letters, C.recursive_chunks(letters, F.col("text")))
    S.write_chunks(chunks, str(tmp_path / "out"), one_file=True)
    back = S.read_chunks(spark, str(tmp_path / "out"))
    assert back.count() == chunks.count() and back.where("year = 1977").first()["text"] == "naïve first letter"
    meta = S.run_metadata(letters, chunks, size=800, overlap=120, least=160).first()
    assert meta["total_letters"] == 2 and meta["year_range"] == [1977, 1978]
    assert S.newest(str(tmp_path / "none"), str(tmp_path / "out"), spark=spark).endswith("out")


def test_upsert_keeps_last(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, at int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, at int")
    assert {(r["id"], r["v"]) for r in I.upsert(old, new, "id", "at").collect()} == {(1, "a"), (2, "d"), (3, "e")}


def test_next_ids_in_many_tasks(spark):
    """Every id meets the next one, over gaps and repeats, and no task has them all."""
    from pyspark.sql import functions as F

    from tessera.plans.retrieval import _next_ids

    ids = sorted([-5, 0, 1, 1, 3, 4, 9, 16, 17, 40, 41, 1000, 1001])
    found = _next_ids(spark.createDataFrame([(i,) for i in ids], "doc_id long"), span=4)
    assert sorted((r["doc_id"], r["pair"]) for r in found.collect() if r["pair"] is not None) + [(ids[-1], None)] == list(zip(ids, [*ids[1:], None]))
    many = _next_ids(spark.range(20000).select(F.col("id").alias("doc_id")))
    assert many.where("pair = doc_id + 1").count() == 19999 and many.where("pair is null").count() == 1


def test_hybrid_multi_fuses_sources_in_each_period(spark):
    """Comparing questions rank vectors and BM25 in every period; the others are plain hybrid."""
    years = spark.createDataFrame([(i, 1980 + 10 * (i % 2)) for i in range(12)], "id int, year int")
    rng = np.random.default_rng(4)
    vector, lexical = ([(q, i, float(rng.random())) for q in (0, 1) for i in range(12)] for _ in range(2))
    df = lambda rows: spark.createDataFrame(rows, "qid int, id int, score double")
    ranges = spark.createDataFrame([(0, None, None), (1, None, None)], "qid int, lo int, hi int")
    periods = spark.createDataFrame([(0, 0, 1980, 1989), (0, 1, 1990, 1999)], "qid int, period int, lo int, hi int")

    def fused(rankings, k):
        score, seen = {}, {}
        for src, ids in enumerate(rankings):
            for rank, i in enumerate(ids):
                score[i] = score.get(i, 0.0) + 1 / (R.RRF_K + rank + 1)
                seen.setdefault(i, (src, rank))
        return sorted(score, key=lambda i: (-round(score[i], 12), seen[i], i))[:k]

    best = lambda rows, year: [i for _, i, _ in sorted((r for r in rows if r[0] == 0 and year in (None, 1980 + 10 * (r[1] % 2))), key=lambda r: -r[2])][:4]
    want = fused([fused([best(vector, y), best(lexical, y)], 4) for y in (1980, 1990)], 5)
    plain = {(r["qid"], r["rank"]): r["id"] for r in R.search("hybrid", df(vector), df(lexical), years, ranges, 5, 4).collect()}
    for strategy in ("hybrid_multi", "hybrid"):
        out = {(r["qid"], r["rank"]): r["id"] for r in R.search(strategy, df(vector), df(lexical), years, ranges, 5, 4, periods).collect()}
        assert [out[0, k] for k in range(5)] == want
        assert {k: i for k, i in out.items() if k[0] == 1} == {k: i for k, i in plain.items() if k[0] == 1}
