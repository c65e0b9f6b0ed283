"""Embedding, approximate search and repeated pairs against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import embed as E, index as I, retrieve as R

SF = "/root/testdata/sf0.001"


def unit(text):
    v = np.array([text.lower().count(chr(97 + k)) for k in range(26)], float)
    return v / (np.linalg.norm(v) or 1)


def test_embeddings(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["abc", "", None, "zz top"] + ["x" * k for k in range(1, 150)])], "id int, text string")
    out = {r["id"]: r["v"] for r in df.select("id", E.embed(df, F.col("text"), E.letter_counts, prefix="q").alias("v")).collect()}
    assert out[2] is None and len(out) == 153
    for i, t in ((0, "qabc"), (1, "q"), (3, "qzz top"), (100, "q" + "x" * 97)):
        assert np.allclose(out[i], unit(t), atol=1e-6)
    plain = E.embed(df.limit(0), F.col("text"), E.letter_counts)
    assert df.limit(0).select(plain).count() == 0
    with pytest.raises(ValueError):
        E.Encoders(small=E.letter_counts)["large"]
    assert entry.queries()["emb_doc"](spark, SF).count() == 200 and entry.queries()["emb_query"](spark, SF).where("size(vec) = 26").count() == 40


def test_approximate_search_finds_nine_of_ten(spark):
    sf = "/root/testdata/sf0.1"
    exact, near = ({(r["qid"], r["id"]) for r in entry.queries()[q](spark, sf).collect()} for q in ("vec_topk", "vec_ann"))
    assert len(near) == len(exact) and len(exact & near) >= 0.9 * len(exact)


def test_exact_search_with_ties_and_nulls(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(300)] + [(300, None)]
    own = spark.createDataFrame(rows, "id int, embedding array<double>").repartition(5)
    asked = own.where("id in (3, 77, 200)").select(F.col("id").alias("qid"), F.col("embedding").alias("vec"))
    got = {(r["qid"], r["rank"]): r["id"] for r in I.vector_topk(own, asked, 7).collect()}
    u = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for q in (3, 77, 200):
        best = sorted(range(300), key=lambda i: (-round(float(u(rows[q][1]) @ u(rows[i][1])), 12), i))[:7]
        assert [got[q, k] for k in range(7)] == best


def test_repeated_pairs(spark):
    texts = {1: "a b c d e f g h i j", 2: "a b c d e f g h i j", 3: "a b c d e f g h i", 4: "x y", 5: "", 6: "X, y!"}
    hits = spark.createDataFrame([(0, k, t) for k, t in texts.items()] + [(1, 1, "a b")], "qid int, id int, text string")
    assert {(r["qid"], r["a"], r["b"]) for r in R.repeated_pairs(hits).collect()} == {(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 4, 6)}
