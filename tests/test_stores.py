"""Vector stores by name against plain numpy, and again after they were opened anew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import stores as S


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)], i % 4) for i in range(400)]
    return rows, spark.createDataFrame(rows, "id long, embedding array<float>, label int")


def best(rows, query, k, keep=lambda r: True):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    scored = [(-round(float(unit(query) @ unit(v)), 12), i) for i, v, label in rows if keep((i, v, label))]
    return [i for _, i in sorted(scored)[:k]]


@pytest.mark.parametrize("name", ["exact", "inverted"])
def test_stores_search_what_they_hold(spark, vectors, tmp_path, name):
    rows, df = vectors
    path = f"file://{tmp_path}/{name}"
    store = S.open_store(name, spark, path, width=8)
    assert store.count() == 0
    store.upsert(df.where("id < 300"), "label")
    store.upsert(df.where("id >= 250"), "label")
    store.delete(df.where("id % 10 = 3").select("id"), "label")
    held = [r for r in rows if r[0] % 10 != 3]
    assert store.count() == len(held)
    asked = df.where("id in (5, 100, 203)").select(F.col("id").alias("qid"), F.col("embedding").alias("vec"))
    for opened in (store, S.open_store(name, spark, path)):
        found = {}
        for r in opened.search(asked, 5).orderBy("qid", "rank").collect():
            found.setdefault(r["qid"], []).append(r["id"])
        want = {q: best(held, rows[q][1], 5) for q in (5, 100, 203)}
        if name == "exact":
            assert found == want
        else:
            assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 12 and all(len(x) == 5 for x in found.values())
    some = store.search(asked, 3, F.col("label") == 1).collect()
    assert {r["id"] % 4 for r in some} == {1}
    if name == "exact":
        assert sorted(r["id"] for r in some if r["qid"] == 5) == sorted(best(held, rows[5][1], 3, lambda r: r[2] == 1))


def test_stores_refuse(spark, vectors, tmp_path):
    _, df = vectors
    with pytest.raises(ValueError, match="unknown store"):
        S.open_store("none", spark, str(tmp_path))
    store = S.open_store("exact", spark, f"file://{tmp_path}/w", width=7)
    with pytest.raises(Exception, match="expected 7 dimensions"):
        store.upsert(df, "label")
    assert store.count() == 0


def test_reports_are_written(spark, tmp_path):
    from tessera.sources import files

    per = spark.createDataFrame([("a", "q1", 0.123456), ("a", "q2", 1.0)], "strategy string, qid string, mrr double")
    means = per.groupBy("strategy").agg(F.count("*").alias("n_queries"), F.avg("mrr").alias("mrr"), F.max("mrr").alias("best"))
    files.write_report(per, means, f"file://{tmp_path}/report")
    assert spark.read.json(f"file://{tmp_path}/report/per_query").count() == 2
    (line,) = spark.read.option("header", True).csv(f"file://{tmp_path}/report/means").collect()
    assert line.asDict() == {"strategy": "a", "n_queries": "2", "best": "1.0", "mrr": "0.5617"}
