"""Indexes, stores and limiters against plain Python and against one another."""

import contextlib
import io
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import impact as X, index as I, inverted as V, metrics as M, retrieve as R, segments as G
from tessera.sources.versioned import Conflict, VersionedTable
from tessera.streaming import limiter as L

SF = "/root/testdata/sf0.001"


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


RANKING = ["bm25_topk", "bm25_score", "rrf", "rrf_weighted", "topk_decade", "hybrid", "multi_period", "rerank", "dedup", "m_recall", "agg_metrics", "local_answer", "vec_topk", "vec_filter", "vec_ann"]


@pytest.mark.parametrize("name", RANKING)
def test_tasks_keep_k_rows_before_they_shuffle(spark, name):
    assert "WindowGroupLimit" in plan_of(entry.queries()[name](spark, SF))


def test_index_follows_its_table(spark, tmp_path):
    """A table that is overwritten is indexed anew, under the same path."""
    for texts, want in ((["alpha beta", "beta z"], ["alpha", "beta", "z"]), (["gamma", "delta gamma", "x"], ["delta", "gamma", "x"])):
        rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        assert sorted(r["tok"] for r in entry.queries()["bm25_build"](spark, str(tmp_path)).collect()) == want


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (1 + k) for k in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.choice((0, 5, 40, 200)))), 1970 + rng.randrange(60)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "id long, text string, year int")
    asked = [(q, " ".join(rng.choices(words, weights, k=rng.randrange(1, 9)))) for q in range(25)] + [(97, "w0 w0 w250"), (98, "nothing here"), (99, "")]
    return docs, spark.createDataFrame(asked, "qid int, query string")


def test_impact_search_is_exact(spark, corpus, tmp_path, monkeypatch):
    """The best of all scores, over several shards, in all documents and in slots of them."""
    docs, queries = corpus
    monkeypatch.setattr(X, "SHARD_DOCUMENTS", 400)
    index = I.build_bm25(docs, "id", "text", str(tmp_path / "index"))
    impact = X.build_impact(docs.repartition(2), "id", "text", str(tmp_path / "impact"), carried={"year": F.col("year")})
    assert impact.shards.where("tok is null").count() >= 2
    plain = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert plain(impact.postings(), "id", "tok", "f", "dl") == plain(index.tf, "id", "tok", "f", "dl") and plain(impact.whole().dl, "id", "dl") == plain(index.dl, "id", "dl")
    assert plain(impact.idf.select("tok", "df", F.round("idf", 9)), "*") == plain(index.idf.select("tok", "df", F.round("idf", 9)), "*")
    scores = I.bm25_scores(index, queries).withColumn("score", F.round("score", 9))
    rows = lambda df: sorted((r["qid"], r["slot"], r["rank"], r["id"], round(r["score"], 8)) for r in df.collect())
    own = docs.select("id", "year")
    year = F.col("year")
    for slot, told in ((F.lit(0), None), (F.when(year.between(1985, 2005), 0), lambda d: F.when(d["year"].between(1985, 2005), 0)), (F.floor(year / 10), lambda d: F.floor(d["year"] / 10))):
        found = X.impact_best(impact, queries, 7, slot=told).withColumn("score", F.round("score", 9))
        want = scores.join(own.select("id", slot.cast("long").alias("slot")), "id").where("slot is not null")
        assert rows(R.ranked(found, 7, ("qid", "slot"))) == rows(R.ranked(want, 7, ("qid", "slot")))
    plan = plan_of(X.impact_best(impact, queries, 7))
    assert "FlatMapGroupsInArrow" in plan and "Exchange" not in plan.replace("BroadcastExchange", "")


def test_impact_search_skips_postings(spark, corpus, tmp_path):
    docs, queries = corpus
    impact = X.build_impact(docs.coalesce(1), "id", "text", str(tmp_path / "impact"))
    told = X.impact_best(impact, queries, 3, counts=True).first()
    assert 0 < told["scored"] < 0.8 * told["postings"]


def test_questions_in_blocks(spark, corpus, tmp_path, monkeypatch):
    docs, queries = corpus
    impact = X.build_impact(docs, "id", "text", str(tmp_path / "impact"))
    once = {tuple(r) for r in X.impact_best(impact, queries, 3).collect()}
    monkeypatch.setattr(X, "QUERY_BLOCK", 6)
    assert {tuple(r) for r in X.impact_best(impact, queries, 3).collect()} == once


def test_shard_search_with_negative_weights_and_ties():
    """Nothing is skipped where a score may fall; of equal scores the first documents stay."""
    dl, slot = np.full(300, 4.0), np.zeros(300, int)
    block = lambda no, f: (min(no), max(no), max(f), 4, np.array(no), np.array(f, float))
    s = X.ShardSearch(dl, slot, 4.0, 2)
    assert [d for _, d, _ in s.best([(1.0, [block([5, 7, 9], [1, 1, 1])])])] == [5, 7]
    s = X.ShardSearch(dl, slot, 4.0, 1)
    best = s.best([(2.0, [block([1, 2], [1, 1])]), (-1.0, [block([1], [3])])])
    assert [d for _, d, _ in best] == [2] and s.scored == s.postings == 3


def test_inverted_file_reads_little(spark):
    """Nine of ten found at sf0.1 while codes and whole vectors read are under 15 % of the vectors' bytes."""
    own = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = own.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("vec"))
    index = V.build_inverted(own)
    assert index.codes.select("id").distinct().count() == own.count() and index.codes.count() == own.count()
    found = {(r["qid"], r["id"]) for r in V.inverted_topk(index, asked, 10).collect()}
    exact = {(r["qid"], r["id"]) for r in I.vector_topk(own, asked, 10).collect()}
    assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact)
    n, q = own.count(), asked.count()
    whole = V.candidates(index, asked, 30).count()
    unit = index.centres
    near = np.argsort(-(I._unit(np.array([r["vec"] for r in asked.collect()], float)) @ unit.T), axis=1)[:, : int(np.ceil(len(unit) * V.PROBED))]
    sizes = {r["cell"]: r["count"] for r in index.codes.groupBy("cell").count().collect()}
    codes = sum(sizes.get(int(c), 0) for row in near for c in row)
    assert whole <= 0.02 * n * q and (codes * (64 + 4) + whole * 256) <= 0.15 * n * q * 256


def test_inverted_file_edges(spark):
    none = spark.createDataFrame([], "id int, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "id int, embedding array<float>")
    asked = one.select(F.col("id").alias("qid"), F.col("embedding").alias("vec"))
    assert V.inverted_topk(V.build_inverted(none), asked, 3).count() == 0
    got = V.inverted_topk(V.build_inverted(one), asked, 3)
    assert {(r["qid"], r["id"]) for r in got.collect()} == {(1, 1), (1, 3), (3, 1), (3, 3)}


@pytest.fixture
def store(spark, tmp_path):
    out = VersionedTable(spark, f"file://{tmp_path}/store", "id", buckets=8)
    out.upsert(spark.range(200).select("id", F.lit("a").alias("v"), F.lit(0).alias("at")), "at")
    return out


def test_store_rewrites_touched_buckets_alone(spark, store):
    before = store.manifest()["files"]
    new = spark.createDataFrame([(3, "b", 1), (3, "c", 2), (1000, "d", 1)], "id long, v string, at int")
    assert store.upsert(new, "at", deleted=spark.createDataFrame([(7,)], "id long")) == 2
    after = store.manifest()["files"]
    touched = {str(r[0]) for r in spark.createDataFrame([(3,), (1000,), (7,)], "id long").select(store._bucket(8)).collect()}
    assert {b for b in before if before[b] != after[b]} == touched and len(touched) < 8
    assert {(r["id"], r["v"]) for r in store.read().collect()} == {(i, "c" if i == 3 else "a") for i in range(200) if i != 7} | {(1000, "d")}
    assert store.read(1).count() == 200 and store.read(1).where("v <> 'a'").count() == 0
    assert [r["v"] for r in store.lookup(spark.createDataFrame([(3,), (5000,)], "id long")).collect()] == ["c"]
    assert store.vacuum() >= len(touched) and store.versions() == [2] and store.read().count() == 200
    with pytest.raises(ValueError):
        store.read(1)


def test_failed_writes_change_nothing(spark, store, tmp_path):
    files, rows = store.manifest(), store.read().count()
    bad = spark.createDataFrame([(None, "b", 1)], "id long, v string, at int")
    with pytest.raises(Exception, match="a null key"):
        store.upsert(bad, "at")
    with pytest.raises(ValueError, match="columns"):
        store.upsert(bad.drop("v"), "at")
    assert store.manifest() == files and store.read().count() == rows
    other = VersionedTable(spark, store.path, "id")
    commit, taken = other._commit, []

    def late(found):  # another writer is faster
        taken.append(store.upsert(spark.createDataFrame([(1, "first", 1)], "id long, v string, at int"), "at"))
        return commit(found)

    other._commit = late
    with pytest.raises(Conflict):
        other.upsert(spark.createDataFrame([(1, "second", 1)], "id long, v string, at int"), "at")
    assert taken == [2] and store.versions() == [1, 2] and store.read().where("id = 1").first()["v"] == "first"
    assert not [f for f in os.listdir(tmp_path / "store" / "manifests") if f.startswith(".") and not f.endswith(".crc")]
    with pytest.raises(ValueError):
        VersionedTable(spark, f"file://{tmp_path}/none", "id").read()


def test_segments_equal_a_rebuild(spark, corpus, tmp_path):
    """After upserts, deletions and merges the index scores like one of the documents as they are."""
    docs, queries = corpus
    docs = docs.select("id", "text").where("id < 300")
    index = G.SegmentedIndex(spark, f"file://{tmp_path}/segments")
    with pytest.raises(ValueError):
        index.index()
    index.add(docs.where("id < 200").withColumn("text", F.when(F.col("id") % 4 == 0, "w1 w2 old").otherwise(F.col("text"))), "id", "text")
    index.add(docs.where("id >= 150"), "id", "text")
    index.add(docs.where("id % 4 = 0"), "id", "text", deleted=docs.where("id % 10 = 1").select("id"))

    def same(now):
        want = I.build_bm25(docs.where("id % 10 <> 1"), "id", "text")
        for mine, other, cols in ((now.tf, want.tf, ("id", "tok", "f", "dl")), (now.dl, want.dl, ("id", "dl")), (now.idf, want.idf, ("tok", "df", "idf")), (now.stats, want.stats, ("n", "avgdl"))):
            rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())
            assert rows(mine) == rows(other)

    same(index.index())
    assert index.merge(most=2) == 2
    same(index.index())
    assert index.merge() == 1 and index.merge() == 1
    same(index.index())
    assert index.index(1).stats.first()["n"] == 200


def fold(rows, most, window):
    """Verdicts of (key, at, id) one by one."""
    out, state = {}, {}
    for key, at, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        anchor, n = state.get(key, (float("-inf"), 0))
        if at >= anchor + window:
            anchor, n = at, 0
        state[key] = anchor, n + 1
        out[i] = (anchor, n + 1, n + 1 <= most)
    return out


def test_verdicts_match_a_loop(spark, monkeypatch):
    """Many windows, ranges without requests, requests at one time and at a window's very end, a hot key."""
    rng = np.random.default_rng(3)
    rows = [("hot", float(t), i) for i, t in enumerate(rng.integers(0, 4000, 900))]
    rows += [("gaps", float(t), 1000 + i) for i, t in enumerate((0, 10, 20, 30, 5000, 5009.5, 5010, 90000, 90010))]
    rows += [("same", 5.0, 2000 + i) for i in range(5)] + [("one", -3.0, 3000)]
    monkeypatch.setattr(M, "RANGE_WINDOWS", 4)
    df = spark.createDataFrame(rows + [(None, 1.0, 4000), ("one", None, 4001)], "key string, at double, id int")
    found = {r["id"]: (r["anchor"], r["nth"], r["allowed"]) for r in M.rate_verdicts(df, 2, 10.0, id_col="id").collect()}
    assert found == fold(rows, 2, 10.0)
    assert M.rate_verdicts(df.limit(0), 2, 10.0).count() == 0


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Verdicts of a stream that is stopped and started again are those of all requests at once."""
    rng = np.random.default_rng(4)
    rows = [(f"k{rng.integers(3)}", float(t), i) for i, t in enumerate(np.sort(rng.integers(0, 300, 200)))]
    df = spark.createDataFrame(rows, "key string, at double, id int")
    for part in ("at < 120", "at >= 120 and at < 121", "at >= 121"):
        df.where(part).drop("id").write.mode("append").parquet(f"{tmp_path}/in")
        L.run_limiter(spark.readStream.schema("key string, at double").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint", 3, 25.0)
    rows_of = lambda d: sorted((r["key"], r["at"], r["allowed"]) for r in d.collect())
    assert rows_of(spark.read.parquet(f"{tmp_path}/out")) == rows_of(M.rate_verdicts(df, 3, 25.0))


def test_stream_keeps_state_by_slots(spark, tmp_path):
    """Many keys are a bounded number of states, and their verdicts are those of a fold over each key."""
    rows = [(f"k{i % 400}", float(i // 400 * 7 + i % 3)) for i in range(2000)] + [(None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "key string, at double")
    df.write.parquet(f"{tmp_path}/in")
    with L.state_store(spark):
        decided = L.limit_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 2, 15.0, replay=True, slots=8)
        query = decided.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 8
    rows_of = lambda d: sorted((r["key"] or "", r["at"], r["allowed"]) for r in d.collect())
    assert rows_of(spark.read.parquet(f"{tmp_path}/out")) == rows_of(M.rate_verdicts(df.fillna("none", "key"), 2, 15.0).replace("none", "", "key"))


def test_idle_keys_of_a_slot_expire():
    """A key without requests for two windows of the clock is dropped while its slot goes on."""
    from types import SimpleNamespace

    import pandas as pd

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

    p = L.SlotWindows(1, 10)
    p.state = Value()
    ask = lambda clock, *rows: pd.concat(p.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["key", "at"])]), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: clock))).sort_values("key")["allowed"].tolist()
    assert ask(1000, ("a", 0.0), ("b", 1.0)) == [True, True]
    assert ask(15000, ("b", 2.0)) == [False]
    assert ask(22000, ("b", 3.0)) == [False] and p.state.held[0] == ["b"]
    assert ask(23000, ("a", 4.0)) == [True]


def test_letters_arrive_once(spark, tmp_path):
    """Runs over a growing folder give each letter once; a changed one is replaced."""
    folder = tmp_path / "in"
    (folder / "again").mkdir(parents=True)
    store = VersionedTable(spark, f"file://{tmp_path}/letters", "source_file", buckets=4)
    run = lambda: L.ingest_letters(spark, str(folder), store, str(tmp_path / "checkpoint"))
    (folder / "letter_1977.txt").write_text("The first letter.")
    (folder / "letter_1978.txt").write_text("The second letter.")
    (folder / "notes.txt").write_text("no year")
    run()
    assert {(r["year"], r["text"]) for r in store.read().collect()} == {(1977, "The first letter."), (1978, "The second letter.")}
    run()  # nothing new
    assert store.versions() == [1]
    (folder / "again" / "letter_1977.txt").write_text("The first letter.")
    (folder / "letter_1979.txt").write_text("The third letter.")
    run()
    assert store.read().count() == 3 and store.read().select("source_file").distinct().count() == 3
