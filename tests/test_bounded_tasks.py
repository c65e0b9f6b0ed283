"""What a task or the driver holds at once does not grow with the tables."""

import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa

import __spark_entry__
import corpus_pipeline
from tessera.llm import line_dedup, spelling
from tessera.llm.shared import Tables, shared_dir
from tessera.operators import chunk as C, impact as X, index as I, inverted as V, topics as K


def _peak_mb(run) -> tuple:
    """(what ``run`` returns, MB that Python and numpy held at most beyond what was there)."""
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_vector_search_holds_tiles():
    rng = np.random.default_rng(5)
    asked = I._unit(rng.normal(size=(I.QUERY_BLOCK, 16)))
    ids = list(range(len(asked)))
    pdf = pd.DataFrame({"id": np.arange(10_000), "vec": list(rng.normal(size=(10_000, 16))), "slot": np.int32(0)})
    (found,), mb = _peak_mb(lambda: list(I._best(ids, asked, 5)(iter([pdf]))))
    assert mb < 150
    score = np.round(asked[:40] @ I._unit(np.array(pdf.vec.tolist())).T, 12)
    for q in range(40):
        assert found[found.qid == q].id.tolist() == np.lexsort((pdf.id, -score[q]))[:5].tolist()


def test_tiles_change_no_rank(monkeypatch):
    rng = np.random.default_rng(6)
    asked = I._unit(rng.integers(-1, 2, size=(7, 3)).astype(float))  # few values: many ties
    parts = [pd.DataFrame({"id": rng.permutation(300) + 300 * n, "vec": list(rng.integers(-1, 2, size=(300, 3)).astype(float)), "slot": rng.integers(0, 4, 300).astype(np.int32)}) for n in range(3)]
    monkeypatch.setattr(I, "TILE", 50)
    monkeypatch.setattr(I, "HELD", 40)
    (found,) = list(I._best(list(range(7)), asked, 4)(iter(parts)))
    every = pd.concat(parts)
    score = np.round(asked @ I._unit(np.array(every.vec.tolist())).T, 12)
    for q in range(7):
        for slot in range(4):
            own = (every.slot == slot).to_numpy()
            want = pd.DataFrame({"id": every.id[own], "score": score[q, own]}).sort_values(["score", "id"], ascending=[False, True]).head(4)
            got = found[(found.qid == q) & (found.slot == slot)]
            assert got.id.tolist() == want.id.tolist() and got.score.tolist() == want.score.tolist()


def test_inverted_scan_holds_tiles():
    rng = np.random.default_rng(7)
    asked = I._unit(rng.normal(size=(I.QUERY_BLOCK, 16))).astype(np.float32)
    centres = I._unit(rng.normal(size=(4, 16))).astype(np.float32)
    code = rng.integers(-127, 128, size=(10_000, 16)).astype(np.int8)
    pdf = pd.DataFrame({"cell": np.arange(10_000, dtype=np.int32) % 4, "id": np.arange(10_000), "step": np.float32(0.004), "code": [c.tobytes() for c in code]})
    looked = {c: np.arange(len(asked)) for c in range(4)}
    (found,), mb = _peak_mb(lambda: list(V._scan(asked, looked, centres, 6)(iter([pdf]))))
    assert mb < 150
    exact = (asked[:20] @ code.T.astype(np.float32)) * np.float32(0.004) + asked[:20] @ centres[pdf.cell].T
    for q in range(20):
        assert set(found[found.n == q].id) == set(np.argsort(-exact[q])[:6].tolist())


def test_nearest_centres_by_tiles(monkeypatch):
    rng = np.random.default_rng(8)
    unit, centres = I._unit(rng.normal(size=(500, 8))), I._unit(rng.normal(size=(37, 8)))
    monkeypatch.setattr(I, "TILE", 100)
    assert I.nearest(unit, centres).tolist() == np.argmax(unit @ centres.T, axis=1).tolist()
    assert len(I.nearest(unit[:0], centres)) == 0


def test_keywords_of_a_long_text(spark):
    text = "alpha beta, gamma-delta. " * 20_000
    docs = spark.createDataFrame([(1, text), (2, None), (3, "beta,  gamma")], "doc_id long, text string")
    keys = K.keyword_table(spark, {"one": ("gamma",), "two": ("beta, gamma", "delta. alpha beta, gamma"), "none": ("omega",)})
    found = {(r["id"], r["topic"]): r["hits"] for r in K.keyword_hits(docs, keys).collect()}
    assert found == {(1, "one"): 20_000, (1, "two"): 20_000, (3, "one"): 1}


def test_many_first_words(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The sea, the wide sea and the land")], "doc_id long, text string")
    keys = K.keyword_table(spark, {"water": ("sea", "wide sea"), "earth": ("the land", "and")})
    few = sorted(map(tuple, K.keyword_hits(docs, keys).collect()))
    monkeypatch.setattr(K, "MOST_FIRSTS", 1)
    assert sorted(map(tuple, K.keyword_hits(docs, keys).collect())) == few == [(1, "earth", 1, 2), (1, "water", 0, 2)]


def test_pieces_are_cut_by_slices():
    texts = pa.array([None, "", *(("word " * 700 + ". ") for _ in range(4000))])
    want = [x for x in (y.strip() for y in C.split_recursive(texts[2].as_py())) if x]
    found, mb = _peak_mb(lambda: C.split_batch(texts))
    assert found[0].as_py() == found[1].as_py() == [] and found[2].as_py() == found[4001].as_py() == want and len(found) == 4002
    assert mb < 5  # strings of a slice, not of the whole batch, beside those of Arrow


def test_rows_of_a_shard_take_few_bytes_a_posting():
    held = X._Shard(pa.int64(), pa.int32())
    rng = np.random.default_rng(9)
    for i in rng.permutation(2000):
        held.add(int(i), b" ".join(b"w%d" % w for w in rng.integers(0, 3000, 600)), None)
    postings = len(held.tok)
    out, mb = _peak_mb(lambda: held.rows(3))
    assert out.column("no").value_lengths().to_numpy().sum() == postings
    assert mb * 1e6 < 45 * postings


def _folders(spark) -> dict[str, int]:
    """Tables' folders in the shared folder, without their numbers, and how many of each there are."""
    base = Path(shared_dir(spark).removeprefix("file://"), "tessera")
    return Counter(p.name.rsplit("-", 1)[0] for p in base.iterdir() if any(p.rglob("*.parquet"))) if base.exists() else Counter()


def test_stages_leave_no_tables_behind(spark, tmp_path):
    """A stage's tables are gone when the next one's result is there; near-duplicate removal keeps what its result reads alone."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    corpus_pipeline._clear()
    before = _folders(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    left = _folders(spark) - before
    assert not [name for name in left if name.startswith(("quality", "lines", "dropped"))]
    assert left["neardup-sets"] == 1 and not left["neardup"]
    assert docs.count() > 0
    # what still reads the tables of the stage before keeps them
    first = corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert corpus_pipeline.line_stage(spark, first, sf).count() > 0


def test_line_keys_are_shuffled_in_parts(spark, monkeypatch):
    """No shuffle of line dedup takes all keys or all texts; more parts change no row."""
    text = ["the same line of words stands here\nand number {} of all others {}".format(k, "abcdefgh"[k % 8] * 9) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    rows = {tuple(map(str, r)) for r in line_dedup.repeated_lines(docs).collect()}
    parts = []
    write = Tables.write
    monkeypatch.setattr(Tables, "write", lambda self, *dfs: (parts.append((tuple(dfs[0].columns), len(dfs))), write(self, *dfs))[1])
    for most in (1, 3):
        monkeypatch.setattr(line_dedup, "KEY_PARTS", most)
        monkeypatch.setattr(line_dedup, "TEXT_PARTS", most)
        parts.clear()
        assert {tuple(map(str, r)) for r in line_dedup.repeated_lines(docs).collect()} == rows
        assert {n for columns, n in parts if columns[0] == "key" and "near" in columns} == {most} == {n for columns, n in parts if columns == ("node", "norm")}


def test_vocabulary_is_never_broadcast(spark, monkeypatch):
    """Small tables show it: Spark would broadcast each of them on its own, whatever the vocabulary becomes."""
    plans = []
    write = Tables.write
    monkeypatch.setattr(Tables, "write", lambda self, df, *more: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(self, df, *more))[1])
    words = spark.createDataFrame([("example", 50), ("exmple", 5), ("examples", 9), ("another", 7)], "word string, n long")
    out = spelling.spelling_forms(words)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r["word"]: r["root"] for r in out.collect()} == {"example": "example", "exmple": "example", "examples": "example", "another": "another"}
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)


def test_strategies_search_once(spark, monkeypatch):
    """All strategies rank the candidates of one search."""
    calls, topk = [], I.vector_topk
    monkeypatch.setattr(I, "vector_topk", lambda *a, **k: (calls.append(1), topk(*a, **k))[1])
    out = __spark_entry__.queries()["search_all"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and {r["strategy"] for r in out.select("strategy").distinct().collect()} == {"naive", "vector", "metadata", "hybrid"}
