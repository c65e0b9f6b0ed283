"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert found == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", ["chunk_record", "dedup", "hybrid", "multi_period", "faith", "local_answer", "rate_limit", "q_expand_parse"])
def test_has_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_chunk_ids_are_unique(spark):
    """Ids tell the chunks of all letters apart, though letters share years; links stay within a letter."""
    own = entry.queries()["chunk_record"](spark, SF).select("id", "source_file", "chunk_index", "previous_chunk_id", "next_chunk_id").collect()
    by = {r["id"]: r for r in own}
    assert len(by) == len(own) > 0
    for r in own:
        for link, step in (("previous_chunk_id", -1), ("next_chunk_id", 1)):
            if r[link] is not None:
                assert (by[r[link]]["source_file"], by[r[link]]["chunk_index"]) == (r["source_file"], r["chunk_index"] + step)
