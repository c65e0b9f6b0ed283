"""Text and question functions on stated cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import query as Q, text as T
from tessera.operators import chunk as C


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_clean(spark):
    assert one(spark, "invest-\nment here", T.dehyphenate) == "investment here"
    assert one(spark, "BERKSHIRE HATHAWAY INC.\nkept\n 12 \n- 3 -\nPage 1 of 9", T.clean) == "kept"
    assert one(spark, "a\n \n \nb", T.clean) == "a\n\n\nb"
    assert one(spark, " a  b\t c ", T.clean) == "a b c"
    assert one(spark, None, T.clean) == ""


def test_decode(spark):
    assert one(spark, bytearray("naïve\r\nx".encode()), T.decode_utf8_or_latin1, "binary") == "naïve\nx"
    assert one(spark, bytearray("naïve".encode("latin-1")), T.decode_utf8_or_latin1, "binary") == "naïve"
    assert one(spark, bytearray("naïve".encode("latin-1")), T.decode_utf8_or_empty, "binary") == ""


@pytest.mark.parametrize(
    ("line", "title"),
    [("INSURANCE\n\nBody text follows here.", "INSURANCE"), ("Abc", None), ("Ends with a Colon:", None), ("lower case words only", None), ("The Big Picture\nx", "The Big Picture"), ("(in $ millions)", None), ("12345 67890 1", None)],
)
def test_title(spark, line, title):
    assert one(spark, line, T.section_title) == title


def test_topics(spark):
    assert one(spark, "Inflation and CPI; the moat. Inflation again, risks", T.topic_tags) == ["inflation", "investment_philosophy"]
    assert one(spark, None, T.topic_tags) == []


@pytest.mark.parametrize(
    ("q", "want"),
    [("in 2008", (2008, 2008)), ("from 1990 to 1985", (1985, 1990)), ("the nineties", (1990, 1999)), ("1980s to the 2010s", (1980, 2019)), ("none", None), ("1969", None), ("2008s", None)],
)
def test_years(spark, q, want):
    r = one(spark, q, Q.year_range)
    assert (r and (r["lo"], r["hi"])) == want


def test_periods(spark):
    ranges = lambda q: [(p["lo"], p["hi"]) for p in one(spark, q, Q.comparison_periods) or []]
    assert ranges("changed from the 1990s to the 2020s") == [(1990, 1999), (2020, 2024)]
    assert ranges("changed between 1980 and 1990") == [(1980, 1985), (1986, 1990)]
    assert ranges("changed between 1980 and 1989") == []
    assert ranges("the 1990s and the 1990s changed") == []
    assert ranges("the 1990s to the 2020s") == []


def test_filters(spark):
    df = spark.createDataFrame([(1990, "a"), (2000, "b"), (None, "c")], "year int, source_file string")
    ids = lambda w: [r["source_file"] for r in df.where(Q.filter_column(w)).collect()]
    assert ids({"year": {"$gte": 1995}}) == ["b"]
    assert ids({"year": {"$in": []}}) == []
    assert ids({}) == ["a", "b", "c"]
    for bad in ({"colour": 1}, {"year": {"$ne": 1}}, {"year": {}}, {"year": {"$in": 3}}):
        with pytest.raises(ValueError):
            Q.filter_column(bad)
    assert Q.filter_label({"year": {"$gte": 1990}}) == "year:1990–?"


def test_keywords(spark):
    assert one(spark, "float, FLOAT; 'loss ratio', one two three four five\nnext", Q.expansion_keywords) == ["float", "loss ratio"]
    assert one(spark, None, Q.expansion_keywords) == []
    for bad in ("1a", "a-b", "x" * 64, "a;drop"):
        with pytest.raises(ValueError):
            Q.valid_identifier(bad)


def test_fixed_windows(spark):
    cut = lambda t: one(spark, t, C.fixed_windows)
    assert cut("") == [] and cut("   ") == [""] and cut("x" * 500) == ["x" * 500]
    assert [len(x) for x in cut("x" * 501)] == [500, 51]
    assert [len(x) for x in cut("x" * 950)] == [500, 500, 50]


def test_recursive_and_merge(spark):
    text = "\n\n".join(" ".join(f"Sentence number {i} is short." for i in range(60)) for _ in range(2))
    parts = C.split_recursive(text, 400, 50)
    assert max(map(len, parts)) <= 400 and parts[0].startswith("Sentence number 0")
    merged = one(spark, ["HEAD", "x" * 200, "tail"], lambda c: C.merge_short(c, 160, 400), "array<string>")
    assert merged == ["HEAD\n\n" + "x" * 200 + "\n\ntail"]
    assert one(spark, ["a", "b"], lambda c: C.merge_short(c, 160, 400), "array<string>") == ["a\n\nb"]


def test_format_list(spark):
    assert one(spark, "Points: 1. a, 2. b", T.format_list) == "Points: 1. a\n\n2. b"
    assert one(spark, "x\n- a\n- b\ny", T.format_list) == "x\n\n- a\n\n- b\n\ny"
