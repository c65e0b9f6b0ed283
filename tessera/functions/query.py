"""What a question asks for: year ranges, comparisons, filters, keywords.  Built-in expressions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

# The years that the corpus covers, and the decades that have a word.
FIRST_YEAR, LAST_YEAR = 1977, 2024
DECADE_NAMES = {"seventies": 1970, "eighties": 1980, "nineties": 1990}


def _years_of(decade: int) -> tuple[int, int]:
    return max(decade, FIRST_YEAR), min(decade + 9, LAST_YEAR)


DECADES: dict[str, tuple[int, int]] = {f"{d}s": _years_of(d) for d in range(1970, 2030, 10)} | {name: _years_of(d) for name, d in DECADE_NAMES.items()}
# Patterns of spans, decade words, years and words of change.
SPAN = r"(?i)(?:from|between)\s+(\d{4})\s+(?:to|and)\s+(\d{4})"
DECADE_WORD = r"\b(1970s|1980s|1990s|2000s|2010s|2020s|seventies|eighties|nineties)\b"
DECADE_SPAN = r"(1970s|1980s|1990s|2000s|2010s|2020s|seventies|eighties|nineties)\s+(?:to|through|–|—|-)\s+(?:the\s+)?(1970s|1980s|1990s|2000s|2010s|2020s|seventies|eighties|nineties)"
YEAR = r"\b(19[7-9]\d|20[0-2]\d)\b"
CHANGE = (
    r"\b(changed?|evolved?|shifted?|developed?|differed?|grown?|compared?|contrasted?|over time|over the years|across (?:the )?decades?|"
    r"throughout|historically|then (?:vs|versus)|now (?:vs|versus))\b"
)
UNICODE = "(?iU)"


def _decade_bounds(word: Column) -> Column:
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("lo"), F.lit(x[1]).alias("hi")) for kv in DECADES.items() for x in kv))
    return F.try_element_at(table, F.lower(word))


def _found(q: Column, pattern: str, group: int) -> Column:
    hit = F.regexp_extract(q, pattern, group)
    return F.when(hit != "", hit)


def _range(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def year_range(q: Column) -> Column:
    """struct(lo, hi) of the years that a question names, or null; one year is lo = hi.

    A span of years comes first, then a span of decades, then a decade, then single years.
    """
    a, b = (_found(q, SPAN, k).cast("int") for k in (1, 2))
    first, last = (_decade_bounds(_found(q, rf"{UNICODE}\b{DECADE_SPAN}\b", k)) for k in (1, 2))
    one = _decade_bounds(_found(q, UNICODE + DECADE_WORD, 1))
    years = F.transform(F.regexp_extract_all(q, F.lit("(?U)" + YEAR), 1), lambda y: y.cast("int"))
    return (
        F.when(a.isNotNull(), _range(F.least(a, b), F.greatest(a, b)))
        .when(first.isNotNull(), _range(first["lo"], last["hi"]))
        .when(one.isNotNull(), _range(one["lo"], one["hi"]))
        .when(F.size(years) > 0, _range(F.array_min(years), F.array_max(years)))
    )


def comparison_periods(q: Column) -> Column:
    """Two ranges where a question compares periods, else null.

    The same decade word twice is no comparison.
    """
    words = F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(UNICODE + DECADE_WORD), 1), F.lower))
    n_words = F.size(F.regexp_extract_all(q, F.lit(UNICODE + DECADE_WORD), 1))
    d1, d2 = (_decade_bounds(F.try_element_at(words, F.lit(k))) for k in (1, 2))
    a, b = (_found(q, SPAN, k).cast("int") for k in (1, 2))
    lo, hi = F.least(a, b), F.greatest(a, b)
    middle = F.floor((lo + hi) / 2)
    return F.when(
        q.rlike(UNICODE + CHANGE),
        F.when(F.size(words) >= 2, F.array(_range(d1["lo"], d1["hi"]), _range(d2["lo"], d2["hi"])))
        .when(n_words >= 2, F.lit(None))
        .when(hi - lo >= 10, F.array(_range(lo, middle), _range(middle + 1, hi))),
    )


# Fields and operators of a filter.
FIELDS = ("year", "decade", "source_file", "chunk_index", "topics")
OPERATORS = ("$eq", "$gte", "$lte", "$gt", "$lt", "$in")


def validate_filter(where: dict | None) -> None:
    """Raise ValueError for a field, operator or value that a filter may not have."""
    for field, wanted in (where or {}).items():
        if field not in FIELDS:
            raise ValueError(f"unknown filter field: {field}")
        if isinstance(wanted, dict):
            if not wanted:
                raise ValueError(f"no operator for {field}")
            for op, value in wanted.items():
                if op not in OPERATORS:
                    raise ValueError(f"unknown filter operator: {op}")
                if op == "$in" and not isinstance(value, (list, tuple, set, frozenset)):
                    raise ValueError("$in needs a collection")


def filter_fault(field: Column, op: Column, listed: Column) -> Column:
    """What is wrong with a condition that comes as data (its field, operator and whether its value is a list), or null."""
    return F.when(~F.coalesce(field.isin(*FIELDS), F.lit(False)), F.concat(F.lit("unknown filter field: "), F.coalesce(field, F.lit("")))).when(
        ~F.coalesce(op.isin(*OPERATORS), F.lit(False)), F.concat(F.lit("unknown filter operator: "), F.coalesce(op, F.lit("")))
    ).when((op == "$in") & ~listed, "$in needs a collection")


def filter_column(where: dict | None) -> Column:
    """A conjunction with SQL's nulls: a null field matches nothing."""
    validate_filter(where)
    parts = []
    for field, wanted in (where or {}).items():
        c = F.col(field)
        for op, value in (wanted if isinstance(wanted, dict) else {"$eq": wanted}).items():
            parts.append({"$eq": lambda: c == value, "$gte": lambda: c >= value, "$lte": lambda: c <= value, "$gt": lambda: c > value, "$lt": lambda: c < value, "$in": lambda: c.isin(sorted(value, key=str))}[op]())
    return F.coalesce(reduce(lambda x, y: x & y, parts, F.lit(True)), F.lit(False))


def filter_sql(where: dict | None) -> tuple[str, dict]:
    """A WHERE clause with named parameters for ``spark.sql(text, args=...)``; '' for no filter."""
    validate_filter(where)
    sign = {"$eq": "=", "$gte": ">=", "$lte": "<=", "$gt": ">", "$lt": "<"}
    parts, args = [], {}
    for field, wanted in (where or {}).items():
        for op, value in (wanted if isinstance(wanted, dict) else {"$eq": wanted}).items():
            names = []
            for v in sorted(value, key=str) if op == "$in" else [value]:
                names.append(f"p{len(args)}")
                args[names[-1]] = v
            parts.append(f"{field} {sign[op]} :{names[0]}" if op != "$in" else (f"{field} in ({', '.join(':' + n for n in names)})" if names else "false"))
    return (" where " + " and ".join(parts), args) if parts else ("", {})


def filter_label(where: dict | None) -> str:
    """A filter in a few words."""
    if not where:
        return "none"
    year = where.get("year")
    if isinstance(year, dict):
        return f"year:{year.get('$gte', '?')}–{year.get('$lte', '?')}"
    return f"year:{year}" if year else f"decade:{where['decade']}s" if where.get("decade") else "custom"


def label_column(year: Column, low: Column, high: Column, decade: Column, other: Column) -> Column:
    """The same for filters that come as data; other: whether there is any further condition."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return (
        F.when(low.isNotNull() | high.isNotNull(), F.concat(F.lit("year:"), part(low), F.lit("–"), part(high)))
        .when(year.isNotNull(), F.concat(F.lit("year:"), year.cast("string")))
        .when(decade.isNotNull(), F.concat(F.lit("decade:"), decade.cast("string"), F.lit("s")))
        .when(other, "custom")
        .otherwise("none")
    )


# Words that mark a reply as no keyword list, and its limits.
NO_KEYWORD = r"(?i)passage|shareholder letters do not|keyword|question"
MOST_KEYWORDS, KEYWORD_CHARS, KEYWORD_WORDS = 8, 40, 4
KEYWORD_ENDS = r"^[.:\-–—\"'`\[\]()]+|[.:\-–—\"'`\[\]()]+$"


def expansion_keywords(reply: Column) -> Column:
    """The keywords of a reply's first line, without repeats, at most eight."""
    from .text import strip

    first = F.split(strip(F.coalesce(reply, F.lit(""))), r"\r\n|\n|\r").getItem(0)
    parts = F.transform(F.split(first, "[,;]"), lambda x: F.regexp_replace(strip(x), KEYWORD_ENDS, ""))
    good = F.filter(parts, lambda x: (x != "") & (F.length(x) <= KEYWORD_CHARS) & (F.size(F.split(strip(x), r"(?U)\s+")) <= KEYWORD_WORDS) & ~x.rlike(NO_KEYWORD))
    kept = F.aggregate(good, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))
    return F.slice(kept, 1, MOST_KEYWORDS)


def expand_query(query: Column, keywords: Column) -> Column:
    """The query with its keywords behind it; the query alone where there are none."""
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) > 0, F.concat_ws(" ", query, F.array_join(keywords, " "))).otherwise(query)


IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{0,62}"


def identifier_ok(name: Column) -> Column:
    """Whether a name needs no quoting."""
    return F.coalesce(name.rlike(rf"\A{IDENTIFIER}\z"), F.lit(False))


def valid_identifier(name: str) -> str:
    """A table name that needs no quoting, or ValueError."""
    if not re.fullmatch(IDENTIFIER, name):
        raise ValueError(f"not an identifier: {name!r}")
    return name
