"""Column helpers shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# Every character Python's str.isspace() accepts, as a regex class and as a plain string.
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD_CHAR = r"[\p{L}\p{N}_]"
# An ASCII word of at least three letters with no word character next to it (text is lower-cased).
ASCII_WORD = rf"(?<!{WORD_CHAR})[a-z]{{3,}}+(?!{WORD_CHAR})"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Every whitespace run becomes one space."""
    return F.regexp_replace(c, WS + "+", " ")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def non_blank(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def non_empty(c: Column) -> Column:
    return F.when(c != "", c)


def words(text: Column) -> Column:
    """ASCII words of three or more letters, lower-cased, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(ASCII_WORD), F.lit(0))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\t-\r\x1c-\x20\x85\p{Z}]+"))


def constant(value, layout: str) -> Column:
    """A nested constant as one expression, folded to a literal when the query is planned."""
    return F.from_json(F.lit(json.dumps(value)), layout)


def strings(values: Iterable[str]) -> Column:
    return constant(list(values), "array<string>")


def lookup_map(values: Mapping[str, str]) -> Column:
    return constant(dict(values), "map<string,string>")


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def first_or_null(c: Column) -> Column:
    return F.try_element_at(c, F.lit(1))


def bounded_rows(df: DataFrame, limit: int) -> list[Row] | None:
    """All rows when there are at most ``limit`` of them, else None (nothing is cut off)."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def counted(tokens: Column) -> Column:
    """``array<struct<term, n, first>>`` of an array of strings, in term order.

    A sort and two linear passes inside the row: long documents cost n log n and no shuffle.
    """
    placed = F.array_sort(F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))

    def runs(p: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(p) - 1),
            lambda i: (i == 0) | (p[i]["term"] != p[F.greatest(i - 1, F.lit(0))]["term"]),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda start, j: F.struct(
                    p[start]["term"].alias("term"),
                    (F.coalesce(F.get(s, j + 1), F.size(p)) - start).alias("n"),
                    p[start]["pos"].alias("first"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<term:string,n:int,first:int>>")
    return let(placed, lambda p: F.when(F.size(p) == 0, empty).otherwise(runs(p)))
