"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: All characters with the property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. (A column that is named inside a lambda may be put there as the expression
    it stands for, and then be computed anew for every element.)"""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def uni_trim(c: Column) -> Column:
    """Trim all Unicode white space (the built-in trim knows the space only). Only the ends are looked at, as a regular
    expression would try every place of the text."""
    return F.btrim(c, F.lit(WHITE))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(uni_trim(c.cast("string")), F.lit(""))


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def tag_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def joined(values: Column, separator: str) -> Column:
    """Array to text; null members count as empty."""
    return F.array_join(F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit(""))), separator)


def facet_values(c: Column) -> Column:
    """Members of a multi-valued cell: split at , 、 ; and line feeds, trimmed, each once; an empty cell has the member ''."""
    parts = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c.cast("string"), F.lit("")), "[,、;\n]"), uni_trim), lambda v: v != ""))
    return let(parts, lambda found: F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found))


def numeric_order(c: Column) -> list[Column]:
    """Sort keys: empty, then whole numbers by value, then texts."""
    number = c.try_cast("bigint")
    return [c != "", number.isNull(), number, c]


def first_line(c: Column) -> Column:
    """First line that isn't blank, trimmed."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), uni_trim), lambda v: v != "")
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def same_order_distinct(ordered: Column) -> Column:
    """Distinct members in the order of first sight, of an array of structs that starts with the order and ends with ``v``."""
    return F.array_distinct(F.transform(F.array_sort(ordered), lambda x: x["v"]))
