"""Element identifiers (``prefix_num__prefix_num``) as column expressions.

Defined results: null stays null; an empty id has no parts and no parent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Container prefixes in the order of the hierarchy.
KINDS = ["part", "book", "title", "chp", "chapter", "sec", "section", "art", "article", "subsec", "para", "subpara", "point", "list", "hcontainer", "att", "table", "tr"]


def parts(eid: Column) -> Column:
    """array<struct<prefix, number, raw>> from the root down."""
    pieces = F.filter(F.split(eid, "__"), lambda p: p != "")

    def one(p: Column) -> Column:
        number = F.regexp_extract(p, r"^[A-Za-z]+_(.*)$", 1)
        return F.struct(F.lower(F.regexp_extract(p, r"^([A-Za-z]+)", 1)).alias("prefix"), number.alias("number"), p.alias("raw"))

    return F.transform(pieces, one)


def parent(eid: Column) -> Column:
    """The id of the enclosing container; null at the root."""
    return F.when(eid.contains("__"), F.regexp_replace(eid, r"__(?:(?!__).)*$", ""))


def ancestors(eid: Column) -> Column:
    """All enclosing ids, root first, itself last."""
    pieces = F.split(eid, "__")
    return F.when(eid == "", F.array().cast("array<string>")).otherwise(F.transform(pieces, lambda _, i: F.array_join(F.slice(pieces, F.lit(1), i + 1), "__")))


def depth(eid: Column) -> Column:
    return F.when(eid == "", 0).otherwise(F.size(F.split(eid, "__")))


def order_key(eid: Column) -> Column:
    """A string that sorts ids in document order: numbers by value, not by digits."""
    padded = F.regexp_replace(eid, r"(\d+)", "000000000$1")
    return F.regexp_replace(padded, r"0*(\d{9})(?!\d)", "$1")


def sibling_key(eid: Column) -> Column:
    """struct<n, bis, dup> of the last part (``art_5bis2_1``); null if it has no number."""
    last = F.element_at(F.split(eid, "__"), -1)
    shape = r"^(?:[a-z]+_)?(\d+)(bis(\d*))?(?:_(\d+))?$"
    num = lambda i: F.coalesce(F.regexp_extract(last, shape, i).try_cast("int"), F.lit(0))
    bis = F.when(F.regexp_extract(last, shape, 2) == "", 0).otherwise(F.greatest(num(3), F.lit(1)))
    return F.when(last.rlike(shape), F.struct(num(1).alias("n"), bis.alias("bis"), num(4).alias("dup")))
