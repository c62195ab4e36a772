"""Work and expression URIs (``/akn/xb/act/regulation/2008/536/deu@2010-01-01``) as column expressions.

Defined results: parts that a URI doesn't have are null; a date that isn't one is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(uri: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(uri, pattern, group), F.lit(""))


def work_parts(uri: Column) -> Column:
    """struct<country, doctype, year, number> of a work URI."""
    shape = r"^/akn/([a-z]{2}(?:-[a-z0-9]+)?)/(.+)/(\d{4})/([^/@]+)"
    return F.struct(
        _part(uri, shape, 1).alias("country"), _part(uri, shape, 2).alias("doctype"), _part(uri, shape, 3).cast("int").alias("year"), _part(uri, shape, 4).alias("number")
    )


def build_work_uri(country: Column, doctype: Column, year: Column, number: Column) -> Column:
    """The canonical URI; a plain act has no subtype, an unknown year is 0000."""
    middle = F.when(F.coalesce(doctype, F.lit("act")) == "act", "act").otherwise(F.concat(F.lit("act/"), doctype))
    return F.format_string("/akn/%s/%s/%s/%s", F.lower(country), middle, F.coalesce(F.lpad(year.cast("string"), 4, "0"), F.lit("0000")), number)


def build_expression_uri(work: Column, language: Column, on: Column) -> Column:
    return F.concat(work, F.lit("/"), language, F.coalesce(F.concat(F.lit("@"), F.date_format(on, "yyyy-MM-dd")), F.lit("")))


def expression_language(uri: Column) -> Column:
    return _part(uri, r"/([a-z]{3})(?:@[^/]*)?(?:/!.*)?$")


def expression_date(uri: Column) -> Column:
    """The date an expression URI names, if the URI or a component tail follows it."""
    return F.try_to_timestamp(_part(uri, r"@(\d{4}-\d{2}-\d{2})(?:T[^/]*)?(?=$|/|\.)"), F.lit("yyyy-MM-dd")).cast("date")


def is_citable(uri: Column) -> Column:
    """Whether a work URI names a usable year and number."""
    return F.coalesce(uri.rlike(r"^/akn/[a-z]{2}[^/]*/.+/(1[2-9]\d\d|20\d\d|21\d\d|2200)/[^/\s]+$"), F.lit(False))


def celex_to_work(celex: Column) -> Column:
    """The work URI of a sector 3 CELEX number."""
    kind = F.create_map(F.lit("L"), F.lit("directive"), F.lit("R"), F.lit("regulation"), F.lit("D"), F.lit("decision"))
    shape = r"^3(\d{4})([LRD])(\d{4})$"
    number = F.regexp_extract(celex, shape, 3).try_cast("int").cast("string")
    return F.when(celex.rlike(shape), F.format_string("/akn/eu/act/%s/%s/%s", F.try_element_at(kind, F.regexp_extract(celex, shape, 2)), F.regexp_extract(celex, shape, 1), number))
