"""Queries of the general data problems over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawlake.operators import change_feed, incremental, nested_records, orphans, timestamps
from lawlake.plans import problems_sql
from lawlake.session import read


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested_records.found(spark, read(spark, d, "versions"))


def p2_articles(spark: SparkSession, d: str) -> DataFrame:
    """The table of one group: articles with their ids, number, heading and parent row."""
    fields = {"eid": "@eId", "wid": "@wId", "num": "num", "heading": "heading"}
    table = nested_records.Tables(spark, read(spark, d, "versions"), "id", "akn_xml").table("article", fields)
    return table.select(F.col("record_id").alias("version_id"), "node_no", "parent_no", *fields)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every table that the records give, with its rows per kind of parent."""
    return nested_records.group_sizes(spark, read(spark, d, "versions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.found(read(spark, d, "descriptors"), read(spark, d, "acquired_documents"), read(spark, d, "jurisdictions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.found(spark, f"{d}/acquired_documents.parquet", read(spark, d, "acquisition_runs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.found(*(read(spark, d, t) for t in ("amendment_effects", "laws", "versions", "provisions")))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per referring field, month and reason."""
    return orphans.counts(p6_found(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return change_feed.found(spark, read(spark, d, "effect_feed"))


QUERIES = {f.__name__: f for f in (p2_found, p2_articles, p2_groups, p4_found, p5_found, p6_found, p6_counts, p7_found)}
SQL = {
    "p5_found": problems_sql.P5,
    "p6_found": problems_sql.P6,
    "p6_counts": f"SELECT ref_field, period, reason, count(*) AS n_orphans FROM ({problems_sql.P6}) GROUP BY ref_field, period, reason",
    "p7_found": problems_sql.P7,
}
