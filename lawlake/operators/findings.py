"""Roll-ups of checks whose outcome is failed, passed or not run (null).

Defined results: null is never counted as false; a rate without a denominator is null, as is a difference
of which one side couldn't be measured; groups without rows on the right keep a zero count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rates(findings: DataFrame, by: list[str], outcome: str = "failed") -> DataFrame:
    f = F.col(outcome)
    counts = findings.groupBy(*by).agg(F.count_if(f).alias("failed"), F.count_if(~f).alias("passed"), F.count_if(f.isNull()).alias("not_run"))
    return counts.withColumn("rate", F.round(F.col("failed") / F.nullif(F.col("failed") + F.col("passed"), F.lit(0)), 6))


def rate_delta(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Rates of two runs side by side with their difference and whether the check stopped or started running."""
    b = before.select(*by, F.col("rate").alias("rate_before"), F.lit(True).alias("__b"))
    a = after.select(*by, F.col("rate").alias("rate_after"), F.lit(True).alias("__a"))
    both = b.join(a, by, "full_outer")
    return both.select(*by, "rate_before", "rate_after", F.round(F.col("rate_after") - F.col("rate_before"), 6).alias("delta"), F.col("__a").isNull().alias("stopped"), F.col("__b").isNull().alias("started"))


def facets(rows: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """``(facet, value, n)``: counts per value of each facet, every facet ignoring its own filter."""
    out = None
    for facet in filters:
        kept = rows
        for other, condition in filters.items():
            if other != facet:
                kept = kept.where(condition)
        one = kept.groupBy(F.col(facet).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(facet).alias("facet"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


def latest_runs(runs: DataFrame, by: list[str], started: str, id_col: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.desc(started), F.desc(id_col))
    return runs.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def rollup_latest(runs: DataFrame, rows: DataFrame, by: list[str], started: str, run_id: str, row_run: str, flags: dict[str, Column]) -> DataFrame:
    """Conditional counts over the rows of the latest run of each group; a run without rows counts zero."""
    last = latest_runs(runs, by, started, run_id)
    joined = last.join(rows, last[run_id] == rows[row_run], "left")
    return joined.groupBy(*by, run_id).agg(F.count(row_run).alias("n_rows"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def share_or_null(rows: DataFrame, by: list[str], flag: str) -> DataFrame:
    """The share of rows with the flag, null if it is underived for any row of the group."""
    f = F.col(flag)
    return rows.groupBy(*by).agg(F.when(F.count_if(f.isNull()) > 0, None).otherwise(F.round(F.count_if(f) / F.count("*"), 6)).alias("share"))


def zero_preserving_counts(left: DataFrame, right: DataFrame, key: str, right_key: str, counted: str) -> DataFrame:
    counts = right.groupBy(F.col(right_key).alias(key)).agg(F.count(counted).alias("n"))
    return left.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def outermost(eid: Column) -> Column:
    """The outermost part of an eId."""
    return F.substring_index(eid, "__", 1)


def under_eid(eid: Column, unit: str) -> Column:
    """The unit itself or anything below it (``art_5`` doesn't hold ``art_50``)."""
    return (eid == unit) | eid.startswith(f"{unit}__")


def payload(column: str, key: str) -> Column:
    """A field of a JSON payload as text; null where it is absent or the payload isn't JSON."""
    return F.get_json_object(column, f"$.{key}")


def actionable(column: str, absent_counts: bool = False) -> Column:
    """Findings whose payload doesn't say ``actionable: false``; absent says nothing unless it counts."""
    said = payload(column, "actionable")
    return F.coalesce(said, F.lit("true")) != "false" if absent_counts else F.coalesce(said != "false", F.lit(False))


def json_slice(column: str, start: int, length: int) -> Column:
    """A window of a JSON array, its elements as JSON text."""
    parsed = F.from_json(column, "array<string>")
    return F.slice(parsed, start + 1, length)


def by_payload(rows: DataFrame, column: str, key: str) -> DataFrame:
    """``(value, n)``: rows per value of a payload field, most frequent first."""
    return rows.groupBy(payload(column, key).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
