"""The state of provisions on a date, as conditional aggregation per provision instead of an ordered fold.

Repeals outrank unshown amendments, those outrank actions that aren't applied; commencements come after
all: they put a provision in force only where nothing else is known and make one dormant that isn't
repealed. Effects that could not be applied are counted by cause.

Defined results: ties on a date go to the greatest id; effects after the date don't exist yet; an effect
without target has no state, only a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORCE = ["entryIntoForce"]
REPEAL = ["repeal"]
TEXT = ["substitution", "insertion"]


def change_dates(effects: DataFrame, key: str) -> DataFrame:
    """``(key, in_force_date)``: the days something happened."""
    return effects.where("in_force_date IS NOT NULL").select(key, "in_force_date").distinct()


def _kind() -> Column:
    a = F.trim("akn_action")
    return F.when(a.isin(FORCE), "force").when(a.isin(REPEAL), "repeal").when(a.isin(TEXT), "text").otherwise("other")


def state_at(effects: DataFrame, work: str, target: str, as_at: str) -> DataFrame:
    """``(work, target, state, since)`` of every provision an effect has touched by ``as_at``."""
    day = F.lit(as_at).cast("date")
    e = effects.where(F.col(target).isNotNull()).withColumn("kind", _kind()).withColumn("on", F.coalesce("applied", F.lit(True)))
    when = F.col("in_force_date")
    told = F.col("on") & (when <= day)
    at = lambda k: F.max(F.when(told & (F.col("kind") == k), when))
    commenced = F.col("on") & (F.col("kind") == "force")
    g = e.groupBy(work, target).agg(
        at("repeal").alias("repealed"), at("text").alias("texted"),
        F.min(F.when(told & (F.col("kind") == "other"), when)).alias("touched"),
        F.max(F.when(commenced & (when <= day), when)).alias("live"),
        F.min(F.when(commenced & (when > day), when)).alias("future"),
        F.max(commenced).alias("named"),
    )
    dormant = F.col("named") & F.col("live").isNull()
    state = (
        F.when(F.col("repealed").isNotNull(), "repealed").when(dormant, "not_yet_in_force").when(F.col("texted").isNotNull(), "text_unapplied")
        .when(F.col("touched").isNotNull(), "affected").when(F.col("live").isNotNull(), "in_force")
    )
    since = F.when(F.col("repealed").isNotNull(), F.col("repealed")).when(dormant, F.col("future")).otherwise(F.coalesce("texted", "touched", "live"))
    return g.select(work, target, state.alias("state"), since.alias("since")).where("state IS NOT NULL")


def holes(effects: DataFrame, target: str, as_at: str) -> DataFrame:
    """One row: effects that the reading could not apply, by cause."""
    day = F.lit(as_at).cast("date")
    when = F.col("in_force_date")
    e = effects.withColumn("kind", _kind()).where(when.isNull() | (when <= day) | (_kind() == "force"))
    force, no_target, off = F.col("kind") == "force", F.col(target).isNull(), ~F.coalesce("applied", F.lit(True))
    by_now = when.isNull() | (when <= day)
    return e.agg(
        F.count_if(no_target & by_now).alias("no_target"),
        F.count_if(~no_target & F.when(force, off & by_now).otherwise(when.isNotNull() & off)).alias("unapplied_by_publisher"),
        F.count_if(~no_target & when.isNull() & (~force | ~off)).alias("undated"),
        F.count_if(~no_target & ~off & when.isNotNull() & (F.col("kind") == "text")).alias("needs_text"),
        F.count_if(~no_target & ~off & when.isNotNull() & (F.col("kind") == "other")).alias("out_of_scope"),
    )
