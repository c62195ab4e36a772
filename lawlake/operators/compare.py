"""Comparing two instruments: candidates by vector, verdicts by an injected model, a summary by share.

Defined results: units that are structural or excluded are not assessed; a unit without candidates is
``not_found``; a summary of fewer than five assessed units is insufficient; shares without assessed units are null.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawlake.operators import quality, search

STRUCTURAL = ["part", "book", "title", "chapter"]


def assessable(units: DataFrame) -> DataFrame:
    """Units with words of their own that are in the pool."""
    return units.where(~F.col("akn_type").isin(*STRUCTURAL) & (F.trim(F.coalesce("text", F.lit(""))) != "") & ~F.coalesce("excluded_from_pool", F.lit(False)))


def candidates(obligations: DataFrame, against: DataFrame, id_col: str, vec_col: str, k: int = 5) -> DataFrame:
    """``(query_id, id, score)``: the ``k`` nearest units of each obligation, exact, in blocks."""
    return search.nearest_of_queries(against, obligations, id_col, vec_col, k)


def judged(pairs: DataFrame, verdict: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Pairs with the verdict (covered, partial, not_found) of an injected model."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", verdict string"
    return pairs.mapInPandas(lambda frames: (f.assign(verdict=verdict(f)) for f in frames), schema)


def summarise(obligations: DataFrame, verdicts: DataFrame, by: str) -> DataFrame:
    """Per group the best verdict of each obligation, counted, and the level of agreement."""
    rank = F.when(F.col("verdict") == "covered", 2).when(F.col("verdict") == "partial", 1).otherwise(0)
    best = verdicts.groupBy("query_id").agg(F.max(rank).alias("r"))
    g = obligations.join(best, "query_id", "left").groupBy(by).agg(F.count("*").alias("assessed"), F.count_if(F.col("r") == 2).alias("covered"), F.count_if(F.col("r") == 1).alias("partial"))
    share = F.round(F.col("covered") / F.nullif(F.col("assessed"), F.lit(0)), 6)
    return g.withColumn("share", share).withColumn("level", quality.alignment_level(F.col("covered"), F.col("assessed")))
