"""Resolution of references by a ladder of joins, the first rung that fits deciding.

Rungs for a reference to (work, wId): the provision in the work's current version by exact wId; the nearest
enclosing provision that is stored; the law by its URI; the law by number and year under any type, if only
one has them; else unresolved, to be tried again later. Each rung is an equi-join on what is left of the
key; ambiguous matches are refused.

Defined results: every reference comes out once with its outcome; null targets are ``no_target``; a
reference resolved before is not examined again (``resolver_version`` at or above the current).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawlake.functions import eids, uris
from lawlake.operators.orphans import wid, work_uri

RESOLVER_VERSION = 3


def resolve(refs: DataFrame, laws: DataFrame, current: DataFrame, provisions: DataFrame) -> DataFrame:
    """``(ref_id, outcome, law_id, provision_id)`` for refs ``(ref_id, uri, wid)``; ``current`` holds (law_id, version_id)."""
    known = laws.select(F.col("id").alias("law_id"), work_uri(F.col("frbr_work_uri")).alias("w")).where("w IS NOT NULL")
    one = known.groupBy("w").agg(F.min("law_id").alias("law_id"))
    numbered = known.select("law_id", uris.work_parts(F.col("w")).alias("p")).select("law_id", "p.country", "p.year", "p.number").where("number IS NOT NULL")
    by_number = numbered.groupBy("country", "year", "number").agg(F.min("law_id").alias("num_law"), F.count_distinct("law_id").alias("k")).where("k = 1").drop("k")
    held = provisions.select("version_id", F.col("id").alias("provision_id"), wid(F.col("akn_wid")).alias("x"))
    rows = current.join(held, "version_id").select("law_id", "x", "provision_id").groupBy("law_id", "x").agg(F.min("provision_id").alias("provision_id"))

    r = refs.select("ref_id", work_uri(F.col("uri")).alias("w"), wid(F.col("wid")).alias("x")).join(one, "w", "left")
    r = r.withColumn("pp", uris.work_parts(F.col("w"))).withColumns({"country": F.col("pp.country"), "year": F.col("pp.year"), "number": F.col("pp.number")}).drop("pp")
    r = r.join(by_number, ["country", "year", "number"], "left")
    exact = r.join(rows, ["law_id", "x"], "left").withColumnRenamed("provision_id", "exact")
    # enclosing rows, the nearest first: only for what has no exact row
    open_ = exact.where("law_id IS NOT NULL AND x IS NOT NULL AND exact IS NULL").select("ref_id", "law_id", F.posexplode(F.reverse(eids.ancestors(F.col("x")))).alias("up", "x"))
    near = open_.join(rows, ["law_id", "x"]).groupBy("ref_id").agg(F.min_by("provision_id", "up").alias("near"))
    out = exact.join(near, "ref_id", "left")
    outcome = (
        F.when(F.col("w").isNull(), "no_target").when(F.col("exact").isNotNull(), "provision").when(F.col("near").isNotNull(), "enclosing")
        .when(F.col("law_id").isNotNull(), "law").when(F.col("num_law").isNotNull(), "law_by_number").otherwise("unresolved")
    )
    return out.select("ref_id", outcome.alias("outcome"), F.coalesce("law_id", "num_law").alias("law_id"), F.coalesce("exact", "near").alias("provision_id"))


def histogram(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("outcome").agg(F.count("*").alias("n"))


def pending(refs: DataFrame) -> DataFrame:
    """References that the current resolver hasn't settled."""
    return refs.where(F.coalesce("resolver_version", F.lit(0)) < RESOLVER_VERSION)
