"""Walks and aggregations over the amendment graph.

Defined results: a walk is over paths, so a node reached by two paths comes twice unless ``once``; a node
isn't entered again on its own path, but the edge that closes a cycle is reported; targets that no law has
are leaves; depth is clamped to 1..10.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawlake.operators.orphans import work_uri


def law_edges(effects: DataFrame, versions: DataFrame, laws: DataFrame) -> DataFrame:
    """``(effect_id, src, dst, akn_category, akn_action)``: from the amending law's URI to the amended one's."""
    uris = laws.select(F.col("id").alias("law_id"), work_uri(F.col("frbr_work_uri")).alias("src")).distinct()
    of = versions.select(F.col("id").alias("version_id"), "law_id").distinct().join(uris, "law_id").select("version_id", "src")
    rows = effects.select(F.col("id").alias("effect_id"), "version_id", work_uri(F.col("target_frbr_uri")).alias("dst"), "akn_category", "akn_action").distinct()
    return rows.join(of, "version_id").select("effect_id", "src", "dst", "akn_category", "akn_action")


def walk(edges: DataFrame, start: DataFrame, depth: int = 3, once: bool = False, inbound: bool = False, classes: list[str] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """``(node, near, depth)``: what is reached from the start nodes (column ``node``) along edges (src, dst), hop by hop.

    ``classes`` keeps edges of these classes (column akn_category) at every hop, ``allowed`` (column node) the
    nodes that may be entered; an empty list or table matches nothing.
    """
    depth = max(1, min(10, depth))
    if classes is not None:
        edges = edges.where(F.col("akn_category").isin(classes) if classes else F.lit(False))
    hops = edges.select(F.col("dst" if inbound else "src").alias("src"), F.col("src" if inbound else "dst").alias("dst")).distinct()
    if allowed is not None:
        hops = hops.join(allowed.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    front = start.select(F.col("node"), F.array("node").alias("path")).distinct()
    found = None
    for d in range(1, depth + 1):
        step = front.withColumnRenamed("node", "src").join(hops, "src").select(F.col("src").alias("near"), F.col("dst").alias("node"), F.lit(d).alias("depth"), "path")
        found = step if found is None else found.unionByName(step)
        front = step.where(~F.array_contains("path", F.col("node"))).select("node", F.concat("path", F.array("node")).alias("path"))
    out = found.select("node", "near", "depth")
    return out.groupBy("node").agg(F.min("depth").alias("depth")) if once else out


def counterparties(edges: DataFrame) -> DataFrame:
    """``(src, dst, akn_category, n)``: edges between two works by class, own ones left out."""
    return edges.where("src <> dst").groupBy("src", "dst", "akn_category").agg(F.count("*").alias("n"))


def fold_mirrors(rows: DataFrame, key: list[str], owner: str) -> DataFrame:
    """Rows mirrored by several owners: per key the greatest multiplicity that any one owner has."""
    per = rows.groupBy(*key, owner).agg(F.count("*").alias("n"))
    return per.groupBy(*key).agg(F.max("n").alias("multiplicity"), F.count("*").alias("owners"))


def under_work(targets: DataFrame, target: str, works: DataFrame, uri: str) -> DataFrame:
    """Prefix join of expression or fragment URIs to works: the work part becomes an equi-join key."""
    bare = F.regexp_replace(F.regexp_replace(F.col(target), "#.*$", ""), "(/[a-z]{3}(@.*)?|@.*)$", "")
    return targets.withColumn("__w", work_uri(bare)).join(works.withColumn("__w", work_uri(F.col(uri))), "__w").drop("__w")


def narrower_or_broader(codes: DataFrame, code: str, wanted: str) -> DataFrame:
    """Rows whose code equals, narrows or broadens the wanted one."""
    broader = [wanted[:i] for i in range(2, len(wanted))]
    c = F.col(code)
    kind = F.when(c == wanted, "equal").when(c.startswith(wanted), "narrower").when(c.isin(broader), "broader")
    return codes.withColumn("relation", kind).where("relation IS NOT NULL")
