"""Selection among versions, scopes, pages and runs.

Defined results: "latest" is by date, then time of ingestion, then smallest id; undated laws pass a year range
unless told otherwise; an empty list of ids matches nothing, none at all is unrestricted; a page after a
cursor that no longer exists is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__rn = 1").drop("__rn")


RECENT = [F.desc_nulls_last, F.desc_nulls_last, F.asc]


def recency(date: str = "expression_date", ingested: str = "ingested_at", id_col: str = "id") -> list[Column]:
    return [F.desc_nulls_last(date), F.desc_nulls_last(ingested), F.asc(id_col)]


def latest_by_language(versions: DataFrame, language: str) -> DataFrame:
    """One version per law: the preferred language if it has it, then the most recent."""
    preferred = (F.col("language") == language).cast("int")
    return first_per(versions, ["law_id"], [preferred.desc(), *recency()])


def current_versions(versions: DataFrame) -> DataFrame:
    """The current original version of each law: no parent in another language, most recent."""
    return first_per(versions.where("parent_version_id IS NULL"), ["law_id"], recency())


def scope(jurisdictions: list[str] | None = None, years: tuple[int, int] | None = None, doctypes: list[str] | None = None, undated: bool = True) -> Column:
    """The predicate of a scope over laws."""
    out = F.lit(True)
    if jurisdictions is not None:
        out &= F.col("jurisdiction_code").isin(jurisdictions) if jurisdictions else F.lit(False)
    if years is not None:
        inside = F.col("year").between(*years)
        out &= inside | F.col("year").isNull() if undated else F.coalesce(inside, F.lit(False))
    if doctypes is not None:
        out &= F.col("doctype").isin(doctypes) if doctypes else F.lit(False)
    return out


def keyset_page(df: DataFrame, created: str, id_col: str, size: int, cursor_id: object | None = None) -> DataFrame:
    """A page, newest first, after the row named by the cursor."""
    order = [F.desc(created), F.desc(id_col)]
    if cursor_id is None:
        return df.orderBy(*order).limit(size)
    at = df.where(F.col(id_col) == F.lit(cursor_id)).select(F.struct(F.col(created).alias("c"), F.col(id_col).alias("i"))).limit(1).scalar()
    return df.where(F.struct(F.col(created).alias("c"), F.col(id_col).alias("i")) < at).orderBy(*order).limit(size)


def ranked_by_case(df: DataFrame, column: str, ranks: list[str], then: list[Column], size: int) -> DataFrame:
    """A queue ordered by the place of ``column`` in ``ranks`` (others last)."""
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col(column))
    return df.withColumn("rank", F.when(rank > 0, rank).otherwise(len(ranks) + 1).cast("int")).orderBy("rank", *then).limit(size)


def lineage(versions: DataFrame, most: int = 100) -> DataFrame:
    """``(id, ancestor_id, depth)`` of every version, itself at depth 0, up to ``most`` steps."""
    pairs = versions.select("id", "parent_version_id").distinct()
    return versions.sparkSession.sql(
        f"""WITH RECURSIVE walk(id, ancestor_id, depth) MAX RECURSION LEVEL 101 AS (
             SELECT id, id AS ancestor_id, 0 AS depth FROM {{pairs}}
             UNION ALL
             SELECT w.id, p.parent_version_id, w.depth + 1 FROM walk w JOIN {{pairs}} p ON p.id = w.ancestor_id
             WHERE p.parent_version_id IS NOT NULL AND w.depth < {int(most)})
           SELECT id, ancestor_id, depth FROM walk""",
        pairs=pairs,
    )


def carry_forward(old: DataFrame, new: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """New rows with the last earlier decision on the same keys."""
    last = old.groupBy(*keys).agg(F.max(F.struct(at, value)).alias("__l")).select(*keys, F.col(f"__l.{value}").alias(f"prior_{value}"))
    return new.join(last, keys, "left")


def nearest_holding(lines: DataFrame, held: DataFrame, columns: list[str]) -> DataFrame:
    """For every version the columns of its nearest ancestor (itself first) that has a row in ``held`` (version_id, ...).

    ``lines`` is the result of ``lineage``.
    """
    met = lines.join(held.select(F.col("version_id").alias("ancestor_id"), *columns), "ancestor_id")
    return met.groupBy("id").agg(F.min(F.struct("depth", "ancestor_id", *columns)).alias("n")).select("id", F.col("n.ancestor_id").alias("held_by"), "n.depth", *[f"n.{c}" for c in columns])


def listing(laws: DataFrame, matches: DataFrame, size: int = 20, window: int = 200) -> DataFrame:
    """Matching laws in order of score less 0.35 per step of their doctype's rank, within the best ``window`` (laws: id, rank; matches: id, score)."""
    top = matches.orderBy(F.desc("score"), "id").limit(window).join(laws.select("id", "rank"), "id", "left")
    return top.withColumn("order_score", F.round(F.col("score") - 0.35 * F.coalesce("rank", F.lit(0)), 6)).orderBy(F.desc("order_score"), "id").limit(size)


def impact(effects: DataFrame, by: str) -> DataFrame:
    """Per work how many effects it makes and how many of them change words."""
    return effects.groupBy(by).agg(F.count("*").alias("n_effects"), F.count_if(F.col("akn_category") == "textual").alias("n_textual"))
