"""Writes as pure functions from tables to tables: idempotent inserts, upserts, replacements, generations and state machines.

A caller writes the result with the usual atomic overwrite of a partition or table. Defined results: of
several new rows with one key the greatest by the order column holds; null keys equal each other; a
terminal state is never left; replacing by an empty set of keys changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _match(keys: list[str], a: str = "a", b: str = "b") -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def insert_new(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows and those new ones whose key isn't held yet (recording an acquisition twice is a no-op)."""
    fresh = rows.dropDuplicates(keys).alias("a").join(stored.select(*keys).alias("b"), _match(keys), "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest wins per key; stored rows count as older than new ones of the same order value."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(rows.select(*stored.columns).withColumn("__new", F.lit(1)))
    w = W.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def replace_by(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """All stored rows of a key that ``rows`` speak of give way to them (replace the rows of a version)."""
    kept = stored.alias("a").join(rows.select(*keys).distinct().alias("b"), _match(keys), "left_anti")
    return kept.unionByName(rows.select(*stored.columns))


def next_generation(stored: DataFrame, rows: DataFrame, key: str, at: str) -> DataFrame:
    """Retire the live rows of the keys that come in and add the rows as the next generation (columns generation, retired_at)."""
    touched = rows.select(key).distinct().withColumn("__t", F.lit(True))
    gen = stored.groupBy(key).agg(F.max("generation").alias("__g"))
    old = stored.join(touched, key, "left").withColumn("retired_at", F.when(F.col("__t") & F.col("retired_at").isNull(), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("retired_at"))).drop("__t")
    new = rows.join(gen, key, "left").withColumn("generation", (F.coalesce("__g", F.lit(0)) + 1).cast("int")).withColumn("retired_at", F.lit(None).cast("timestamp_ntz"))
    return old.select(*stored.columns).unionByName(new.select(*stored.columns))


def fill_missing(stored: DataFrame, rows: DataFrame, key: str, column: str) -> DataFrame:
    """Take a value only where none is stored."""
    named = rows.groupBy(key).agg(F.max(column).alias("__v"))
    return stored.join(named, key, "left").withColumn(column, F.coalesce(column, "__v")).drop("__v").select(*stored.columns)


def stale(rows: DataFrame, version_column: str, version: int) -> DataFrame:
    """Rows derived by another version, or by none."""
    return rows.where(~F.col(version_column).eqNullSafe(F.lit(version)))


def missing_from_cache(rows: DataFrame, cache: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Rows whose text hash isn't in the cache under their keys, with the hash (what is still to be embedded)."""
    hashed = rows.withColumn("text_sha", F.sha2(F.col(text), 256))
    return hashed.join(cache.select(*keys, "text_sha").distinct(), [*keys, "text_sha"], "left_anti")


# Run states and the moves between them.
MOVES = {"queued": ["running", "cancelled", "failed"], "running": ["succeeded", "failed", "cancelled"]}


def run_states(events: DataFrame, run: str, state: str, order: str) -> DataFrame:
    """``(run, state, since)`` after the logged events of each run in turn: a move that isn't allowed changes nothing.

    A run begins as queued or running; a terminal state stays. A run all of whose events are refused is left out.
    """
    allowed = F.create_map(*[x for a, to in MOVES.items() for x in (F.lit(a), F.array(*map(F.lit, to)))])
    first = F.array(*[F.lit(s) for s in MOVES])
    begin = F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast(events.schema[order].dataType).alias("t"))

    def move(now: Column, e: Column) -> Column:
        may = F.array_contains(F.when(now["s"].isNull(), first).otherwise(F.coalesce(F.try_element_at(allowed, F.coalesce(now["s"], F.lit(""))), F.array().cast("array<string>"))), e[state])
        return F.when(may, F.struct(e[state].alias("s"), e[order].alias("t"))).otherwise(now)

    known = events.where(F.col(state).isNotNull() & F.col(order).isNotNull())
    g = known.groupBy(run).agg(F.sort_array(F.collect_list(F.struct(order, state))).alias("es")).select(run, F.aggregate("es", begin, move).alias("x"))
    return g.where("x.s IS NOT NULL").select(run, F.col("x.s").alias(state), F.col("x.t").alias("since"))


def claim_indexes(children: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """0-based index of each child of a batch by arrival."""
    return children.withColumn("batch_index", F.row_number().over(W.partitionBy(parent).orderBy(*order)) - 1)


def amend(provisions: DataFrame, version: str, new_version: str, patches: DataFrame) -> DataFrame:
    """The rows of a new version: those of the old one with patched texts (patches: akn_eid, new_text)."""
    old = provisions.where(F.col("version_id") == version).join(patches.select("akn_eid", "new_text"), "akn_eid", "left")
    made = old.withColumn("text", F.coalesce("new_text", "text")).withColumn("version_id", F.lit(new_version))
    return made.withColumn("id", F.sha2(F.concat_ws("|", "version_id", "akn_eid"), 256)).drop("new_text").select(*provisions.columns)


def stale_translations(versions: DataFrame, stamps: DataFrame) -> DataFrame:
    """Translations whose source has changed since: sha of the parent's XML is not the one stamped (id, source_sha)."""
    parents = versions.select(F.col("id").alias("parent_version_id"), F.sha2("akn_xml", 256).alias("now_sha"))
    return versions.join(stamps, "id").join(parents, "parent_version_id").where(~F.col("now_sha").eqNullSafe(F.col("source_sha"))).select("id")


def containment(part: DataFrame, whole: DataFrame, text: str) -> DataFrame:
    """One row: distinct texts of ``part``, and how many of them ``whole`` holds, by hash."""
    hashes = lambda df: df.where(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256).alias("h")).distinct()
    held = hashes(whole).withColumn("__in", F.lit(1))
    return hashes(part).join(held, "h", "left").agg(F.count("*").alias("n"), F.count("__in").alias("n_held"))
