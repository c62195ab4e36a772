"""References to records that do not exist, from signed counts per key.

References and records are states on one key space. A delivery of a record is a change of state: what it
refers to or exists under from now on counts +1 on its key, what was stored of it before counts -1. The
balance per key (references, records, live records) is the sum of these deltas, and keys with references
and no live existence at the time of a reference form the orphan report; only those keys meet the references
again, to name them per field and month. Sums are partial before every shuffle, so a hot key costs no more
than another.

``advance`` takes a stored state and balance and a batch of delivered records, and reads no other history. Sums
are additive; the earliest times aren't, so they are taken anew for the keys that lost something, from the
stored states of these keys. The first load is a batch that meets an empty store.

Defined results: null refers to nothing, an empty or blank reference refers to a key that no record has; a row
delivered again as it was changes nothing; of one record delivered in different forms in one batch all
forms count, and all give way to what a later batch says; a report row appears once however often its
reference was delivered; references with null created_at are never ``late``; records without id are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawlake import session

KEY = ["ref_field", "k1", "k2"]
STATE = ["kind", "id", *KEY, "is_ref", "at", "live"]
SUMS, TIMES = ["n_refs", "n_rows", "n_live"], ["first_ref", "first_live"]


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def work_uri(c: Column) -> Column:
    """A work URI apart from letter case, outer white space and one final slash."""
    return F.regexp_replace(F.lower(strip(c)), "/$", "")


def wid(c: Column) -> Column:
    """A wId apart from outer white space and one leading #."""
    return F.regexp_replace(strip(c), "^#", "")


def effect_states(effects: DataFrame) -> DataFrame:
    """``STATE`` rows of effects: a row per reference that an effect states."""
    none, uri = F.lit(""), work_uri(F.col("target_frbr_uri"))
    keyed = F.array(
        F.struct(F.lit("target_frbr_uri").alias("ref_field"), uri.alias("k1"), none.alias("k2")),
        F.struct(F.lit("target_akn_wid").alias("ref_field"), uri.alias("k1"), wid(F.col("target_akn_wid")).alias("k2")),
        F.struct(F.lit("source_akn_wid").alias("ref_field"), F.col("version_id").alias("k1"), wid(F.col("source_akn_wid")).alias("k2")),
    )
    return _states("effect", effects.select("id", F.col("created_at").alias("at"), F.lit(True).alias("live"), F.inline(keyed)), True)


def law_states(laws: DataFrame) -> DataFrame:
    """``STATE`` rows of laws, each under its work URI."""
    keyed = laws.select("id", F.col("created_at").alias("at"), F.col("deleted_at").isNull().alias("live"), F.lit("target_frbr_uri").alias("ref_field"), work_uri(F.col("frbr_work_uri")).alias("k1"), F.lit("").alias("k2"))
    return _states("law", keyed, False)


def provision_states(provisions: DataFrame, versions: DataFrame, laws: DataFrame) -> DataFrame:
    """``STATE`` rows of provisions, each under its version and under every URI of its version's laws."""
    uris = laws.select(F.col("id").alias("law_id"), work_uri(F.col("frbr_work_uri")).alias("uri")).distinct()
    held = versions.select(F.col("id").alias("version_id"), "law_id").distinct().join(uris, "law_id", "left").select("version_id", "uri").distinct()
    rows = provisions.select("id", "version_id", wid(F.col("akn_wid")).alias("k2"), F.col("created_at").alias("at"), F.col("deleted_at").isNull().alias("live"))
    keyed = F.array(
        F.struct(F.lit("source_akn_wid").alias("ref_field"), F.col("version_id").alias("k1")),
        F.struct(F.lit("target_akn_wid").alias("ref_field"), F.col("uri").alias("k1")),
    )  # one pass over provisions
    return _states("provision", rows.join(held, "version_id", "left").select("id", "at", "live", "k2", F.inline(keyed)), False)


def _states(kind: str, keyed: DataFrame, is_ref: bool) -> DataFrame:
    said = keyed.select(F.lit(kind).alias("kind"), "id", *KEY, F.lit(is_ref).alias("is_ref"), F.col("at").cast("timestamp_ntz").alias("at"), "live")
    return said.where("id IS NOT NULL AND k1 IS NOT NULL AND k2 IS NOT NULL")


def balance(states: DataFrame, sign: int = 1) -> DataFrame:
    """The balance per key of states that come (1) or go (-1)."""
    ref, row = F.col("is_ref"), ~F.col("is_ref")
    one = lambda c: F.sum(F.when(c, sign).otherwise(0))
    first = lambda c: F.min(F.when(c, F.col("at"))) if sign > 0 else F.lit(None).cast("timestamp_ntz")
    return states.groupBy(*KEY).agg(
        one(ref).alias("n_refs"), one(row).alias("n_rows"), one(row & F.col("live")).alias("n_live"),
        first(ref).alias("first_ref"), first(row & F.col("live")).alias("first_live"),
    )


def merge_balances(changes: DataFrame) -> DataFrame:
    """The balance per key of several balances."""
    return changes.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS], *[F.min(c).alias(c) for c in TIMES])


def advance(states: DataFrame, stored: DataFrame, delivered: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States and balance after a batch.

    ``delivered`` holds ``(kind, id)`` of the records that the batch says something of, ``new`` their ``STATE``
    rows (none for a record that is gone). Write the results before the next batch.
    """
    ids = delivered.distinct()
    came, went = new.distinct(), states.join(ids, ["kind", "id"], "left_semi").select(STATE)
    now = states.join(ids, ["kind", "id"], "left_anti").select(STATE).unionByName(came)
    lost = went.select(*KEY).distinct()
    merged = merge_balances(stored.unionByName(balance(came)).unionByName(balance(went, -1)))
    again = balance(now.join(lost, KEY, "left_semi")).select(*KEY, *[F.col(c).alias(f"again_{c}") for c in TIMES])
    touched = merged.join(lost.withColumn("touched", F.lit(True)), KEY, "left").join(again, KEY, "left")
    times = [F.when(F.col("touched"), F.col(f"again_{c}")).otherwise(F.col(c)).alias(c) for c in TIMES]
    return now, touched.select(*KEY, *SUMS, *times).where("n_refs <> 0 OR n_rows <> 0")


def first_load(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States and balance of a batch that meets an empty store."""
    states = new.distinct()
    return states, balance(states)


def orphan_keys(balances: DataFrame) -> DataFrame:
    """Keys referred to of which no record exists, none is left, or none was there at the first reference."""
    keys = balances.where("n_refs > 0 AND (n_live <= 0 OR first_live > first_ref)")
    return keys.select(*KEY, F.expr("CASE WHEN n_rows <= 0 THEN 'missing' WHEN n_live <= 0 THEN 'deleted' ELSE 'late' END").alias("reason"), "first_live")


def orphan_report(states: DataFrame, balances: DataFrame) -> DataFrame:
    """``(effect_id, ref_field, period, reason)`` of every orphan reference.

    An orphan target_akn_wid counts only where a law has its URI.
    """
    keys, works = orphan_keys(balances), balances.where("ref_field = 'target_frbr_uri' AND n_rows > 0").select("k1")
    checked = keys.where("ref_field = 'target_akn_wid'").join(works, "k1", "left_semi").select(keys.columns)
    keys = keys.where("ref_field <> 'target_akn_wid'").unionByName(checked)
    hits = states.where("is_ref").join(keys, KEY).where("reason <> 'late' OR first_live > at")
    return hits.select(F.col("id").alias("effect_id"), "ref_field", F.date_format("at", "yyyy-MM").alias("period"), "reason").distinct()


def found(effects: DataFrame, laws: DataFrame, versions: DataFrame, provisions: DataFrame) -> DataFrame:
    """p6_found: every orphan reference of ``amendment_effects``."""
    stated = effect_states(effects)
    _, balances = first_load(stated.unionByName(law_states(laws)).unionByName(provision_states(provisions, versions, laws)))
    folder = session.shared_dir(effects.sparkSession, "orphan-balance")
    balances.write.parquet(folder)  # read for the keys and for the laws there are
    return orphan_report(stated, effects.sparkSession.read.parquet(folder))


def counts(report: DataFrame) -> DataFrame:
    """Orphans per referring field and month."""
    return report.groupBy("ref_field", "period", "reason").agg(F.count("*").alias("n_orphans"))
