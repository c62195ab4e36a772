"""Lookups and picks over stored records: publishers' sources, ids of provisions, languages, listings.

Defined results: rows with a null key are in no result; ties are broken by the greater or smaller id as said; a
listing that has no row for a key has none here either; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lawlake.functions import eids


def newest(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Per key the row greatest in ``order``, which must not tie on different rows; partial maxima, so a hot key costs little."""
    known = rows
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    best = known.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("__x"))
    return best.select(*keys, *[F.col(f"__x.{c}").alias(c) for c in keep])


def works_of_urls(sources: DataFrame) -> DataFrame:
    """``(source_url, frbr_work_uri, n_works)``: the work a publisher's URL stands for; null where it stood for several."""
    per = sources.where("source_url IS NOT NULL AND frbr_work_uri IS NOT NULL").groupBy("source_url")
    many = per.agg(F.count_distinct("frbr_work_uri").alias("n_works"), F.min("frbr_work_uri").alias("w"))
    return many.select("source_url", F.when(F.col("n_works") == 1, F.col("w")).alias("frbr_work_uri"), "n_works")


def eids_of_fragments(provisions: DataFrame) -> DataFrame:
    """``(version_id, fragment, akn_eid)``: the shortest eId that ends in a fragment (its last segment), the smaller of equally long ones."""
    said = provisions.where("version_id IS NOT NULL AND akn_eid <> ''").select("version_id", F.element_at(F.split("akn_eid", "__"), -1).alias("fragment"), "akn_eid")
    best = said.groupBy("version_id", "fragment").agg(F.min(F.struct(F.length("akn_eid").alias("n"), "akn_eid")).alias("x"))
    return best.select("version_id", "fragment", F.col("x.akn_eid").alias("akn_eid"))


def provision_urls(provisions: DataFrame, versions: DataFrame, laws: DataFrame, sources: DataFrame) -> DataFrame:
    """``(id, url)``: where the publisher shows each provision: the newest source of its work with its eId as fragment."""
    urls = newest(sources.where("source_url IS NOT NULL"), ["frbr_work_uri"], ["fetched_at", "fetch_id", "source_url"], ["source_url"])
    of_law = laws.select(F.col("id").alias("law_id"), "frbr_work_uri").join(urls, "frbr_work_uri").select("law_id", "source_url")
    of_version = versions.select(F.col("id").alias("version_id"), "law_id").join(of_law, "law_id").select("version_id", "source_url")
    return provisions.where("akn_eid <> ''").select("id", "version_id", "akn_eid").join(of_version, "version_id").select("id", F.concat("source_url", F.lit("#"), "akn_eid").alias("url"))


def provision_ids(provisions: DataFrame) -> DataFrame:
    """``(version_id, akn_eids, ids)``: the id of every eId of a version, in the order of eIds; of a repeated eId the smaller id."""
    one = provisions.where("version_id IS NOT NULL AND akn_eid IS NOT NULL").groupBy("version_id", "akn_eid").agg(F.min("id").alias("id"))
    per = one.groupBy("version_id").agg(F.sort_array(F.collect_list(F.struct("akn_eid", "id"))).alias("x"))
    return per.select("version_id", F.col("x.akn_eid").alias("akn_eids"), F.col("x.id").alias("ids"))


def laws_with_jurisdictions(laws: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """``(id, title, jurisdiction, family, calendar)``: laws that aren't deleted with their jurisdiction (a few rows), null if it isn't known."""
    known = jurisdictions.select(F.col("id").alias("jurisdiction_id"), F.col("name").alias("jurisdiction"), "family", "calendar")
    return laws.where("deleted_at IS NULL").join(known, "jurisdiction_id", "left").select("id", "title", "jurisdiction", "family", "calendar")


def jurisdictions_in_scope(versions: DataFrame, laws: DataFrame) -> DataFrame:
    """``(doctype, jurisdictions)``: the partitions that a search among the versions of a doctype must read."""
    held = versions.select("law_id").distinct()
    met = laws.join(held, laws.id == held.law_id, "left_semi").where("doctype IS NOT NULL AND jurisdiction_code IS NOT NULL")
    return met.groupBy("doctype").agg(F.sort_array(F.collect_set("jurisdiction_code")).alias("jurisdictions"))


def languages_of_laws(laws: DataFrame, versions: DataFrame) -> DataFrame:
    """``(law_id, languages)``: the languages a law can be read in, by its versions or by its translated titles."""
    titled = laws.select(F.col("id").alias("law_id"), F.explode(F.map_keys("title_translations")).alias("language"))
    both = titled.unionByName(versions.select("law_id", "language")).where("law_id IS NOT NULL AND language IS NOT NULL")
    return both.groupBy("law_id").agg(F.sort_array(F.collect_set("language")).alias("languages"))


def sources_by_wid_or_eid(effects: DataFrame, provisions: DataFrame) -> DataFrame:
    """``(effect_id, provision_id)``: provisions that an effect names by wId or by eId; two equi-joins in place of one on either key."""
    named = effects.select(F.col("id").alias("effect_id"), "version_id", F.regexp_replace(F.trim("source_akn_wid"), "^#", "").alias("__k"))
    by = lambda c: named.join(provisions.select("version_id", F.col(c).alias("__k"), F.col("id").alias("provision_id")), ["version_id", "__k"]).select("effect_id", "provision_id")
    return by("akn_wid").union(by("akn_eid")).distinct()


def first_rows(provisions: DataFrame, most: int) -> DataFrame:
    """``(version_id, id, n)``: of every version the first ``most`` provisions in document order, before anything is scored."""
    w = W.partitionBy("version_id").orderBy("position", "id")
    return provisions.where("deleted_at IS NULL").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("version_id", "id", "n")


def listing_orders(laws: DataFrame) -> DataFrame:
    """``(jurisdiction_code, id, by_title, by_ingested)``: the place of each law in its jurisdiction's listing by title and by arrival, newest first."""
    titled = W.partitionBy("jurisdiction_code").orderBy(F.lower("title").asc_nulls_last(), "id")
    arrived = W.partitionBy("jurisdiction_code").orderBy(F.col("created_at").desc_nulls_last(), "id")
    return laws.where("deleted_at IS NULL").select("jurisdiction_code", "id", F.row_number().over(titled).alias("by_title"), F.row_number().over(arrived).alias("by_ingested"))


def enclosing_units(provisions: DataFrame) -> DataFrame:
    """``(id, parent_id)``: the nearest stored unit around each provision, null for outermost ones."""
    chain = provisions.where("akn_eid <> ''").select("id", "version_id", "akn_eid", F.posexplode(eids.ancestors(F.col("akn_eid"))).alias("d", "__a"))
    held = provisions.groupBy("version_id", F.col("akn_eid").alias("__a")).agg(F.min("id").alias("parent_id"))
    met = chain.where("__a <> akn_eid").join(held, ["version_id", "__a"]).groupBy("id").agg(F.max_by("parent_id", "d").alias("parent_id"))
    return provisions.where("akn_eid <> ''").select("id").join(met, "id", "left")
