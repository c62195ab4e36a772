"""Queries of lookups and picks over stored records."""

from __future__ import annotations

from lawlake.operators import records
from lawlake.plans.reference import once, sql
from lawlake.session import read

_NEWEST = "SELECT frbr_work_uri, max((fetched_at, fetch_id, source_url)) AS x FROM acquired_documents WHERE frbr_work_uri IS NOT NULL AND source_url IS NOT NULL GROUP BY frbr_work_uri"


@sql(f"SELECT frbr_work_uri, x[3] AS source_url, x[2] AS fetch_id FROM ({_NEWEST})")
def official_sources(spark, d):
    """The publisher's source of every work: its newest fetch."""
    rows = read(spark, d, "acquired_documents").where("source_url IS NOT NULL")
    return records.newest(rows, ["frbr_work_uri"], ["fetched_at", "fetch_id", "source_url"], ["source_url", "fetch_id"])


@sql("SELECT source_url, CASE WHEN count(DISTINCT frbr_work_uri) = 1 THEN min(frbr_work_uri) END AS frbr_work_uri, count(DISTINCT frbr_work_uri) AS n_works FROM acquired_documents WHERE source_url IS NOT NULL AND frbr_work_uri IS NOT NULL GROUP BY source_url")
def works_of_urls(spark, d):
    return records.works_of_urls(read(spark, d, "acquired_documents"))


@sql("SELECT version_id, fragment, arg_min(akn_eid, (length(akn_eid), akn_eid)) AS akn_eid FROM (SELECT version_id, akn_eid, string_split(akn_eid, '__')[-1] AS fragment FROM provisions WHERE version_id IS NOT NULL AND akn_eid <> '') GROUP BY version_id, fragment", "provisions")
def fragment_eids(spark, d):
    return records.eids_of_fragments(once(spark, d, "provisions"))


@sql(f"+ u AS ({_NEWEST}) SELECT p.id, u.x[3] || '#' || p.akn_eid AS url FROM provisions p JOIN versions v ON v.id = p.version_id JOIN laws l ON l.id = v.law_id JOIN u USING (frbr_work_uri) WHERE p.akn_eid <> ''", "provisions", "versions", "laws")
def provision_urls(spark, d):
    return records.provision_urls(*(once(spark, d, t) for t in ("provisions", "versions", "laws")), read(spark, d, "acquired_documents"))


@sql("SELECT version_id, list(akn_eid ORDER BY akn_eid) AS akn_eids, list(id ORDER BY akn_eid) AS ids FROM (SELECT version_id, akn_eid, min(id) AS id FROM provisions WHERE version_id IS NOT NULL AND akn_eid IS NOT NULL GROUP BY ALL) GROUP BY version_id", "provisions")
def provision_id_maps(spark, d):
    return records.provision_ids(once(spark, d, "provisions"))


@sql("SELECT l.id, l.title, j.name AS jurisdiction, j.family, j.calendar FROM laws l LEFT JOIN jurisdictions j ON j.id = l.jurisdiction_id WHERE l.deleted_at IS NULL", "laws")
def laws_with_jurisdictions(spark, d):
    return records.laws_with_jurisdictions(once(spark, d, "laws"), read(spark, d, "jurisdictions"))


@sql("SELECT doctype, list_sort(list(DISTINCT jurisdiction_code)) AS jurisdictions FROM laws WHERE id IN (SELECT law_id FROM versions) AND doctype IS NOT NULL AND jurisdiction_code IS NOT NULL GROUP BY doctype", "laws", "versions")
def scope_jurisdictions(spark, d):
    return records.jurisdictions_in_scope(once(spark, d, "versions"), once(spark, d, "laws"))


@sql("SELECT law_id, list_sort(list(DISTINCT language)) AS languages FROM (SELECT id AS law_id, unnest(map_keys(title_translations)) AS language FROM laws UNION ALL SELECT law_id, language FROM versions) WHERE law_id IS NOT NULL AND language IS NOT NULL GROUP BY law_id", "laws", "versions")
def law_languages(spark, d):
    return records.languages_of_laws(once(spark, d, "laws"), once(spark, d, "versions"))


@sql("SELECT DISTINCT e.id AS effect_id, p.id AS provision_id FROM amendment_effects e JOIN provisions p ON p.version_id = e.version_id AND regexp_replace(trim(e.source_akn_wid, ' '), '^#', '') IN (p.akn_wid, p.akn_eid)", "amendment_effects", "provisions")
def effect_sources(spark, d):
    return records.sources_by_wid_or_eid(once(spark, d, "amendment_effects"), once(spark, d, "provisions"))


@sql("SELECT version_id, id, n FROM (SELECT version_id, id, row_number() OVER (PARTITION BY version_id ORDER BY position, id) AS n FROM provisions WHERE deleted_at IS NULL) WHERE n <= 20", "provisions")
def scope_first_rows(spark, d):
    """The row cap of a search that knows its scope: the first 20 provisions of every version."""
    return records.first_rows(once(spark, d, "provisions"), 20)


@sql("SELECT jurisdiction_code, id, row_number() OVER (PARTITION BY jurisdiction_code ORDER BY lower(title) NULLS LAST, id) AS by_title, row_number() OVER (PARTITION BY jurisdiction_code ORDER BY created_at DESC NULLS LAST, id) AS by_ingested FROM laws WHERE deleted_at IS NULL", "laws")
def law_orders(spark, d):
    return records.listing_orders(once(spark, d, "laws"))


@sql("SELECT fetch_id, role, max(body_id) AS body_id FROM bodies WHERE fetch_id IS NOT NULL AND role IS NOT NULL GROUP BY fetch_id, role")
def newest_bodies(spark, d):
    """The newest artifact of each kind of a fetch."""
    return records.newest(read(spark, d, "bodies"), ["fetch_id", "role"], ["body_id"], ["body_id"])


@sql("""+ a AS (SELECT p.id, q.id AS parent_id, length(q.akn_eid) AS d FROM provisions p JOIN provisions q ON q.version_id = p.version_id AND starts_with(p.akn_eid, q.akn_eid || '__') WHERE p.akn_eid <> '' AND q.akn_eid <> '')
SELECT p.id, a.parent_id FROM provisions p LEFT JOIN (SELECT id, arg_max(parent_id, (d, -1)) AS parent_id FROM (SELECT id, d, min(parent_id) AS parent_id FROM a GROUP BY id, d) GROUP BY id) a USING (id) WHERE p.akn_eid <> ''""", "provisions")
def enclosing_units(spark, d):
    return records.enclosing_units(once(spark, d, "provisions"))
