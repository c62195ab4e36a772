"""More queries: rebuilding, lineage evidence, impact, registers, glossaries, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawlake.functions import texts
from lawlake.operators import bluebell, classify, compare, documents, findings, graph, resolution, search, stores, translation, versioned
from lawlake.operators.orphans import work_uri
from lawlake.plans.reference import _EBASE, _EDGES, SQL_TOKENS, _edges, once, sql
from lawlake.session import read
from lawlake.sources import lanes


@sql("")
def bluebell_texts(spark, d):
    """Every version as indented text."""
    v = once(spark, d, "versions").where("akn_xml IS NOT NULL")
    return v.select("id", bluebell.text_of("akn_xml").alias("text")).where("text IS NOT NULL")


@sql("RECURSIVE + w AS (SELECT id, id AS a, 0 AS depth FROM versions UNION ALL SELECT w.id, p.parent_version_id, w.depth + 1 FROM w JOIN versions p ON p.id = w.a WHERE p.parent_version_id IS NOT NULL AND w.depth < 100), h AS (SELECT w.*, v.language AS lang FROM w JOIN versions v ON v.id = w.a WHERE v.is_current) SELECT id, held_by, depth, lang FROM (SELECT id, a AS held_by, depth, lang, row_number() OVER (PARTITION BY id ORDER BY depth, a) AS rn FROM h) WHERE rn = 1", "versions")
def nearest_source(spark, d):
    """The nearest version in each lineage that is current, with its language."""
    v = once(spark, d, "versions")
    held = v.where("is_current").select(F.col("id").alias("version_id"), F.col("language").alias("lang"))
    return versioned.nearest_holding(versioned.lineage(v.select("id", "parent_version_id")), held, ["lang"])


@sql(f"{_EDGES} SELECT src, count(*) AS n_effects, count(*) FILTER (WHERE akn_category = 'textual') AS n_textual FROM e GROUP BY src", *_EBASE)
def law_impact(spark, d):
    return versioned.impact(_edges(spark, d), "src")


@sql(f"{_EDGES} SELECT dst, count(DISTINCT src) AS amending, min(src) AS first_source FROM e WHERE dst NOT IN (SELECT src FROM e) GROUP BY dst", *_EBASE)
def leaf_works(spark, d):
    """Works that are amended but amend nothing themselves."""
    e = _edges(spark, d)
    return e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti").groupBy("dst").agg(F.count_distinct("src").alias("amending"), F.min("src").alias("first_source"))


@sql("+ n AS (SELECT number, year, min(id) AS n_id FROM laws WHERE number IS NOT NULL GROUP BY number, year HAVING count(DISTINCT id) = 1), t AS (SELECT lower(title) AS t, year, min(id) AS t_id FROM laws GROUP BY 1, 2 HAVING count(DISTINCT id) = 1), c AS (SELECT DISTINCT ON (descriptor_id) descriptor_id, number, try_cast(year AS INT) AS year, title FROM descriptors) SELECT c.descriptor_id AS card_id, coalesce(n_id, t_id) AS law_id, CASE WHEN n_id IS NOT NULL THEN 'number' WHEN t_id IS NOT NULL THEN 'title' END AS rung FROM c LEFT JOIN n ON n.number = c.number AND n.year = c.year LEFT JOIN t ON t.t = lower(c.title) AND t.year = c.year", "laws")
def register_match(spark, d):
    """Descriptors matched to laws by number and year, else title and year; ambiguous ones refused."""
    cards = read(spark, d, "descriptors").dropDuplicates(["descriptor_id"]).select(F.col("descriptor_id").alias("card_id"), "number", F.col("year").try_cast("int").alias("year"), "title")
    return lanes.match_register(cards, once(spark, d, "laws").select("id", "number", "year", "title"))


@sql("SELECT id, nullif(regexp_extract(title, '\\b((?:1[2-9]|20|21)\\d\\d)\\s*$', 1), '')::INT AS year FROM laws", "laws")
def title_years(spark, d):
    return once(spark, d, "laws").select("id", texts.identity_from_title(F.col("title"))["year"].alias("year"))


@sql(f"+ t AS (SELECT id, ' ' || array_to_string({SQL_TOKENS.format('text')}, ' ') || ' ' AS t FROM provisions), g AS (SELECT unnest(['water authority', 'harbour master', 'certificate of origin', 'Gemeinderat', 'permis']) AS term) SELECT t.id, g.term FROM t JOIN g ON contains(t.t, ' ' || lower(g.term) || ' ')", "provisions")
def pinned_terms(spark, d):
    """Provisions with the glossary terms they hold."""
    glossary = spark.createDataFrame([(t,) for t in ("water authority", "harbour master", "certificate of origin", "Gemeinderat", "permis")], "term string")
    return search.pinned_terms(once(spark, d, "provisions").select("id", "text"), "text", glossary).select("id", "term")


@sql("SELECT count(DISTINCT a.text) AS n, count(DISTINCT CASE WHEN a.text IN (SELECT text FROM provisions WHERE created_at < TIMESTAMP '2024-06-01') THEN a.text END) AS n_held FROM provisions a WHERE created_at >= TIMESTAMP '2024-06-01'", "provisions")
def text_containment(spark, d):
    """Distinct later provision texts, and how many of them stood before."""
    p = once(spark, d, "provisions")
    cut = F.col("created_at") >= F.lit("2024-06-01").cast("timestamp_ntz")
    return stores.containment(p.where(cut), p.where(~cut), "text")


@sql("SELECT id, [regexp_replace(regexp_replace(x, '[.,]+$', ''), '[.,]', '', 'g') FOR x IN regexp_extract_all(coalesce(text, ''), '([0-9][0-9.,]*)', 1)] AS numbers FROM provisions", "provisions")
def numeric_slots(spark, d):
    """The numbers of every provision in order."""
    return once(spark, d, "provisions").select("id", F.transform(texts.numeric_tokens(F.col("text")), lambda x: F.regexp_replace(x, "[.,]", "")).alias("numbers"))


@sql("")
def resolution_outcomes(spark, d):
    """References by the rung that settled them."""
    from lawlake.plans.structure import _resolved

    return resolution.histogram(_resolved(spark, d))


@sql("+ m AS (SELECT v.law_id AS id, count(*)::DOUBLE AS score FROM provisions p JOIN versions v ON v.id = p.version_id WHERE p.normative GROUP BY v.law_id), t AS (SELECT * FROM m ORDER BY score DESC, id LIMIT 200) SELECT t.id, round(score - 0.35 * CASE l.doctype WHEN 'act' THEN 0 WHEN 'decree' THEN 1 ELSE 2 END, 6) AS order_score FROM t JOIN laws l ON l.id = t.id ORDER BY order_score DESC, id LIMIT 20", "provisions", "versions", "laws")
def law_listing(spark, d):
    """Laws by normative provisions, doctypes ranked."""
    rank = F.when(F.col("doctype") == "act", 0).when(F.col("doctype") == "decree", 1).otherwise(2)
    laws = once(spark, d, "laws").select("id", rank.alias("rank"))
    of = once(spark, d, "versions", "law_id").select(F.col("id").alias("version_id"), "law_id")
    matches = once(spark, d, "provisions").where("normative").join(of, "version_id").groupBy(F.col("law_id").alias("id")).agg(F.count("*").cast("double").alias("score"))
    return versioned.listing(laws, matches).select("id", "order_score")


@sql("SELECT akn_type, count(*) AS n FROM provisions WHERE akn_type NOT IN ('part', 'book', 'title', 'chapter') AND trim(coalesce(text, ''), ' ') <> '' AND NOT coalesce(excluded_from_pool, false) GROUP BY akn_type", "provisions")
def assessable_units(spark, d):
    return compare.assessable(once(spark, d, "provisions")).groupBy("akn_type").agg(F.count("*").alias("n"))


@sql("+ e AS (SELECT regexp_replace(lower(regexp_replace(target_frbr_uri, '^\\s+|\\s+$', '', 'g')), '/$', '') AS w, akn_action FROM amendment_effects) SELECT w, akn_action, count(*) AS n FROM e WHERE starts_with(w, '/akn/xb/') GROUP BY w, akn_action", "amendment_effects")
def amendment_history(spark, d):
    """Effects on the works of one jurisdiction, by action."""
    e = once(spark, d, "amendment_effects").withColumn("w", work_uri(F.col("target_frbr_uri")))
    return e.where(F.col("w").startswith("/akn/xb/")).groupBy("w", "akn_action").agg(F.count("*").alias("n"))


@sql(f"{_EDGES} SELECT min(depth) AS depth, node FROM (SELECT dst AS node, 1 AS depth FROM e WHERE src = (SELECT max(src) FROM e) UNION ALL SELECT e2.dst, 2 FROM e JOIN e e2 ON e2.src = e.dst WHERE e.src = (SELECT max(src) FROM e) AND e.dst <> e.src) GROUP BY node", *_EBASE)
def reached_once(spark, d):
    """Two hops out from the last work, every work once."""
    e = _edges(spark, d)
    return graph.walk(e, e.agg(F.max("src").alias("node")), 2, once=True)


@sql("""+ p AS (SELECT id, year, number, frbr_work_uri AS u, regexp_matches(frbr_work_uri, '^/akn/[a-z]{2}[^/]*/.+/(1[2-9]\\d\\d|20\\d\\d|21\\d\\d|2200)/[^/\\s]+$') AS ok, regexp_extract(frbr_work_uri, '^/akn/([a-z]{2}(?:-[a-z0-9]+)?)/(.+)/(\\d{4})/([^/@]+)', 3) AS y, regexp_extract(frbr_work_uri, '^/akn/([a-z]{2}(?:-[a-z0-9]+)?)/(.+)/(\\d{4})/([^/@]+)', 4) AS n FROM laws)
SELECT id AS law_id, 'uncitable_work_uri' AS check_name, 'warning' AS severity FROM p WHERE NOT ok UNION ALL SELECT id, 'identity_future_year', 'error' FROM p WHERE year > 2025 UNION ALL SELECT id, 'identity_unconverted_year', 'error' FROM p WHERE year BETWEEN 2400 AND 2700
UNION ALL SELECT id, 'identity_implausible_year', 'error' FROM p WHERE year < 1200 UNION ALL SELECT id, 'identity_uri_mismatch', 'error' FROM p WHERE (y <> '' AND try_cast(y AS INT) <> year) OR (n <> '' AND n <> number)""", "laws")
def identity_checks(spark, d):
    """Works whose identity can't be right."""
    return documents.document_checks(once(spark, d, "laws"), "2025-12-31")


_RULES = [
    classify.Rule("consolidation", "title", r"(?iu)consolidat|consolidée|texto refundido", priority=3),
    classify.Rule("amending", "title", r"(?iu)amendment|änderung|modificat", priority=2),
    classify.Rule("order", "title", r"(?iu)\border\b|verordnung|arrêté|orden\b", priority=1),
]
_ERAS = [("early", None, 1989), ("middle", 1989, 2009), ("late", 2010, None)]


@sql("SELECT CASE WHEN regexp_matches(title, '(?i)consolidat|consolidée|texto refundido') THEN 'consolidation' WHEN regexp_matches(title, '(?i)amendment|änderung|modificat') THEN 'amending' WHEN regexp_matches(title, '(?i)\\border\\b|verordnung|arrêté|orden\\b') THEN 'order' END AS class, CASE WHEN year IS NULL THEN 'unknown' WHEN year <= 1989 THEN 'early' WHEN year <= 2009 THEN 'middle' ELSE 'late' END AS era, count(*) AS n FROM laws GROUP BY 1, 2", "laws")
def document_classes(spark, d):
    """Laws by declared class and era."""
    laws = once(spark, d, "laws", "title", "year")
    return laws.groupBy(classify.document_class(_RULES).alias("class"), classify.era(F.col("year"), _ERAS).alias("era")).agg(F.count("*").alias("n"))


@sql("""+ v AS (SELECT id, parent_version_id AS p FROM versions WHERE parent_version_id IS NOT NULL), u AS (SELECT version_id, akn_wid, min(text) AS text FROM provisions GROUP BY version_id, akn_wid),
s AS (SELECT v.id, u.akn_wid, u.text FROM v JOIN u ON u.version_id = v.p), t AS (SELECT v.id, u.akn_wid, u.text FROM v JOIN u ON u.version_id = v.id)
SELECT check_name, count(*) AS n FROM (SELECT CASE WHEN t.id IS NULL THEN 'unit_missing' WHEN s.id IS NULL THEN 'unit_added' END AS check_name FROM s FULL JOIN t ON s.id = t.id AND s.akn_wid = t.akn_wid) WHERE check_name IS NOT NULL GROUP BY check_name""", "versions", "provisions")
def derived_unit_changes(spark, d):
    """Units that derived versions lack or add against the version they derive from."""
    v = once(spark, d, "versions", "parent_version_id").where("parent_version_id IS NOT NULL")
    u = once(spark, d, "provisions", "version_id", "akn_wid", "text").groupBy("version_id", "akn_wid").agg(F.min("text").alias("text"))
    source = v.join(u.withColumnRenamed("version_id", "parent_version_id"), "parent_version_id").select("id", "akn_wid", "text")
    target = v.join(u.withColumnRenamed("version_id", "id"), "id").select("id", "akn_wid", "text")
    found = translation.audit(source, target, ["id", "akn_wid"])
    return found.where("check_name IN ('unit_missing', 'unit_added')").groupBy("check_name").agg(F.count("*").alias("n"))


@sql("SELECT json_extract_string(props, '$.k') AS value, count(*) AS n FROM events GROUP BY 1")
def events_by_payload(spark, d):
    """Events per value of a payload field."""
    return findings.by_payload(read(spark, d, "events"), "props", "k")


@sql("+ m AS (SELECT DISTINCT version_id, akn_eid FROM provisions WHERE excluded_from_pool) SELECT DISTINCT p.version_id, p.akn_eid FROM provisions p JOIN m ON m.version_id = p.version_id AND (p.akn_eid = m.akn_eid OR starts_with(p.akn_eid, m.akn_eid || '__'))", "provisions")
def marked_scope(spark, d):
    """Units at or under an excluded one."""
    u = read(spark, d, "provisions").select("version_id", "akn_eid", "excluded_from_pool").distinct()
    return documents.marked_scope(u.select("version_id", "akn_eid").distinct(), u.where("excluded_from_pool"))


@sql("+ u AS (SELECT DISTINCT version_id, akn_eid FROM provisions) SELECT a.version_id, a.akn_eid, list(b.akn_eid ORDER BY length(b.akn_eid)) AS path FROM u a JOIN u b ON b.version_id = a.version_id AND (a.akn_eid = b.akn_eid OR starts_with(a.akn_eid, b.akn_eid || '__')) GROUP BY a.version_id, a.akn_eid", "provisions")
def provision_paths(spark, d):
    """The enclosing stored units of every provision, root first."""
    return documents.paths(read(spark, d, "provisions").select("version_id", "akn_eid").distinct())


@sql(f"{_EDGES}, t AS (SELECT * FROM e WHERE akn_category = 'textual' AND src LIKE '/akn/xd/%'), s AS (SELECT min(dst) AS n FROM t) SELECT DISTINCT src AS node, dst AS near, 1 AS depth FROM t, s WHERE dst = n", *_EBASE)
def inbound_walk(spark, d):
    """Works of one jurisdiction that change the words of the first work so changed."""
    e = _edges(spark, d)
    own = e.where(F.col("src").startswith("/akn/xd/"))
    start = own.where("akn_category = 'textual'").agg(F.min("dst").alias("node"))
    return graph.walk(e, start, 1, inbound=True, classes=["textual"], allowed=own.select(F.col("src").alias("node")))
