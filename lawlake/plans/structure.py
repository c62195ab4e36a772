"""Queries on structure, resolution, stores, sources and streams over whole tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from lawlake import session
from lawlake.functions import eids, texts, uris
from lawlake.operators import anchors, documents, findings, quality, resolution, search, stores, versioned, xml_checks
from lawlake.plans.reference import SQL_URI, once, sql
from lawlake.session import read
from lawlake.sources import lanes
from lawlake.streaming import events


def _nodes(spark, d):
    """The node table, parsed once and written to the shared folder as several checks read it."""
    folder = session.shared_dir(spark, "nodes")
    documents.nodes(once(spark, d, "versions")).write.parquet(folder)
    return spark.read.parquet(folder)


@sql("")
def provision_rows(spark, d):
    """Every structural element of every version (documents to rows)."""
    return documents.nodes(once(spark, d, "versions"))


def _checked(spark, d):
    """Outcomes of the checks on whole documents, made once and written to the shared folder."""
    folder = session.shared_dir(spark, "checked")
    xml_checks.checked(once(spark, d, "versions")).write.parquet(folder)
    return spark.read.parquet(folder)


@sql("")
def validator_findings(spark, d):
    return documents.validate(_nodes(spark, d)).unionByName(xml_checks.found(xml_checks.checked(once(spark, d, "versions"))))


@sql("")
def structural_scan_rates(spark, d):
    """Structural checks of all versions as rates per check."""
    v = once(spark, d, "versions")
    return findings.rates(documents.structural_scan(v).unionByName(xml_checks.translations_preserved(v)), ["check_name"])


@sql("")
def structural_grades(spark, d):
    """Every version's grade; what has no XML that parses is ungraded."""
    checked = _checked(spark, d)
    rows = documents.validate(_nodes(spark, d)).unionByName(xml_checks.found(checked))
    return documents.grade(rows, checked.select("version_id"), xml_checks.verdicts(checked))


@sql("")
def table_cells(spark, d):
    return documents.table_rows(_nodes(spark, d))


@sql("SELECT version_id, string_agg(repeat('  ', len(string_split(akn_eid, '__')) - 1) || upper(akn_type) || ' ' || akn_eid || ' - ' || coalesce(text, ''), chr(10) ORDER BY position, id) AS text FROM provisions GROUP BY version_id", "provisions")
def rebuilt_documents(spark, d):
    """Rows back to documents."""
    return documents.rebuild(once(spark, d, "provisions"))


@sql("SELECT id, len(string_split(akn_eid, '__')) AS depth, CASE WHEN contains(akn_eid, '__') THEN array_to_string(string_split(akn_eid, '__')[:-2], '__') END AS parent FROM provisions", "provisions")
def eid_parents(spark, d):
    e = F.col("akn_eid")
    return once(spark, d, "provisions", "akn_eid").select("id", eids.depth(e).alias("depth"), eids.parent(e).alias("parent"))


@sql("+ k AS (SELECT version_id, id, position, regexp_replace(regexp_replace(akn_eid, '(\\d+)', '000000000\\1', 'g'), '0*(\\d{9})([^\\d]|$)', '\\1\\2', 'g') AS k FROM provisions) SELECT id, row_number() OVER (PARTITION BY version_id ORDER BY k, id) AS rn FROM k", "provisions")
def eid_document_order(spark, d):
    """Provisions numbered in the order of their ids, numbers by value."""
    keyed = once(spark, d, "provisions", "version_id", "akn_eid").select("id", "version_id", eids.order_key(F.col("akn_eid")).alias("k"))
    return keyed.selectExpr("id", "row_number() OVER (PARTITION BY version_id ORDER BY k, id) AS rn")


@sql("SELECT id, regexp_extract(u, '^/akn/([a-z]{2}(?:-[a-z0-9]+)?)/(.+)/(\\d{4})/([^/@]+)', 1) AS country, regexp_extract(u, '^/akn/([a-z]{2}(?:-[a-z0-9]+)?)/(.+)/(\\d{4})/([^/@]+)', 2) AS doctype, regexp_extract(u, '^/akn/([a-z]{2}(?:-[a-z0-9]+)?)/(.+)/(\\d{4})/([^/@]+)', 3)::INT AS year, regexp_extract(u, '^/akn/([a-z]{2}(?:-[a-z0-9]+)?)/(.+)/(\\d{4})/([^/@]+)', 4) AS number FROM (SELECT id, frbr_work_uri AS u FROM laws)", "laws")
def work_uri_parts(spark, d):
    return once(spark, d, "laws", "frbr_work_uri").select("id", uris.work_parts(F.col("frbr_work_uri")).alias("p")).select("id", "p.*")


@sql("SELECT id, nullif(regexp_extract(expression_uri, '/([a-z]{3})(?:@[^/]*)?$', 1), '') AS lang, try_cast(nullif(regexp_extract(expression_uri, '@(\\d{4}-\\d{2}-\\d{2})', 1), '') AS DATE) AS on_date FROM versions", "versions")
def expression_uri_parts(spark, d):
    u = F.col("expression_uri")
    return once(spark, d, "versions", "expression_uri").select("id", uris.expression_language(u).alias("lang"), uris.expression_date(u).alias("on_date"))


@sql("+ c AS (SELECT body_id, nullif(lower(trim(language)), '') AS c FROM bodies) SELECT body_id, CASE c WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'ger' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'fre' THEN 'fra' WHEN 'es' THEN 'spa' WHEN 'esp' THEN 'spa' ELSE c END AS lang FROM c")
def body_languages(spark, d):
    """Language codes of several standards as one."""
    return read(spark, d, "bodies").select("body_id", texts.language(F.col("language")).alias("lang"))


@sql("")
def stemmed_tokens(spark, d):
    """Search tokens of every provision in its version's language: normal form, case fold, light stem."""
    lang = once(spark, d, "versions", "language").select(F.col("id").alias("version_id"), "language")
    rows = once(spark, d, "provisions").join(lang, "version_id", "left")
    return rows.select("id", texts.search_tokens("text", "language").alias("tokens"))


def _resolved(spark, d):
    refs = once(spark, d, "amendment_effects").select(F.col("id").alias("ref_id"), F.col("target_frbr_uri").alias("uri"), F.col("target_akn_wid").alias("wid"))
    current = versioned.current_versions(once(spark, d, "versions", "law_id", "parent_version_id", "expression_date", "ingested_at")).select("law_id", F.col("id").alias("version_id"))
    return resolution.resolve(refs, once(spark, d, "laws"), current, once(spark, d, "provisions"))


@sql("")
def reference_ladder(spark, d):
    """Every effect's target by the rung that resolved it."""
    return _resolved(spark, d)


@sql(f"""+ cur AS (SELECT law_id, id AS version_id FROM (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY expression_date DESC NULLS LAST, ingested_at DESC NULLS LAST, id) AS rn FROM versions WHERE parent_version_id IS NULL) WHERE rn = 1),
one AS (SELECT {SQL_URI.format('frbr_work_uri')} AS w, min(id) AS law_id FROM laws GROUP BY 1),
r AS (SELECT a.id, {SQL_URI.format('a.target_frbr_uri')} AS w, regexp_replace(regexp_replace(a.target_akn_wid, '^\\s+|\\s+$', '', 'g'), '^#', '') AS x FROM amendment_effects a),
j AS (SELECT r.id, r.w, r.x, one.law_id, EXISTS (SELECT 1 FROM cur JOIN provisions p ON p.version_id = cur.version_id WHERE cur.law_id = one.law_id AND p.akn_wid = r.x) AS hit FROM r LEFT JOIN one ON one.w = r.w)
SELECT count(*) AS n, count(*) FILTER (WHERE hit) AS n_exact, count(*) FILTER (WHERE law_id IS NOT NULL) AS n_law FROM j""", "amendment_effects", "versions", "laws", "provisions")
def resolution_totals(spark, d):
    """How many targets name a stored law and a stored provision of its current version."""
    r = _resolved(spark, d)
    return r.agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "provision").alias("n_exact"), F.count_if(F.col("outcome").isin("provision", "enclosing", "law")).alias("n_law"))


@sql("SELECT source_url, max_by(fetch_id, (fetched_at, fetch_id)) AS fetch_id, count(DISTINCT fetch_id) AS n FROM acquired_documents GROUP BY source_url")
def latest_by_url(spark, d):
    """The last acquisition of every source."""
    a = read(spark, d, "acquired_documents")
    return a.groupBy("source_url").agg(F.max_by("fetch_id", F.struct("fetched_at", "fetch_id")).alias("fetch_id"), F.count_distinct("fetch_id").alias("n"))


@sql("SELECT fetch_id, min(landed_at) AS landed_at FROM acquired_documents GROUP BY fetch_id")
def idempotent_acquisitions(spark, d):
    """Acquisitions recorded once however often they landed: the first landing is kept, later ones are no-ops.

    What landed up to the middle of the log is stored, the rest comes as new rows, known fetches among it and unknown ones.
    """
    a = read(spark, d, "acquired_documents").select("fetch_id", "landed_at")
    cutoff = a.agg(F.min("landed_at").alias("lo"), F.max("landed_at").alias("hi")).select((F.col("lo") + (F.col("hi") - F.col("lo")) / 2).alias("cutoff"))
    rows = a.join(F.broadcast(cutoff), how="cross")
    # a null landing is never up to the cutoff; of several landings the first holds, on either side
    first = lambda side: rows.where(side).groupBy("fetch_id").agg(F.min("landed_at").alias("landed_at"))
    stored = F.coalesce(F.col("landed_at") <= F.col("cutoff"), F.lit(False))
    return stores.insert_new(first(stored), first(~stored), ["fetch_id"])


@sql("SELECT publisher_effect_id, revision, akn_action FROM (SELECT *, row_number() OVER (PARTITION BY publisher_effect_id ORDER BY revision DESC, feed_seq DESC) AS rn FROM effect_feed) WHERE rn = 1")
def upsert_latest(spark, d):
    """The feed as upserts by revision."""
    feed = read(spark, d, "effect_feed").select("publisher_effect_id", "revision", "akn_action")
    return stores.upsert(feed.limit(0), feed, ["publisher_effect_id"], "revision")


@sql("+ x AS (SELECT run_id, min(CASE WHEN s IN ('succeeded', 'failed', 'cancelled') THEN (logged_at, s) END) AS e, max((logged_at, s)) AS l FROM (SELECT *, CASE lower(status) WHEN 'success' THEN 'succeeded' WHEN 'aborted' THEN 'cancelled' WHEN 'rolled_back' THEN 'failed' ELSE lower(status) END AS s FROM acquisition_runs) GROUP BY run_id) SELECT run_id, coalesce(e, l)[2] AS state, coalesce(e, l)[1] AS since FROM x")
def run_states(spark, d):
    """The log of runs folded by the state machine in which a terminal state stays."""
    s = F.lower("status")
    log = read(spark, d, "acquisition_runs").withColumn("state", F.when(s == "success", "succeeded").when(s == "aborted", "cancelled").when(s == "rolled_back", "failed").otherwise(s))
    return stores.run_states(log.select("run_id", "state", "logged_at"), "run_id", "state", "logged_at")


@sql("SELECT id, title_translations[language] AS known FROM (SELECT l.id, l.title_translations, 'eng' AS language FROM laws l)", "laws")
def translated_titles(spark, d):
    return once(spark, d, "laws").select("id", F.try_element_at("title_translations", F.lit("eng")).alias("known"))


@sql("SELECT p.id FROM provisions p WHERE sha256(p.text) NOT IN (SELECT sha256(text) FROM provisions WHERE created_at < TIMESTAMP '2024-06-01' AND text IS NOT NULL)", "provisions")
def embedding_cache_misses(spark, d):
    """Provisions whose text no earlier one has: what is still to be embedded."""
    p = once(spark, d, "provisions")
    cache = p.where("created_at < TIMESTAMP_NTZ '2024-06-01'").select(F.lit("m").alias("model"), F.sha2("text", 256).alias("text_sha"))
    return stores.missing_from_cache(p.withColumn("model", F.lit("m")), cache, "text", ["model"]).select("id")


@sql("")
def anchor_census(spark, d):
    """Structural markers of all documents, by kind."""
    return anchors.census(anchors.anchors(read(spark, d, "documents"), "doc_id", "text"))


@sql("")
def structuring_windows(spark, d):
    docs = read(spark, d, "documents")
    return anchors.windows(anchors.anchors(docs, "doc_id", "text"), docs, "doc_id", "text")


@sql("")
def act_segments(spark, d):
    return anchors.segments(read(spark, d, "documents"), "doc_id", "text")


@sql("")
def html_blocks(spark, d):
    """Blocks of all bodies that hold HTML, whatever their media type says."""
    texts_ = read(spark, d, "bodies").select("body_id", F.col("content").cast("string").alias("html"))
    pages = texts_.where(F.col("html").rlike(r"(?i)<(p|h[1-6]|li|div|td|th|pre)\b"))
    return lanes.html_blocks(pages, "body_id", "html")


@sql("SELECT CASE WHEN regexp_matches(lower(source_url), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(source_url), '\\.html?$') THEN 'html' ELSE 'unknown' END AS lane, count(*) AS n FROM acquired_documents GROUP BY 1")
def source_lanes(spark, d):
    return read(spark, d, "acquired_documents").groupBy(lanes.route(F.col("source_url")).alias("lane")).agg(F.count("*").alias("n"))


@sql("SELECT event_id, event_type, ts FROM events WHERE event_type IN ('purchase', 'click') AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 50")
def event_feed(spark, d):
    kept = read(spark, d, "events").where("event_type IN ('purchase', 'click') AND ts >= TIMESTAMP_NTZ '2024-01-10'")
    return versioned.keyset_page(kept.select("event_id", "event_type", "ts"), "ts", "event_id", 50)


_DAILY = "SELECT date_trunc('day', ts) AS from_ts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"


@sql(_DAILY)
def windowed_counts(spark, d):
    """Daily counts by the plan that also runs on the stream."""
    return events.windowed_counts(read(spark, d, "events"))


@sql(_DAILY)
def stream_counts(spark, d):
    """The events table drained as a stream into daily counts (complete mode, the last state read back)."""
    folder = session.shared_dir(spark, "stream-in")
    read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(folder)
    drained = events.drained_counts(spark, folder, session.shared_dir(spark, "stream"), session.shared_dir(spark, "stream-checkpoint"))
    return drained.withColumn("from_ts", F.col("from_ts").cast("timestamp_ntz"))


@sql("+ o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1) SELECT o.o_orderkey FROM o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def pair_pick_coverage(spark, d):
    """The latest run per pair without an adverse row."""
    runs = findings.latest_runs(read(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate"), ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey")
    bad = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return runs.join(bad, "o_orderkey", "left_anti").select("o_orderkey")


@sql("+ q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS score FROM embeddings a, q WHERE a.vec_id <> q.vec_id) SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 5")
def align_topk(spark, d):
    """The five nearest candidates of every query (ids divisible by 50), against all rows."""
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    return search.nearest_of_queries(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)


@sql("+ c AS (SELECT version_id, count(*) AS n FROM provisions WHERE akn_type IN ('paragraph', 'point') GROUP BY version_id), p AS (SELECT v.id, coalesce(t.n, 0) AS target, coalesce(s.n, 0) AS source FROM versions v LEFT JOIN c t ON t.version_id = v.id LEFT JOIN c s ON s.version_id = v.parent_version_id WHERE v.parent_version_id IS NOT NULL) SELECT id, source, target, source > 0 AND target / source < 0.80 AND source - target >= 2 AS lost FROM p", "versions", "provisions")
def clause_parity(spark, d):
    """Versions that have lost clauses against the version they derive from."""
    n = once(spark, d, "provisions").where(F.col("akn_type").isin("paragraph", "point")).groupBy("version_id").agg(F.count("*").alias("n"))
    v = once(spark, d, "versions", "parent_version_id").where("parent_version_id IS NOT NULL")
    both = v.join(n.select(F.col("version_id").alias("id"), F.col("n").alias("t")), "id", "left").join(n.select(F.col("version_id").alias("parent_version_id"), F.col("n").alias("s")), "parent_version_id", "left")
    return quality.clause_parity(both.select("id", F.coalesce("s", F.lit(0)).alias("source"), F.coalesce("t", F.lit(0)).alias("target")))


@sql("SELECT count(*) AS documents, sum(n_chars) AS characters, count(*) FILTER (WHERE text IS NULL OR trim(text, ' ') = '') AS empty, count(DISTINCT source) AS sources, round(count(*) FILTER (WHERE lang IS NULL) / nullif(count(*), 0), 6) AS unknown_share, count(DISTINCT md5(text)) AS texts FROM documents")
def corpus_totals(spark, d):
    """Totals of the corpus sweep in one aggregation."""
    blank = F.col("text").isNull() | (F.trim("text") == "")
    return read(spark, d, "documents").agg(
        F.count("*").alias("documents"), F.sum("n_chars").alias("characters"), F.count_if(blank).alias("empty"), F.count_distinct("source").alias("sources"),
        F.round(F.count_if(F.col("lang").isNull()) / F.nullif(F.count("*"), F.lit(0)), 6).alias("unknown_share"), F.count_distinct(F.md5(F.col("text").cast("binary"))).alias("texts"),
    )


@sql("+ g AS (SELECT p.id, p.version_id, l.doctype, md5(p.id) AS h FROM provisions p JOIN versions v ON v.id = p.version_id JOIN laws l ON l.id = v.law_id WHERE p.text <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY doctype ORDER BY h) AS rn FROM g) SELECT id, doctype FROM r ORDER BY rn, doctype LIMIT 40", "provisions", "versions", "laws")
def stratified_sample(spark, d):
    """A sample that takes strata in turn, by hash order (the sample is the feature)."""
    law = once(spark, d, "versions", "law_id").select(F.col("id").alias("version_id"), "law_id").join(once(spark, d, "laws", "doctype").select(F.col("id").alias("law_id"), "doctype"), "law_id")
    return quality.round_robin(once(spark, d, "provisions").where("text <> ''").join(law, "version_id"), "doctype", "id", 40).select("id", "doctype")


