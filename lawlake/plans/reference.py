"""The catalogue of analytical queries, each over its whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawlake.operators import findings, graph, quality, search, timeline, versioned
from lawlake.operators.orphans import work_uri
from lawlake.session import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Base rows: deliveries of the same record are identical, so one per id is kept.
BASE = {t: f"{t} AS (SELECT DISTINCT ON (id) * FROM {t})" for t in ("laws", "versions", "provisions", "amendment_effects")}
SQL_URI = "regexp_replace(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '/$', '')"
SQL_TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '([\\p{{L}}\\p{{N}}\\p{{M}}]+)', 1)"


def sql(text: str, *base: str) -> Callable:
    """Registers a query under its function's name with its SQL over deduplicated base tables."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if text:
            with_ = "WITH " + ("RECURSIVE " if "RECURSIVE" in text else "") + ", ".join(BASE[b].replace(f"FROM {b})", f"FROM main.{b})") for b in base) if base else ""
            body = text.replace("RECURSIVE", "").strip()
            SQL[f.__name__] = (with_ + (", " if body.startswith("+") else " ") if base else ("WITH " + ("RECURSIVE " if "RECURSIVE" in text else "") if body.startswith("+") else "")) + body.lstrip("+")
        return f

    return add


def once(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    """A table without repeated deliveries. Of named columns distinct rows are hashed; without names whole rows are kept by id."""
    rows = read(spark, d, table)
    return rows.select("id", *columns).distinct() if columns else rows.dropDuplicates(["id"])


TERMS = ["drinking", "water", "certificate"]
_IN = ", ".join(f"'{t}'" for t in TERMS)
_BM25 = f"""+ toks AS (SELECT id, version_id, {SQL_TOKENS.format('text')} AS t FROM provisions),
st AS (SELECT count(*) AS n, avg(len(t)) AS av, {', '.join(f"count(*) FILTER (WHERE list_contains(t, '{x}')) AS df{i}" for i, x in enumerate(TERMS))} FROM toks),
scored AS (SELECT id, version_id, round({' + '.join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * len(list_filter(t, lambda x: x = '{x}')) * 2.2 / (len(list_filter(t, lambda x: x = '{x}')) + 1.2 * (0.25 + 0.75 * len(t) / av))" for i, x in enumerate(TERMS))}, 6) AS score
  FROM toks, st WHERE list_has_any(t, [{_IN}]))"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(read(spark, d, "provisions").select("id", "version_id", "text"), "text", TERMS)


@sql(_BM25 + " SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 50", "provisions")
def bm25_topk(spark, d):
    """Lexical top 50 of all provisions."""
    return search.top_k(_scored(spark, d).select("id", "score"), "id", 50)


@sql(_BM25 + " SELECT version_id, id, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY score DESC, id) AS rn FROM scored) WHERE rn <= 3", "provisions")
def lexical_top_per_group(spark, d):
    return search.top_per_group(_scored(spark, d), "version_id", "id", 3).select("version_id", "id", "score", "rn")


@sql(_BM25 + ", hits AS (SELECT v.law_id, count(*) AS n_hits, max(score) AS best FROM scored s JOIN versions v ON v.id = s.version_id GROUP BY v.law_id) SELECT law_id, n_hits, best, count(*) OVER () AS total FROM hits ORDER BY n_hits DESC, law_id LIMIT 20", "provisions", "versions")
def laws_by_matches(spark, d):
    """Laws by matching provisions, the total riding on the page."""
    hits = _scored(spark, d).join(once(spark, d, "versions", "law_id").select(F.col("id").alias("version_id"), "law_id"), "version_id").groupBy("law_id").agg(F.count("*").alias("n_hits"), F.max("score").alias("best"))
    return hits.withColumn("total", hits.agg(F.count("*")).scalar()).orderBy(F.desc("n_hits"), "law_id").limit(20)


@sql(f"SELECT term, count(*) AS ndoc FROM (SELECT DISTINCT id, unnest({SQL_TOKENS.format('text')}) AS term FROM provisions) WHERE strlen(term) <= 128 GROUP BY term", "provisions")
def lexicon_rebuild(spark, d):
    return search.lexicon(once(spark, d, "provisions"), "id", "text")


@sql(f"+ alive AS (SELECT DISTINCT unnest({SQL_TOKENS.format('text')}) AS term FROM provisions WHERE deleted_at IS NULL), named AS (SELECT DISTINCT unnest({SQL_TOKENS.format('title')}) AS term FROM laws) SELECT term FROM named WHERE term NOT IN (SELECT term FROM alive)", "provisions", "laws")
def lexicon_dead_terms(spark, d):
    """Terms of law titles that no living provision holds."""
    alive = search.lexicon(once(spark, d, "provisions").where("deleted_at IS NULL"), "id", "text", 1 << 20)
    return search.dead_terms(search.lexicon(once(spark, d, "laws"), "id", "title", 1 << 20).select("term"), alive)


_TRI = "list_distinct([substr('  ' || {0} || ' ', i, 3) FOR i IN range(1, length({0}) + 2)])"


@sql(f"""+ terms AS (SELECT term, count(*) AS ndoc FROM (SELECT id, unnest(list_distinct({SQL_TOKENS.format('text')})) AS term FROM provisions) GROUP BY term), q AS (SELECT DISTINCT unnest({SQL_TOKENS.format('title')}) AS token FROM laws),
qt AS (SELECT token, unnest({_TRI.format('token')}) AS g, len({_TRI.format('token')}) AS nq FROM q WHERE length(token) >= 3),
raw AS (SELECT term, ndoc, unnest(range(1, length(term) + 2)) AS i FROM terms),
tt AS (SELECT term, ndoc, g, row_number() OVER (PARTITION BY term ORDER BY i) AS pos FROM (SELECT term, ndoc, substr('  ' || term || ' ', i, 3) AS g, min(i) AS i FROM raw GROUP BY 1, 2, 3)),
p AS (SELECT token, term, nq, ndoc, list_sort(list(pos)) AS a FROM qt JOIN tt USING (g) GROUP BY token, term, nq, ndoc),
s AS (SELECT token, term, ndoc, round(list_max(list_transform(range(1, len(a) + 1), lambda i: list_max(list_transform(range(i, len(a) + 1), lambda j: (j - i + 1) / (nq + a[j] - a[i] + 1 - (j - i + 1)))))), 6) AS similarity FROM p)
SELECT token, term, similarity FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY similarity DESC, ndoc DESC, term) AS rn FROM s WHERE similarity >= 0.5 AND token <> term) WHERE rn <= 6""", "provisions", "laws")
def lexicon_expand(spark, d):
    """Words of the provisions' lexicon of which a word of law titles looks like a part."""
    terms = search.lexicon(once(spark, d, "provisions"), "id", "text", 1 << 20)
    named = search.lexicon(once(spark, d, "laws"), "id", "title", 1 << 20).select(F.col("term").alias("token"))
    return search.expand_terms(named, terms)


_COS = "list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"
_DENSE = f"SELECT a.vec_id, round({_COS}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY score DESC, vec_id LIMIT 30"


def _dense(spark: SparkSession, d: str) -> DataFrame:
    vectors = read(spark, d, "embeddings")
    return search.nearest(vectors, "vec_id", "embedding", vectors.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q")), 30).select("vec_id", "score")


@sql(_DENSE)
def dense_topk(spark, d):
    """The 30 vectors nearest to the first."""
    return _dense(spark, d)


_DOCS = f"""+ toks AS (SELECT doc_id AS id, {SQL_TOKENS.format('title')} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS av, {', '.join(f"count(*) FILTER (WHERE list_contains(t, '{x}')) AS df{i}" for i, x in enumerate(['water', 'act']))} FROM toks),
lex AS (SELECT id, round({' + '.join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * len(list_filter(t, lambda x: x = '{x}')) * 2.2 / (len(list_filter(t, lambda x: x = '{x}')) + 1.2 * (0.25 + 0.75 * len(t) / av))" for i, x in enumerate(['water', 'act']))}, 6) AS score
  FROM toks, st WHERE list_has_any(t, ['water', 'act']) ORDER BY score DESC, id LIMIT 30), dense AS ({_DENSE}),
f AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rn FROM lex UNION ALL SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) FROM dense)
SELECT id, round(sum(1.0 / (60 + rn)), 9) AS rrf_score FROM f GROUP BY id ORDER BY rrf_score DESC, id LIMIT 10"""


@sql(_DOCS)
def rrf_hybrid(spark, d):
    """A lexical list over documents' titles and a dense one over embeddings (same ids), fused."""
    docs = read(spark, d, "documents").select("doc_id", "title")
    lexical = search.top_k(search.bm25(docs, "title", ["water", "act"]), "doc_id", 30).select(F.col("doc_id").alias("id"), "score")
    return search.reciprocal_rank_fusion([lexical, _dense(spark, d).withColumnRenamed("vec_id", "id")], "id", 10)


@sql("SELECT law_id, id, language FROM (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY (language = 'eng')::INT DESC, expression_date DESC NULLS LAST, ingested_at DESC NULLS LAST, id) AS rn FROM versions) WHERE rn = 1", "versions")
def latest_preferred(spark, d):
    return versioned.latest_by_language(once(spark, d, "versions", "law_id", "language", "expression_date", "ingested_at"), "eng").select("law_id", "id", "language")


@sql("SELECT law_id, id FROM (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY expression_date DESC NULLS LAST, ingested_at DESC NULLS LAST, id) AS rn FROM versions WHERE parent_version_id IS NULL) WHERE rn = 1", "versions")
def current_versions(spark, d):
    return versioned.current_versions(once(spark, d, "versions", "law_id", "parent_version_id", "expression_date", "ingested_at")).select("law_id", "id")


@sql("SELECT id, jurisdiction_code, year FROM laws WHERE jurisdiction_code IN ('xb', 'xd', 'xg') AND (year BETWEEN 1990 AND 2015 OR year IS NULL) AND doctype IN ('act', 'order')", "laws")
def scope_filter(spark, d):
    return once(spark, d, "laws", "jurisdiction_code", "year", "doctype").where(versioned.scope(["xb", "xd", "xg"], (1990, 2015), ["act", "order"])).select("id", "jurisdiction_code", "year")


@sql("SELECT event_id, ts FROM events WHERE (ts, event_id) < (SELECT (ts, event_id) FROM events WHERE event_id = 100) ORDER BY ts DESC, event_id DESC LIMIT 25")
def keyset_page(spark, d):
    return versioned.keyset_page(read(spark, d, "events").select("event_id", "ts"), "ts", "event_id", 25, 100)


@sql("SELECT CASE doctype WHEN 'act' THEN 1 WHEN 'decree' THEN 2 WHEN 'regulation' THEN 3 ELSE 4 END AS rank, id, year FROM laws ORDER BY rank, year DESC NULLS LAST, id LIMIT 100", "laws")
def review_queue(spark, d):
    return versioned.ranked_by_case(once(spark, d, "laws", "year", "doctype"), "doctype", ["act", "decree", "regulation"], [F.desc_nulls_last("year"), F.asc("id")], 100).select("rank", "id", "year")


@sql("RECURSIVE + w AS (SELECT id, id AS ancestor_id, 0 AS depth FROM versions UNION ALL SELECT w.id, p.parent_version_id, w.depth + 1 FROM w JOIN versions p ON p.id = w.ancestor_id WHERE p.parent_version_id IS NOT NULL AND w.depth < 100) SELECT id, ancestor_id, depth FROM w", "versions")
def version_lineage(spark, d):
    return versioned.lineage(once(spark, d, "versions", "parent_version_id"))


_EDGES = f"""+ e AS (SELECT a.id AS effect_id, {SQL_URI.format('l.frbr_work_uri')} AS src, {SQL_URI.format('a.target_frbr_uri')} AS dst, a.akn_category, a.akn_action
  FROM amendment_effects a JOIN versions v ON v.id = a.version_id JOIN laws l ON l.id = v.law_id)"""
_EBASE = ("amendment_effects", "versions", "laws")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.law_edges(read(spark, d, "amendment_effects"), read(spark, d, "versions"), read(spark, d, "laws"))


@sql(f"""{_EDGES}, h AS (SELECT DISTINCT src, dst FROM e), s AS (SELECT min(src) AS node FROM h),
w1 AS (SELECT h.src AS near, h.dst AS node, 1 AS depth, [h.src] AS path FROM h JOIN s ON s.node = h.src),
w2 AS (SELECT h.src AS near, h.dst AS node, 2 AS depth, list_append(path, h.src) AS path FROM w1 JOIN h ON h.src = w1.node WHERE NOT list_contains(path, w1.node)),
w3 AS (SELECT h.src AS near, h.dst AS node, 3 AS depth FROM w2 JOIN h ON h.src = w2.node WHERE NOT list_contains(path, w2.node))
SELECT node, near, depth FROM w1 UNION ALL SELECT node, near, depth FROM w2 UNION ALL SELECT node, near, depth FROM w3""".replace("node, near, depth FROM w1", "node, near, depth FROM w1"), *_EBASE)
def citation_walk(spark, d):
    """Three hops out from the first work, by paths."""
    e = _edges(spark, d)
    return graph.walk(e, e.agg(F.min("src").alias("node")), 3)


@sql(f"{_EDGES} SELECT src, dst, akn_category, count(*) AS n FROM e WHERE src <> dst GROUP BY src, dst, akn_category", *_EBASE)
def counterparties(spark, d):
    return graph.counterparties(_edges(spark, d))


@sql(f"{_EDGES}, p AS (SELECT dst, akn_action, src, count(*) AS n FROM e GROUP BY dst, akn_action, src) SELECT dst, akn_action, max(n) AS multiplicity, count(*) AS owners FROM p GROUP BY dst, akn_action", *_EBASE)
def effects_fold(spark, d):
    """Effects on a work mirrored by several amending works, each at its greatest multiplicity."""
    return graph.fold_mirrors(_edges(spark, d), ["dst", "akn_action"], "src")


@sql(f"SELECT v.id AS version_id, l.id AS work_id FROM versions v JOIN laws l ON {SQL_URI.format('l.frbr_work_uri')} = {SQL_URI.format(chr(114) + 'egexp_replace(regexp_replace(v.expression_uri, ' + chr(39) + '#.*$' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + '(/[a-z]{3}(@.*)?|@.*)$' + chr(39) + ', ' + chr(39) * 2 + ')')}", "versions", "laws")
def prefix_join(spark, d):
    """Expression URIs under the works they begin with."""
    versions = once(spark, d, "versions").select(F.col("id").alias("version_id"), "expression_uri")
    return graph.under_work(versions, "expression_uri", once(spark, d, "laws").select(F.col("id").alias("work_id"), "frbr_work_uri"), "frbr_work_uri").select("version_id", "work_id")


@sql("SELECT p_partkey, CASE WHEN c = '123' THEN 'equal' WHEN starts_with(c, '123') THEN 'narrower' ELSE 'broader' END AS relation FROM (SELECT p_partkey, p_partkey::VARCHAR AS c FROM part) WHERE starts_with(c, '123') OR c = '12'")
def prefix_codes(spark, d):
    codes = read(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("c"))
    return graph.narrower_or_broader(codes, "c", "123").select("p_partkey", "relation")


_STATE = f"""+ e AS (SELECT {SQL_URI.format('target_frbr_uri')} AS work, target_akn_wid, in_force_date AS d, coalesce(applied, true) AS ok,
  CASE WHEN trim(akn_action) = 'entryIntoForce' THEN 'force' WHEN trim(akn_action) = 'repeal' THEN 'repeal' WHEN trim(akn_action) IN ('substitution', 'insertion') THEN 'text' ELSE 'other' END AS k FROM amendment_effects)"""


@sql(_STATE + """, g AS (SELECT work, target_akn_wid, max(d) FILTER (WHERE ok AND d <= DATE '2015-06-30' AND k = 'repeal') AS r, max(d) FILTER (WHERE ok AND d <= DATE '2015-06-30' AND k = 'text') AS t,
 min(d) FILTER (WHERE ok AND d <= DATE '2015-06-30' AND k = 'other') AS o, max(d) FILTER (WHERE ok AND k = 'force' AND d <= DATE '2015-06-30') AS live, min(d) FILTER (WHERE ok AND k = 'force' AND d > DATE '2015-06-30') AS fut, bool_or(ok AND k = 'force') AS named
 FROM e WHERE target_akn_wid IS NOT NULL GROUP BY work, target_akn_wid)
SELECT * FROM (SELECT work, target_akn_wid, CASE WHEN r IS NOT NULL THEN 'repealed' WHEN named AND live IS NULL THEN 'not_yet_in_force' WHEN t IS NOT NULL THEN 'text_unapplied' WHEN o IS NOT NULL THEN 'affected' WHEN live IS NOT NULL THEN 'in_force' END AS state,
 CASE WHEN r IS NOT NULL THEN r WHEN named AND live IS NULL THEN fut ELSE coalesce(t, o, live) END AS since FROM g) WHERE state IS NOT NULL""", "amendment_effects")
def state_at(spark, d):
    """Every provision's state on a day."""
    effects = once(spark, d, "amendment_effects", "target_frbr_uri", "target_akn_wid", "in_force_date", "applied", "akn_action").withColumn("work", work_uri(F.col("target_frbr_uri")))
    return timeline.state_at(effects, "work", "target_akn_wid", "2015-06-30")


@sql(_STATE + """, x AS (SELECT *, d IS NULL OR d <= DATE '2015-06-30' AS by_now FROM e WHERE d IS NULL OR d <= DATE '2015-06-30' OR k = 'force')
SELECT count(*) FILTER (WHERE target_akn_wid IS NULL AND by_now) AS no_target,
 count(*) FILTER (WHERE target_akn_wid IS NOT NULL AND CASE WHEN k = 'force' THEN NOT ok AND by_now ELSE d IS NOT NULL AND NOT ok END) AS unapplied_by_publisher,
 count(*) FILTER (WHERE target_akn_wid IS NOT NULL AND d IS NULL AND (k <> 'force' OR ok)) AS undated,
 count(*) FILTER (WHERE target_akn_wid IS NOT NULL AND ok AND d IS NOT NULL AND k = 'text') AS needs_text,
 count(*) FILTER (WHERE target_akn_wid IS NOT NULL AND ok AND d IS NOT NULL AND k = 'other') AS out_of_scope FROM x""", "amendment_effects")
def timeline_holes(spark, d):
    return timeline.holes(once(spark, d, "amendment_effects", "target_akn_wid", "in_force_date", "applied", "akn_action"), "target_akn_wid", "2015-06-30")


@sql(f"SELECT DISTINCT {SQL_URI.format('target_frbr_uri')} AS work, in_force_date FROM amendment_effects WHERE in_force_date IS NOT NULL", "amendment_effects")
def change_dates(spark, d):
    return timeline.change_dates(once(spark, d, "amendment_effects", "target_frbr_uri", "in_force_date").withColumn("work", work_uri(F.col("target_frbr_uri"))), "work")


_FIND = """+ f AS (SELECT l.jurisdiction_code, p.akn_type AS check_name, p.excluded_from_pool AS failed, p.created_at FROM provisions p JOIN versions v ON v.id = p.version_id JOIN laws l ON l.id = v.law_id)"""
_RATE = "count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE NOT failed) AS passed, count(*) FILTER (WHERE failed IS NULL) AS not_run, round(count(*) FILTER (WHERE failed) / nullif(count(*) FILTER (WHERE failed IS NOT NULL), 0), 6) AS rate"
_FBASE = ("provisions", "versions", "laws")


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """Exclusion of a provision from the pool as a check with three outcomes."""
    law = once(spark, d, "versions", "law_id").select(F.col("id").alias("version_id"), "law_id").join(once(spark, d, "laws", "jurisdiction_code").select(F.col("id").alias("law_id"), "jurisdiction_code"), "law_id")
    return once(spark, d, "provisions", "version_id", "akn_type", "excluded_from_pool", "created_at").join(law, "version_id").select("jurisdiction_code", F.col("akn_type").alias("check_name"), F.col("excluded_from_pool").alias("failed"), "created_at")


@sql(f"{_FIND} SELECT jurisdiction_code, check_name, {_RATE} FROM f GROUP BY jurisdiction_code, check_name", *_FBASE)
def finding_rates(spark, d):
    return findings.rates(_findings(spark, d), ["jurisdiction_code", "check_name"])


@sql(f"""{_FIND}, a AS (SELECT jurisdiction_code, check_name, {_RATE} FROM f WHERE created_at < TIMESTAMP '2024-01-01' GROUP BY ALL), b AS (SELECT jurisdiction_code, check_name, {_RATE} FROM f WHERE created_at >= TIMESTAMP '2024-01-01' GROUP BY ALL)
SELECT coalesce(a.jurisdiction_code, b.jurisdiction_code) AS jurisdiction_code, coalesce(a.check_name, b.check_name) AS check_name, a.rate AS rate_before, b.rate AS rate_after, round(b.rate - a.rate, 6) AS delta, b.check_name IS NULL AS stopped, a.check_name IS NULL AS started
FROM a FULL JOIN b ON a.jurisdiction_code = b.jurisdiction_code AND a.check_name = b.check_name""", *_FBASE)
def finding_rate_delta(spark, d):
    f, by = _findings(spark, d), ["jurisdiction_code", "check_name"]
    return findings.rate_delta(findings.rates(f.where("created_at < TIMESTAMP '2024-01-01'"), by), findings.rates(f.where("created_at >= TIMESTAMP '2024-01-01'"), by), by)


@sql("SELECT count(DISTINCT version_id) AS scanned FROM provisions WHERE excluded_from_pool IS NOT NULL")
def scanned_distinct(spark, d):
    return read(spark, d, "provisions").where("excluded_from_pool IS NOT NULL").agg(F.count_distinct("version_id").alias("scanned"))


@sql("SELECT version_id, CASE WHEN count(*) FILTER (WHERE excluded_from_pool IS NULL) > 0 THEN NULL ELSE round(count(*) FILTER (WHERE excluded_from_pool) / count(*), 6) END AS share FROM provisions GROUP BY version_id", "provisions")
def excluded_share(spark, d):
    return findings.share_or_null(once(spark, d, "provisions", "version_id", "excluded_from_pool"), ["version_id"], "excluded_from_pool")


@sql("SELECT 'doctype' AS facet, doctype AS value, count(*) AS n FROM laws WHERE status = 'enacted' GROUP BY doctype UNION ALL SELECT 'status', status, count(*) FROM laws WHERE doctype = 'act' GROUP BY status", "laws")
def facets_skip_own(spark, d):
    return findings.facets(once(spark, d, "laws", "doctype", "status"), {"doctype": F.col("doctype") == "act", "status": F.col("status") == "enacted"})


@sql("SELECT o_custkey, o_orderkey, count(l_orderkey) AS n_rows, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1) o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o_custkey, o_orderkey")
def latest_run_rollup(spark, d):
    """Rows of the latest run per subject, zero kept (runs: orders)."""
    runs = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return findings.rollup_latest(runs, read(spark, d, "lineitem"), ["o_custkey"], "o_orderdate", "o_orderkey", "l_orderkey", {"returned": F.col("l_returnflag") == "R"})


@sql("SELECT j.code, count(l.id) AS n FROM jurisdictions j LEFT JOIN (SELECT * FROM laws WHERE deleted_at IS NOT NULL) l ON l.jurisdiction_code = j.code GROUP BY j.code", "laws")
def zero_counts(spark, d):
    gone = once(spark, d, "laws", "jurisdiction_code", "deleted_at").where("deleted_at IS NOT NULL")
    return findings.zero_preserving_counts(read(spark, d, "jurisdictions").select("code"), gone, "code", "jurisdiction_code", "id")


@sql("SELECT split_part(akn_eid, '__', 1) AS outer_eid, akn_type, count(*) AS n FROM provisions GROUP BY 1, 2", "provisions")
def findings_by_unit(spark, d):
    return once(spark, d, "provisions", "akn_eid", "akn_type").groupBy(findings.outermost(F.col("akn_eid")).alias("outer_eid"), "akn_type").agg(F.count("*").alias("n"))


@sql("SELECT id FROM provisions WHERE akn_eid = 'sec_5' OR starts_with(akn_eid, 'sec_5__')", "provisions")
def findings_under_unit(spark, d):
    return once(spark, d, "provisions", "akn_eid").where(findings.under_eid(F.col("akn_eid"), "sec_5")).select("id")


@sql("SELECT e.event_id, p.prior_event_type FROM events e LEFT JOIN (SELECT user_id, max_by(event_type, (ts, event_type)) AS prior_event_type FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id) p USING (user_id) WHERE e.ts >= TIMESTAMP '2024-01-15'")
def carry_forward(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return versioned.carry_forward(e.where("ts < TIMESTAMP_NTZ '2024-01-15'"), e.where("ts >= TIMESTAMP_NTZ '2024-01-15'"), ["user_id"], "ts", "event_type").select("event_id", "prior_event_type")


@sql("SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY user_id, event_type")
def rate_limit(spark, d):
    return read(spark, d, "events").where("ts >= TIMESTAMP_NTZ '2024-01-20'").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


_DIV = "1 - len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))"


@sql(f"""+ t AS (SELECT doc_id, text, list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents)
SELECT a.doc_id, CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN round({_DIV.format('a.w', 'b.w')}, 6) END AS divergence FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def divergence(spark, d):
    """Token-set distance of every document and the next."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    return docs.join(following, "doc_id").select("doc_id", quality.divergence(F.col("text"), F.col("next")).alias("divergence"))


@sql("""+ t AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '(\\S+)', 1) AS w FROM documents), g AS (SELECT doc_id, text, len(w) AS n, [array_to_string(w[i:i+5], ' ') FOR i IN range(1, len(w) - 4)] AS g FROM t)
SELECT doc_id, CASE WHEN length(trim(text, ' ')) >= 40 AND n >= 12 THEN round(1 - len(list_distinct(g)) / len(g), 6) END AS repeat_density FROM g""")
def repeat_density(spark, d):
    return quality.repeat_densities(read(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "repeat_density")


@sql("""+ n AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '([0-9][0-9.,]*)', 1), lambda x: regexp_replace(regexp_replace(x, '[.,]+$', ''), ',', '', 'g')) AS a FROM documents),
p AS (SELECT x.doc_id, CASE WHEN len(x.a) >= len(y.a) THEN x.a ELSE y.a END AS f, CASE WHEN len(x.a) >= len(y.a) THEN y.a ELSE x.a END AS o FROM n x JOIN n y ON y.doc_id = x.doc_id + 1)
SELECT doc_id, round(list_sum([least(len(list_filter(f, lambda z: z = v)), len(list_filter(o, lambda z: z = v))) FOR v IN list_distinct(f)]) / nullif(len(f), 0), 6) AS parity FROM p""")
def numeral_parity(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    return quality.numeral_parity(docs.join(following, "doc_id"), "doc_id", "text", "next")


@sql("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?:^|[^\\p{L}])((?:[A-Za-z] ){3,}[A-Za-z])(?:[^\\p{L}]|$)', 1)) AS runs FROM documents")
def letter_spaced(spark, d):
    return read(spark, d, "documents").select("doc_id", quality.letter_spaced(F.col("text")).alias("runs"))


_FW = "CASE lang " + " ".join(f"WHEN '{k}' THEN len(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in v)})))" for k, v in quality.FUNCTION_WORDS.items()) + " END"


@sql(f"""+ t AS (SELECT doc_id, lang, {SQL_TOKENS.format('text')} AS t FROM documents), r AS (SELECT doc_id, CASE WHEN len(t) >= 200 THEN round({_FW} * 1000.0 / len(t), 3) END AS rate FROM t)
SELECT doc_id, rate, CASE WHEN rate >= 120 THEN 'good' WHEN rate >= 80 THEN 'fair' WHEN rate >= 40 THEN 'poor' WHEN rate IS NOT NULL THEN 'illegible' END AS band FROM r""")
def legibility(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", search.tokens(F.col("text")).alias("t"))
    rated = docs.select("doc_id", quality.function_word_rate(F.col("t"), F.col("lang")).alias("rate"))
    return rated.withColumn("band", quality.band(F.col("rate")))


@sql("""+ t AS (SELECT id, trim(coalesce(text, ''), ' ') AS t, akn_eid FROM provisions), w AS (SELECT *, regexp_matches(lower(t), '\\b(shall|must|may|should|is|are|will|has|have|be|means)\\b') AS op, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) AS n, length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) AS an, length(regexp_replace(t, '[^\\p{Nd}]', '', 'g')) AS dg FROM t)
SELECT id, CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '(?i)^\\s*\\[[^\\]\\n]{0,200} not transcribed: [^\\]\\n]{0,250}\\]\\s*$') THEN 'placeholder' WHEN n < 25 AND NOT op AND regexp_matches(t, '\\|.+\\||\\.{4,}|_{3,}|☐') THEN 'table' WHEN starts_with(akn_eid, 'att_') AND NOT op AND an > 0 AND dg > an * 0.3 THEN 'digits' END AS reason FROM w""", "provisions")
def exclusion_reason(spark, d):
    return once(spark, d, "provisions").select("id", quality.exclusion_reason(F.col("text"), F.col("akn_eid")).alias("reason"))


@sql("""+ t AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '(\\S+)', 1) AS w FROM documents), g AS (SELECT doc_id, text, len(w) AS n, [array_to_string(w[i:i+5], ' ') FOR i IN range(1, len(w) - 4)] AS g FROM t),
r AS (SELECT doc_id, CASE WHEN length(trim(text, ' ')) >= 40 AND n >= 12 THEN round(1 - len(list_distinct(g)) / len(g), 6) END AS r FROM g)
SELECT CASE WHEN r > 0.5 THEN 'escalate' WHEN r IS NULL THEN 'reread' ELSE 'accept' END AS verdict, count(*) AS n FROM r GROUP BY 1""")
def page_verdicts(spark, d):
    """Verdicts of all documents read alone (no rival reading)."""
    none = F.lit(None).cast("double")
    rated = quality.repeat_densities(read(spark, d, "documents").select("doc_id", "text"), "text")
    return rated.groupBy(quality.page_verdict(F.col("repeat_density"), none, none).alias("verdict")).agg(F.count("*").alias("n"))


@sql("""+ x AS (SELECT DISTINCT version_id, position FROM provisions), l AS (SELECT *, lead(position) OVER (PARTITION BY version_id ORDER BY position) - position - 1 AS run FROM x),
g AS (SELECT version_id, sum(greatest(coalesce(run, 0), 0))::BIGINT AS n_missing, max(coalesce(run, 0))::BIGINT AS max_run, min(position) AS lo, max(position) AS hi FROM l GROUP BY version_id)
SELECT *, CASE WHEN n_missing = 0 THEN 'none' WHEN max_run >= 3 OR n_missing / (hi - lo + 1) > 0.30 THEN 'defect' WHEN max_run = 1 AND n_missing <= 3 THEN 'repeal' ELSE 'ambiguous' END AS gap FROM g""", "provisions")
def gap_class(spark, d):
    return quality.gaps(read(spark, d, "provisions").select("version_id", "position"), ["version_id"], "position")


@sql("SELECT l_orderkey, l_linenumber FROM (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_linenumber) AS prev FROM lineitem) WHERE prev >= l_linenumber")
def monotonic_breaks(spark, d):
    return quality.breaks(read(spark, d, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber"], "l_linenumber").select("l_orderkey", "l_linenumber")


@sql("SELECT version_id, md5(text) AS said, count(*) AS n FROM provisions WHERE text <> '' GROUP BY version_id, said HAVING count(*) > 1", "provisions")
def duplicate_texts(spark, d):
    """Texts that occur more than once within a version."""
    said = once(spark, d, "provisions").where("text <> ''").groupBy("version_id", F.md5(F.col("text").cast("binary")).alias("said"))
    return said.agg(F.count("*").alias("n")).where("n > 1")


@sql("SELECT version_id, akn_eid, count(*) AS n FROM provisions GROUP BY version_id, akn_eid HAVING count(*) > 1", "provisions")
def duplicate_eids(spark, d):
    return once(spark, d, "provisions", "version_id", "akn_eid").groupBy("version_id", "akn_eid").agg(F.count("*").alias("n")).where("n > 1")


_RED = "coalesce(text, '')"
for _kind, _pattern in quality.REDACTIONS.items():
    _RED = "regexp_replace({}, '{}', '[redacted {}]', 'g')".format(_RED, _pattern.replace("'", "''"), _kind)


@sql(f"SELECT doc_id, md5({_RED}) AS redacted FROM documents")
def redact(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(quality.redact(F.coalesce("text", F.lit(""))).cast("binary")).alias("redacted"))


@sql("SELECT jurisdiction_code, m, n, CASE WHEN n < 5 THEN 'insufficient' WHEN m / n >= 0.85 THEN 'full' WHEN m / n >= 0.5 THEN 'partial' ELSE 'low' END AS level FROM (SELECT jurisdiction_code, count(*) FILTER (WHERE status = 'enacted') AS m, count(*) AS n FROM laws GROUP BY jurisdiction_code)", "laws")
def alignment_level(spark, d):
    g = once(spark, d, "laws", "jurisdiction_code", "status").groupBy("jurisdiction_code").agg(F.count_if(F.col("status") == "enacted").alias("m"), F.count("*").alias("n"))
    return g.withColumn("level", quality.alignment_level(F.col("m"), F.col("n")))


@sql("""+ n AS (SELECT id, list_transform(regexp_extract_all(concat_ws(' ', number, title), '(\\d{1,9})', 1), lambda x: x::INT) AS n FROM laws)
SELECT id, CASE WHEN n[2] BETWEEN 1200 AND 2200 THEN n[1] WHEN n[1] BETWEEN 1200 AND 2200 THEN n[2] END AS number, CASE WHEN n[2] BETWEEN 1200 AND 2200 THEN n[2] WHEN n[1] BETWEEN 1200 AND 2200 THEN n[1] END AS year FROM n WHERE len(n) = 2""", "laws")
def citation_parse(spark, d):
    named = once(spark, d, "laws").select("id", F.concat_ws(" ", "number", "title").alias("text"))
    c = named.select("id", quality.citation(F.col("text")).alias("c"), F.size(F.regexp_extract_all("text", F.lit(r"(\d{1,9})"), F.lit(1))).alias("k"))
    return c.where("k = 2").select("id", "c.number", "c.year")


@sql(_BM25 + """, gold AS (SELECT 'q' AS query, id AS doc FROM provisions WHERE position = 1 AND list_has_any({0}, ['water'])),
rk AS (SELECT id AS doc, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored), h AS (SELECT count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM rk JOIN gold USING (doc) WHERE rank <= 50), n AS (SELECT count(*) AS n FROM gold)
SELECT 'q' AS query, round(hits / n, 6) AS recall, round(coalesce(1 / first, 0), 6) AS rr, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 51) t(i) WHERE i <= n), 6) AS ndcg FROM h, n WHERE n > 0""".replace("{0}", SQL_TOKENS.format("text")), "provisions")
def ranking_metrics(spark, d):
    """Recall, reciprocal rank and nDCG at 50 of the lexical list against first provisions on water."""
    provisions = once(spark, d, "provisions")
    gold = provisions.where(F.col("position") == 1).where(F.array_contains(search.tokens(F.col("text")), "water")).select(F.lit("q").alias("query"), F.col("id").alias("doc"))
    top = search.top_k(_scored(spark, d), "id", 50)
    ranked = top.select(F.lit("q").alias("query"), F.col("id").alias("doc"), F.expr("row_number() OVER (ORDER BY score DESC, id)").alias("rank"))
    return search.retrieval_metrics(ranked, gold, 50)
