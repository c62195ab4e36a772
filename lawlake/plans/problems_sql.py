"""The general problems' results in plain SQL (DuckDB), for comparison."""

P6 = """
WITH uris AS (
  SELECT DISTINCT id AS law_id, regexp_replace(lower(regexp_replace(frbr_work_uri, '^\\s+|\\s+$', '', 'g')), '/$', '') AS uri, created_at, deleted_at FROM laws),
provs AS (
  SELECT DISTINCT p.id, p.version_id, u.uri, regexp_replace(regexp_replace(p.akn_wid, '^\\s+|\\s+$', '', 'g'), '^#', '') AS wid, p.created_at, p.deleted_at
  FROM provisions p LEFT JOIN (SELECT DISTINCT id, law_id FROM versions) v ON v.id = p.version_id LEFT JOIN uris u ON u.law_id = v.law_id),
refs AS (
  SELECT DISTINCT id, created_at, version_id,
    regexp_replace(lower(regexp_replace(target_frbr_uri, '^\\s+|\\s+$', '', 'g')), '/$', '') AS uri,
    regexp_replace(regexp_replace(target_akn_wid, '^\\s+|\\s+$', '', 'g'), '^#', '') AS twid,
    regexp_replace(regexp_replace(source_akn_wid, '^\\s+|\\s+$', '', 'g'), '^#', '') AS swid FROM amendment_effects),
hits AS (
  SELECT r.id, 'target_frbr_uri' AS ref_field, r.created_at AS ref_at, u.law_id AS hit, u.created_at, u.deleted_at
  FROM refs r LEFT JOIN uris u ON u.uri = r.uri WHERE r.uri IS NOT NULL
  UNION ALL
  SELECT r.id, 'target_akn_wid', r.created_at, p.id, p.created_at, p.deleted_at
  FROM refs r LEFT JOIN provs p ON p.uri = r.uri AND p.wid = r.twid
  WHERE r.twid IS NOT NULL AND r.uri IN (SELECT uri FROM uris WHERE uri IS NOT NULL)
  UNION ALL
  SELECT r.id, 'source_akn_wid', r.created_at, p.id, p.created_at, p.deleted_at
  FROM refs r LEFT JOIN provs p ON p.version_id = r.version_id AND p.wid = r.swid WHERE r.swid IS NOT NULL),
judged AS (
  SELECT id AS effect_id, ref_field, strftime(ref_at, '%Y-%m') AS period,
    CASE WHEN count(hit) = 0 THEN 'missing'
         WHEN count(hit) FILTER (WHERE deleted_at IS NULL) = 0 THEN 'deleted'
         WHEN min(created_at) FILTER (WHERE hit IS NOT NULL AND deleted_at IS NULL) > ref_at THEN 'late' END AS reason
  FROM hits GROUP BY id, ref_field, ref_at)
SELECT effect_id, ref_field, period, reason FROM judged WHERE reason IS NOT NULL
"""

P7 = """
WITH held AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY publisher_effect_id ORDER BY revision DESC, feed_seq DESC) AS rn FROM effect_feed) WHERE rn = 1),
eff AS (
  SELECT *, lower(trim(regexp_replace(akn_action, '^\\s+|\\s+$', '', 'g'))) AS action FROM held
  WHERE applied AND in_force_date IS NOT NULL AND target_akn_wid IS NOT NULL),
kinds AS (
  SELECT *, CASE WHEN action IN ('insertion', 'reenactment') THEN 'put' WHEN action IN ('substitution', 'replacement', 'variation') THEN 'text'
                 WHEN action IN ('repeal', 'endofenactment') THEN 'gone' END AS kind,
    row_number() OVER (PARTITION BY target_frbr_uri, target_akn_wid ORDER BY in_force_date, effect_no, publisher_effect_id) AS n FROM eff),
k AS (
  SELECT target_frbr_uri, target_akn_wid, max(n) FILTER (WHERE kind = 'put') AS put, max(n) FILTER (WHERE kind = 'gone') AS gone,
    max(n) FILTER (WHERE kind IN ('put', 'text')) AS said FROM kinds GROUP BY ALL)
SELECT k.target_frbr_uri, k.target_akn_wid, e.publisher_effect_id FROM k
JOIN kinds e ON e.target_frbr_uri = k.target_frbr_uri AND e.target_akn_wid = k.target_akn_wid AND e.n = k.said
WHERE k.put IS NOT NULL AND (k.gone IS NULL OR k.put > k.gone)
"""

P5 = """
WITH RECURSIVE last AS (
  SELECT run_id, max_by(cutoff_at, (logged_at, lower(trim(status)))) AS cutoff_at, max_by(lower(trim(status)), (logged_at, lower(trim(status)))) AS status FROM acquisition_runs GROUP BY run_id),
ok AS (SELECT run_id, cutoff_at, row_number() OVER (ORDER BY cutoff_at, run_id) AS idx FROM last WHERE status = 'success'),
f AS (
  SELECT fetch_id, any_value(source_url) AS url, any_value(fetched_at) AS fetched_at, min(landed_at) AS av,
    any_value(nullif(regexp_replace(regexp_replace(trim(etag), '^[Ww]/', ''), '^"|"$', '', 'g'), '')) AS tag,
    any_value(coalesce(epoch(try_strptime(last_modified, '%a, %d %b %Y %H:%M:%S GMT')), epoch(try_cast(CASE WHEN last_modified LIKE '____-__-__T%' THEN last_modified END AS TIMESTAMPTZ)))) AS lm
  FROM acquired_documents GROUP BY fetch_id),
g AS (SELECT f.*, (SELECT min(idx) FROM ok WHERE ok.cutoff_at >= f.av) AS idx FROM f),
h AS (SELECT url, idx, max((fetched_at, fetch_id)) AS k, max_by({'tag': tag, 'lm': lm}, (fetched_at, fetch_id)) AS c FROM g WHERE idx IS NOT NULL GROUP BY url, idx),
m AS (SELECT *, max(k) OVER (PARTITION BY url ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM h),
s AS (SELECT url, idx, k[2] AS fetch_id, c.tag AS tag, c.lm AS lm, row_number() OVER (PARTITION BY url ORDER BY idx) AS rn FROM m WHERE was IS NULL OR k > was),
w AS (
  SELECT url, rn, idx, fetch_id, true AS is_case, fetch_id AS c_id, tag AS c_tag, lm AS c_lm FROM s WHERE rn = 1
  UNION ALL
  SELECT url, rn, idx, fetch_id, is_case, CASE WHEN is_case THEN fetch_id ELSE c_id END, CASE WHEN is_case THEN tag ELSE c_tag END, CASE WHEN is_case THEN lm ELSE c_lm END FROM (
    SELECT s.*, w.c_id, w.c_tag, w.c_lm, CASE WHEN s.fetch_id = w.c_id THEN false WHEN s.tag IS NOT NULL AND w.c_tag IS NOT NULL THEN s.tag <> w.c_tag WHEN s.lm IS NOT NULL AND w.c_lm IS NOT NULL THEN s.lm <> w.c_lm ELSE true END AS is_case
    FROM w JOIN s ON s.url = w.url AND s.rn = w.rn + 1))
SELECT ok.run_id, w.fetch_id FROM w JOIN ok ON ok.idx = w.idx WHERE w.is_case
"""
