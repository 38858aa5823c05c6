"""Common table expressions of the SQL that queries are checked against."""

BASE = """WITH raw AS (
  SELECT l.*, o.o_custkey, c.c_nationkey, p.p_brand, CASE WHEN l_linenumber <= 3 THEN l_suppkey % 8 ELSE 8 + l_suppkey END AS k
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN part p ON l_partkey = p_partkey),
obs AS (SELECT l_orderkey * 8 + l_linenumber AS seq, 'site-' || (c_nationkey % 10) AS site_id, 'dev-' || o_custkey AS device_id, lower(p_brand) AS device_type,
  CASE WHEN k % 8 = 3 THEN 'update.v' || k || '.example.com' WHEN k % 8 > 3 THEN 'api.v' || k || '.example.com' END AS fqdn,
  CASE WHEN k % 8 = 1 THEN '10.0.' ELSE '8.8.' END || (k // 250) || '.' || (k % 250) AS remote_ip,
  CASE WHEN k % 8 IN (1, 2, 4) THEN 'udp' ELSE 'https' END AS protocol,
  CAST(CASE WHEN k % 8 IN (1, 4) THEN 53 WHEN k % 8 = 2 THEN 123 ELSE 443 END AS INTEGER) AS port,
  CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ts,
  CASE WHEN k % 8 >= 3 AND l_linestatus = 'O' THEN 'flow+http_host' WHEN k % 8 >= 3 THEN 'flow+tls_sni' ELSE 'flow' END AS evidence_type,
  l_returnflag = 'R' AS response_observed FROM raw),
keyed AS (SELECT *, lower(coalesce(fqdn, remote_ip)) AS endpoint, CAST(ts AS DATE) AS day FROM obs),
cube AS (SELECT site_id, device_type, endpoint, protocol, port, day, count(*) AS n FROM keyed GROUP BY ALL),
pairs AS (SELECT DISTINCT site_id, device_type, endpoint, protocol, port FROM cube),
dev AS (SELECT device_type, count(DISTINCT site_id) AS eligible_sites, count(DISTINCT day) AS device_days, sum(n) AS device_n FROM cube GROUP BY 1),
fact AS (SELECT device_type, endpoint, protocol, port, count(DISTINCT site_id) AS supporting_sites, count(DISTINCT day) AS days, sum(n) AS n FROM cube GROUP BY 1, 2, 3, 4),
base AS (SELECT f.*, d.* EXCLUDE (device_type), CAST(supporting_sites AS DOUBLE) / eligible_sites AS site_confidence,
  least(1.0, CAST(0.7 AS DOUBLE) * CAST(days AS DOUBLE) / greatest(device_days, 1) + CAST(0.3 AS DOUBLE) * CAST(f.n AS DOUBLE) / greatest(device_n, 1)) AS temporal_confidence,
  CASE WHEN endpoint LIKE '10.%' THEN 'other' WHEN port = 53 THEN 'dns' WHEN port = 123 THEN 'ntp' WHEN endpoint LIKE 'update.%' THEN 'update' WHEN endpoint LIKE 'api.%' THEN 'vendor-cloud' ELSE 'other' END AS endpoint_class
  FROM fact f JOIN dev d USING (device_type)),
vanilla AS (SELECT *, CAST(0.6 AS DOUBLE) * site_confidence + CAST(0.4 AS DOUBLE) * temporal_confidence AS score FROM base),
scored AS (SELECT *, supporting_sites >= 2 AND endpoint_class <> 'other' AND score >= CAST(0.65 AS DOUBLE) AS accepted FROM vanilla),
breadth AS (SELECT site_id, count(*) AS breadth FROM pairs GROUP BY 1),
weights AS (SELECT site_id, breadth, reference, least(1.0, breadth / reference) AS weight FROM breadth, (SELECT quantile_cont(breadth, 0.5) AS reference FROM breadth)),
sizes AS (SELECT device_type, site_id, count(*) AS size FROM pairs GROUP BY 1, 2),
jac AS (SELECT x.device_type, x.site_id AS a, y.site_id AS b, coalesce(c.common, 0) AS common, x.size + y.size - coalesce(c.common, 0) AS either,
  CAST(coalesce(c.common, 0) AS DOUBLE) / (x.size + y.size - coalesce(c.common, 0)) AS jaccard
  FROM sizes x JOIN sizes y ON x.device_type = y.device_type AND x.site_id < y.site_id
  LEFT JOIN (SELECT p.device_type, p.site_id AS a, q.site_id AS b, count(*) AS common FROM pairs p JOIN pairs q USING (device_type, endpoint, protocol, port) WHERE p.site_id < q.site_id GROUP BY 1, 2, 3) c
  ON c.device_type = x.device_type AND c.a = x.site_id AND c.b = y.site_id)
"""

EVENTS = """WITH ev AS (SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, 'site-' || (user_id % 10) AS site_id, event_type AS device_type, 'e' || (props::JSON->>'$.k') AS endpoint, value, user_id, CAST(ts AS DATE) AS day FROM events)
"""
