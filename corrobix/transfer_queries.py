"""Registered queries about transfer: groups of sites left out, cold starts, registrable domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _OTHERS, _truth
from .functions.keys import KEY
from .operators import domains, overlap, scoring, transfer
from .plans.registered import query
from .sources.observations import evidence_cube, from_star_schema
from .sources.tables import written

_K = ", ".join(KEY)
_WINDOWS = (0, 90, 730)


def _cube(spark, d):
    return written(evidence_cube(from_star_schema(spark, d)), "cube")


@query(f""", grp AS (SELECT DISTINCT site_id, CASE WHEN site_id <> 'site-9' THEN 'lab-' || (CAST(split_part(site_id, '-', 2) AS INTEGER) % 3) END AS g FROM cube),
left_ AS (SELECT h.g AS left_out, c.* FROM (SELECT DISTINCT g FROM grp WHERE g IS NOT NULL) h, cube c JOIN grp USING (site_id) WHERE grp.g IS NULL OR grp.g <> h.g),
lf AS (SELECT left_out, {_K}, count(DISTINCT site_id) AS ss, count(DISTINCT day) AS ds, sum(n) AS ns FROM left_ GROUP BY ALL), ld AS (SELECT left_out, device_type, count(DISTINCT site_id) AS es, count(DISTINCT day) AS dd, sum(n) AS dn FROM left_ GROUP BY 1, 2),
ls AS (SELECT left_out, {_K}, ss >= 2 AND endpoint_class <> 'other' AND 0.6::DOUBLE * (CAST(ss AS DOUBLE) / es) + 0.4::DOUBLE * least(1.0, 0.7::DOUBLE * CAST(ds AS DOUBLE) / greatest(dd, 1) + 0.3::DOUBLE * CAST(ns AS DOUBLE) / greatest(dn, 1)) >= 0.65 AS ok FROM lf JOIN ld USING (left_out, device_type) JOIN (SELECT {_K}, endpoint_class FROM base) USING ({_K}))
SELECT left_out, count(*) AS facts, count(*) FILTER (ok) AS accepted, count(*) FILTER (ok AND accepted) AS kept, count(*) FILTER (ok AND NOT accepted) AS gained FROM ls JOIN scored USING ({_K}) GROUP BY 1""")
def leave_group_out(spark, d):
    """Facts that are admitted without each lab's sites, beside what all sites admit; one site belongs to no lab."""
    cube = _cube(spark, d)
    lab = F.concat(F.lit("lab-"), (F.substring_index("site_id", "-", -1).cast("int") % 3).cast("string"))
    groups = cube.select("site_id").distinct().withColumn("left_out", F.when(F.col("site_id") != "site-9", lab))
    rows = transfer.leave_group_out(cube, groups).select("left_out", *KEY, F.col("accepted").alias("ok")).join(scoring.score(cube).select(*KEY, "accepted"), list(KEY))
    return rows.groupBy("left_out").agg(F.count("*").alias("facts"), F.count_if("ok").alias("accepted"), F.count_if(F.col("ok") & F.col("accepted")).alias("kept"), F.count_if(F.col("ok") & ~F.col("accepted")).alias("gained"))


_COLD = _OTHERS + f""", acc AS (SELECT receiver, {_K} FROM oscored WHERE ss >= 2 AND endpoint_class <> 'other' AND score >= CAST(0.65 AS DOUBLE)),
truth AS (SELECT {_K} FROM keyed WHERE response_observed GROUP BY ALL HAVING count(DISTINCT site_id) >= 3), tt AS (SELECT DISTINCT device_type FROM truth),
nx AS (SELECT device_type AS own, coalesce(lead(device_type) OVER (ORDER BY device_type), min(device_type) OVER ()) AS device_type FROM tt),
tg AS (SELECT * FROM rc SEMI JOIN tt USING (device_type)),
loc AS (SELECT site_id AS receiver, {_K}, min(day) - min(begin) AS age FROM cube JOIN (SELECT site_id, min(day) AS begin FROM cube GROUP BY 1) USING (site_id) GROUP BY ALL),
js AS (SELECT site_id, count(*) AS size FROM pairs GROUP BY 1), jc AS (SELECT p.site_id, q.site_id AS other, count(*) AS common FROM pairs p JOIN pairs q USING ({_K}) WHERE p.site_id <> q.site_id GROUP BY 1, 2),
ne AS (SELECT jc.site_id AS receiver, arg_min(other, (-CAST(common AS DOUBLE) / (x.size + y.size - common), other)) AS nearest FROM jc JOIN js x ON x.site_id = jc.site_id JOIN js y ON y.site_id = jc.other GROUP BY 1),
prior AS (SELECT 'registry' AS method, * FROM acc
  UNION SELECT 'pooled union', receiver, p.device_type, endpoint, protocol, port FROM tg JOIN pairs p ON p.device_type = tg.device_type AND p.site_id <> receiver
  UNION SELECT 'nearest site', receiver, p.device_type, endpoint, protocol, port FROM tg JOIN ne USING (receiver) JOIN pairs p ON p.device_type = tg.device_type AND p.site_id = nearest
  UNION SELECT 'mismatched type', receiver, own, endpoint, protocol, port FROM acc JOIN nx USING (device_type)
  UNION SELECT 'mismatched type', receiver, own, endpoint, protocol, port FROM (SELECT DISTINCT receiver FROM rc) r, scored JOIN nx USING (device_type) WHERE accepted AND NOT EXISTS (SELECT 1 FROM rc WHERE rc.receiver = r.receiver AND rc.device_type = scored.device_type)),
ways AS (SELECT * FROM (VALUES ('local only'), ('registry'), ('pooled union'), ('nearest site'), ('mismatched type')) m(method), (VALUES {", ".join(f"({w})" for w in _WINDOWS)}) w("window")),
pred AS (SELECT method, "window", receiver, {_K} FROM prior JOIN ways USING (method) SEMI JOIN tg USING (receiver, device_type) UNION SELECT method, "window", receiver, {_K} FROM loc CROSS JOIN ways SEMI JOIN tg USING (receiver, device_type) WHERE age < "window"),
cnt AS (SELECT method, "window", receiver, device_type, count(*) AS n, count(t) AS hits FROM pred LEFT JOIN (SELECT *, 1 AS t FROM truth) USING ({_K}) GROUP BY ALL),
met AS (SELECT method, "window", receiver, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, all_true FROM tg CROSS JOIN ways JOIN (SELECT device_type, count(*) AS all_true FROM truth GROUP BY 1) USING (device_type) LEFT JOIN cnt USING (method, "window", receiver, device_type))
SELECT receiver, "window", method, count(*) AS devices, CAST(sum(n) AS BIGINT) AS predicted, round(avg(CASE WHEN n > 0 THEN CAST(hits AS DOUBLE) / n ELSE 0 END), 6) AS precision, round(avg(CAST(hits AS DOUBLE) / all_true), 6) AS recall, round(avg(2.0::DOUBLE * hits / (n + all_true)), 6) AS f1 FROM met GROUP BY ALL
"""


@query(_COLD)
def cold_start_priors(spark, d):
    """For every site and three windows: how well its first days' facts, with each of five priors, meet the reference facts."""
    cube = _cube(spark, d)
    nearest = transfer.nearest_by_all_facts(overlap.site_jaccard(cube), cube)
    rows = transfer.cold_start(cube, written(_truth(spark, d), "truth"), written(nearest, "nearest"), _WINDOWS)
    return rows.select("receiver", "window", "method", "devices", "predicted", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


_SUFFIXES = ("com", "example.com", "*.v1.example.com", "!api.v9.example.com", "// not a rule", "v12.example.com")


@query("""SELECT domain, count(*) AS facts, count(DISTINCT site_id) AS sites FROM (SELECT site_id, CASE
  WHEN fqdn IS NULL THEN NULL WHEN fqdn = 'api.v9.example.com' THEN fqdn WHEN fqdn LIKE '%.v1.example.com' THEN NULL WHEN fqdn LIKE '%.v12.example.com' THEN fqdn
  ELSE array_to_string(string_split(fqdn, '.')[-3:], '.') END AS domain FROM (SELECT DISTINCT site_id, fqdn FROM obs)) GROUP BY 1""")
def registrable_domains(spark, d):
    """Names and sites by registrable domain, under suffix rules with a wildcard and an exception."""
    rules = domains.suffix_rules(spark.createDataFrame([(x,) for x in _SUFFIXES], "line string"))
    rows = domains.with_registrable(from_star_schema(spark, d).select("site_id", "fqdn").distinct(), rules)
    return rows.groupBy("domain").agg(F.count("*").alias("facts"), F.count_distinct("site_id").alias("sites"))
