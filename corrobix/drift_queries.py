"""Registered queries about change: rollouts of an endpoint, days to admission, decisions at checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import drift, scoring
from .plans.registered import query
from .sources.observations import evidence_cube, from_star_schema
from .sources.tables import written

_FRACTIONS, _HORIZON, _DAYS = (0.1, 0.2, 0.4, 0.6, 0.8, 1.0), 120, (1, 7, 30, 60, 120)
_CHECKPOINTS = (0, 180, 365, 730, 1460, 2600)

# Every day of every rollout is scored from its own rows.
_ROLLOUT = f""", fr AS (SELECT CAST(f AS DOUBLE) AS fraction FROM (VALUES {", ".join(f"({f})" for f in _FRACTIONS)}) t(f)),
st AS (SELECT device_type, site_id, CAST((min({{'seq': seq, 'ts': ts}})).ts AS DATE) AS day, any_value(weight) AS weight FROM obs JOIN weights USING (site_id) GROUP BY 1, 2),
ho AS (SELECT device_type, count(*) AS eligible, sum(weight) AS all_w FROM st GROUP BY 1 HAVING count(*) > 1),
ch AS (SELECT * FROM (SELECT st.*, eligible, all_w, fraction, row_number() OVER (PARTITION BY device_type, fraction ORDER BY sha256(site_id), site_id) AS place FROM st JOIN ho USING (device_type), fr) WHERE place <= greatest(1, round(eligible * fraction))),
gr AS (SELECT device_type, fraction, count(*) AS sites, any_value(eligible) AS eligible, sum(weight) / any_value(all_w) AS conf FROM ch GROUP BY 1, 2),
dr AS (SELECT device_type, fraction, r.d AS rollout_days, ch.day + CAST(i.i AS INTEGER) AS day FROM ch, range(1, {_HORIZON + 1}) r(d), range(1, {_HORIZON + 1}) i(i) WHERE i.i <= r.d),
nd AS (SELECT x.device_type, fraction, rollout_days, count(DISTINCT x.day) AS days, count(DISTINCT CASE WHEN k.day IS NULL THEN x.day END) AS fresh, count(*) AS n
  FROM dr x LEFT JOIN (SELECT DISTINCT device_type, day FROM cube) k ON k.device_type = x.device_type AND k.day = x.day GROUP BY 1, 2, 3),
tc AS (SELECT nd.*, sites, eligible, conf, least(1.0, CAST(0.7 AS DOUBLE) * CAST(days AS DOUBLE) / (device_days + fresh) + CAST(0.3 AS DOUBLE) * CAST(nd.n AS DOUBLE) / (device_n + nd.n)) AS temp FROM nd JOIN gr USING (device_type, fraction) JOIN dev USING (device_type)),
ro AS (SELECT device_type, fraction, rollout_days, sites, eligible, conf, temp, 0.6::DOUBLE * conf + 0.4::DOUBLE * temp AS score, sites >= 2 AND round(0.6::DOUBLE * conf + 0.4::DOUBLE * temp, 9) >= 0.65 AS accepted FROM tc)
"""


def _starts(spark, d, cube: DataFrame) -> DataFrame:
    """Where each site's part of a rollout begins: the day of its first row of the device type."""
    rows = from_star_schema(spark, d).groupBy("device_type", "site_id").agg(F.to_date(F.min(F.struct("seq", "timestamp"))["timestamp"]).alias("day"))
    return rows.join(scoring.trust_weights(cube).select("site_id", "weight"), "site_id")


def _rollout(spark, d) -> DataFrame:
    cube = written(evidence_cube(from_star_schema(spark, d)), "cube")
    return drift.rollout(cube, drift.adopters(_starts(spark, d, cube), _FRACTIONS), _HORIZON)


@query(_ROLLOUT + f"SELECT device_type, fraction, rollout_days, sites, round(conf, 6) AS site_confidence, round(temp, 6) AS temporal_confidence, round(score, 6) AS score, accepted FROM ro WHERE rollout_days IN {_DAYS}")
def drift_rollout(spark, d):
    """A new endpoint at growing shares of a device type's sites, after some lengths of its rollout."""
    rows = _rollout(spark, d).where(F.col("rollout_days").isin(*_DAYS))
    return rows.select("device_type", "fraction", "rollout_days", F.col("supporting_sites").alias("sites"), *(F.round(c, 6).alias(c) for c in ("site_confidence", "temporal_confidence", "score")), "accepted")


@query(_ROLLOUT + "SELECT device_type, fraction, min(CASE WHEN accepted THEN rollout_days END) AS first_admitted_day FROM ro GROUP BY 1, 2")
def days_to_admission(spark, d):
    """The first day on which each rollout is admitted."""
    return drift.first_admitted(_rollout(spark, d))


@query(_ROLLOUT + f""", fa AS (SELECT device_type, fraction, min(CASE WHEN accepted THEN rollout_days END) AS day FROM ro GROUP BY 1, 2),
ps AS (SELECT device_type, min(CASE WHEN accepted THEN fraction END) AS p FROM ro WHERE rollout_days = {_HORIZON} GROUP BY 1)
SELECT count(day) AS admitted, count(*) AS cases, round(quantile_cont(day, 0.5), 6) AS median_days, round(quantile_cont(day, 0.9), 6) AS p90_days, (SELECT count(*) FROM ps WHERE p IS NULL) AS never, (SELECT round(avg(p), 6) FROM ps) AS mean_least_fraction FROM fa""")
def drift_summary(spark, d):
    """Rollouts that are admitted within the horizon, the days they take, and the share of sites that it takes."""
    rows = written(_rollout(spark, d), "rollout")
    days = drift.first_admitted(rows).agg(F.count("first_admitted_day").alias("admitted"), F.count("*").alias("cases"), *(F.round(F.percentile("first_admitted_day", F.lit(p)), 6).alias(n) for p, n in ((0.5, "median_days"), (0.9, "p90_days"))))
    least = drift.least_fraction(rows, _HORIZON).agg(F.count_if(F.col("least_fraction").isNull()).alias("never"), F.round(F.avg("least_fraction"), 6).alias("mean_least_fraction"))
    return days.crossJoin(F.broadcast(least))


_EXPECTED = 0.6  # a rollout at this share of the sites should be promoted


@query(_ROLLOUT + f""", so AS (SELECT device_type, eligible, fraction, all_w, site_id, day, weight FROM (SELECT st.*, eligible, all_w, CAST(1 AS DOUBLE) / eligible AS fraction, row_number() OVER (PARTITION BY device_type ORDER BY site_id) AS place FROM st JOIN ho USING (device_type)) WHERE place = 1),
cases AS (SELECT 'legitimate' AS scenario, score, CASE WHEN fraction >= {_EXPECTED} THEN accepted ELSE NOT accepted END AS correct, accepted FROM ro WHERE rollout_days = {_HORIZON}
UNION ALL SELECT 'compromise', 0.6::DOUBLE * weight / all_w + 0.4::DOUBLE * least(1.0, 0.7::DOUBLE * s.d / (device_days + s.d - (SELECT count(*) FROM (SELECT DISTINCT device_type, day FROM cube) k WHERE k.device_type = so.device_type AND k.day > so.day AND k.day <= so.day + CAST(s.d AS INTEGER))) + 0.3::DOUBLE * s.d / (device_n + s.d)), true, false FROM so JOIN dev USING (device_type), (VALUES (1), (30), (120)) s(d))
SELECT scenario, count(*) AS cases, round(avg(CAST(correct AS INTEGER)), 6) AS accuracy, count(*) FILTER (accepted) AS promoted, round(avg(score), 6) AS mean_score FROM cases GROUP BY 1""")
def drift_classification(spark, d):
    """Rollouts over many sites should be promoted, what one compromised site repeats should not, however long."""
    cube = written(evidence_cube(from_star_schema(spark, d)), "cube")
    starts = written(_starts(spark, d, cube), "starts")
    wide = drift.rollout(cube, drift.adopters(starts, _FRACTIONS), _HORIZON).where(F.col("rollout_days") == _HORIZON)
    hosts = starts.groupBy("device_type").agg(F.count("*").alias("eligible_sites"), F.sum("weight").alias("all_weight"), F.min(F.struct("site_id", "day", "weight")).alias("s")).where("eligible_sites > 1")
    single = hosts.select("device_type", "eligible_sites", "all_weight", "s.*", (1 / F.col("eligible_sites")).alias("fraction"))
    lone = drift.rollout(cube, single, _HORIZON).where(F.col("rollout_days").isin(1, 30, 120))
    right = F.when(F.col("fraction") >= _EXPECTED, F.col("accepted")).otherwise(~F.col("accepted"))
    cases = wide.select(F.lit("legitimate").alias("scenario"), "score", "accepted", right.alias("correct")).unionByName(lone.select(F.lit("compromise").alias("scenario"), "score", "accepted", (~F.col("accepted")).alias("correct")))
    return cases.groupBy("scenario").agg(F.count("*").alias("cases"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), F.count_if("accepted").alias("promoted"), F.round(F.avg("score"), 6).alias("mean_score"))


def _checkpoint_sql() -> str:
    """Every checkpoint scored from the cube up to its day."""
    parts = []
    for c in _CHECKPOINTS:
        parts.append(f"""SELECT {c} AS checkpoint, f.*, supporting_sites >= 2 AND class <> 'other' AND 0.6::DOUBLE * (CAST(supporting_sites AS DOUBLE) / eligible_sites) + 0.4::DOUBLE * least(1.0, 0.7::DOUBLE * CAST(days AS DOUBLE) / greatest(dd, 1) + 0.3::DOUBLE * CAST(f.n AS DOUBLE) / greatest(dn, 1)) >= 0.65 AS accepted
FROM (SELECT device_type, endpoint, protocol, port, count(DISTINCT site_id) AS supporting_sites, count(DISTINCT day) AS days, sum(n) AS n FROM cube WHERE day <= (SELECT min(day) FROM cube) + {c} GROUP BY ALL) f
JOIN (SELECT device_type, count(DISTINCT site_id) AS eligible_sites, count(DISTINCT day) AS dd, sum(n) AS dn FROM cube WHERE day <= (SELECT min(day) FROM cube) + {c} GROUP BY 1) USING (device_type)
JOIN (SELECT device_type, endpoint, protocol, port, endpoint_class AS class FROM base) USING (device_type, endpoint, protocol, port)""")
    return ", cp AS (" + " UNION ALL ".join(parts) + ")\n"


@query(_checkpoint_sql() + "SELECT checkpoint, count(*) AS facts, count(*) FILTER (accepted) AS accepted FROM cp GROUP BY 1")
def checkpoint_scores(spark, d):
    """Facts and admitted facts at each checkpoint, scored on what had been seen by then."""
    rows = drift.checkpoint_scores(written(evidence_cube(from_star_schema(spark, d)), "cube"), _CHECKPOINTS)
    return rows.groupBy("checkpoint").agg(F.count("*").alias("facts"), F.count_if("accepted").alias("accepted"))


@query(_checkpoint_sql() + f""", od AS (SELECT unnest(range(1, {len(_CHECKPOINTS) + 1})) AS step, unnest([{", ".join(map(str, _CHECKPOINTS))}]) AS checkpoint),
ok AS (SELECT step, device_type, endpoint, protocol, port FROM cp JOIN od USING (checkpoint) WHERE accepted),
ev AS (SELECT coalesce(a.step, b.step + 1) AS step, a.step IS NOT NULL AS now, b.step IS NOT NULL AS before FROM ok a FULL JOIN ok b ON a.step = b.step + 1 AND a.device_type = b.device_type AND a.endpoint = b.endpoint AND a.protocol = b.protocol AND a.port = b.port)
SELECT checkpoint, count(*) FILTER (now) AS accepted, count(*) FILTER (now AND NOT before) AS added, count(*) FILTER (before AND NOT now) AS removed, count(*) FILTER (now <> before) AS updates FROM od LEFT JOIN ev USING (step) GROUP BY 1""")
def decision_churn(spark, d):
    """Policy updates between checkpoints: facts that the score begins or ceases to admit."""
    cube = written(evidence_cube(from_star_schema(spark, d)), "cube")
    return drift.decision_churn(drift.checkpoint_scores(cube, _CHECKPOINTS), _CHECKPOINTS)
