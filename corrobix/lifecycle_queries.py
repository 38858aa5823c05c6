"""Registered queries over the life of facts: states of sites' records, versions of scores, flags for review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import lifecycle, timeline
from .plans.oracle import EVENTS
from .plans.registered import query
from .sources.observations import from_events

_RECURSIVE = EVENTS.replace("WITH ev", "WITH RECURSIVE ev", 1)

# Every site's record is led through all events of its fact, one at a time.
_RECORDS = """, nm AS (SELECT seq, endpoint AS fact, site_id, ['query', 'commit', 'query', 'commit', 'revoke', 'restore_local', 'query', 'commit', 'dispute', 'restore'][seq % 10 + 1] AS op, value >= 20 AS adm,
  row_number() OVER (PARTITION BY endpoint ORDER BY seq) AS i FROM ev WHERE endpoint IS NOT NULL),
rec AS (
  SELECT fact, site_id AS site, CAST(0 AS BIGINT) AS i, 0 AS lvl, CAST(NULL AS VARCHAR) AS who, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS origin, CAST(NULL AS BIGINT) AS moved, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS op, FALSE AS own
  FROM (SELECT DISTINCT fact, site_id FROM nm)
  UNION ALL
  SELECT fact, site, i, CASE WHEN op = 'restore' THEN 0 WHEN down THEN lvl + 1 ELSE lvl END, CASE WHEN down AND lvl = 0 THEN by_site ELSE who END,
    CASE WHEN new IS NULL THEN status ELSE split_part(new, '/', 1) END, CASE WHEN new IS NULL THEN origin ELSE split_part(new, '/', 2) END, CASE WHEN new IS NULL THEN moved ELSE seq END, seq, op, own
  FROM (SELECT *, CASE
      WHEN down AND status IN ('monitor-only', 'active', 'disputed') THEN CASE WHEN lvl = 0 THEN 'disputed/dispute' ELSE 'revoked/dispute' END
      WHEN op = 'restore' AND lvl > 0 AND origin = 'dispute' THEN 'monitor-only/restore'
      WHEN own AND op = 'query' AND status IS NULL AND adm AND lvl = 0 THEN 'monitor-only/query'
      WHEN own AND op = 'commit' AND status = 'monitor-only' AND adm AND lvl = 0 THEN 'active/commit'
      WHEN own AND op = 'revoke' AND status IN ('monitor-only', 'active') THEN 'revoked/local'
      WHEN own AND op = 'restore_local' AND status = 'revoked' AND origin = 'local' AND lvl = 0 THEN 'monitor-only/local' END AS new
    FROM (SELECT r.fact, r.site, n.i, r.lvl, r.who, r.status, r.origin, r.moved, n.seq, n.op, n.site_id = r.site AS own, n.adm, n.site_id AS by_site, n.op = 'dispute' AND (r.lvl = 0 OR r.lvl = 1 AND n.site_id <> r.who) AS down
      FROM rec r JOIN nm n ON n.fact = r.fact AND n.i = r.i + 1))),
final AS (SELECT fact, site AS site_id, status, origin, moved AS seq FROM rec JOIN (SELECT fact, max(i) AS i FROM nm GROUP BY 1) USING (fact, i) WHERE status IS NOT NULL)
"""


def _log(spark, d) -> DataFrame:
    return lifecycle.event_log(from_events(spark, d))


@query(_RECORDS + "SELECT * FROM final", _RECURSIVE)
def lifecycle_fold(spark, d):
    """Status of every endpoint at every site after all events."""
    return timeline.fold(_log(spark, d))


@query(_RECORDS + "SELECT fact, site AS site_id, seq, op, status, origin FROM rec WHERE own AND op IN ('query', 'commit', 'revoke', 'restore_local')", _RECURSIVE)
def lifecycle_trace(spark, d):
    """Each site's record of an endpoint after each of its own events."""
    return timeline.trace(_log(spark, d))


@query(_RECORDS + ", sc AS (SELECT endpoint AS fact, count(DISTINCT user_id) AS score FROM ev GROUP BY 1) SELECT fact, site_id, score, coalesce(score < 12, true) AS review FROM final LEFT JOIN sc USING (fact) WHERE status = 'active'", _RECURSIVE)
def review_flags(spark, d):
    """Active decisions whose endpoint fewer than twelve users have reported: flagged, not changed."""
    scores = from_events(spark, d).groupBy(F.col("endpoint").alias("fact")).agg(F.count_distinct("user_id").alias("score")).withColumn("accepted", F.col("score") >= 12)
    return lifecycle.review_flags(timeline.fold(_log(spark, d)), scores)


# A fact's score, its value while active, and what each event makes of both.
_VERSIONS = """, nm AS (SELECT seq, endpoint AS fact, site_id, value, ['score', 'dispute', 'score', 'dispute', 'score', 'restore', 'score'][seq % 7 + 1] AS op, row_number() OVER (PARTITION BY endpoint ORDER BY seq) AS i FROM ev WHERE endpoint IS NOT NULL),
rec AS (
  SELECT DISTINCT fact, CAST(0 AS BIGINT) AS i, -1 AS lvl, CAST(NULL AS VARCHAR) AS who, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS held, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS event FROM nm
  UNION ALL
  SELECT r.fact, n.i,
    CASE WHEN n.op = 'score' THEN greatest(lvl, 0) WHEN lvl = 0 AND n.op = 'dispute' THEN 1 WHEN lvl = 1 AND n.op = 'dispute' AND n.site_id <> who THEN 2 WHEN lvl > 0 AND n.op = 'restore' THEN 0 ELSE lvl END,
    CASE WHEN lvl = 0 AND n.op = 'dispute' THEN n.site_id ELSE who END,
    CASE WHEN n.op = 'score' THEN n.value WHEN lvl > 0 AND n.op = 'restore' THEN held ELSE r.value END,
    CASE WHEN n.op = 'score' AND lvl <= 0 THEN n.value ELSE held END, n.seq,
    CASE WHEN n.op = 'score' THEN 'score' WHEN lvl = 0 AND n.op = 'dispute' THEN 'dispute' WHEN lvl = 1 AND n.op = 'dispute' AND n.site_id <> who THEN 'revoke' WHEN lvl > 0 AND n.op = 'restore' THEN 'restore' END
  FROM rec r JOIN nm n ON n.fact = r.fact AND n.i = r.i + 1),
ver AS (SELECT fact, seq AS valid_from, lead(seq) OVER (PARTITION BY fact ORDER BY seq) AS valid_to, event, ['active', 'disputed', 'revoked'][lvl + 1] AS status, value AS score, value >= 50 AS accepted FROM rec WHERE event IS NOT NULL)
"""


def _scores(spark, d) -> DataFrame:
    """Rescorings, disputes and restores of endpoints, from the event table's rows."""
    op = F.element_at(F.array(*(F.lit(x) for x in ("score", "dispute", "score", "dispute", "score", "restore", "score"))), (F.col("seq") % 7 + 1).cast("int"))
    return from_events(spark, d).select("seq", F.col("endpoint").alias("fact"), "site_id", op.alias("op"), F.col("value").alias("score"), (F.col("value") >= 50).alias("accepted"))


@query(_VERSIONS + "SELECT * FROM ver", _RECURSIVE)
def score_versions(spark, d):
    """Every version of every endpoint's score; a restore brings the last active version's value back."""
    return timeline.versions(_scores(spark, d))


@query(_VERSIONS + "SELECT e.seq, e.endpoint AS fact, e.site_id, v.status, v.score, v.accepted FROM ev e LEFT JOIN ver v ON v.fact = e.endpoint AND v.valid_from <= e.seq AND (v.valid_to IS NULL OR e.seq < v.valid_to) WHERE e.seq % 5 = 2 AND e.endpoint IS NOT NULL", _RECURSIVE)
def score_as_of(spark, d):
    """What the registry held of an endpoint when a site asked."""
    asked = from_events(spark, d).where("seq % 5 = 2 and endpoint is not null").select("seq", F.col("endpoint").alias("fact"), "site_id")
    return timeline.as_of(timeline.versions(_scores(spark, d)), asked)
