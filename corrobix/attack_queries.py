"""Registered queries of attacks on the busiest device type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.keys import KEY
from .operators import attacks, overlap, scoring
from .plans.oracle import BASE
from .plans.registered import query
from .sources.observations import evidence_cube, from_star_schema
from .sources.tables import written

_K = ", ".join(KEY)
FAKE = "api.fake.example.com"
_RECURSIVE = BASE.replace("WITH raw", "WITH RECURSIVE raw", 1)
_TARGET = """, tgt AS (SELECT device_type FROM dev ORDER BY device_n DESC, device_type LIMIT 1), tc AS (SELECT c.* FROM cube c JOIN tgt USING (device_type)), first AS (SELECT min(day) AS start, count(DISTINCT site_id) AS hosts FROM tc),
ranked AS (SELECT site_id, row_number() OVER (ORDER BY sha256(site_id)) AS place FROM (SELECT DISTINCT site_id FROM tc)),
placed AS (SELECT *, row_number() OVER (ORDER BY sha256(concat_ws('|', device_type, endpoint, protocol, port)), endpoint, protocol, port) - 1 AS place FROM (SELECT DISTINCT device_type, endpoint, protocol, port FROM tc)),
facts AS (SELECT count(*) AS facts FROM placed)
"""
_FALSE = f"SELECT scenario, 'sybil-' || i AS site_id, device_type, '{FAKE}' AS endpoint, 'https' AS protocol, 443 AS port, start + CAST(d AS INTEGER) AS day FROM (SELECT scenario, days, unnest(range(0, sites)) AS i FROM grid), tgt, first, LATERAL (SELECT unnest(range(0, days)) AS d)"
_PAD = """SELECT scenario, 'sybil-' || i AS site_id, device_type, endpoint, protocol, port, start AS day FROM (
  SELECT scenario, i, CASE WHEN j < common THEN j ELSE common + (i * (used - common) + j - common) % greatest(facts - common, 1) END AS place FROM (
    SELECT scenario, facts, used, least(used, CAST(round(used * shared) AS BIGINT)) AS common, i, unnest(range(0, used)) AS j FROM (SELECT scenario, facts, least(padding, facts) AS used, shared, unnest(range(0, sites)) AS i FROM grid, facts))) p JOIN placed USING (place), first"""


def _real(bad: str) -> str:
    """Rows of the first sites by hash; bad: endpoint, protocol, port."""
    return f"SELECT scenario, site_id, device_type, endpoint, protocol, port, start + CAST(d AS INTEGER) AS day FROM (SELECT scenario, real_sites, unnest(range(0, days)) AS d FROM grid) g JOIN ranked ON place <= real_sites, tgt, first, ({bad}) bad"


_ONE_FAKE = f"SELECT '{FAKE}' AS endpoint, 'https' AS protocol, 443 AS port"


def _attack_sql(grid: str, injected: str) -> str:
    modes = {"vanilla": "CAST(sites AS DOUBLE) / all_sites", "trust": "w / all_w", "independence": "CAST(c AS DOUBLE) / all_c", "combined": "m / all_m"}
    scores = ", ".join(f"round(0.6 * ({x}) + 0.4 * t, 9) AS score_{m}" for m, x in modes.items())
    tests = ", ".join(f"gate AND score_{m} >= 0.65 AS accepted_{m}" for m in modes)
    return _TARGET + f""", grid AS ({grid}), inj AS ({injected}),
ac AS (SELECT scenario, site_id, {_K}, day, n FROM grid, tc UNION ALL SELECT scenario, site_id, {_K}, day, 1 FROM inj),
af AS (SELECT scenario, {_K}, count(DISTINCT day) AS days, sum(n) AS n FROM ac GROUP BY ALL), ad AS (SELECT scenario, count(DISTINCT day) AS dd, sum(n) AS dn FROM ac GROUP BY 1),
ap AS (SELECT DISTINCT scenario, site_id, {_K} FROM ac),
fresh AS (SELECT scenario, site_id, count(*) AS more FROM (SELECT DISTINCT scenario, site_id, {_K} FROM inj) ANTI JOIN pairs USING (site_id, {_K}) GROUP BY 1, 2),
aw AS (SELECT s.scenario, s.site_id, least(1.0, (coalesce(b.breadth, 0) + coalesce(more, 0)) / (SELECT any_value(reference) FROM weights)) AS weight, coalesce(b.weight, 0.1) AS frozen
  FROM (SELECT DISTINCT scenario, site_id FROM ap) s LEFT JOIN weights b USING (site_id) LEFT JOIN fresh USING (scenario, site_id)),
asz AS (SELECT scenario, site_id, count(*) AS size FROM ap GROUP BY 1, 2),
near AS (SELECT p.scenario, p.site_id AS a, q.site_id AS b FROM ap p JOIN ap q USING (scenario, {_K}) JOIN asz x ON x.scenario = p.scenario AND x.site_id = p.site_id JOIN asz y ON y.scenario = p.scenario AND y.site_id = q.site_id
  GROUP BY 1, 2, 3, x.size, y.size HAVING CAST(count(*) AS DOUBLE) / (x.size + y.size - count(*)) >= 0.35),
reach AS (SELECT scenario, site_id, site_id AS other FROM asz UNION SELECT r.scenario, r.site_id, e.b FROM reach r JOIN near e ON e.scenario = r.scenario AND e.a = r.other),
acl AS (SELECT scenario, site_id, min(other) AS cluster FROM reach GROUP BY 1, 2),
ss AS (SELECT scenario, {_K}, sum(k) AS sites, sum(w) AS w, sum(m) AS m, sum(f) AS f, count(*) AS c FROM (SELECT scenario, {_K}, cluster, count(*) AS k, sum(weight) AS w, max(weight) AS m, sum(frozen) AS f FROM ap JOIN aw USING (scenario, site_id) JOIN acl USING (scenario, site_id) GROUP BY ALL) GROUP BY ALL),
ee AS (SELECT scenario, sum(k) AS all_sites, sum(w) AS all_w, sum(m) AS all_m, sum(f) AS all_f, count(*) AS all_c FROM (SELECT scenario, cluster, count(*) AS k, sum(weight) AS w, max(weight) AS m, sum(frozen) AS f FROM aw JOIN acl USING (scenario, site_id) GROUP BY ALL) GROUP BY 1),
raw_rows AS (SELECT ss.*, ee.* EXCLUDE (scenario), least(1.0, CAST(0.7 AS DOUBLE) * CAST(days AS DOUBLE) / greatest(dd, 1) + CAST(0.3 AS DOUBLE) * CAST(n AS DOUBLE) / greatest(dn, 1)) AS t, NOT EXISTS (SELECT 1 FROM tc WHERE tc.endpoint = ss.endpoint AND tc.protocol = ss.protocol AND tc.port = ss.port) AS injected,
  sites >= 2 AND CASE WHEN endpoint LIKE '10.%' THEN FALSE WHEN port IN (53, 123) THEN TRUE ELSE endpoint LIKE 'update.%' OR endpoint LIKE 'api.%' END AS gate FROM ss JOIN ee USING (scenario) JOIN af USING (scenario, {_K}) JOIN ad USING (scenario)),
srows AS (SELECT *, {tests}, score_rwv > 0.65 AS accepted_rwv FROM (SELECT *, {scores}, round(f / all_f, 9) AS score_rwv FROM raw_rows)),
report AS (SELECT scenario, {', '.join(f"round(max(score_{m}) FILTER (injected), 6) AS fake_score_{m}, coalesce(bool_or(accepted_{m}) FILTER (injected), FALSE) AS fake_accepted_{m}, count(*) FILTER (NOT injected AND accepted_{m}) AS legit_accepted_{m}" for m in attacks.MODES)} FROM srows GROUP BY 1)
"""


def _cube(spark, d) -> DataFrame:
    return written(evidence_cube(from_star_schema(spark, d)), "cube")


def _grid(cube: DataFrame, rows: list[tuple], columns: str) -> DataFrame:
    """Scenarios on the busiest device type; real_share, where given, becomes a number of its sites."""
    grid = cube.sparkSession.createDataFrame(rows, columns).crossJoin(F.broadcast(attacks.busiest_device(cube)))
    if "real_share" in grid.columns:
        hosts = cube.groupBy("device_type").agg(F.count_distinct("site_id").alias("hosts"))
        grid = grid.join(hosts, "device_type").withColumn("real_sites", F.round(F.col("hosts") * F.col("real_share")).cast("int"))
    return written(grid, "grid")


def _malicious(cube: DataFrame, rows: list[tuple]) -> DataFrame:
    bad = cube.sparkSession.createDataFrame(rows, "endpoint string, protocol string, port int")
    return cube.groupBy("device_type").agg(F.min("day").alias("day")).crossJoin(F.broadcast(bad)).select(*KEY, "day")


def _compromised(cube: DataFrame, grid: DataFrame, rows: list[tuple]) -> DataFrame:
    return attacks.compromised_sites(cube, grid.drop("sites").withColumnRenamed("real_sites", "sites"), _malicious(cube, rows))


_FRACTIONS = (0.1, 0.2, 0.3, 0.5, 0.8)


@query(_attack_sql(f"SELECT 'f' || f AS scenario, CAST(round(hosts * f) AS INTEGER) AS real_sites, 1 AS days FROM first, (SELECT unnest({list(_FRACTIONS)})::DOUBLE AS f)", _real(_ONE_FAKE)) + "SELECT * FROM report", _RECURSIVE)
def poisoning_resistance(spark, d):
    """A share of the real sites reports one false endpoint once."""
    cube = _cube(spark, d)
    grid = _grid(cube, [(f"f{f}", f, 1) for f in _FRACTIONS], "scenario string, real_share double, days int")
    return attacks.attack_report(attacks.under_attack(cube, grid, _compromised(cube, grid, [(FAKE, "https", 443)])))


_COUNTS, _DAYS = (1, 2, 4, 8, 16, 32, 64, 128), (1, 7, 20, 60, 120, 200)
_SURFACE = _attack_sql(f"SELECT 's' || s || 'd' || d AS scenario, s AS sites, d AS days FROM (SELECT unnest({list(_COUNTS)}) AS s), (SELECT unnest({list(_DAYS)}) AS d)", _FALSE)


def _surface(spark, d) -> DataFrame:
    cube = _cube(spark, d)
    grid = _grid(cube, [(f"s{s}d{n}", s, n) for s in _COUNTS for n in _DAYS], "scenario string, sites int, days int")
    return attacks.attack_report(attacks.under_attack(cube, grid, attacks.false_sites(cube, grid, FAKE)))


@query(_SURFACE + "SELECT * FROM report", _RECURSIVE)
def sybil_surface(spark, d):
    """Number of false sites by days they persist, under every way of scoring."""
    return _surface(spark, d)


@query(_SURFACE + " UNION ALL ".join(
    f"""SELECT '{m}' AS mode, bool_and(NOT fake_accepted_{m}) AS resists, min(s) FILTER (fake_accepted_{m}) AS first_break, arg_max(fake_score_{m}, struct_pack(s := s, f := fake_score_{m})) AS score_at_most, min(s) FILTER (legit_accepted_{m} = 0) AS first_empty
FROM (SELECT *, CAST(regexp_extract(scenario, 's([0-9]+)', 1) AS INTEGER) AS s FROM report)""" for m in attacks.MODES), _RECURSIVE)  # fmt: skip
def sybil_surface_summary(spark, d):
    """For every way of scoring: whether it resists, the fewest false sites that break it or empty the device's profile."""
    rows = attacks.by_mode(written(_surface(spark, d), "surface")).withColumn("s", F.regexp_extract("scenario", "s([0-9]+)", 1).cast("int"))
    return attacks.grid_summary(rows, "s")


@query(_attack_sql("SELECT 'f' || f || 'd' || d AS scenario, 8 AS sites, d AS days, CAST(round(hosts * f) AS INTEGER) AS real_sites FROM first, (SELECT unnest([0.2, 0.5])::DOUBLE AS f), (SELECT unnest([5, 60]) AS d)", _FALSE + " UNION ALL " + _real(_ONE_FAKE)) + "SELECT * FROM report", _RECURSIVE)
def combined_attack(spark, d):
    """A share of the real sites and eight false ones report the same endpoint."""
    cube = _cube(spark, d)
    grid = _grid(cube, [(f"f{f}d{n}", 8, n, f) for f in (0.2, 0.5) for n in (5, 60)], "scenario string, sites int, days int, real_share double")
    injected = attacks.false_sites(cube, grid, FAKE).unionByName(_compromised(cube, grid, [(FAKE, "https", 443)]))
    return attacks.attack_report(attacks.under_attack(cube, grid, injected))


def _padded(spark, d, rows: list[tuple]) -> tuple[DataFrame, DataFrame]:
    cube = _cube(spark, d)
    grid = _grid(cube, rows, "scenario string, sites int, days int, padding long, shared double")
    injected = written(attacks.false_sites(cube, grid, FAKE).unionByName(attacks.padding(cube, grid)), "padded")
    scored = attacks.attack_report(attacks.under_attack(cube, grid, injected))
    target = cube.join(grid.select("device_type").distinct(), "device_type").select("site_id", *KEY).distinct()
    every = grid.select("scenario", "device_type").join(target, "device_type").select("scenario", "site_id", *KEY).unionByName(injected.select("scenario", "site_id", *KEY)).distinct()
    every = written(every, "every")
    return scored, attacks.false_site_structure(every, attacks._clusters(every, 0.35))


_STRUCTURE = " JOIN (SELECT scenario, CAST(sum(size) AS BIGINT) AS false_sites, count(*) AS clusters, max(size) AS largest FROM (SELECT scenario, cluster, count(*) AS size FROM acl WHERE site_id LIKE 'sybil-%' GROUP BY 1, 2) GROUP BY 1) USING (scenario)"


@query(_attack_sql("SELECT 'p' || p AS scenario, 6 AS sites, 40 AS days, p AS padding, CAST(0 AS DOUBLE) AS shared FROM (SELECT unnest([0, 4, 30]) AS p)", _FALSE + " UNION ALL " + _PAD) + "SELECT * FROM report" + _STRUCTURE, _RECURSIVE)
def diversified_sybil(spark, d):
    """Six false sites that each report other real facts too, to look unlike each other and broad; with their clusters."""
    scored, structure = _padded(spark, d, [(f"p{p}", 6, 40, p, 0.0) for p in (0, 4, 30)])
    return scored.join(structure, "scenario")


@query(_attack_sql("SELECT 'o' || o AS scenario, 6 AS sites, 40 AS days, 12 AS padding, o AS shared FROM (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS o)", _FALSE + " UNION ALL " + _PAD) + "SELECT * FROM report" + _STRUCTURE, _RECURSIVE)
def overlap_controlled_sybil(spark, d):
    """The same with a set share of the added facts common to all false sites."""
    scored, structure = _padded(spark, d, [(f"o{o}", 6, 40, 12, o) for o in (0.0, 0.5, 1.0)])
    return scored.join(structure, "scenario")


_BAD = [("8.9.1.1", "udp", 53), ("8.9.1.2", "https", 443)]
_BAD_SQL = "SELECT endpoint, protocol, CAST(port AS INTEGER) AS port FROM (VALUES {}) v(endpoint, protocol, port)"
_K_DAYS = [(k, n) for k in (1, 3, 5) for n in (1, 40)]


def _compromised_sql(bad: list[tuple]) -> str:
    values = _BAD_SQL.format(", ".join(map(str, bad)))
    grid = f"SELECT 'k' || k || 'd' || d AS scenario, k AS real_sites, d AS days FROM (VALUES {', '.join(map(str, _K_DAYS))}) v(k, d)"
    return _attack_sql(grid, _real(values)) + " UNION ALL ".join(
        f"""SELECT scenario, '{m}' AS mode, round(CAST(count(*) FILTER (accepted_{m} AND bad) AS DOUBLE) / 2, 6) AS malicious_admission_rate, round(CAST(coalesce(sum(clean) FILTER (NOT accepted_{m} AND NOT bad), 0) AS DOUBLE) / any_value(hosts), 6) AS benign_exceptions_per_site
FROM (SELECT r.*, b.endpoint IS NOT NULL AS bad, coalesce(f.supporting_sites, 0) AS clean FROM srows r LEFT JOIN ({values}) b ON b.endpoint = r.endpoint AND b.protocol = r.protocol AND b.port = r.port LEFT JOIN fact f ON {' AND '.join(f'f.{k} = r.{k}' for k in KEY)}), first GROUP BY 1"""
        for m in attacks.MODES
    )


def _compromised_baseline(spark, d, malicious: DataFrame, cube: DataFrame) -> DataFrame:
    grid = _grid(cube, [(f"k{k}d{n}", k, n) for k, n in _K_DAYS], "scenario string, sites int, days int")
    malicious = malicious.join(grid.select("device_type").distinct(), "device_type")
    rows = attacks.under_attack(cube, grid, attacks.compromised_sites(cube, grid, malicious))
    return attacks.compromised_report(written(rows, "rows"), cube, malicious)


@query(_compromised_sql(_BAD), _RECURSIVE)
def compromised_baseline(spark, d):
    """Malicious addresses learned at k sites for a day or 40: admission and what benign facts the policy lacks."""
    cube = _cube(spark, d)
    return _compromised_baseline(spark, d, _malicious(cube, _BAD), cube)


@query(_compromised_sql([(f"api.p{e.replace('.', '-')}.peer.example.com", p, n) for e, p, n in _BAD]), _RECURSIVE)
def compromised_resolved(spark, d):
    """The same under names, as if every malicious address had been resolved: names pass the class gate."""
    cube = _cube(spark, d)
    return _compromised_baseline(spark, d, attacks.resolved_peers(_malicious(cube, _BAD)), cube)


@query(f""", oc AS (SELECT CASE WHEN site_id IN ('site-8', 'site-9') THEN 'org-a' WHEN site_id IN ('site-6', 'site-7') THEN 'org-b' ELSE site_id END AS site_id, {_K}, day, n FROM cube)
SELECT device_type, supporting, count(*) AS facts FROM (SELECT {_K}, count(DISTINCT site_id) AS supporting FROM oc GROUP BY ALL) GROUP BY 1, 2""")
def joined_organisations(spark, d):
    """Facts by support once sites of one organisation count as one."""
    cube = _cube(spark, d)
    orgs = spark.createDataFrame([("site-8", "org-a"), ("site-9", "org-a"), ("site-6", "org-b"), ("site-7", "org-b")], "site_id string, organisation string")
    return scoring.fact_totals(attacks.joined_organisations(cube, orgs)).groupBy("device_type", F.col("supporting_sites").alias("supporting")).agg(F.count("*").alias("facts"))


_TAUS = tuple(i / 20 for i in range(1, 20, 2))
_SWEEP = f""", taus AS (SELECT CAST(t AS DOUBLE) AS tau FROM (VALUES {", ".join(f"({t})" for t in _TAUS)}) v(t)),
se AS (SELECT tau, device_type, a, b FROM jac, taus WHERE jaccard >= tau UNION ALL SELECT tau, device_type, b, a FROM jac, taus WHERE jaccard >= tau),
sr AS (SELECT tau, device_type, site_id, site_id AS other FROM sizes, taus UNION SELECT r.tau, r.device_type, r.site_id, e.b FROM sr r JOIN se e ON e.tau = r.tau AND e.device_type = r.device_type AND e.a = r.other),
sc AS (SELECT tau, device_type, site_id, min(other) AS cluster FROM sr GROUP BY 1, 2, 3)
"""


@query(_SWEEP + "SELECT tau, device_type, count(*) AS clusters, max(n) AS largest FROM (SELECT tau, device_type, cluster, count(*) AS n FROM sc GROUP BY 1, 2, 3) GROUP BY 1, 2", _RECURSIVE)
def cluster_sweep(spark, d):
    """Clusters of sites at every threshold, cut from one spanning forest."""
    cube = _cube(spark, d)
    sizes = overlap.clusters_at(overlap.spanning_forest(overlap.site_jaccard(cube)), cube, _TAUS).groupBy("tau", "device_type", "cluster").agg(F.count("*").alias("n"))
    return sizes.groupBy("tau", "device_type").agg(F.count("*").alias("clusters"), F.max("n").alias("largest"))


@query(_SWEEP + f"""SELECT tau, count(*) AS facts, count(*) FILTER (supporting_sites >= 2 AND endpoint_class <> 'other' AND round(0.6::DOUBLE * c / all_c + 0.4::DOUBLE * temporal_confidence, 9) >= 0.65) AS accepted, round(avg(CAST(c AS DOUBLE) / all_c), 6) AS site_confidence
FROM (SELECT tau, {_K}, count(DISTINCT cluster) AS c FROM pairs JOIN sc USING (device_type, site_id) GROUP BY ALL) JOIN (SELECT tau, device_type, count(DISTINCT cluster) AS all_c FROM sc GROUP BY 1, 2) USING (tau, device_type) JOIN base USING ({_K}) GROUP BY 1""", _RECURSIVE)
def jaccard_threshold_sweep(spark, d):
    """Facts that the cluster-aware score admits at every threshold of similar sites, scored in one pass."""
    cube = _cube(spark, d)
    clusters = written(overlap.clusters_at(overlap.spanning_forest(overlap.site_jaccard(cube)), cube, _TAUS), "clusters")
    pairs = cube.select("site_id", *KEY).distinct().join(clusters, ["device_type", "site_id"])
    support = pairs.groupBy("tau", *KEY).agg(F.count_distinct("cluster").alias("c"))
    eligible = clusters.groupBy("tau", "device_type").agg(F.count_distinct("cluster").alias("all_c"))
    share = F.col("c").cast("double") / F.col("all_c")
    rows = support.join(eligible, ["tau", "device_type"]).join(scoring.score(cube).select(*KEY, "supporting_sites", "endpoint_class", "temporal_confidence"), list(KEY)).withColumn("site_confidence", share)
    admitted = (F.col("supporting_sites") >= 2) & (F.col("endpoint_class") != "other") & (F.round(0.6 * F.col("site_confidence") + 0.4 * F.col("temporal_confidence"), 9) >= 0.65)
    return rows.groupBy("tau").agg(F.count("*").alias("facts"), F.count_if(admitted).alias("accepted"), F.round(F.avg("site_confidence"), 6).alias("site_confidence"))


_MANAGED = _attack_sql(f"SELECT 'f' || f AS scenario, CAST(round(hosts * f) AS INTEGER) AS real_sites, 30 AS days FROM first, (SELECT unnest({list(_FRACTIONS)})::DOUBLE AS f)", _real(_ONE_FAKE)) + f""", gs AS (SELECT DISTINCT site_id FROM tc),
own AS (SELECT scenario, site_id, count(*) AS size, max(CASE WHEN endpoint = '{FAKE}' THEN 1 ELSE 0 END) AS fake FROM ap SEMI JOIN gs USING (site_id) GROUP BY 1, 2),
mf AS (SELECT s.*, af.n AS rows_seen FROM srows s JOIN af USING (scenario, {_K}))
SELECT scenario, 'local only' AS strategy, count(*) AS units, round(avg(size), 6) AS policy_size, max(fake) > 0 AS fake_accepted, round(avg(fake), 6) AS false_grant_rate, CAST(NULL AS DOUBLE) AS fake_score FROM own GROUP BY 1
UNION ALL """ + " UNION ALL ".join(
    f"SELECT scenario, '{name}', 1, CAST(count(*) FILTER ({ok}) AS DOUBLE), coalesce(bool_or(injected AND {ok}), false), CASE WHEN coalesce(bool_or(injected AND {ok}), false) THEN 1.0 ELSE 0.0 END, {score} FROM mf GROUP BY 1"
    for name, ok, score in [("pooled union", "TRUE", "NULL"), ("majority", "CAST(sites AS DOUBLE) / all_sites >= 0.5", "NULL"), ("frequency", "rows_seen >= 2", "NULL"), *((m, f"accepted_{m}", f"round(max(score_{m}) FILTER (injected), 6)") for m in attacks.STRATEGIES[4:])]
)


@query(_MANAGED, _RECURSIVE)
def management_attack(spark, d):
    """What eight ways of managing policies grant when a share of the real sites reports a false endpoint for a month."""
    cube = _cube(spark, d)
    grid = _grid(cube, [(f"f{f}", f, 30) for f in _FRACTIONS], "scenario string, real_share double, days int")
    injected = written(_compromised(cube, grid, [(FAKE, "https", 443)]), "injected")
    return attacks.management_report(attacks.under_attack(cube, grid, injected), cube, grid, injected)
