"""Registered reports: audits, statistics, classification, registry reads, graph explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.keys import KEY, key_string, registered_domain, service_class
from .operators import attacks, classify, evaluation, lifecycle, overlap, perturb, scoring, statistics
from .plans.oracle import BASE, EVENTS
from .plans.registered import query
from .sources.observations import evidence_cube, from_events, from_star_schema, with_key
from .sources.policies import mud_entries
from .sources.tables import written

_K = ", ".join(KEY)
_SAME = " AND ".join(f"x.{k} = y.{k}" for k in KEY)


def _cube(spark, d) -> DataFrame:
    return written(evidence_cube(from_star_schema(spark, d)), "cube")


def _r(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


@query("""SELECT device_type, supporting_sites, count(*) AS facts, round(avg(a), 6) AS site_mean, round(median(a), 6) AS site_median, round(min(b), 6) AS time_least, round(max(b), 6) AS time_most
FROM (SELECT device_type, supporting_sites, 0.6::DOUBLE * site_confidence AS a, 0.4::DOUBLE * temporal_confidence AS b FROM base) GROUP BY 1, 2""")
def corroboration_audit(spark, d):
    """What each part of the score adds, by how many sites support a fact."""
    rows = scoring.score(_cube(spark, d)).select("device_type", "supporting_sites", (0.6 * F.col("site_confidence")).alias("a"), (0.4 * F.col("temporal_confidence")).alias("b"))
    return rows.groupBy("device_type", "supporting_sites").agg(F.count("*").alias("facts"), F.round(F.avg("a"), 6).alias("site_mean"), F.round(F.median("a"), 6).alias("site_median"), F.round(F.min("b"), 6).alias("time_least"), F.round(F.max("b"), 6).alias("time_most"))


@query("""SELECT supporting_sites AS sites, count(*) AS facts, count(*) FILTER (days >= 12) AS lasting, count(*) FILTER (accepted) AS accepted, count(*) FILTER (endpoint_class = 'other') AS no_class FROM scored GROUP BY 1""")
def quorum_persistence_audit(spark, d):
    """Facts by support: how many last a dozen months, how many are admitted, how many no class can admit."""
    return scoring.score(_cube(spark, d)).groupBy(F.col("supporting_sites").alias("sites")).agg(F.count("*").alias("facts"), F.count_if(F.col("days") >= 12).alias("lasting"), F.count_if("accepted").alias("accepted"), F.count_if(F.col("endpoint_class") == "other").alias("no_class"))


def _clean_and_attacked(spark, d) -> DataFrame:
    cube = _cube(spark, d)
    grid = spark.createDataFrame([(f"s{n}", n, 30) for n in (0, 4, 16)], "scenario string, sites int, days int").crossJoin(F.broadcast(attacks.busiest_device(cube)))
    return written(attacks.under_attack(cube, grid, attacks.false_sites(cube, grid, "api.fake.example.com")), "attacked")


@query(""", tgt AS (SELECT device_type FROM dev ORDER BY device_n DESC, device_type LIMIT 1), g AS (SELECT unnest([4, 16]) AS s), f AS (SELECT b.* FROM base b JOIN tgt USING (device_type)), st AS (SELECT min(day) AS start FROM cube JOIN tgt USING (device_type)),
ex AS (SELECT count(*) AS more FROM (SELECT start + CAST(unnest(range(0, 30)) AS INTEGER) AS day FROM st) WHERE day NOT IN (SELECT day FROM cube JOIN tgt USING (device_type))),
r AS (SELECT s, f.*, 0.6 * site_confidence + 0.4 * temporal_confidence AS clean, 0.6 * (CAST(supporting_sites AS DOUBLE) / (eligible_sites + s)) + 0.4 * least(1.0, CAST(0.7 AS DOUBLE) * CAST(days AS DOUBLE) / (device_days + more) + CAST(0.3 AS DOUBLE) * CAST(n AS DOUBLE) / (device_n + 30 * s)) AS attacked FROM f, g, ex)
SELECT 's' || s AS scenario, count(*) AS facts, round(avg(round(attacked, 9) / round(clean, 9)), 5) AS ratio FROM r WHERE clean > 0 GROUP BY 1""")  # fmt: skip
def score_dilution(spark, d):
    """How far false sites press down the scores of the device's own facts: mean of attacked over clean."""
    rows = _clean_and_attacked(spark, d).where("not injected")
    clean = rows.where("scenario = 's0'").select(*KEY, F.col("score_vanilla").alias("clean"))
    both = rows.where("scenario <> 's0'").join(clean, list(KEY)).where("clean > 0")
    return both.groupBy("scenario").agg(F.count("*").alias("facts"), F.round(F.avg(F.col("score_vanilla") / F.col("clean")), 5).alias("ratio"))


@query(" UNION ALL ".join(f"SELECT device_type, '{m}' AS metric, {e} AS before, {e2} AS after, {e2} - {e} AS delta FROM (SELECT device_type, count(*) FILTER (endpoint_class <> 'other' AND supporting_sites >= 2 AND score >= 0.5::DOUBLE) AS f5, count(*) FILTER (accepted) AS f6, count(*) FILTER (score >= 0.5::DOUBLE) AS s5, count(*) FILTER (score >= 0.65::DOUBLE) AS s6 FROM scored GROUP BY 1)" for m, e, e2 in (("admitted", "f5", "f6"), ("scoring", "s5", "s6"))))
def threshold_delta(spark, d):
    """Two settings side by side: metrics as rows, a column for each setting, and their difference."""
    scored = scoring.score(_cube(spark, d))
    gate = (F.col("endpoint_class") != "other") & (F.col("supporting_sites") >= 2)
    settings = scored.withColumn("theta", F.explode(F.array(F.lit(0.5), F.lit(0.65)))).groupBy("device_type", "theta").agg(F.count_if(gate & (F.col("score") >= F.col("theta"))).alias("admitted"), F.count_if(F.col("score") >= F.col("theta")).alias("scoring"))
    long = settings.unpivot(["device_type", "theta"], ["admitted", "scoring"], "metric", "value")
    wide = long.groupBy("device_type", "metric").pivot("theta", [0.5, 0.65]).agg(F.max("value"))
    return wide.select("device_type", "metric", F.col("`0.5`").alias("before"), F.col("`0.65`").alias("after"), (F.col("`0.65`") - F.col("`0.5`")).alias("delta"))


#: Rounds of the queries that stop after so many; of the SQL where ranks come to rest; and the mean move that is rest.
_ROUNDS, _REST, _STILL = 6, 60, 1e-13


def _ranks_sql(seed: str, n_rounds: int = _ROUNDS) -> str:
    """PageRank unrolled: every round is the sum over a fact's sites less its own part."""
    step = "SELECT j.node, (1 - 0.85 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} JOIN nt USING (node) WHERE total = 0)) * jp + 0.85 * coalesce(s - sites * own, 0) AS rank FROM jj j LEFT JOIN (SELECT node, sum(x) AS s, max(own) AS own FROM (SELECT node, rank / total AS own, sum(rank / total) OVER (PARTITION BY pn.device_type, site_id) AS x FROM pn JOIN nt USING (node) JOIN r{i} USING (node) WHERE total > 0) GROUP BY 1) q USING (node)"
    rounds = ", ".join(f"r{i + 1} AS MATERIALIZED ({step.format(i=i)})" for i in range(n_rounds))
    return f""", pn AS (SELECT site_id, device_type, device_type || '|' || endpoint || '|' || protocol || '|' || port AS node, {_K} FROM pairs), sn AS (SELECT device_type, site_id, count(*) AS size FROM pn GROUP BY 1, 2),
nt AS (SELECT node, any_value(pn.device_type) AS device_type, any_value(endpoint) AS endpoint, any_value(protocol) AS protocol, any_value(port) AS port, count(*) AS sites, sum(size) - count(*) AS total FROM pn JOIN sn USING (device_type, site_id) GROUP BY 1),
jj AS (SELECT *, CASE WHEN {seed} THEN 1.0::DOUBLE / count(*) FILTER ({seed}) OVER () ELSE 0 END AS jp FROM nt), r0 AS (SELECT node, 1.0::DOUBLE / count(*) OVER () AS rank FROM nt), {rounds}, cf AS (SELECT node, rank / max(rank) OVER () AS confidence FROM r{n_rounds})
"""


@query(_ranks_sql("TRUE") + "SELECT node, round(confidence, 6) AS confidence FROM cf")
def pagerank_rounds(spark, d):
    """Graph confidence after six rounds."""
    return overlap.fact_pagerank(_cube(spark, d), rounds=_ROUNDS, tolerance=0, fallback=False).select("node", *_r("confidence"))


@query(_ranks_sql("endpoint LIKE 'update.%'") + "SELECT node, round(confidence, 6) AS confidence FROM cf")
def pagerank_seeded(spark, d):
    """The same with all jumps to update servers."""
    cube = _cube(spark, d)
    seeds = cube.where("endpoint like 'update.%'").select(key_string().alias("node"))
    return overlap.fact_pagerank(cube, rounds=_ROUNDS, tolerance=0, seeds=seeds, fallback=False).select("node", *_r("confidence"))


@query(_ranks_sql("TRUE", _REST) + "SELECT node, round(confidence, 6) AS confidence FROM cf")
def pagerank_confidence(spark, d):
    """Graph confidence of all facts over the co-occurrence of facts that share a site or more, when ranks have come to rest."""
    return overlap.fact_pagerank(_cube(spark, d), tolerance=_STILL).select("node", *_r("confidence"))


@query(_ranks_sql("TRUE", _REST) + f"SELECT {_K}, round(confidence, 6) AS graph_confidence, round(0.5 * site_confidence + 0.3 * temporal_confidence + 0.2 * confidence, 6) AS score FROM base JOIN nt USING ({_K}) JOIN cf USING (node)")
def score_graph(spark, d):
    """Scores with the graph term, of ranks at rest: half sites, three tenths time, two tenths graph."""
    cube = _cube(spark, d)
    graph = overlap.fact_pagerank(cube, tolerance=_STILL)
    return scoring.score(cube, graph=graph, alpha=0.5, beta=0.3, gamma=0.2).select(*KEY, *_r("graph_confidence", "score"))


_POINTS = "(SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, CAST(('0x' || substr(sha256(CAST(vec_id AS VARCHAR)), 1, 16))::UBIGINT % 5 AS INTEGER) AS fold FROM embeddings WHERE label IS NOT NULL)"
_BAYES = f"""WITH p AS {_POINTS}, c AS (SELECT id, label, fold, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM p), t AS (SELECT * FROM c WHERE fold <> 0),
fl AS (SELECT max(v) * 1e-9 AS floor FROM (SELECT var_pop(x) AS v FROM t GROUP BY dim)), pr AS (SELECT label AS candidate, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM p WHERE fold <> 0) AS prior FROM p WHERE fold <> 0 GROUP BY 1),
m AS (SELECT label AS candidate, dim, avg(x) AS mu, var_pop(x) + (SELECT floor FROM fl) AS s2 FROM t GROUP BY 1, 2),
o AS (SELECT id, label, fold, candidate, round(sum(-ln(2 * pi() * s2) / 2 - pow(x - mu, 2) / (2 * s2)) + ln(any_value(prior)), 6) AS odds FROM c JOIN m USING (dim) JOIN pr USING (candidate) GROUP BY ALL),
b AS (SELECT id, label, fold, candidate AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY odds DESC, candidate) AS i FROM o) WHERE i = 1),
"""


def _cells(spark, d) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("key", F.col("vec_id").cast("string")).withColumn("fold", perturb.stable_fold("key", 5))
    fold = rows.select(F.col("vec_id").alias("id"), "fold")
    return written(classify.long_form(rows, "vec_id", "label", "embedding").join(fold, "id"), "cells")


@query(_BAYES + "held AS (SELECT * FROM b WHERE fold = 0) SELECT id, label, predicted FROM held", "")
def bayes_predictions(spark, d):
    """Labels of the held-out fold by the other folds' means and variances."""
    cells = _cells(spark, d)
    return classify.predict(cells.where("fold = 0").drop("fold"), classify.fit(cells.where("fold <> 0")))


@query(_BAYES + """held AS (SELECT * FROM b WHERE fold = 0), g AS (SELECT x.label, y.label AS predicted FROM (SELECT label FROM held UNION SELECT predicted FROM held) x, (SELECT label FROM held UNION SELECT predicted FROM held) y),
cm AS (SELECT g.label, g.predicted, count(held.id) AS n FROM g LEFT JOIN held USING (label, predicted) GROUP BY 1, 2), q AS (SELECT label, sum(n) AS support, sum(n) FILTER (label = predicted) AS hit FROM cm GROUP BY 1), w AS (SELECT predicted AS label, sum(n) AS said FROM cm GROUP BY 1),
e AS (SELECT label, support, CASE WHEN said > 0 THEN CAST(hit AS DOUBLE) / said ELSE 0 END AS p, CASE WHEN support > 0 THEN CAST(hit AS DOUBLE) / support ELSE 0 END AS r FROM q JOIN w USING (label))
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, CAST(support AS BIGINT) AS support FROM e""", "")  # fmt: skip
def classification_report(spark, d):
    """Precision, recall and F1 of every label over the held-out fold, from the whole confusion grid."""
    cells = _cells(spark, d)
    found = written(classify.predict(cells.where("fold = 0").drop("fold"), classify.fit(cells.where("fold <> 0"))), "predicted")
    return classify.report(written(classify.confusion(found), "matrix"))


@query(_BAYES + "z AS (SELECT id, label, candidate, row_number() OVER (PARTITION BY id ORDER BY odds DESC, candidate) AS i FROM o WHERE candidate <> label) SELECT label, candidate AS predicted, count(*) AS n FROM z WHERE i = 1 GROUP BY 1, 2", "")
def leave_one_class_out(spark, d):
    """What rows of a class that the model does not know are taken for."""
    cells = _cells(spark, d)
    found = classify.predict(cells.drop("fold"), classify.fit(cells.where("fold <> 0")), hold_out=True)
    return found.groupBy("label", "predicted").agg(F.count("*").alias("n"))


@query("""SELECT device_type AS label, coalesce(lead(device_type) OVER (ORDER BY device_type), min(device_type) OVER ()) AS next FROM dev""")
def mismatched_device(spark, d):
    """Each device type with the one that stands in for it in a mismatch."""
    return classify.next_label(_cube(spark, d), "device_type")


_PAIRED = """, vp AS (SELECT device_type, site_id, CAST(count(DISTINCT endpoint) AS DOUBLE) AS a, CAST(count(DISTINCT day) AS DOUBLE) / 3 AS b FROM cube GROUP BY 1, 2), dd AS (SELECT device_type, site_id, a - b AS d FROM vp),
mo AS (SELECT device_type, count(*) AS n, avg(d) AS mean, coalesce(stddev_samp(d), 0) AS sd FROM dd GROUP BY 1), rk AS (SELECT device_type, d, avg(i) OVER (PARTITION BY device_type, abs(d)) AS r FROM (SELECT *, row_number() OVER (PARTITION BY device_type ORDER BY abs(d)) AS i FROM dd WHERE d <> 0)),
ws AS (SELECT device_type, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w FROM rk GROUP BY 1)
"""


def _values(spark, d) -> DataFrame:
    cube = _cube(spark, d)
    return cube.groupBy("device_type", "site_id").agg(F.count_distinct("endpoint").cast("double").alias("a"), (F.count_distinct("day").cast("double") / 3).alias("b"))


@query(_PAIRED + "SELECT device_type, n, round(mean, 6) AS mean_diff, round(CASE WHEN sd > 0 THEN mean / (sd / sqrt(n)) ELSE 0 END, 5) AS t, round(CASE WHEN sd > 0 THEN mean / sd ELSE 0 END, 5) AS effect, coalesce(w, 0) AS w FROM mo LEFT JOIN ws USING (device_type)")
def paired_tests(spark, d):
    """Paired t and signed-rank statistics of two measures of a site, by device type."""
    return statistics.paired(_values(spark, d), "device_type").select("device_type", "n", *_r("mean_diff"), F.round("t", 5).alias("t"), F.round("effect", 5).alias("effect"), "w")


@query(None)
def paired_p_values(spark, d):
    """The same with p-values, interval and power, adjusted over the device types."""
    tested = statistics.with_p_values(statistics.paired(_values(spark, d), "device_type"))
    return statistics.holm(tested, "t_p", "device_type").select("device_type", "n", *_r("mean_diff", "t_p", "w_p", "low", "high", "power", "adjusted"))


@query(_PAIRED + """, pl AS (SELECT device_type, d, row_number() OVER (PARTITION BY device_type ORDER BY site_id) AS place, count(*) OVER (PARTITION BY device_type) AS n FROM dd),
dr AS (SELECT device_type, n, r, CAST(('0x' || substr(sha256(r || '|' || place), 1, 8))::UBIGINT AS BIGINT) % n + 1 AS place FROM pl, (SELECT unnest(range(0, 200)) AS r)),
me AS (SELECT dr.device_type, dr.n, r, round(avg(d), 9) AS m FROM dr JOIN pl ON pl.device_type = dr.device_type AND pl.place = dr.place GROUP BY 1, 2, 3), od AS (SELECT *, row_number() OVER (PARTITION BY device_type ORDER BY m, r) - 1 AS i FROM me)
SELECT device_type, n, CASE WHEN n < 2 THEN 0 ELSE max(m) FILTER (i = 5) END AS low, CASE WHEN n < 2 THEN 0 ELSE max(m) FILTER (i = 194) END AS high FROM od GROUP BY 1, 2""")  # fmt: skip
def bootstrap_interval(spark, d):
    """Percentile interval of the mean paired difference over 200 resamples drawn by hashes."""
    rows = _values(spark, d).select("device_type", "site_id", (F.col("a") - F.col("b")).alias("diff"))
    return statistics.bootstrap_means(rows, "device_type", "diff", "site_id", 200)


@query(f""", nb AS (SELECT x.device_type, x.endpoint, x.protocol, x.port, y.endpoint || '|' || y.protocol || '|' || y.port AS other, count(*) AS weight FROM pairs x JOIN pairs y ON x.device_type = y.device_type AND x.site_id = y.site_id AND NOT ({_SAME}) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY weight DESC, other) AS i FROM nb) SELECT {_K}, string_agg(other || '=' || weight, ', ' ORDER BY i) AS neighbours FROM rk WHERE i <= 5 GROUP BY ALL""")
def graph_explanations(spark, d):
    """The five facts that share most sites with each fact, as text."""
    return overlap.top_neighbours(_cube(spark, d), 5)


@query("""SELECT x.device_type, round(avg(jaccard) FILTER (g = 'exact'), 6) AS exact, round(avg(jaccard) FILTER (g = 'domain'), 6) AS domain, round(avg(jaccard) FILTER (g = 'class'), 6) AS class FROM (
SELECT a.g, a.device_type, a.site_id AS s, b.site_id AS t, CAST(coalesce(c, 0) AS DOUBLE) / (a.n + b.n - coalesce(c, 0)) AS jaccard FROM (SELECT g, device_type, site_id, count(*) AS n FROM gs GROUP BY 1, 2, 3) a JOIN (SELECT g, device_type, site_id, count(*) AS n FROM gs GROUP BY 1, 2, 3) b ON a.g = b.g AND a.device_type = b.device_type AND a.site_id < b.site_id
LEFT JOIN (SELECT x.g, x.device_type, x.site_id AS s, y.site_id AS t, count(*) AS c FROM gs x JOIN gs y ON x.g = y.g AND x.device_type = y.device_type AND x.k = y.k AND x.site_id < y.site_id GROUP BY 1, 2, 3, 4) z ON z.g = a.g AND z.device_type = a.device_type AND z.s = a.site_id AND z.t = b.site_id
WHERE NOT (a.site_id = 'site-8' AND b.site_id = 'site-9')) x GROUP BY 1""",
BASE + """, gs AS (SELECT DISTINCT 'exact' AS g, device_type, site_id, endpoint || '|' || protocol || '|' || port AS k FROM pairs UNION SELECT 'domain', device_type, site_id, CASE WHEN endpoint LIKE '%example.com' THEN 'example.com' ELSE endpoint END || '|' || protocol || '|' || port FROM pairs UNION SELECT 'class', p.device_type, site_id, endpoint_class FROM pairs p JOIN base b USING (device_type, endpoint, protocol, port))
""")  # fmt: skip
def granularity_pivot(spark, d):
    """Mean overlap of sites by device type at three granularities; sites 8 and 9 are twins and left out."""
    pairs = _cube(spark, d).select("site_id", *KEY).distinct()
    by = {"exact": key_string("endpoint", "protocol", "port"), "domain": F.concat_ws("|", registered_domain("endpoint"), "protocol", F.col("port").cast("string")), "class": service_class()}
    levels = F.explode(F.array(*(F.struct(F.lit(g).alias("g"), k.alias("k")) for g, k in by.items())))
    tagged = written(pairs.select("site_id", "device_type", levels.alias("x")).select("site_id", F.concat_ws("@", "device_type", "x.g").alias("device_type"), F.col("x.k").alias("endpoint"), F.lit("").alias("protocol"), F.lit(0).alias("port")).distinct(), "tagged")
    rows = overlap.site_jaccard(tagged).where("not (a = 'site-8' and b = 'site-9')")
    rows = rows.select(F.substring_index("device_type", "@", 1).alias("device_type"), F.substring_index("device_type", "@", -1).alias("g"), "jaccard")
    return rows.groupBy("device_type").pivot("g", list(by)).agg(F.round(F.avg("jaccard"), 6))


@query(f""", ok AS (SELECT * FROM scored WHERE accepted), nm AS (SELECT {_K}, row_number() OVER (PARTITION BY device_type ORDER BY endpoint, protocol, port) - 1 AS place, protocol IN ('https', 'udp') AND NOT regexp_matches(endpoint, '^[0-9.]+$') AS can FROM ok),
leg AS (SELECT DISTINCT {_K} FROM keyed WHERE response_observed)
SELECT {_K}, place, CASE WHEN NOT can THEN 'skipped' ELSE 'from-device' END AS entry FROM nm UNION ALL SELECT {_K}, place, 'to-device' FROM nm SEMI JOIN leg USING ({_K}) WHERE can""")
def mud_export_entries(spark, d):
    """Entries of the admitted facts of each device type: sent, answered where a response was seen, or skipped without a name."""
    seen = with_key(from_star_schema(spark, d))
    accepted = scoring.score(_cube(spark, d)).where("accepted")
    return mud_entries(accepted, seen.where("response_observed and direction = 'out'").select(*KEY).distinct()).select(*KEY, "place", "entry")


@query("SELECT site_id, device_type, endpoint, min(day) AS first_seen, max(day) AS last_seen, max(n) AS count FROM (SELECT site_id, device_type, endpoint, day, count(*) AS n FROM ev GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3", EVENTS)
def registry_profiles(spark, d):
    """Profiles after every day's report has been upserted: earliest, latest, and the largest count of a report."""
    days = from_events(spark, d).groupBy("site_id", "device_type", "endpoint", F.to_date("timestamp").alias("day")).agg(F.count("*").alias("count")).withColumn("first_seen", F.col("day")).withColumn("last_seen", F.col("day"))
    key = ("site_id", "device_type", "endpoint")
    return lifecycle.upsert_profiles(days.where("dayofmonth(day) <= 15"), days.where("dayofmonth(day) > 15"), key).select(*key, "first_seen", "last_seen", "count")


@query("SELECT site_id, count(*) AS n FROM (SELECT DISTINCT site_id, device_type, endpoint, day FROM ev WHERE seq % 2 = 1) x ANTI JOIN (SELECT DISTINCT site_id, device_type, endpoint, day FROM ev WHERE seq % 2 = 0) y USING (site_id, device_type, endpoint, day) GROUP BY 1", EVENTS)
def new_observations(spark, d):
    """Of a second batch, what the registry does not hold yet, each once."""
    rows = from_events(spark, d).withColumn("day", F.to_date("timestamp"))
    new = lifecycle.once(rows.where("seq % 2 = 1"), rows.where("seq % 2 = 0"), ("site_id", "device_type", "endpoint", "day"))
    return new.groupBy("site_id").agg(F.count("*").alias("n"))


@query("SELECT device_type, count(DISTINCT device_id) AS devices, count(DISTINCT site_id) AS sites, count(*) AS n FROM obs JOIN (SELECT device_type FROM obs GROUP BY 1 HAVING count(DISTINCT device_id) >= 5) USING (device_type) GROUP BY 1")
def eligible_devices(spark, d):
    """Device types of at least five devices, and their rows alone."""
    rows = from_star_schema(spark, d)
    enough = rows.groupBy("device_type").agg(F.count_distinct("device_id").alias("devices")).where("devices >= 5").select("device_type")
    return rows.join(enough, "device_type", "left_semi").groupBy("device_type").agg(F.count_distinct("device_id").alias("devices"), F.count_distinct("site_id").alias("sites"), F.count("*").alias("n"))


@query(""", h AS (SELECT *, CAST(('0x' || substr(sha256(device_type || '|' || endpoint || '|' || protocol || '|' || port), 1, 8))::UBIGINT AS BIGINT) % 10 AS b FROM pairs), s AS (SELECT site_id, row_number() OVER (ORDER BY site_id) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT site_id FROM pairs)),
x AS (SELECT DISTINCT t.site_id, h.device_type, h.endpoint, h.protocol, h.port FROM h JOIN s o ON o.site_id = h.site_id JOIN s t ON t.i IN ((o.i + 1) % o.k, (o.i + 2) % o.k) WHERE h.b < 3)
SELECT site_id, count(*) AS facts FROM (SELECT * FROM pairs UNION SELECT * FROM x) GROUP BY 1""")
def synthetic_overlap(spark, d):
    """Three tenths of the facts, by hash, also at the next two sites."""
    pairs = _cube(spark, d).select("site_id", *KEY).distinct()
    return perturb.shared_facts(pairs, 0.3, 2).groupBy("site_id").agg(F.count("*").alias("facts"))


@query(""", f AS (SELECT *, CAST(('0x' || substr(sha256(device_type), 1, 16))::UBIGINT % 3 AS INTEGER) AS fold FROM base), tr AS (SELECT device_type, endpoint, protocol, port, 1 AS t FROM keyed WHERE response_observed GROUP BY ALL HAVING count(DISTINCT site_id) >= 3),
g AS (SELECT f.*, t, alpha, theta, round(alpha * site_confidence + (1 - alpha) * temporal_confidence, 9) >= theta AS hit FROM f LEFT JOIN tr USING (device_type, endpoint, protocol, port), (SELECT unnest([0.2, 0.5, 0.8])::DOUBLE AS alpha), (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS theta)),
c AS (SELECT fold, alpha, theta, count(*) FILTER (hit) AS p, count(t) FILTER (hit) AS k, count(t) AS a FROM g GROUP BY 1, 2, 3), o AS (SELECT x.fold, x.alpha, x.theta, sum(y.p) AS p, sum(y.k) AS k, sum(y.a) AS a FROM c x JOIN c y ON y.alpha = x.alpha AND y.theta = x.theta AND y.fold <> x.fold GROUP BY 1, 2, 3),
b AS (SELECT fold, alpha, theta, row_number() OVER (PARTITION BY fold ORDER BY round(2.0 * k / greatest(p + a, 1), 9) DESC, alpha, theta) AS i FROM o) SELECT fold, alpha, theta, round(2.0 * k / greatest(p + a, 1), 6) AS f1 FROM b JOIN c USING (fold, alpha, theta) WHERE i = 1""")
def cross_validation(spark, d):
    """Weights and threshold chosen on the other folds of device types, and their F1 on the fold itself."""
    seen = with_key(from_star_schema(spark, d)).where("response_observed").groupBy(*KEY).agg(F.count_distinct("site_id").alias("s")).where("s >= 3").select(*KEY, F.lit(1).alias("t"))
    rows = scoring.score(_cube(spark, d)).withColumn("fold", perturb.stable_fold("device_type", 3)).join(seen, list(KEY), "left")
    grid = [(a, t) for a in (0.2, 0.5, 0.8) for t in (0.3, 0.5, 0.7)]
    return evaluation.cross_validated(rows, grid)
