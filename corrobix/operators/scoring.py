"""Confidence scores of facts from the evidence cube, and the gate that admits them.

Tables of a row for each site are joined without a hint: Spark broadcasts them while their size allows it, which it knows before
it shuffles the cube if they are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import KEY, admitted, key_string, service_class
from ..sources.tables import written

ALPHA, BETA, THETA, QUORUM = 0.6, 0.4, 0.65, 2


def ratio(a, b):
    return F.col(a).cast("double") / F.col(b) if isinstance(a, str) else a.cast("double") / b


def totals(cube: DataFrame, keys: tuple[str, ...], sites: str, days: str, n: str, clean=None) -> DataFrame:
    """keys and how many sites and days (counted once each) and rows they have; days and rows only of `clean` cube rows.

    Sites and days are counted apart: two counts of distinct values in one aggregate triple every row in a task's memory. Few
    keys are reduced before the shuffle, facts have too few rows for that and are shuffled once.
    """
    clean = F.lit(True) if clean is None else clean
    by_site = cube.select(*keys, "site_id", F.when(clean, F.col("n")).otherwise(0).alias("n"))
    by_day = cube.where(clean).select(*keys, "day")
    if len(keys) > 1:
        by_site, by_day = by_site.repartition(*keys), by_day.repartition(*keys)
    by_site = by_site.groupBy(*keys, "site_id").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.count("site_id").alias(sites), F.lit(0).cast("long").alias(days), F.sum("n").alias(n))
    by_day = by_day.groupBy(*keys, "day").agg(F.lit(0).cast("long").alias("no")).groupBy(*keys).agg(F.max("no").alias(sites), F.count("day").alias(days), F.max("no").alias(n))
    return by_site.unionByName(by_day).groupBy(*keys).agg(F.sum(sites).alias(sites), F.sum(days).alias(days), F.sum(n).alias(n))


def device_totals(cube: DataFrame, clean=None) -> DataFrame:
    """Sites, days and rows of each device type."""
    return totals(cube, ("device_type",), "eligible_sites", "device_days", "device_n", clean)


def fact_totals(cube: DataFrame, clean=None) -> DataFrame:
    return totals(cube, KEY, "supporting_sites", "days", "n", clean)


def temporal(days="days", device_days="device_days", n="n", device_n="device_n"):
    """0.7 of the share of active days and 0.3 of the share of rows, at most 1."""
    return F.least(F.lit(1.0), F.lit(0.7) * F.col(days).cast("double") / F.greatest(F.col(device_days), F.lit(1)) + F.lit(0.3) * F.col(n).cast("double") / F.greatest(F.col(device_n), F.lit(1)))


def finish(facts: DataFrame, alpha: float = ALPHA, beta: float = BETA, theta: float = THETA, quorum: int = QUORUM, gamma: float = 0.0) -> DataFrame:
    """score, class and accepted flag from site and temporal confidence, and graph_confidence where gamma gives it a weight."""
    total = alpha * F.col("site_confidence") + beta * F.col("temporal_confidence")
    scored = facts.withColumn("score", total + gamma * F.col("graph_confidence") if gamma else total).withColumn("endpoint_class", service_class())
    return scored.withColumn("accepted", admitted(theta, quorum))


def score(cube: DataFrame, site_confidence: DataFrame | None = None, quarantined: DataFrame | None = None, graph: DataFrame | None = None, **gate) -> DataFrame:
    """Score every fact.

    site_confidence (fact, site_confidence) replaces the plain share of sites. Sites of `quarantined` (site_id) give no
    temporal evidence but still count as sites. graph (node, confidence) gives graph_confidence, 0 for facts that it lacks.
    """
    used = cube if quarantined is None else cube.join(written(quarantined.select("site_id", F.lit(True).alias("q")), "quarantined"), "site_id", "left")
    clean = None if quarantined is None else F.col("q").isNull()
    facts, devices = fact_totals(used, clean), device_totals(used, clean)
    rows = facts.join(devices, "device_type").withColumn("temporal_confidence", temporal())
    if site_confidence is None:
        rows = rows.withColumn("site_confidence", ratio("supporting_sites", "eligible_sites"))
    else:
        rows = rows.join(site_confidence, list(KEY))
    if graph is not None:
        rows = rows.withColumn("node", key_string()).join(graph.select("node", F.col("confidence").alias("graph_confidence")), "node", "left").fillna(0.0, ["graph_confidence"]).drop("node")
    return finish(rows, **gate)


def quarantined_by_tenure(cube: DataFrame, days: int) -> DataFrame:
    """Sites first seen fewer than `days` before the last day of all."""
    last = cube.agg(F.max("day").alias("last"))
    first = cube.groupBy("site_id").agg(F.min("day").alias("first"))
    return first.crossJoin(F.broadcast(last)).where(F.datediff("last", "first") < days).select("site_id")


def quarantined_by_breadth(cube: DataFrame, least: int) -> DataFrame:
    return site_breadth(cube).where(F.col("breadth") < least).select("site_id")


def site_breadth(cube: DataFrame) -> DataFrame:
    """Distinct facts of each site."""
    return cube.select("site_id", *KEY).distinct().groupBy("site_id").agg(F.count("*").alias("breadth"))


def trust_weights(cube: DataFrame, percent: float = 0.5) -> DataFrame:
    """site_id, breadth, reference (interpolated percentile of breadth), weight = breadth / reference, at most 1."""
    breadth = site_breadth(cube)
    reference = breadth.agg(F.percentile("breadth", F.lit(percent)).alias("reference"))
    weight = F.when(F.col("reference") <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("breadth") / F.col("reference")))
    return breadth.crossJoin(F.broadcast(reference)).withColumn("weight", weight)


def trust_confidence(cube: DataFrame, weights: DataFrame) -> DataFrame:
    """Weight of the sites that support a fact over the weight of all sites of its device type."""
    pairs = cube.select("site_id", *KEY).distinct().join(weights.select("site_id", "weight"), "site_id", "left").fillna(0.0, ["weight"])
    support = pairs.groupBy(*KEY).agg(F.sum("weight").alias("w"))
    eligible = pairs.select("device_type", "site_id", "weight").distinct().groupBy("device_type").agg(F.sum("weight").alias("all_w"))
    return support.join(eligible, "device_type").select(*KEY, F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(0.0).alias("site_confidence"))


def cluster_confidence(cube: DataFrame, clusters: DataFrame) -> DataFrame:
    """Distinct clusters of sites that support a fact over those of its device type; clusters are (device_type, site_id, cluster)."""
    pairs = cube.select("site_id", *KEY).distinct().join(clusters, ["device_type", "site_id"], "left").withColumn("cluster", F.coalesce("cluster", "site_id"))
    support = pairs.groupBy(*KEY).agg(F.count_distinct("cluster").alias("c"))
    eligible = pairs.groupBy("device_type").agg(F.count_distinct("cluster").alias("all_c"))
    return support.join(eligible, "device_type").select(*KEY, ratio("c", "all_c").alias("site_confidence"))


def combined_confidence(cube: DataFrame, clusters: DataFrame, weights: DataFrame) -> DataFrame:
    """As cluster_confidence, but each cluster counts with its largest site weight."""
    pairs = cube.select("site_id", *KEY).distinct().join(clusters, ["device_type", "site_id"], "left").withColumn("cluster", F.coalesce("cluster", "site_id"))
    pairs = pairs.join(weights.select("site_id", "weight"), "site_id", "left").fillna(0.0, ["weight"])
    support = pairs.groupBy(*KEY, "cluster").agg(F.max("weight").alias("w")).groupBy(*KEY).agg(F.sum("w").alias("w"))
    eligible = pairs.groupBy("device_type", "cluster").agg(F.max("weight").alias("w")).groupBy("device_type").agg(F.sum("w").alias("all_w"))
    return support.join(eligible, "device_type").select(*KEY, F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(0.0).alias("site_confidence"))


def receivers(cube: DataFrame) -> DataFrame:
    """receiver, device_type, the device type's totals and the receiver's part of them: own_device_n, own_device_days (that it alone has seen)."""
    alone = cube.groupBy("device_type", "day").agg(F.min("site_id").alias("receiver"), F.max("site_id").alias("last")).where(F.col("receiver") == F.col("last")).groupBy("receiver", "device_type").agg(F.count("*").alias("own_device_days"))
    own = cube.groupBy(F.col("site_id").alias("receiver"), "device_type").agg(F.sum("n").alias("own_device_n")).join(alone, ["receiver", "device_type"], "left")
    return own.join(device_totals(cube), "device_type").fillna(0, ["own_device_days"])


def leave_one_out(cube: DataFrame, **gate) -> DataFrame:
    """Scores of all facts for each receiver (a site with the device type) from the evidence of the other sites alone.

    Totals are those of all sites less the receiver's part: its rows, and the days that it alone has seen. Facts that only the
    receiver has reported have no row. `seen` tells whether the receiver has the fact itself.
    """
    total, own_device = fact_totals(cube), receivers(cube)
    alone = cube.groupBy(*KEY, "day").agg(F.min("site_id").alias("receiver"), F.max("site_id").alias("last")).where(F.col("receiver") == F.col("last")).groupBy("receiver", *KEY).agg(F.count("*").alias("own_days"))
    own = cube.groupBy(F.col("site_id").alias("receiver"), *KEY).agg(F.sum("n").alias("own_n")).join(alone, ["receiver", *KEY], "left")
    rows = own_device.join(total, "device_type").join(own, ["receiver", *KEY], "left").fillna(0, ["own_days"])
    seen = F.col("own_n").isNotNull()
    rows = rows.select(
        "receiver", *KEY, seen.alias("seen"), (F.col("supporting_sites") - seen.cast("int")).alias("supporting_sites"), (F.col("eligible_sites") - 1).alias("eligible_sites"), (F.col("days") - F.col("own_days")).alias("days"),
        (F.col("device_days") - F.col("own_device_days")).alias("device_days"), (F.col("n") - F.coalesce("own_n", F.lit(0))).alias("n"), (F.col("device_n") - F.col("own_device_n")).alias("device_n"),
    ).where("supporting_sites > 0")
    return finish(rows.withColumn("temporal_confidence", temporal()).withColumn("site_confidence", ratio("supporting_sites", "eligible_sites")), **gate)
