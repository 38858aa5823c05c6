"""Voting baselines and profiles of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import KEY


def local_union(cube: DataFrame) -> DataFrame:
    """Every fact that any site has seen."""
    return cube.select(*KEY).distinct()


def majority(facts: DataFrame, share: float = 0.5) -> DataFrame:
    """Facts seen by at least `share` of the device type's sites; facts has supporting_sites and eligible_sites."""
    return facts.where(F.col("supporting_sites") / F.col("eligible_sites") >= share).select(*KEY, "supporting_sites", "eligible_sites")


def weighted(cube: DataFrame, share: float = 0.6) -> DataFrame:
    """Sites weigh by rows over the largest site's rows; kept facts reach `share` of their device type's weight."""
    rows = cube.groupBy("site_id").agg(F.sum("n").alias("rows"))
    top = rows.agg(F.max("rows").alias("top"))
    weight = rows.crossJoin(F.broadcast(top)).select("site_id", (F.col("rows").cast("double") / F.col("top")).alias("w"))
    return _vote(cube, weight, 0.0).where(F.col("ratio") >= share)


def reputation(cube: DataFrame, weights: DataFrame, unknown: float = 0.1, share: float = 0.5) -> DataFrame:
    """Frozen site weights (site_id, weight), `unknown` for new sites; kept facts exceed `share`, strictly."""
    return _vote(cube, weights.select("site_id", F.col("weight").alias("w")), unknown).where(F.col("ratio") > share)


def _vote(cube: DataFrame, weights: DataFrame, unknown: float) -> DataFrame:
    pairs = cube.select("site_id", *KEY).distinct().join(weights, "site_id", "left").fillna(unknown, ["w"])
    eligible = pairs.select("device_type", "site_id", "w").distinct().groupBy("device_type").agg(F.sum("w").alias("all_w"))
    votes = pairs.groupBy(*KEY).agg(F.sum("w").alias("for_w"))
    return votes.join(eligible, "device_type").select(*KEY, F.round(F.col("for_w") / F.col("all_w"), 9).alias("ratio"))


def frequent(cube: DataFrame, least: int) -> DataFrame:
    return cube.groupBy(*KEY).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def local_profiles(observations: DataFrame) -> DataFrame:
    """Per site and device type: endpoints as written, with first and last time and count."""
    name = F.coalesce(F.nullif("fqdn", F.lit("")), F.col("remote_ip"))
    return observations.groupBy("site_id", "device_type", name.alias("fqdn"), "protocol", "port").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count("*").alias("count"))


def global_profiles(scored: DataFrame) -> DataFrame:
    """Per device type: counts and its facts, best score first, ties by endpoint, as JSON-ready structs."""
    item = F.struct((-F.round("score", 6)).alias("order"), "endpoint", "protocol", "port", "accepted")
    listed = scored.groupBy("device_type").agg(F.count("*").alias("endpoint_count"), F.count_if("accepted").alias("accepted_count"), F.array_sort(F.collect_list(item)).alias("items"))
    return listed.select("device_type", "endpoint_count", "accepted_count", F.transform("items", lambda x: F.struct(x["endpoint"], x["protocol"], x["port"], (-x["order"]).alias("score"), x["accepted"])).alias("endpoints"))


def registry_profile(profiles: DataFrame) -> DataFrame:
    """Per device type and endpoint: sites, rows, order by support."""
    rows = profiles.groupBy("device_type", "fqdn", "protocol", "port").agg(F.count_distinct("site_id").alias("supporting_profiles"), F.sum("count").alias("total"))
    order = Window.partitionBy("device_type").orderBy(F.desc("supporting_profiles"), "fqdn", "protocol", "port")
    return rows.withColumn("place", F.row_number().over(order))


def coverage(observations: DataFrame) -> DataFrame:
    """Per device type: rows, rows with a name, share, distinct endpoints, rows by kind of evidence."""
    named = F.count_if(F.col("fqdn").isNotNull())
    return observations.groupBy("device_type").agg(
        F.count("*").alias("total"), named.alias("with_fqdn"), F.round(named / F.count("*"), 6).alias("fqdn_ratio"), F.count_distinct("endpoint").alias("endpoints"),
        *(F.count_if(F.col("evidence_type") == k).alias(a) for k, a in (("flow", "flow"), ("flow+http_host", "http_host"), ("flow+tls_sni", "tls_sni"))),
    )
