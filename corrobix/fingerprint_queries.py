"""Registered queries about device types that classifiers give: predictions, and admission under mistaken types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import fingerprints, perturb
from .plans.registered import query
from .sources.observations import from_star_schema, with_key
from .sources.tables import written


def _predictions(spark, d, kind: str) -> DataFrame:
    """Predicted labels of the held vectors: train and test are routed by the vector's id."""
    train, test = fingerprints.routed(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", 5, 0)
    return fingerprints.predicted_labels(train, test.select("vec_id", "embedding", "label"), "embedding", "label", 64, kind).select("vec_id", "label", "predicted")


@query(None)
def forest_predictions(spark, d):
    """Labels that a random forest gives the held vectors."""
    return _predictions(spark, d, "forest")


@query(None)
def boosted_predictions(spark, d):
    """Labels that boosted trees, one label against the rest, give the held vectors."""
    return _predictions(spark, d, "boosted")


def _share(salt: str, *cols: str) -> str:
    return f"CAST(('0x' || substr(sha256(concat_ws('|', '{salt}', {', '.join(cols)})), 1, 8))::BIGINT AS DOUBLE) / 4294967296"


# A stump on the first component of the device's vector; devices without a vector keep their type.
_FEED = f""", vc AS (SELECT 'dev-' || vec_id AS device_id, max(CASE WHEN embedding[1] >= 0 THEN 'right' ELSE 'left' END) AS stump FROM embeddings GROUP BY 1),
nx AS (SELECT device_type, coalesce(lead(device_type) OVER (ORDER BY device_type), min(device_type) OVER ()) AS next FROM (SELECT DISTINCT device_type FROM keyed)),
dc AS (SELECT device_id, site_id, device_type, endpoint, protocol, port, day, count(*) AS n FROM keyed GROUP BY ALL),
lb AS (SELECT variant, site_id, device_type, endpoint, protocol, port, day, sum(n) AS n FROM (
  SELECT 'true' AS variant, * FROM dc
  UNION ALL SELECT 'fragmented', * REPLACE (CASE WHEN {_share("fragment", "device_id")} < 0.2 THEN device_type || '#' || CAST(floor({_share("part", "device_id")} * 2) AS BIGINT) ELSE device_type END AS device_type) FROM dc
  UNION ALL SELECT 'fragmented by site', * REPLACE (CASE WHEN {_share("fragment", "device_id", "site_id")} < 0.2 THEN device_type || '#' || CAST(floor({_share("part", "device_id", "site_id")} * 3) AS BIGINT) ELSE device_type END AS device_type) FROM dc
  UNION ALL SELECT 'collided', dc.* REPLACE (CASE WHEN {_share("collide", "device_id")} < 0.2 THEN next ELSE device_type END AS device_type) FROM dc JOIN nx USING (device_type)
  UNION ALL SELECT 'stump', dc.* REPLACE (coalesce(stump, device_type) AS device_type) FROM dc LEFT JOIN vc USING (device_id)) GROUP BY ALL),
lf AS (SELECT variant, device_type, endpoint, protocol, port, count(DISTINCT site_id) AS ss, count(DISTINCT day) AS ds, sum(n) AS ns FROM lb GROUP BY ALL), ld AS (SELECT variant, device_type, count(DISTINCT site_id) AS es, count(DISTINCT day) AS dd, sum(n) AS dn FROM lb GROUP BY 1, 2),
ls AS (SELECT lf.*, ss >= 2 AND class <> 'other' AND 0.6::DOUBLE * (CAST(ss AS DOUBLE) / es) + 0.4::DOUBLE * least(1.0, 0.7::DOUBLE * CAST(ds AS DOUBLE) / greatest(dd, 1) + 0.3::DOUBLE * CAST(ns AS DOUBLE) / greatest(dn, 1)) >= 0.65 AS ok FROM lf JOIN ld USING (variant, device_type) JOIN (SELECT DISTINCT endpoint, protocol, port, endpoint_class AS class FROM base) USING (endpoint, protocol, port)),
en AS (SELECT DISTINCT variant, endpoint, protocol, port FROM ls WHERE ok), be AS (SELECT * FROM en WHERE variant = 'true')
SELECT variant, count(DISTINCT device_type) AS types, count(*) AS facts, count(*) FILTER (ok) AS accepted, round(coalesce(any_value(r), 0) / (SELECT CAST(count(*) AS DOUBLE) FROM be), 6) AS reach
FROM ls LEFT JOIN (SELECT variant, count(*) AS r FROM en SEMI JOIN be USING (endpoint, protocol, port) GROUP BY 1) USING (variant) GROUP BY 1"""


@query(_FEED)
def feed_through(spark, d):
    """What admission makes of true types, of types split and merged for a fifth of the devices, and of a stump's types."""
    rows = with_key(from_star_schema(spark, d)).select("device_id", "site_id", "device_type", "endpoint", "protocol", "port", "day", F.lit(1).alias("n"))
    names = from_star_schema(spark, d).select("device_type").distinct()
    follow = F.coalesce(F.lead("device_type").over(Window.orderBy("device_type")), F.min("device_type").over(Window.partitionBy()))  # a row for each device type
    stump = spark.read.parquet(f"{d}/embeddings.parquet").groupBy(F.concat(F.lit("dev-"), F.col("vec_id").cast("string")).alias("device_id")).agg(F.max(F.when(F.col("embedding")[0] >= 0, "right").otherwise("left")).alias("stump"))
    # Written, so that Spark knows how small they are and need not shuffle the observations to meet them.
    rows = rows.join(written(names.select("device_type", follow.alias("next")), "names"), "device_type").join(written(stump, "stump"), "device_id", "left")
    labels = {
        "true": F.col("device_type"),
        "fragmented": perturb.fragmented("device_type", 0.2),
        "fragmented by site": perturb.fragmented("device_type", 0.2, 3, ("device_id", "site_id")),
        "collided": perturb.collided("device_type", 0.2, "next"),
        "stump": F.coalesce("stump", "device_type"),
    }
    out = fingerprints.fed_through(fingerprints.score_variants(rows, labels))
    return out.withColumn("reach", F.round("reach", 6))


@query(None)
def feed_through_forest(spark, d):
    """Admission when the devices of held vectors get the type that a forest predicts, beside their labels' types."""
    told = _predictions(spark, d, "forest").select(F.concat(F.lit("dev-"), F.col("vec_id").cast("string")).alias("device_id"), F.col("label").cast("string").alias("label"), "predicted").dropDuplicates(["device_id"])
    rows = with_key(from_star_schema(spark, d)).select("device_id", "site_id", "endpoint", "protocol", "port", "day", F.lit(1).alias("n")).join(written(told, "told"), "device_id")
    return fingerprints.fed_through(fingerprints.score_variants(rows, {"true": F.col("label"), "predicted": F.col("predicted")}))
