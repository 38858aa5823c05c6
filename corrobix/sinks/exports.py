"""Results as files: tables as CSV or JSON, a profile for each site and device type, the graph of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import KEY, slug
from ..operators.overlap import connected

SCORE_COLUMNS = (*KEY, "endpoint_class", "supporting_sites", "eligible_sites", "site_confidence", "temporal_confidence", "score", "accepted")


def write_table(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Rows as CSV with a header, or as JSON lines; numbers are written as they are, nulls as empty fields."""
    if kind not in ("csv", "json"):
        raise ValueError(f"unknown kind of table: {kind}")
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def write_scores(scored: DataFrame, path: str, kind: str = "csv") -> None:
    """Scores of facts with a fixed order of columns and the direction that scores stand for."""
    write_table(scored.select(F.lit("from-device").alias("direction"), *SCORE_COLUMNS), path, kind)


def read_scores(spark, path: str, least: float = 0.0) -> DataFrame:
    """Accepted facts of a written score table; a table without a direction column is refused."""
    rows = spark.read.csv(path, header=True)
    if "direction" not in rows.columns:
        raise ValueError("score table has no direction column")
    typed = rows.withColumn("score", F.col("score").cast("double")).withColumn("port", F.col("port").cast("int"))
    return typed.where((F.lower("accepted") == "true") & (F.col("score") >= least)).select(*KEY, "direction", "score")


def write_local_profiles(profiles: DataFrame, path: str) -> None:
    """One folder of JSON for each site and device type, named by their slugs; the names themselves stay in the rows."""
    named = profiles.withColumn("site", slug("site_id")).withColumn("device", slug("device_type"))
    named.repartition("site", "device").write.mode("overwrite").partitionBy("site", "device").json(path)


def write_global_profiles(profiles: DataFrame, path: str) -> None:
    """One folder of JSON for each device type."""
    profiles.withColumn("device", slug("device_type")).repartition("device").write.mode("overwrite").partitionBy("device").json(path)


def write_baseline(facts: DataFrame, path: str, name: str, kind: str = "csv") -> None:
    """Facts that a baseline keeps, with its name."""
    write_table(facts.select(F.lit(name).alias("baseline"), *KEY), path, kind)


def read_baseline(spark, path: str) -> DataFrame:
    """Facts of a written baseline."""
    return spark.read.csv(path, header=True).select("device_type", "endpoint", "protocol", F.col("port").cast("int").alias("port")).distinct()


def graph_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """device_type, nodes, edges, density, degree (mean), components of a graph of facts (device_type, a, b, weight) with all nodes
    (device_type, node)."""
    n = nodes.groupBy("device_type").agg(F.count_distinct("node").alias("nodes"))
    e = edges.groupBy("device_type").agg(F.count("*").alias("edges"))
    parts = connected(edges, nodes, ["device_type"]).groupBy("device_type").agg(F.count_distinct("root").alias("components"))
    possible = F.col("nodes") * (F.col("nodes") - 1) / 2
    rows = n.join(e, "device_type", "left").fillna(0, ["edges"]).join(parts, "device_type")
    return rows.withColumn("density", F.when(possible > 0, F.col("edges") / possible).otherwise(0.0)).withColumn("degree", 2 * F.col("edges") / F.col("nodes")).select("device_type", "nodes", "edges", "density", "degree", "components")


def write_graph(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """A GML document for each device type, in a folder of its own: its nodes with numbers and labels, then its edges.

    A document is one file, so a device type's lines pass through one task, sorted and in a stream, never held.
    """
    numbered = nodes.select("device_type", "node").distinct().withColumn("id", F.row_number().over(Window.partitionBy("device_type").orderBy("node")))
    ends = edges.join(numbered.toDF("device_type", "a", "ia"), ["device_type", "a"]).join(numbered.toDF("device_type", "b", "ib"), ["device_type", "b"])
    label = F.regexp_replace(F.regexp_replace("node", "&", "&amp;"), '"', "&quot;")
    lines = numbered.select("device_type", F.lit(1).alias("part"), F.col("id").alias("x"), F.lit(0).alias("y"), F.concat(F.lit("  node [ id "), F.col("id").cast("string"), F.lit(' label "'), label, F.lit('" ]')).alias("value"))
    lines = lines.unionByName(ends.select("device_type", F.lit(2).alias("part"), F.col("ia").alias("x"), F.col("ib").alias("y"), F.concat(F.lit("  edge [ source "), F.col("ia").cast("string"), F.lit(" target "), F.col("ib").cast("string"), F.lit(" weight "), F.col("weight").cast("string"), F.lit(" ]")).alias("value")))
    around = nodes.select("device_type").distinct().select("device_type", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("graph [\n  directed 0").alias("value")), F.struct(F.lit(3).alias("part"), F.lit("]").alias("value")))).alias("e"))
    lines = lines.unionByName(around.select("device_type", "e.part", F.lit(0).alias("x"), F.lit(0).alias("y"), "e.value"))
    lines.repartition("device_type").sortWithinPartitions("device_type", "part", "x", "y").select("device_type", "value").write.mode("overwrite").partitionBy("device_type").text(path)
