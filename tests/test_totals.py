"""Totals and labellings without a row for each count or labelling, against plain counts; tasks that grow with the tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corrobix import catalog
from corrobix.functions.keys import KEY
from corrobix.operators import fingerprints, scoring
from corrobix.plans import registered
from corrobix.sources import tables


def _rows(spark, seed: int):
    rng = random.Random(seed)
    days = [datetime.date(2024, 1, 1 + i) for i in range(6)]
    rows = [(f"s{rng.randrange(4)}", rng.choice(("cam", "tv", None)), rng.choice(("a", "b", None)), "udp", 53, rng.choice(days), rng.randrange(1, 4), rng.random() < 0.2) for _ in range(300)]
    return spark.createDataFrame(rows, "site_id string, device_type string, endpoint string, protocol string, port int, day date, n int, moved boolean")


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_totals_are_plain_counts(spark):
    rows = _rows(spark, 1)
    clean = F.col("site_id") != "s0"
    got = scoring.fact_totals(rows, clean)
    want = rows.groupBy(*KEY).agg(F.count_distinct("site_id").alias("supporting_sites"), F.count_distinct(F.when(clean, F.col("day"))).alias("days"), F.sum(F.when(clean, F.col("n")).otherwise(0)).alias("n"))
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    assert "Expand" not in _plan(scoring.score(rows))


def test_labellings_are_scored_as_if_each_were_alone(spark):
    rows = _rows(spark, 2)
    labels = {"true": F.col("device_type"), "moved": F.when(F.col("moved"), "tv").otherwise(F.col("device_type")), "same": F.col("device_type")}
    got = {tuple(r) for r in fingerprints.score_variants(rows, labels).select(*KEY, "supporting_sites", "days", "n", F.round("score", 9), "accepted").collect()}
    want = set()
    for name, label in labels.items():
        alone = scoring.score(rows.withColumn("device_type", F.concat(F.lit(f"{name}|"), label)))
        want |= {tuple(r) for r in alone.select(*KEY, "supporting_sites", "days", "n", F.round("score", 9), "accepted").collect()}
    assert got == want


def test_a_row_with_one_label_stays_one_row(spark):
    rows = _rows(spark, 3).where("device_type = 'tv'")
    cells = ("site_id", *KEY, "day")
    cube = fingerprints.variants(rows, {"true": F.col("device_type"), "moved": F.when(F.col("moved"), "tv").otherwise(F.col("device_type"))})
    assert cube.count() == rows.select(*cells).distinct().count()


def test_partitions_grow_with_the_tables(spark, monkeypatch):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    tables.bounded_tasks(spark, "/root/testdata/sf0.001")
    assert spark.conf.get(name) == spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(tables, "BYTES_A_PARTITION", 1000)
    tables.bounded_tasks(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(name)) > 50
    tables.bounded_tasks(spark, "/nowhere")


def test_every_registered_query_bounds_its_tasks_first(monkeypatch):
    class Bounded(Exception):
        pass

    def bound(spark, sf_dir):
        raise Bounded(sf_dir)

    monkeypatch.setattr(registered, "bounded_tasks", bound)
    for name, q in catalog.queries().items():
        with pytest.raises(Bounded, match="folder"):
            q(None, "folder")
            pytest.fail(name)
