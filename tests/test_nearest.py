"""Nearest evidence in large groups."""

import datetime
import time

from corrobix.operators import sequences


def test_nearest_evidence_takes_linear_time(spark):
    """One site with 60,000 rows and as many pieces of evidence in a day: a frame that is read again for each row takes hours."""
    begin = datetime.datetime(2024, 1, 1)
    rows = spark.range(60000).selectExpr("'a' as site_id", f"timestamp'{begin}' + make_interval(0, 0, 0, 0, 0, 0, id) as timestamp", "id as seq")
    names = spark.range(1, 60000, 3).selectExpr("'a' as site_id", f"timestamp'{begin}' + make_interval(0, 0, 0, 0, 0, 0, id) as timestamp", "concat('n', id) as name")
    began = time.perf_counter()
    found = sequences.nearest_evidence(rows, names, ("site_id",), 24)
    assert found.where("name = concat('n', case seq % 3 when 0 then greatest(seq + 1, 1) when 1 then seq else seq - 1 end)").count() >= 59999
    assert time.perf_counter() - began < 60
