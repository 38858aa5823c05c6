"""Operators without SQL, sources and streams, on small tables of their own."""

import datetime

import pytest
from pyspark.sql import functions as F

from corrobix.functions import keys
from corrobix.operators import evaluation, lifecycle, overlap, scoring, sequences, timeline
from corrobix.sources import observations
from corrobix.streaming import windows

DAY = datetime.date(2026, 1, 1)


def cube(spark, rows):
    return spark.createDataFrame([(s, "camera", e, "https", 443, DAY + datetime.timedelta(d), n) for s, e, d, n in rows], "site_id string, device_type string, endpoint string, protocol string, port int, day date, n long")


def test_site_confidence_of_three_sites(spark):
    rows = scoring.score(cube(spark, [("a", "x.example", 0, 1), ("b", "x.example", 0, 1), ("c", "y.example", 1, 1)])).collect()
    assert {r.endpoint: round(r.site_confidence, 6) for r in rows} == {"x.example": 0.666667, "y.example": 0.333333}


def test_repeated_reports_do_not_raise_support(spark):
    one, many = ([("a", "x.example", 0, n), ("b", "y.example", 0, 1)] for n in (1, 500))
    assert [r.supporting_sites for r in scoring.score(cube(spark, one)).orderBy("endpoint").collect()] == [r.supporting_sites for r in scoring.score(cube(spark, many)).orderBy("endpoint").collect()]


def test_quarantined_sites_stay_sites(spark):
    c = cube(spark, [("a", "x.example", 0, 1), ("b", "x.example", 9, 1)])
    row = scoring.score(c, quarantined=scoring.quarantined_by_tenure(c, 5)).first()
    assert row.supporting_sites == 2 and row.days == 1


def test_empty_cube(spark):
    assert scoring.score(cube(spark, [])).collect() == []


@pytest.mark.parametrize(
    ("endpoint", "protocol", "port", "expected"),
    [("10.1.2.3", "udp", 53, "other"), ("8.8.8.8", "udp", 53, "dns"), ("8.8.8.8", "ntp", 1, "ntp"), ("ota.example.com", "https", 443, "update"), ("api.example.com", "https", 443, "vendor-cloud"), ("8.8.8.8", "https", 443, "other")],
)
def test_service_class(spark, endpoint, protocol, port, expected):
    assert spark.createDataFrame([(endpoint, protocol, port)], "endpoint string, protocol string, port int").select(keys.service_class()).first()[0] == expected


def test_matching_kinds(spark):
    schema = "device_type string, endpoint string, protocol string, port int"
    predicted = spark.createDataFrame([("cam", "a.example", "tcp", 443), ("cam", "8.8.1.2", "udp", 53), ("cam", "192.168.0.1", "udp", 67), ("plug", "a.example", "tcp", 443)], schema)
    rules = spark.createDataFrame([("cam", "a.example", "tcp", 0), ("cam", "8.8.0.0/16", "unknown", 53), ("cam", "gateway", "udp", 67), ("cam", "*", "tcp", 80)], schema)
    found = evaluation.matches(predicted, rules).collect()
    assert {(r.endpoint, r.kind) for r in found} == {("a.example", "literal"), ("8.8.1.2", "cidr"), ("192.168.0.1", "gateway")}


def test_nearest_evidence_prefers_the_earlier(spark):
    def at(h):
        return datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=h)

    rows = spark.createDataFrame([("s", at(10), 1), ("s", at(100), 2), ("t", at(1), 3)], "site string, timestamp timestamp, seq long")
    evidence = spark.createDataFrame([("s", at(8), "before"), ("s", at(12), "after")], "site string, timestamp timestamp, name string")
    got = {r.seq: r for r in sequences.nearest_evidence(rows, evidence, ("site",), 24).collect()}
    assert got[1].name == "before" and got[2].name is None and got[2].known_here and not got[3].known_here


def test_pagerank_of_a_star(spark):
    edges = spark.createDataFrame([("d", "hub", x, 1) for x in "abc"], "device_type string, a string, b string, weight long")
    got = {r.node: r.confidence for r in overlap.pagerank(edges).collect()}
    assert got["d|hub"] == 1.0 and 0 < got["d|a"] < 1 and abs(got["d|a"] - got["d|c"]) < 1e-9


def test_pagerank_of_all_facts(spark):
    """Weak edges count, a fact without any keeps its row; against power rounds over the whole matrix."""
    sites = {"a": "123", "b": "12", "c": "3", "d": "4", "e": "1"}
    cube = spark.createDataFrame([(s, "cam", f, "tcp", 1) for f, own in sites.items() for s in own], "site_id string, device_type string, endpoint string, protocol string, port int")
    names = sorted(sites)
    weight = {(x, y): len(set(sites[x]) & set(sites[y])) if x != y else 0 for x in names for y in names}
    rank = dict.fromkeys(names, 1 / len(names))
    for _ in range(6):
        total = {x: sum(weight[x, y] for y in names) for x in names}
        loose = sum(rank[x] for x in names if not total[x])
        rank = {y: (0.15 + 0.85 * loose) / len(names) + 0.85 * sum(rank[x] * weight[x, y] / total[x] for x in names if total[x]) for y in names}
    got = {r.node: r.confidence for r in overlap.fact_pagerank(cube, rounds=6, tolerance=0, fallback=False).collect()}
    assert got == pytest.approx({f"cam|{f}|tcp|1": rank[f] / max(rank.values()) for f in names}, abs=1e-6)


def test_pagerank_rounds_are_made_of_sets_of_sites(spark, monkeypatch):
    """Facts with the same sites are one row of every round, apart from seeds; all ranks as of the whole matrix, at rest by all facts' moves."""
    sites = {f"{own}{i}": own for own, times in {"12": 5, "1": 4, "23": 3, "4": 1, "5": 2}.items() for i in range(times)}
    names, seeds = sorted(sites), ["120", "230", "40"]
    cube = spark.createDataFrame([(s, "cam", f, "tcp", 1) for f in names for s in sites[f]] + [(None, "cam", "nowhere", "tcp", 1)], "site_id string, device_type string, endpoint string, protocol string, port int")
    weight = {(x, y): len(set(sites[x]) & set(sites[y])) if x != y else 0 for x in names for y in names}
    total = {x: sum(weight[x, y] for y in names) for x in names}
    sizes, write = [], overlap.written
    monkeypatch.setattr(overlap, "written", lambda df, name="step": sizes.append((name, (out := write(df, name)).count())) or out)
    for known in (None, seeds):
        jump = {x: 1 / len(names) if known is None else (x in known) / len(known) for x in names}
        rank = dict.fromkeys(names, 1 / len(names))
        for _ in range(7):
            loose = sum(rank[x] for x in names if not total[x])
            rank = {y: (0.15 + 0.85 * loose) * jump[y] + 0.85 * sum(rank[x] * weight[x, y] / total[x] for x in names if total[x]) for y in names}
        given = None if known is None else spark.createDataFrame([(f"cam|{x}|tcp|1",) for x in known], "node string")
        sizes.clear()
        got = {r.node: r.confidence for r in overlap.fact_pagerank(cube, rounds=7, tolerance=0, seeds=given, fallback=False).collect()}
        assert got == pytest.approx({f"cam|{f}|tcp|1": rank[f] / max(rank.values()) for f in names}, abs=1e-9)
        assert max(rows for name, rows in sizes if name == "ranks") <= (5 if known is None else 7)
    still = {r.node for r in overlap.fact_pagerank(cube, rounds=6, tolerance=1e-12).where("confidence = 1").collect()}
    assert len(still) == len(names)


def test_csv_reader(spark, tmp_path):
    (tmp_path / "o.csv").write_text("site_id,device_type,fqdn,protocol,port,timestamp,source_dataset,evidence_type,response_observed\na,cam, x.example ,HTTPS,443,2026-01-01T00:00:00Z,unit,flow,Yes\na,cam,,udp,53,2026-01-01T00:00:00Z,unit,flow,\n")
    rows = observations.read_observations_csv(spark, str(tmp_path / "o.csv")).collect()
    assert [(r.fqdn, r.protocol, r.response_observed, r.direction) for r in rows] == [("x.example", "https", True, "out"), (None, "udp", False, "out")]
    (tmp_path / "bad.csv").write_text("site_id,port\na,1\n")
    with pytest.raises(ValueError, match="lacks columns"):
        observations.read_observations_csv(spark, str(tmp_path / "bad.csv"))


def test_flow_csv_with_other_headers(spark, tmp_path):
    (tmp_path / "cam").mkdir()
    (tmp_path / "cam" / "f.csv").write_text("ts,id.orig_h,id.resp_h,id.resp_p,proto\n1700000000,10.0.0.2,8.8.8.8,53.0,17\n1700000000000,10.0.0.2,224.0.0.1,53,udp\n1700000000,10.0.0.2,8.8.8.8,x,udp\n")
    rows = observations.read_flow_csv(spark, str(tmp_path), "s", "unit").collect()
    assert [(r.device_type, r.remote_ip, r.port, r.protocol) for r in rows] == [("cam", "8.8.8.8", 53, "udp")]


def log(spark, events):
    return spark.createDataFrame([(i, "f", s, op, True) for i, (s, op) in enumerate(events)], "seq long, fact string, site_id string, op string, admissible boolean")


def test_lifecycle(spark):
    events = [("a", "query"), ("a", "commit"), ("b", "query"), ("c", "query"), ("c", "revoke"), ("b", "dispute")]
    assert {r.site_id: r.status for r in timeline.fold(log(spark, events)).collect()} == {"a": "disputed", "b": "disputed", "c": "revoked"}
    assert {r.site_id: r.status for r in timeline.fold(log(spark, [*events, ("a", "dispute")])).collect()} == {"a": "revoked", "b": "revoked", "c": "revoked"}
    after = {r.site_id: (r.status, r.origin) for r in timeline.fold(log(spark, [*events, ("a", "dispute"), ("a", "restore")])).collect()}
    assert after == {"a": ("monitor-only", "restore"), "b": ("monitor-only", "restore"), "c": ("revoked", "local")}


def test_stream_equals_batch(spark, tmp_path):
    events = observations.from_events(spark, "/root/testdata/sf0.001")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.daily_counts(stream, "4000 days").writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("daily").collect()) == sorted(windows.daily_counts(events).collect())


def test_streamed_fold_equals_batch(spark, tmp_path):
    events = lifecycle.event_log(observations.from_events(spark, "/root/testdata/sf0.001")).drop("timestamp")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = lifecycle.fold_stream(stream).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    latest = spark.table("folded").groupBy("fact", "site_id").agg(F.max_by("status", "seq").alias("status"))
    assert sorted(latest.collect()) == sorted(timeline.fold(events).select("fact", "site_id", "status").collect())
