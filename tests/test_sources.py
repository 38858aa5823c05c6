"""Inventories, counted readers, archived logs, mapped captures, policy tables, federations, graphs, suffix rules, classifiers."""

import json
import zipfile

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corrobix.functions import keys
from corrobix.operators import domains, evaluation, fingerprints, perturb, transfer
from corrobix.sinks import exports
from corrobix.sources import captures, flows, inventory, policies

from .test_captures import answer, capture, frame

HEADER = "srcIp,dstIp,dstPort,protocol,ipProto,time,dstNumPackets\n"
ME, FAR = "192.168.1.5", "8.8.4.4"


def test_what_is_wrong_with_folders(spark, tmp_path):
    assert [r.reason for r in inventory.flow_issues(spark, str(tmp_path / "none"), "flows").collect()] == ["the folder is missing"]
    at = tmp_path / "flows"
    at.mkdir()
    assert [r.reason for r in inventory.flow_issues(spark, str(at), "flows").collect()] == ["there are no *_flows.csv files"]
    (at / "lamp_x1_flows.csv").write_text("srcIp,dstIp,dstPort,time\n1.1.1.1,2.2.2.2,443,2026-01-01T00:00:00\n")
    (at / "lamp_x2_flows.csv").write_text("srcIp,port\n1.1.1.1,443\n\n")
    (at / "empty_x3_flows.csv").write_text("srcIp,dstIp,dstPort,time\n")
    assert sorted((r.path.rsplit("/", 1)[-1], r.reason) for r in inventory.flow_issues(spark, str(at), "flows").collect()) == [("empty_x3_flows.csv", "no rows"), ("lamp_x2_flows.csv", "missing columns: dstIp, dstPort, time")]
    own = tmp_path / "profiles"
    own.mkdir()
    for name, text in (("camera", json.dumps({"rules": [1, 2]})), ("broken", "not json"), ("list", "[]")):
        (own / f"{name}.json").write_text(text)
    wrong = inventory.profile_issues(spark, str(own), "profiles")
    assert sorted((r.path.rsplit("/", 1)[-1], r.reason) for r in wrong.collect()) == [("broken.json", "malformed profile"), ("list.json", "malformed profile")]
    parts = [inventory.inventory(inventory.flow_files(spark, str(at)), "flows", "traffic"), inventory.inventory(inventory.profile_files(spark, str(own)).where("whole"), "profiles", "reference")]
    summary, text = inventory.report(parts, [inventory.flow_issues(spark, str(at), "flows"), wrong])
    assert sorted(map(tuple, summary.collect())) == [("flows", "traffic", 3, 3, 2, 2), ("profiles", "reference", 1, 1, 2, 2)]
    assert [d["dataset"] for d in json.loads(text)["datasets"]] == ["flows", "profiles"]


def test_flows_are_counted_as_they_are_read(spark, tmp_path):
    rows = [f"{ME},{FAR},443,tls,6,2025-01-01 00:00:00,3", f"{FAR},{ME},443,tls,6,2025-01-01 00:00:00,1", f"{ME},224.0.0.1,1,,2,2025-01-01 00:00:00,1"]
    (tmp_path / "cam_a1_flows.csv").write_text(HEADER + "\n".join(rows) + "\n")
    (tmp_path / "none_b2_flows.csv").write_text(HEADER + "8.8.8.8,9.9.9.9,1,tcp,6,2025-01-01 00:00:00,1\n")
    counters = Observation("flows")
    assert flows.read_flows(spark, str(tmp_path), counters=counters).count() == 1
    assert counters.get == {"rows": 4, "no device address": 1, "not sent by the device": 1, "no usable peer": 1, "observation": 1}
    judged = spark.createDataFrame([("f", ME, ME, FAR), ("f", None, ME, FAR), ("g", ME, FAR, ME), ("g", ME, FAR, ME)], "file string, device_ip string, srcIp string, dstIp string")
    assert sorted(map(tuple, flows.parse_statistics(judged, flows.flow_status()).collect())) == [("f", "no device address", 1), ("f", "observation", 1), ("g", "not sent by the device", 2)]


def test_archived_logs_become_observations(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "logs.zip", "w") as z:
        z.writestr("cam/a.csv", "TS,Dst_IP,Dst Port,proto,mac\n1700000000,8.8.8.8,443,6,aa:bb\n1700000000,224.0.0.1,443,6,aa:bb\n1700000001,8.8.4.4,x,6,\n")
        z.writestr("tv/b.csv", "time,host,port,service\n2026-01-01T00:00:00Z,Api.Example.com,443,https\n")
        z.writestr("tv/c.csv", "nothing,here\n1,2\n")
    found = captures.archived_observations(captures.read_archived_csv(spark, str(tmp_path)), "s", "unit").collect()
    assert sorted((r.device_type, r.device_id, r.fqdn, r.remote_ip, r.port) for r in found if r.device_type == "cam") == [("cam", "aa:bb", None, "8.8.8.8", 443)]
    assert [(r.device_type, r.device_id, r.fqdn, r.port, r.protocol) for r in found if r.device_type == "tv"] == [("tv", "tv", "api.example.com", 443, "https")]


def test_captures_of_known_devices(spark, tmp_path):
    (tmp_path / "map.csv").write_text(f"name,address\nRing Doorbell,{ME}\n,10.0.0.9\nHub,10.0.0.7,extra\nbad\n")
    devices = captures.device_mapping(spark, str(tmp_path / "map.csv"))
    assert sorted(map(tuple, devices.collect())) == [("10.0.0.7", "Hub"), (ME, "Ring Doorbell")]
    at = tmp_path / "caps"
    at.mkdir()
    data = capture((100, frame(ME, "10.9.9.9", 6, 1, 443)), (100, frame(ME, FAR, 6, 1, 443)), (101, frame("192.168.1.1", ME, 17, 53, 5001, answer("Api.Example.com", FAR))), (102, frame(ME, FAR, 6, 1, 443)), (102, frame(ME, FAR, 6, 2, 443)), (103, frame("10.0.0.8", FAR, 6, 1, 443)), (104, frame(ME, FAR, 1, 0, 0)))
    (at / "x.pcap").write_bytes(data)
    rows = captures.read_mapped_captures(spark, str(at), devices, "lab", "unit", {"ring-doorbell": "doorbell"}).collect()
    assert sorted((r.device_type, r.fqdn or "", r.remote_ip, r.evidence_type) for r in rows) == [("doorbell", "", FAR, "flow"), ("doorbell", "api.example.com", FAR, "flow+dns_answer")]
    assert [p[4] for p in captures.packets(data)].count("icmp") == 1


def test_policy_tables(spark, tmp_path):
    at = tmp_path / "p"
    at.mkdir()
    (at / "Smart Cam.csv").write_text("direction,dst_dnsname,dst_ip,dst_port,protocol\nout,Api.Example.com,1.1.1.1,443,6\nto-device,,8.8.8.8,x,udp\nin,,,1,udp\n")
    assert sorted(map(tuple, policies.read_policy_tables(spark, str(at)).collect())) == [("smart-cam", "from-device", "api.example.com", "tcp", 443), ("smart-cam", "to-device", "8.8.8.8", "udp", 0)]
    (at / "Smart Cam.csv").write_text("dst_dnsname,port\nx,1\n")
    with pytest.raises(ValueError, match="direction"):
        policies.read_policy_tables(spark, str(at))
    (at / "Smart Cam.csv").write_text("direction,dst_ip\nsideways,1.1.1.1\n")
    with pytest.raises(Exception, match="unknown direction"):
        policies.read_policy_tables(spark, str(at)).collect()


def test_federation(spark):
    one = spark.createDataFrame([("x", "cam", 1), ("y", "tv", 2)], "site_id string, device_type string, seq int")
    two = spark.createDataFrame([("z", "cam", "api")], "site_id string, device_type string, fqdn string")
    shared = spark.createDataFrame([("cam",)], "device_type string")
    got = flows.federated({"a": one, "b": two}, shared, {"a": "org-1"}).collect()
    assert sorted((r.site_id, r.device_type, r.seq or 0, r.fqdn or "") for r in got) == [("b", "cam", 0, "api"), ("org-1", "cam", 1, "")]


def test_graphs_can_be_read(spark, tmp_path):
    edges = spark.createDataFrame([("cam", "a", "b", 2), ("cam", 'c"&', "b", 1)], "device_type string, a string, b string, weight int")
    nodes = spark.createDataFrame([("cam", x) for x in ("a", "b", 'c"&', "d")] + [("tv", "e")], "device_type string, node string")
    assert sorted(map(tuple, exports.graph_summary(edges, nodes).collect())) == [("cam", 4, 2, 2 / 6, 1.0, 2), ("tv", 1, 0, 0.0, 0.0, 1)]
    exports.write_graph(edges, nodes, str(tmp_path / "g"))
    files = {p.parent.name: p.read_text() for p in (tmp_path / "g").rglob("part-*") if p.suffix == ".txt"}
    assert files["device_type=tv"] == 'graph [\n  directed 0\n  node [ id 1 label "e" ]\n]\n'
    assert files["device_type=cam"].splitlines()[2:] == ['  node [ id 1 label "a" ]', '  node [ id 2 label "b" ]', '  node [ id 3 label "c&quot;&amp;" ]', '  node [ id 4 label "d" ]', "  edge [ source 1 target 2 weight 2 ]", "  edge [ source 3 target 2 weight 1 ]", "]"]


def test_suffix_rules(spark):
    rules = domains.suffix_rules(spark.createDataFrame([(x,) for x in ("// comment", "", "com", "co.uk", "uk", "*.ck", "!www.ck", "*.kawasaki.jp", "jp", "!city.kawasaki.jp", "Blogspot.com  trailing")], "line string"))
    want = {"a.b.example.com": "example.com", "com": None, "x.co.uk": "x.co.uk", "co.uk": None, "www.x.uk": "x.uk", "a.b.c.ck": "b.c.ck", "c.ck": None, "www.ck": "www.ck", "a.www.ck": "www.ck", "x.y.kawasaki.jp": "x.y.kawasaki.jp", "y.kawasaki.jp": None, "a.city.kawasaki.jp": "city.kawasaki.jp", "me.blogspot.com": "me.blogspot.com", "host.local": "host.local", "EXAMPLE.com.": "example.com", "8.8.8.8": "8.8.8.8", "::1": "::1", "": None, None: None}
    rows = spark.createDataFrame([(x,) for x in [*want, "a.b.example.com"]], "fqdn string")
    got = domains.with_registrable(rows, rules).collect()
    assert len(got) == len(want) + 1 and {r.fqdn: r.domain for r in got} == want


def test_classifiers(spark):
    import random

    rng = random.Random(1)
    rows = [(i, [rng.gauss(3.0 * (i % 3 == k), 0.5) for k in range(3)] + [rng.random()], f"type-{i % 3}") for i in range(240)] + [(900, None, "type-0"), (901, [1.0], "type-0"), (902, [float("nan")] * 4, "type-0"), (None, [0.0] * 4, "type-1"), (904, [0.0] * 4, None)]
    train, test = fingerprints.routed(spark.createDataFrame(rows, "id long, vector array<double>, label string"), "id", 4, 1)
    assert not {r.id for r in train.collect()} & {r.id for r in test.collect()}
    for kind, least in (("forest", 0.95), ("boosted", 0.95), ("stump", 0.5)):
        got = fingerprints.predicted_labels(train, test, "vector", "label", 4, kind).where("label is not null").collect()
        assert len(got) > 30 and sum(r.predicted == r.label for r in got) >= least * len(got)
    with pytest.raises(ValueError, match="none of"):
        fingerprints.predicted_labels(train, test, "vector", "label", 4, "oracle")


def test_predicted_types_take_the_place_of_reported_ones(spark):
    rows = spark.createDataFrame([("d1", 1, "cam"), ("d1", 2, "cam"), ("d2", 1, "tv")], "device_id string, at int, device_type string")
    told = spark.createDataFrame([("d1", 2, "hub")], "device_id string, at int, predicted string")
    assert sorted((r.device_id, r.at, r.device_type) for r in fingerprints.relabelled(rows, told, ("device_id", "at")).collect()) == [("d1", 1, "cam"), ("d1", 2, "hub"), ("d2", 1, "tv")]
    many = spark.createDataFrame([(f"d{i}", f"s{i % 5}", "cam", "tv") for i in range(2000)], "device_id string, site_id string, device_type string, next string")
    parts = {r.label: r["count"] for r in many.select(perturb.fragmented("device_type", 0.3).alias("label")).groupBy("label").count().collect()}
    assert set(parts) == {"cam", "cam#0", "cam#1"} and abs(parts["cam"] - 1400) < 120
    merged = {r.label: r["count"] for r in many.select(perturb.collided("device_type", 0.3, "next").alias("label")).groupBy("label").count().collect()}
    assert set(merged) == {"cam", "tv"} and abs(merged["tv"] - 600) < 120
    assert many.where(perturb.fragmented("device_type", 0.0) != F.col("device_type")).count() == 0
    by_site = many.select("site_id", perturb.fragmented("device_type", 0.5, 2, ("site_id",)).alias("label")).distinct()
    assert by_site.count() == 5


def test_columns_of_policies_and_devices(spark):
    rows = spark.createDataFrame([("api.example.com", "https"), ("8.8.8.8", "https"), (None, "udp"), ("x.example.com", "gre")], "endpoint string, protocol string")
    assert [r[0] for r in rows.select(keys.representable()).collect()] == [True, False, False, False]
    names = spark.createDataFrame([("Ring Doorbell.json",), ("TP-Link Plug",)], "d string")
    assert [r[0] for r in names.select(keys.canonical_device("d", {"ring-doorbell": "doorbell"})).collect()] == ["doorbell", "tp-link-plug"]
    seen = spark.createDataFrame([("cam", "a", "https", 1, "out", True), ("cam", "a", "https", 1, "out", True), ("cam", "b", "https", 1, "out", False), ("cam", "c", "https", 1, "in", True)], "device_type string, endpoint string, protocol string, port int, direction string, response_observed boolean")
    assert [tuple(r) for r in keys.response_legs(seen).collect()] == [("cam", "a", "https", 1)]
    rules = spark.createDataFrame([("cam", "a", "tcp", 1), ("cam", "8.8.0.0/16", "tcp", 1), ("cam", "*", "udp", 123), ("hub", "x", "tcp", 1)], keys.endpoint and "device_type string, endpoint string, protocol string, port int")
    assert sum(r.asDict().get("count", r[-1]) for r in evaluation.rule_kinds(rules).collect()) == 4
    assert evaluation.device_coverage(seen, rules).count() == 2


def test_priors_of_a_site_that_has_just_begun(spark):
    """A prior of other sites knows on the first day what the site itself does not; the next type's profile does not help."""
    import datetime

    day = datetime.date(2026, 1, 1)
    rows = [(s, "camera", "api.maker.example", "https", 443, day, 1) for s in ("a", "b", "c")] + [("new", "camera", "api.maker.example", "https", 443, day + datetime.timedelta(10), 1), ("b", "heater", "api.rival.example", "https", 443, day, 1), ("c", "heater", "api.rival.example", "https", 443, day, 1)]
    cube = spark.createDataFrame(rows, "site_id string, device_type string, endpoint string, protocol string, port int, day date, n long")
    truth = cube.select("device_type", "endpoint", "protocol", "port").distinct()
    from corrobix.operators import overlap

    nearest = transfer.nearest_by_all_facts(overlap.site_jaccard(cube), cube)
    got = {(r.window, r.method): r.f1 for r in transfer.cold_start(cube, truth, nearest, (0, 1)).where("receiver = 'new'").collect()}
    assert {m: got[0, m] for m in transfer.METHODS} == {"local only": 0.0, "registry": 1.0, "pooled union": 1.0, "nearest site": 1.0, "mismatched type": 0.0}
    assert got[1, "local only"] == 1.0 and got[1, "mismatched type"] == pytest.approx(2 / 3)


def test_priors_shuffle_facts_twice(spark, monkeypatch):
    """Facts are shuffled once for all priors and once for the wrong type's; a fact without a port counts as the SQL counts it."""
    import datetime

    day = datetime.date(2026, 1, 1)
    rows = [(s, "camera", "api.maker.example", "https", port, day, 1) for s, port in (("a", 443), ("b", 443), ("b", None), (None, 443))] + [("a", "lock", "api.maker.example", "https", 443, day, 1)]
    cube = spark.createDataFrame(rows, "site_id string, device_type string, endpoint string, protocol string, port int, day date, n long")
    truth = cube.where("port = 443").select("device_type", "endpoint", "protocol", "port").distinct()
    nearest = spark.createDataFrame([("a", "b"), ("b", "a")], "site_id string, nearest string")
    plans, write = [], transfer.written

    def kept(df, name="step"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(transfer, "written", kept)
    found = transfer.cold_start(write(cube, "cube"), write(truth, "truth"), nearest, (0, 1))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("Exchange hashpartitioning" in line and "endpoint" in line for p in plans for line in p.splitlines()) <= 2
    got = {(r.receiver, r.window, r.method): (r.devices, r.predicted, round(r.recall, 6)) for r in found.collect()}
    assert got["b", 1, "local only"] == (1, 2, 1.0) and got["b", 0, "nearest site"] == (1, 1, 1.0) and got["a", 0, "nearest site"] == (2, 2, 0.5)
    assert got["a", 0, "pooled union"] == (2, 2, 0.5) and got["b", 0, "local only"] == (1, 0, 0.0)
