"""Flow tables, names, archives and written results on small files."""

import io
import tarfile
import zipfile

import pytest

from corrobix.operators import scoring
from corrobix.sinks import exports
from corrobix.sources import captures, flows, observations

HEADER = "srcIp,dstIp,dstPort,protocol,ipProto,time,dstNumPackets\n"
ME, FAR = "192.168.1.5", "8.8.4.4"


def hello(name):
    entry = b"\0" + len(name).to_bytes(2, "big") + name
    body = len(entry).to_bytes(2, "big") + entry
    return (b"\0\x0b\0\x02\x01\0" + b"\0\0" + len(body).to_bytes(2, "big") + body).hex()


@pytest.fixture
def corpus(tmp_path):
    rows = [f"{ME},{FAR},443,tls,6,2025-01-01 00:00:00.1234567,3", f"{ME},{FAR},443,none,6,2025-01-01T01:00:00+01:00,0", f"{ME},1.1.1.1,53,,17,2025-01-02 00:00:00,1", f"{FAR},{ME},443,tls,6,2025-01-01 00:00:00,1", f"{ME},224.0.0.1,1,,2,2025-01-01 00:00:00,1"]
    (tmp_path / "Smart_Cam_a1_flows.csv").write_text(HEADER + "\n".join(rows) + "\n")
    (tmp_path / "none_b2_flows.csv").write_text(HEADER + "8.8.8.8,9.9.9.9,1,tcp,6,2025-01-01 00:00:00,1\n")
    at = tmp_path / "parameters" / "Smart_Cam_a1" / "request"
    at.mkdir(parents=True)
    (at / "httpattributes.csv").write_text(f"host,dstIp,dstPort\nOld.example,1.1.1.1,53\nNew.example.,1.1.1.1,53\nnull,{FAR},443\n")
    (at / "tlsattributes.csv").write_text(f"client-hello-extensions,dstIp,dstPort\n{hello(b'first.example')},{FAR},443\n{hello(b'second.example')},{FAR},443\n{hello(b'x.example')},1.1.1.1,53\nzz,{FAR},443\n")
    return str(tmp_path)


def test_flows_with_names(spark, corpus):
    got = {(r.device_type, r.device_id, r.fqdn, r.remote_ip, r.port, r.protocol, r.evidence_type, r.response_observed, r.timestamp.hour) for r in flows.read_flows(spark, corpus, flows.name_index(spark, corpus)).collect()}
    assert got == {
        ("Smart_Cam", "a1", "first.example", FAR, 443, "tls", "flow+tls_sni", True, 0), ("Smart_Cam", "a1", "first.example", FAR, 443, "tcp", "flow+tls_sni", False, 0), ("Smart_Cam", "a1", "new.example", "1.1.1.1", 53, "udp", "flow+http_host", True, 0),
    }
    assert flows.read_flows(spark, corpus).where("fqdn is not null").count() == 0


def test_server_names():
    assert flows.server_name(bytes.fromhex(hello(b"a.example"))) == "a.example"
    assert flows.server_name(b"") is None and flows.server_name(b"\0\0\0\xff\0") is None and flows.server_name(bytes.fromhex(hello(b"\xff"))) is None


def test_attack_flows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"1500000000000,{ME},{FAR},17,53\n1500000000000,10.0.0.9,{FAR},17,53\nx,{ME},{FAR},6,80\n1500000000000,{ME},0.0.0.0,6,80\n")
    assert [(r.device_type, r.endpoint, r.protocol, r.port, r.timestamp.year) for r in flows.read_attacks(spark, str(tmp_path), {ME: "cam"}).collect()] == [("cam", FAR, "udp", 53, 2017)]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("cam/x.csv", "ts,dst\n1,2\n3,4\n")
        z.writestr("readme.txt", "no")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        data = b"other\n5\n"
        info = tarfile.TarInfo("y.csv")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    (tmp_path / "broken.zip").write_bytes(b"PK nothing")
    got = sorted((r.file.rsplit("/", 1)[-1], r.line, dict(r.cells)) for r in captures.read_archived_csv(spark, str(tmp_path)).collect())
    assert got == [("x.csv", 0, {"ts": "1", "dst": "2"}), ("x.csv", 1, {"ts": "3", "dst": "4"}), ("y.csv", 0, {"other": "5"})]


def test_headers_of_other_tools():
    assert observations.column_mapping(["date_time", "dst", "sni", "eth.src", "service"]) == {"timestamp": "date_time", "dst_ip": "dst", "hostname": "sni", "device_id": "eth.src", "protocol": "service"}


def test_conditional_rows_and_features(spark):
    rows = spark.createDataFrame([(f"h{i % 6}", "cam", str(i)) for i in range(12)] + [("h1", "plug", "x"), ("h1", None, "1")], "home string, device string, a string")
    assert flows.conditional_rows(rows, ["device"], "home").count() == 12
    assert flows.flow_features(rows, ["a"]).count() == 13


def test_written_scores_and_profiles(spark, tmp_path):
    cube = observations.evidence_cube(observations.from_star_schema(spark, "/root/testdata/sf0.001"))
    scored = scoring.score(cube)
    exports.write_scores(scored, str(tmp_path / "scores"))
    got = exports.read_scores(spark, str(tmp_path / "scores"))
    want = scored.where("accepted").select("device_type", "endpoint", "protocol", "port")
    assert sorted(got.drop("direction", "score").collect()) == sorted(want.collect()) and got.select("direction").distinct().collect()[0][0] == "from-device"
    exports.write_baseline(want, str(tmp_path / "b"), "admitted")
    assert sorted(exports.read_baseline(spark, str(tmp_path / "b")).collect()) == sorted(want.collect())
    exports.write_table(want, str(tmp_path / "bad"), "json")
    with pytest.raises(ValueError, match="no direction"):
        exports.read_scores(spark, str(tmp_path / "b"))
