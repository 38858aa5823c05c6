"""Policies against documents written out by hand."""

import json

import pytest

from corrobix.sources.policies import mud_entries, policy_documents, read_policies

FACT = "device_type string, endpoint string, protocol string, port int"
IN_ONLY = """{"ietf-mud:mud": {"from-device-policy": {"access-lists": {"access-list": [{"name": "other"}]}}, "to-device-policy": {"access-lists": {"access-list": [{"name": "x"}]}}},
"ietf-access-control-list:acls": {"acl": [{"name": "x", "aces": {"ace": [{"name": "1", "matches": {"ipv4": {"ietf-acldns:src-dnsname": "S.example"}, "tcp": {"source-port": {"port": 80}}}}]}}]}}"""
BOTH = """{"ietf-mud:mud": {"from-device-policy": {"access-lists": {"access-list": [{"name": "x"}]}}, "to-device-policy": {"access-lists": {"access-list": [{"name": "x"}]}}},
"ietf-access-control-list:acls": {"acl": [{"name": "x", "aces": {"ace": [{"name": "1", "matches": {"udp": {"destination-port": {"port": 53}}}}]}}]}}"""


def test_rules_of_a_policy_for_what_comes_in(spark, tmp_path):
    (tmp_path / "Smart_Cam.json").write_text(IN_ONLY)
    assert [tuple(r) for r in read_policies(spark, str(tmp_path)).collect()] == [("smart-cam", "to-device", "s.example", "tcp", 80)]


def test_a_list_in_both_policies_is_an_error(spark, tmp_path):
    (tmp_path / "cam.json").write_text(BOTH)
    with pytest.raises(Exception, match="ACL in both"):
        read_policies(spark, str(tmp_path)).collect()


def test_export_skips_what_names_cannot_express(spark):
    facts = spark.createDataFrame([("cam", "a.example", "https", 443), ("cam", "8.8.8.8", "udp", 53), ("cam", "2001:4860::8888", "udp", 53), ("cam", "b.example", "igmp", 0), ("cam", "c.example", "ntp", 123)], FACT)
    got = {(r.endpoint, r.entry, r.place) for r in mud_entries(facts, facts.where("endpoint = 'c.example'")).collect()}
    assert got == {("2001:4860::8888", "skipped", 0), ("8.8.8.8", "skipped", 1), ("a.example", "from-device", 2), ("b.example", "skipped", 3), ("c.example", "from-device", 4), ("c.example", "to-device", 4)}


def test_written_policies_are_read_again(spark, tmp_path):
    facts = spark.createDataFrame([("cam", "a.example", "https", 443), ("cam", "8.8.8.8", "udp", 53), ("plug", "b.example", "ntp", 123)], FACT)
    for r in policy_documents(facts, facts.where("device_type = 'plug'")).collect():
        assert json.loads(r.mud)["ietf-mud:mud"]["is-supported"] and r.skipped == (r.device_type == "cam")
        (tmp_path / f"{r.device_type}.json").write_text(r.mud)
    got = {tuple(r) for r in read_policies(spark, str(tmp_path)).collect()}
    assert got == {("cam", "from-device", "a.example", "tcp", 443), ("plug", "from-device", "b.example", "udp", 123), ("plug", "to-device", "b.example", "udp", 123)}
