"""Numbers that tables and other programs give for the same tests, and addresses of both kinds."""

import ipaddress
import math
import struct


import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corrobix.functions import keys
from corrobix.operators import lifecycle
from corrobix.operators import statistics as stats


def test_t_distribution():
    assert stats.t_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-8) and stats.t_tail(0, 5) == pytest.approx(1)
    assert stats.t_quantile(0.975, 27) == pytest.approx(2.051830516, abs=1e-7)
    assert stats.t_tail(1.0, 1) == pytest.approx(0.5, abs=1e-10)  # the Cauchy distribution


def test_signed_ranks():
    assert stats.signed_rank_p(0, 6) == pytest.approx(2 / 64) and stats.signed_rank_p(5, 8) == pytest.approx(2 * 10 / 256)
    assert stats.signed_rank_p(0, 0) == 1.0 and 0 < stats.signed_rank_p(600, 60) < 1


def test_power():
    """With no effect power is the level; it grows with the effect, and the least effect has the power asked for."""
    assert stats.observed_power(20, 1e-12, 1.0) == pytest.approx(0.05, abs=1e-4)
    d = stats.least_effect(28, 2.0)
    assert stats.observed_power(28, d, 2.0) == pytest.approx(0.8, abs=1e-3) and d / 2 == pytest.approx(0.549, abs=0.003)
    assert stats.observed_power(5, 1.0, 0.0) == 1.0 and stats.observed_power(1, 1.0, 1.0) == 0.0


def test_paired_table(spark):
    rows = spark.createDataFrame([("x", float(a), float(b)) for a, b in ((125, 110), (115, 122), (130, 125), (140, 120), (140, 140), (115, 124), (140, 123), (125, 137), (140, 135), (135, 145))] + [("y", 1.0, 0.0), ("y", None, 1.0)], "k string, a double, b double")
    got = {r.k: r for r in stats.with_p_values(stats.paired(rows, "k")).collect()}
    x = got["x"]
    assert (x.n, x.mean_diff, x.w, x.moved) == (10, 2.4, 18.0, 9) and x.t == pytest.approx(2.4 / math.sqrt(1280.4 / 90), abs=1e-9) and x.t_p == pytest.approx(0.5404, abs=1e-3) and x.low < 2.4 < x.high
    assert (got["y"].t, got["y"].t_p, got["y"].low) == (0.0, 1.0, 0.0)


ODD = ["8.8.8.8", "10.0.0.1", "::", "::1", "::ffff:8.8.8.8", "2001:4860:4860::8888", "2001:db8::1", "fc00::1", "fe80::1%eth0", "fe80::1", "ff02::1", "64:ff9b::808:808", "64:ff9b:1::1", "100::1", "2002::1", "2001::1", "2001:1::1", "2001:1::4", "2001:20::1", "2001:30::1", "2001:3::1", "2001:4:112::1", "1:2:3:4:5:6:7:8", "1::2:3:4:5:6:7", "3fff::1", "5f00::1"]
NONE = ["a.example", "1:2:3", "1::2::3", "12345::", ":::", "", "1.2.3", "1:2:3:4:5:6:7:8:9", "g::1", "1.2.3.256"]


def test_addresses_as_another_parser_reads_them(spark):
    rows = spark.createDataFrame([(x,) for x in [*ODD, *NONE]], "a string").select("a", keys.is_address("a").alias("is"), keys.is_global("a").alias("far"), keys.ipv6_groups("a").alias("g")).collect()
    for r in rows:
        assert r["is"] == (r.a in ODD), r.a
        if r.a in ODD and ":" in r.a:
            own = ipaddress.ip_address(r.a.split("%")[0])
            assert r.g == list(struct.unpack(">8H", own.packed)), r.a
            assert r.far == own.is_global, r.a


def test_names_and_classes(spark):
    rows = spark.createDataFrame([("a.b.co.uk",), ("www.example.com",), ("co.uk",), ("8.8.8.8",), ("x.gov.au",), ("fe80::1",), ("localhost",)], "endpoint string")
    assert [r[0] for r in rows.select(keys.registered_domain("endpoint")).collect()] == ["b.co.uk", "example.com", "co.uk", "8.8.8.8", "x.gov.au", "fe80::1", "localhost"]
    v6 = spark.createDataFrame([("fe80::1", "https", 443), ("2001:4860::1", "https", 443), ("2001:4860::1", "udp", 53)], "endpoint string, protocol string, port int")
    assert [r[0] for r in v6.select(keys.service_class()).collect()] == ["other", "other", "dns"]
    kept = spark.createDataFrame([(None, "fe80::1"), (None, "2001:4860::1"), ("10.0.0.1:80", "10.0.0.1"), ("a.example", "10.0.0.1")], "fqdn string, remote_ip string")
    assert [r.remote_ip for r in kept.where(keys.keeps_global()).collect()] == ["2001:4860::1", "10.0.0.1"]


def test_open_disputes_block(spark):
    row = spark.createDataFrame([(3, "dns", 0.9, True), (3, "dns", 0.9, False), (None, "dns", 0.9, None), (1, "dns", 0.9, None)], "supporting_sites long, endpoint_class string, score double, open boolean")
    from pyspark.sql import functions as F

    got = row.select(keys.admitted(0.65, 2, disputed=F.col("open")).alias("ok"), keys.blocked_reason(0.65, 2, F.col("open")).alias("why")).collect()
    assert [(r.ok, r.why) for r in got] == [(False, "dispute"), (True, ""), (True, ""), (False, "quorum")]


OPS = st.sampled_from(["query", "commit", "revoke", "restore_local", "dispute", "restore"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(OPS, st.sampled_from("abc"), st.booleans()), max_size=40))
def test_lifecycle_invariants(events):
    """Nothing is active without a commit, an open dispute leaves nothing active, a local veto outlives a restore."""
    state = {"sites": {}, "disputes": set()}
    for i, (op, site, ok) in enumerate(events):
        before = {s: list(v) for s, v in state["sites"].items()}
        lifecycle.step(state, op, site, ok, i)
        for s, (status, origin, seq) in state["sites"].items():
            assert status in ("monitor-only", "active", "disputed", "revoked")
            if status == "active" and before.get(s, [""])[0] != "active":
                assert op == "commit" and s == site and ok and not state["disputes"]
            assert not (state["disputes"] and status == "active")
            if op == "restore" and before.get(s, ["", ""])[:2] == ["revoked", "local"]:
                assert [status, origin, seq] == before[s]

