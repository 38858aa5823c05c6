"""Rollouts and checkpoints against scores of every day's own rows."""

import datetime
import random

import pytest

from corrobix.operators import drift, scoring

DAY = datetime.date(2026, 1, 1)
CUBE = "site_id string, device_type string, endpoint string, protocol string, port int, day date, n long"


def cube_rows(seed=1, sites=6):
    rng = random.Random(seed)
    rows = {}
    for s in range(sites):
        for _ in range(12):
            rows[f"s{s}", "cam", f"api.v{rng.randrange(4)}.example.com", "https", 443, DAY + datetime.timedelta(rng.randrange(50))] = rng.randrange(1, 4)
    rows["s0", "lamp", "api.v1.example.com", "https", 443, DAY] = 1
    return [(*k, n) for k, n in rows.items()]


def test_rollout_equals_scores_of_each_day(spark):
    rows, horizon = cube_rows(), 20
    cube = spark.createDataFrame(rows, CUBE)
    first = {}
    for s, t, *_, day, _ in rows:
        first[t, s] = min(day, first.get((t, s), day))
    starts = spark.createDataFrame([(t, s, day, 1.0 + i / 4) for i, ((t, s), day) in enumerate(sorted(first.items()))], "device_type string, site_id string, day date, weight double")
    chosen = drift.adopters(starts, (0.1, 0.5, 1.0))
    groups = {}
    for r in chosen.collect():
        groups.setdefault((r.device_type, r.fraction), []).append(r)
    assert {k: len(v) for k, v in groups.items()} == {("cam", 0.1): 1, ("cam", 0.5): 3, ("cam", 1.0): 6}
    assert {r.site_id for r in groups["cam", 0.5]} <= {r.site_id for r in groups["cam", 1.0]}
    got = {(r.fraction, r.rollout_days): r for r in drift.rollout(cube, chosen, horizon, theta=0.5).collect()}
    assert len(got) == 3 * horizon
    for (_, fraction), own in groups.items():
        weight = sum(r.weight for r in own) / own[0].all_weight
        for d in range(1, horizon + 1):
            new = [(r.site_id, "cam", "new.example.com", "https", 443, r.day + datetime.timedelta(i), 1) for r in own for i in range(1, d + 1)]
            fact = next(r for r in scoring.score(spark.createDataFrame([x for x in rows if x[1] == "cam"] + new, CUBE)).where("endpoint = 'new.example.com'").collect()) if d in (1, 7, 20) else None
            r = got[fraction, d]
            assert r.supporting_sites == len(own) and abs(r.site_confidence - weight) < 1e-12 and r.accepted == (len(own) >= 2 and round(r.score, 9) >= 0.5)
            if fact:
                assert abs(r.temporal_confidence - fact.temporal_confidence) < 1e-12
    days = {r.fraction: r.first_admitted_day for r in drift.first_admitted(drift.rollout(cube, chosen, horizon, theta=0.5)).collect()}
    assert days == {f: min((d for (g, d), r in got.items() if g == f and r.accepted), default=None) for f in (0.1, 0.5, 1.0)}


def test_drift_over_many_sites_is_promoted_and_one_site_is_not(spark):
    cube = spark.createDataFrame([(f"site-{s}", "camera", e, "https", 443, DAY, 1) for s in "abcd" for e in ("api.maker.example", "clock.maker.example")], CUBE)
    starts = cube.selectExpr("device_type", "site_id", "day", "1.0D as weight").distinct()
    rows = drift.rollout(cube, drift.adopters(starts, (0.25, 1.0)), 30, theta=0.55).collect()
    assert {(r.fraction, r.rollout_days): r.accepted for r in rows if r.rollout_days in (1, 30)} == {(0.25, 1): False, (0.25, 30): False, (1.0, 1): True, (1.0, 30): True}


@pytest.mark.parametrize("checkpoints", [(0, 7, 30), (50,), (3,)])
def test_checkpoints_equal_rescoring(spark, checkpoints):
    rows = cube_rows(2)
    cube = spark.createDataFrame(rows, CUBE)
    begin = min(r[5] for r in rows)
    got = drift.checkpoint_scores(cube, checkpoints, theta=0.5)
    keys = ["device_type", "endpoint", "protocol", "port", "supporting_sites", "eligible_sites", "days", "device_days", "n", "accepted"]
    accepted = {}
    for c in checkpoints:
        want = scoring.score(cube.where(cube.day <= begin + datetime.timedelta(c)), theta=0.5)
        assert sorted(map(tuple, got.where(f"checkpoint = {c}").select(keys).collect())) == sorted(map(tuple, want.select(keys).collect()))
        accepted[c] = {tuple(r)[:4] for r in want.where("accepted").select(keys).collect()}
    before, expected = set(), []
    for c in sorted(checkpoints):
        expected.append((c, len(accepted[c]), len(accepted[c] - before), len(before - accepted[c]), len(accepted[c] ^ before)))
        before = accepted[c]
    assert sorted(map(tuple, drift.decision_churn(got, checkpoints).collect())) == expected


def test_scratch_tables_go(spark):
    from corrobix.sources import tables

    with tables.scratch(spark):
        rows = tables.written(spark.range(3), "gone")
        path = rows.inputFiles()[0].rsplit("/", 1)[0]
        assert rows.count() == 3
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
