"""Folds, traces and versions by spans against one event after another."""

import random

import pytest

from corrobix.operators import lifecycle, timeline

LOG = "seq long, fact string, site_id string, op string, admissible boolean"
SCORES = "seq long, fact string, site_id string, op string, score double, accepted boolean"


def random_log(seed, n=600):
    """One fact holds half of all events; sequence numbers have gaps."""
    rng, seq, rows = random.Random(seed), 0, []
    for _ in range(n):
        seq += rng.choice((1, 1, 1, 7))
        op = rng.choice(("query", "query", "commit", "commit", "revoke", "restore_local", "dispute", "restore"))
        rows.append((seq, "hot" if rng.random() < 0.5 else f"f{rng.randrange(8)}", f"s{rng.randrange(4)}", op, rng.random() < 0.8))
    return rows


def one_by_one(rows):
    facts, traced = {}, []
    for seq, fact, site, op, ok in sorted(rows):
        state = facts.setdefault(fact, {"sites": {}, "disputes": set()})
        lifecycle.step(state, op, site, ok, seq)
        if op in ("query", "commit", "revoke", "restore_local"):
            traced.append((fact, site, seq, op, *state["sites"].get(site, [None, None])[:2]))
    return sorted((f, s, *v) for f, x in facts.items() for s, v in x["sites"].items()), sorted(traced, key=repr)


@pytest.mark.parametrize(("seed", "span"), [(1, 2), (2, 5), (3, 64), (4, 4096)])
def test_fold_and_trace(spark, seed, span):
    rows = random_log(seed)
    log = spark.createDataFrame([*rows, (9999, None, "s1", "query", True), (10000, "unseen", "s1", "restore", None)], LOG).repartition(3)
    states, traced = one_by_one(rows)
    assert sorted(map(tuple, timeline.fold(log, span).collect())) == states
    assert sorted(map(tuple, timeline.trace(log, span).collect()), key=repr) == traced


def test_no_events(spark):
    log = spark.createDataFrame([], LOG)
    assert timeline.fold(log).collect() == [] and timeline.trace(log).collect() == [] and timeline.versions(spark.createDataFrame([], SCORES)).collect() == []


def test_local_vetoes_outlast_shared_restores(spark):
    """A veto from before or during a withdrawal stays through restores and later episodes; its own site lifts it."""
    for reporters in (("b",), ("b", "c")):
        events = [("a", "query"), ("a", "commit"), ("b", "query"), ("b", "commit"), ("a", "revoke"), *((r, "dispute") for r in reporters), ("c", "restore")]
        log = [(i, "f", s, op, True) for i, (s, op) in enumerate(events)]

        def states(rows):
            return {r.site_id: (r.status, r.origin) for r in timeline.fold(spark.createDataFrame(rows, LOG), 2).collect()}

        assert states(log) == {"a": ("revoked", "local"), "b": ("monitor-only", "restore")}
        later = [*log, (20, "f", "c", "dispute", True), (21, "f", "b", "restore", True)]
        assert states(later)["a"] == ("revoked", "local")
        assert states([*later, (22, "f", "a", "restore_local", True)])["a"] == ("monitor-only", "local")


def versions_one_by_one(rows):
    out, facts = [], {}
    for seq, fact, site, op, score, accepted in sorted(rows):
        x = facts.get(fact)
        if x is None and op != "score":
            continue
        x = facts.setdefault(fact, {"by": [], "active": None, "value": None})
        event = None
        if op == "score":
            event, x["value"] = "score", (score, accepted)
            if not x["by"]:
                x["active"] = x["value"]
        elif op == "dispute" and site not in x["by"] and len(x["by"]) < 2:
            x["by"].append(site)
            event = ("dispute", "revoke")[len(x["by"]) - 1]
        elif op == "restore" and x["by"]:
            event, x["by"], x["value"] = "restore", [], x["active"]
        if event:
            out.append([fact, seq, None, event, ("active", "disputed", "revoked")[len(x["by"])], *x["value"]])
    last = {}
    for v in out:
        if v[0] in last:
            last[v[0]][2] = v[1]
        last[v[0]] = v
    return sorted(map(tuple, out))


@pytest.mark.parametrize(("seed", "span"), [(1, 2), (2, 16), (3, 4096)])
def test_versions(spark, seed, span):
    rng, seq, rows = random.Random(seed), 0, []
    for _ in range(400):
        seq += rng.choice((1, 1, 5))
        score = rng.randrange(100) / 100
        rows.append((seq, "hot" if rng.random() < 0.5 else f"f{rng.randrange(6)}", f"s{rng.randrange(3)}", rng.choice(("score", "score", "dispute", "restore")), score, score >= 0.5))
    held = timeline.versions(spark.createDataFrame(rows, SCORES).repartition(3), span)
    want = versions_one_by_one(rows)
    assert sorted(map(tuple, held.collect())) == want
    probes = [(rng.randrange(seq + 9), rng.choice(("hot", "f1", "f2", "none")), f"p{i}") for i in range(200)]
    got = timeline.as_of(held, spark.createDataFrame(probes, "seq long, fact string, probe string"), span).collect()
    found = {p: next(((v[4], v[5], v[6]) for v in want if v[0] == f and v[1] <= s and (v[2] is None or s < v[2])), (None, None, None)) for s, f, p in probes}
    assert len(got) == len(probes) and all((r.status, r.score, r.accepted) == found[r.probe] for r in got)


def test_restore_brings_the_last_active_version_back(spark):
    rows = [(1, "f", "a", "score", 0.85, True), (2, "f", "a", "score", 0.92, True), (3, "f", "b", "dispute", None, None), (4, "f", "c", "dispute", None, None), (5, "f", "a", "score", 0.1, False), (6, "f", "a", "restore", None, None), (7, "f", "a", "restore", None, None), (8, "g", "a", "dispute", None, None)]
    held = sorted(map(tuple, timeline.versions(spark.createDataFrame(rows, SCORES)).collect()))
    assert [(v[1], v[2], *v[3:]) for v in held] == [(1, 2, "score", "active", 0.85, True), (2, 3, "score", "active", 0.92, True), (3, 4, "dispute", "disputed", 0.92, True), (4, 5, "revoke", "revoked", 0.92, True), (5, 6, "score", "revoked", 0.1, False), (6, None, "restore", "active", 0.92, True)]


def test_no_plan_gathers_a_fact(spark):
    """The only groups are of a fact and a span, or of small rows for each span."""
    log = spark.createDataFrame(random_log(9, 50), LOG)
    plan = timeline.fold(log)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "BatchEvalPython" not in plan
