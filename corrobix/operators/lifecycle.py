"""Lifecycle of facts: one event's step and the stream of it, registry upserts and review flags. `timeline` folds whole logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log: seq, fact, site_id, op (query, commit, revoke, restore_local, dispute, restore), admissible.
STATE = "fact string, site_id string, status string, origin string, seq long"


def step(state: dict, op: str, site: str, admissible: bool, seq: int) -> None:
    """Apply one event of a fact to state: {"sites": {site: [status, origin, seq]}, "disputes": set}.

    Commits need an admissible fact in monitor-only; a first dispute suspends the fact everywhere, one by another site
    revokes it; restore lifts what disputes did and leaves local vetoes alone.
    """
    sites, disputes = state["sites"], state["disputes"]
    now = sites.get(site)
    if op == "query" and now is None and admissible and not disputes:
        sites[site] = ["monitor-only", "query", seq]
    elif op == "commit" and now and now[0] == "monitor-only" and admissible and not disputes:
        sites[site] = ["active", "commit", seq]
    elif op == "revoke" and now and now[0] in ("monitor-only", "active"):
        sites[site] = ["revoked", "local", seq]
    elif op == "restore_local" and now and now[:2] == ["revoked", "local"] and not disputes:
        sites[site] = ["monitor-only", "local", seq]
    elif op == "dispute" and site not in disputes:
        disputes.add(site)
        to = "disputed" if len(disputes) == 1 else "revoked"
        for s in sites.values():
            if s[0] in ("monitor-only", "active", "disputed"):
                s[:] = [to, "dispute", seq]
    elif op == "restore" and disputes:
        disputes.clear()
        for s in sites.values():
            if s[1] == "dispute":
                s[:] = ["monitor-only", "restore", seq]


def history(log: DataFrame, fact: str, site: str | None = None) -> DataFrame:
    """The events of a fact, or of it at one site, in order: the log is only ever appended to."""
    rows = log.where(F.col("fact") == fact)
    return (rows if site is None else rows.where(F.col("site_id") == site)).orderBy("seq")


def once(observations: DataFrame, held: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    """New observations, each once: repeats within the batch and of what is held, by identity with nulls equal, are dropped."""
    same = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(f"_{c}") for c in identity]
    keys = [f"_{c}" for c in identity]
    return observations.select("*", *same).dropDuplicates(keys).join(held.select(*same).distinct(), keys, "left_anti").drop(*keys)


def upsert_profiles(held: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Profiles (key, first_seen, last_seen, count) after another report: the earliest, the latest and the larger count."""
    both = held.select(*key, "first_seen", "last_seen", "count").unionByName(new.select(*key, "first_seen", "last_seen", "count"))
    return both.groupBy(*key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("count").alias("count"))


def review_flags(states: DataFrame, scores: DataFrame) -> DataFrame:
    """Active decisions whose fact the recomputed scores no longer admit, or do not hold: flagged, their state stays."""
    active = states.where(F.col("status") == "active").join(scores.select("fact", "accepted", "score"), "fact", "left")
    return active.select("fact", "site_id", "score", (~F.coalesce("accepted", F.lit(False))).alias("review"))


def active_facts(states: DataFrame, site: str) -> DataFrame:
    """What a site enforces: its active facts alone, also those flagged for review."""
    return states.where((F.col("status") == "active") & (F.col("site_id") == site)).select("fact")


def fold_stream(log: DataFrame) -> DataFrame:
    """The fold over a stream: state per fact, changed sites out. Events at or before the last applied seq are ignored."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        import json

        state, last = {"sites": {}, "disputes": set()}, -1
        if held.exists:
            text, last = held.get
            old = json.loads(text)
            state = {"sites": old["sites"], "disputes": set(old["disputes"])}
        out: dict[str, list] = {}
        for r in pd.concat(batches).sort_values("seq").itertuples():
            if int(r.seq) <= last:
                continue
            before = {s: list(v) for s, v in state["sites"].items()}
            step(state, r.op, r.site_id, bool(r.admissible), int(r.seq))
            last = int(r.seq)
            out |= {s: list(v) for s, v in state["sites"].items() if before.get(s) != v}
        held.update((json.dumps({"sites": state["sites"], "disputes": sorted(state["disputes"])}), last))
        yield pd.DataFrame([(key[0], s, *v) for s, v in sorted(out.items())], columns=["fact", "site_id", "status", "origin", "seq"])

    return log.groupBy("fact").applyInPandasWithState(run, STATE, "state string, last long", "update", GroupStateTimeout.NoTimeout)


def event_log(events: DataFrame) -> DataFrame:
    """A log from the event table's rows: what each kind of event means for an endpoint at a site."""
    op = F.element_at(F.array(*(F.lit(x) for x in ("query", "commit", "query", "commit", "revoke", "restore_local", "query", "commit", "dispute", "restore"))), (F.col("seq") % 10 + 1).cast("int"))
    return events.select("seq", F.col("endpoint").alias("fact"), "site_id", op.alias("op"), (F.col("value") >= 20).alias("admissible"), "timestamp")
