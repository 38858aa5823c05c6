"""Drift over time: an endpoint that spreads over sites, and the scores of all facts at many points of time at once.

Nothing is rescored per day. A rollout's totals are sums over the days up to each one, of what the day adds; scores at
checkpoints are sums over first-seen events, of which every site, day and row has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import KEY
from .scoring import ALPHA, BETA, QUORUM, THETA, finish, ratio, temporal


def adopters(starts: DataFrame, fractions: tuple[float, ...]) -> DataFrame:
    """starts (device_type, site_id, day, weight) for each fraction: the first round(sites * fraction) sites, one at least, by hash.

    Device types with one site have no fractions to speak of and are left out. A larger fraction takes the smaller one's sites too.
    """
    place = F.row_number().over(Window.partitionBy("device_type").orderBy(F.sha2(F.col("site_id").cast("binary"), 256), "site_id"))
    sites = starts.groupBy("device_type").agg(F.count("*").alias("eligible_sites"), F.sum("weight").alias("all_weight")).where("eligible_sites > 1")
    ranked = starts.withColumn("place", place).join(sites, "device_type").withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    return ranked.where(F.col("place") <= F.greatest(F.lit(1), F.round(F.col("eligible_sites") * F.col("fraction"))))


def rollout(cube: DataFrame, chosen: DataFrame, horizon: int, theta: float = THETA, quorum: int = QUORUM) -> DataFrame:
    """Scores of a new endpoint on every day of its rollout, 1 to horizon, for all groups of adopters at once.

    chosen: device_type, fraction, site_id, day (the endpoint shows from the day after it), weight, eligible_sites, all_weight.
    After d days it has been seen on all days within d of some start: of the gaps between starts d days each, or the whole gap.
    A day on which the device type was seen anyway is no new one for it; it is met d days after the last start before it.
    """
    by = ["device_type", "fraction"]
    groups = chosen.groupBy(*by).agg(F.count("*").alias("supporting_sites"), F.first("eligible_sites").alias("eligible_sites"), (F.sum("weight") / F.first("all_weight")).alias("site_confidence"))
    starts = chosen.select(*by, F.date_add("day", 1).alias("start")).distinct()
    after = F.lead("start").over(Window.partitionBy(*by).orderBy("start"))
    gaps = starts.withColumn("gap", F.least(F.coalesce(F.datediff(after, "start"), F.lit(horizon)), F.lit(horizon)))
    known = cube.select("device_type", "day").distinct()
    totals = known.groupBy("device_type").agg(F.count("*").alias("old_days")).join(cube.groupBy("device_type").agg(F.sum("n").alias("old_n")), "device_type")
    marks = starts.select(*by, F.col("start").alias("day"), F.lit(True).alias("starts")).unionByName(known.join(groups.select(*by), "device_type").select(*by, "day", F.lit(False).alias("starts")))
    last = F.max(F.when(F.col("starts"), F.col("day"))).over(Window.partitionBy(*by).orderBy("day", F.desc("starts")).rowsBetween(Window.unboundedPreceding, 0))
    met = marks.withColumn("d", F.datediff("day", last) + 1).where(F.col("d").between(1, horizon) & ~F.col("starts"))
    grid = groups.select(*by, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("d"))
    # A gap of g days gives a new day on each of the days 1 to g.
    ends = gaps.groupBy(*by, F.col("gap").alias("d")).agg(F.count("*").alias("ended"))
    overlap = met.groupBy(*by, "d").agg(F.count("*").alias("overlap"))
    each = grid.join(ends, [*by, "d"], "left").join(overlap, [*by, "d"], "left").fillna(0, ["ended", "overlap"])
    up, down = Window.partitionBy(*by).orderBy("d"), Window.partitionBy(*by).orderBy(F.desc("d"))
    each = each.withColumn("new", F.sum("ended").over(down)).withColumn("days", F.sum("new").over(up)).withColumn("overlap", F.sum("overlap").over(up))
    rows = each.select(*by, F.col("d").alias("rollout_days"), "days", "overlap").join(groups, by).join(totals, "device_type")
    rows = rows.withColumn("n", F.col("supporting_sites") * F.col("rollout_days")).withColumn("device_days", F.col("old_days") + F.col("days") - F.col("overlap")).withColumn("device_n", F.col("old_n") + F.col("n"))
    rows = rows.withColumn("temporal_confidence", temporal()).withColumn("score", ALPHA * F.col("site_confidence") + BETA * F.col("temporal_confidence"))
    return rows.withColumn("accepted", (F.col("supporting_sites") >= quorum) & (F.round("score", 9) >= theta)).select(*by, "rollout_days", "supporting_sites", "eligible_sites", "site_confidence", "temporal_confidence", "score", "accepted")


def first_admitted(rows: DataFrame) -> DataFrame:
    """The first day of each rollout from which the endpoint is admitted, null if none within the horizon."""
    return rows.groupBy("device_type", "fraction").agg(F.min(F.when(F.col("accepted"), F.col("rollout_days"))).alias("first_admitted_day"))


def least_fraction(rows: DataFrame, days: int) -> DataFrame:
    """The smallest fraction of sites with which a rollout of so many days is admitted, null if none is."""
    return rows.where(F.col("rollout_days") == days).groupBy("device_type").agg(F.min(F.when(F.col("accepted"), F.col("fraction"))).alias("least_fraction"))


def checkpoint_scores(cube: DataFrame, checkpoints: tuple[int, ...], **gate) -> DataFrame:
    """checkpoint and the scores of all facts seen by then, for checkpoints of so many days after the cube's first day.

    Every (fact, site), (fact, day) and row counts from the first checkpoint that holds it; sums over a fact's checkpoints give
    its totals at each, and likewise for device types.
    """
    first = cube.agg(F.min("day").alias("begin"))
    at = F.array(*map(F.lit, sorted(checkpoints)))
    dated = cube.crossJoin(F.broadcast(first)).withColumn("age", F.datediff("day", "begin"))

    def since(c):
        return F.array_min(F.filter(at, lambda x: x >= c))

    def totals(keys: list[str], sites: str, days: str, n: str) -> DataFrame:
        new_sites = dated.groupBy(*keys, "site_id").agg(F.min("age").alias("age")).select(*keys, since(F.col("age")).alias("checkpoint"), F.lit(1).alias("s"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("n"))
        new_days = dated.groupBy(*keys, "age").agg(F.sum("n").alias("n")).select(*keys, since(F.col("age")).alias("checkpoint"), F.lit(0).alias("s"), F.lit(1).alias("d"), "n")
        each = new_sites.unionByName(new_days).where("checkpoint is not null").groupBy(*keys, "checkpoint").agg(F.sum("s").alias("s"), F.sum("d").alias("d"), F.sum("n").alias("n"))
        born = each.groupBy(*keys).agg(F.min("checkpoint").alias("born"))
        grid = born.select(*keys, F.explode(F.filter(at, lambda x: x >= F.col("born"))).alias("checkpoint"))
        up = Window.partitionBy(*keys).orderBy("checkpoint")  # a row for each checkpoint
        return grid.join(each, [*keys, "checkpoint"], "left").select(*keys, "checkpoint", *(F.sum(F.coalesce(c, F.lit(0))).over(up).alias(name) for c, name in (("s", sites), ("d", days), ("n", n))))

    facts, devices = totals(list(KEY), "supporting_sites", "days", "n"), totals(["device_type"], "eligible_sites", "device_days", "device_n")
    rows = facts.join(devices, ["device_type", "checkpoint"]).withColumn("temporal_confidence", temporal()).withColumn("site_confidence", ratio("supporting_sites", "eligible_sites"))
    return finish(rows, **gate)


def decision_churn(rows: DataFrame, checkpoints: tuple[int, ...]) -> DataFrame:
    """Accepted facts at each checkpoint: how many, and how many came and went since the checkpoint before."""
    order = sorted(checkpoints)
    place = F.array_position(F.array(*map(F.lit, order)), F.col("checkpoint")).cast("int")
    now = rows.where("accepted").select(place.alias("step"), *KEY, F.lit(1).alias("now"), F.lit(0).alias("before"))
    moved = now.where(F.col("step") < len(order)).select((F.col("step") + 1).alias("step"), *KEY, F.lit(0).alias("now"), F.lit(1).alias("before"))
    each = now.unionByName(moved).groupBy("step", *KEY).agg(F.max("now").alias("now"), F.max("before").alias("before"))
    counts = each.groupBy("step").agg(F.sum("now").alias("accepted"), F.sum(F.col("now") * (1 - F.col("before"))).alias("added"), F.sum(F.col("before") * (1 - F.col("now"))).alias("removed"))
    steps = rows.sparkSession.createDataFrame([(i + 1, c) for i, c in enumerate(order)], "step int, checkpoint int")
    return steps.join(counts, "step", "left").fillna(0).select("checkpoint", "accepted", "added", "removed", (F.col("added") + F.col("removed")).alias("updates"))
