"""Matching against reference policies, set metrics, review cost and ranked queues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import KEY, PRIVATE, in_blocks, ipv4_number
from ..sources.tables import written

WILDCARD, GATEWAY = "*", "gateway"


def with_kind(rules: DataFrame) -> DataFrame:
    """kind (literal, cidr, wildcard, gateway) and address bounds of each rule (device_type, endpoint, protocol, port)."""
    base, bits = F.substring_index("endpoint", "/", 1), F.when(F.contains("endpoint", F.lit("/")), F.substring_index("endpoint", "/", -1).try_cast("int")).otherwise(32)
    size = F.pow(F.lit(2), 32 - bits).cast("long")
    low = F.floor(ipv4_number(base) / size) * size
    kind = F.when(F.col("endpoint") == WILDCARD, "wildcard").when(F.col("endpoint") == GATEWAY, "gateway").when(low.isNotNull(), "cidr").otherwise("literal")
    return rules.select(F.col("device_type").alias("r_device"), F.col("endpoint").alias("r_endpoint"), F.col("protocol").alias("r_protocol"), F.col("port").alias("r_port"), kind.alias("kind"), low.alias("low"), (low + size - 1).alias("high"))


def matches(predicted: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of a predicted fact and a rule it satisfies. Port 0 and protocol `unknown` match anything.

    Each kind of rule has a join of its own, always on the device type: literals also on the endpoint, blocks of addresses also
    on the upper half of the address, of which a block of eight bits or more holds 256 at most. Wider blocks, wildcards and
    gateways are a few rules of a device type.
    """
    r = with_kind(rules)
    p = predicted.select(*KEY).withColumn("number", ipv4_number("endpoint"))
    half = F.floor(F.col("number") / 65536)
    block = r.where("kind = 'cidr'").withColumn("wide", F.col("high") - F.col("low") >= 1 << 24)
    narrow = block.where("not wide").withColumn("half", F.explode(F.sequence(F.floor(F.col("low") / 65536), F.floor(F.col("high") / 65536))))
    fits = (F.col("r_protocol").isin("unknown") | (F.col("r_protocol") == F.col("protocol")) | (F.col("protocol") == "unknown")) & ((F.col("r_port") == 0) | (F.col("r_port") == F.col("port")))
    device = F.col("device_type") == F.col("r_device")
    parts = [
        p.join(r.where("kind = 'literal'"), device & (F.col("endpoint") == F.col("r_endpoint")) & fits),
        p.where("number is not null").join(narrow, device & (half == F.col("half")) & F.col("number").between(F.col("low"), F.col("high")) & fits),
        p.where("number is not null").join(block.where("wide"), device & F.col("number").between(F.col("low"), F.col("high")) & fits),
        p.join(r.where("kind = 'wildcard'"), device & fits),
        p.where(in_blocks("endpoint", PRIVATE)).join(r.where("kind = 'gateway'"), device & fits),
    ]
    return reduce(DataFrame.unionByName, (x.select(*KEY, "r_endpoint", "r_protocol", "r_port", "kind") for x in parts))


def semantic_metrics(predicted: DataFrame, rules: DataFrame) -> DataFrame:
    """Precision, recall and F1 by device type, many to many; an empty side gives 0."""
    predicted, rules = written(predicted.select(*KEY)), written(rules)  # facts and rules are read for every kind of rule
    m = written(matches(predicted, rules))
    hit_p = m.select(*KEY).distinct().groupBy("device_type").agg(F.count("*").alias("hit_p"))
    hit_r = m.select("device_type", "r_endpoint", "r_protocol", "r_port").distinct().groupBy("device_type").agg(F.count("*").alias("hit_r"))
    sizes = predicted.groupBy("device_type").agg(F.count("*").alias("predicted")).join(rules.distinct().groupBy("device_type").agg(F.count("*").alias("rules")), "device_type", "full")
    rows = sizes.join(hit_p, "device_type", "left").join(hit_r, "device_type", "left").fillna(0)
    return rows.select("device_type", "predicted", "rules", *_prf(F.col("hit_p"), F.col("predicted"), F.col("hit_r"), F.col("rules")))


def _prf(hit_p, n_p, hit_r, n_r):
    precision, recall = F.when(n_p > 0, hit_p / n_p).otherwise(0.0), F.when(n_r > 0, hit_r / n_r).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return [F.round(x, 6).alias(a) for x, a in ((precision, "precision"), (recall, "recall"), (f1, "f1"))]


def set_metrics(predicted: DataFrame, truth: DataFrame, by: str = "device_type") -> DataFrame:
    """Exact precision, recall, F1 and Jaccard (1 for two empty sets) by device type."""
    both = predicted.select(*KEY).distinct().withColumn("p", F.lit(1)).join(truth.select(*KEY).distinct().withColumn("t", F.lit(1)), list(KEY), "full")
    n = both.groupBy(by).agg(F.count("p").alias("n_p"), F.count("t").alias("n_t"), F.count(F.col("p") + F.col("t")).alias("hit"), F.count("*").alias("either"))
    return n.select(by, "hit", *_prf(F.col("hit"), F.col("n_p"), F.col("hit"), F.col("n_t")), F.round(F.col("hit") / F.col("either"), 6).alias("jaccard"))


def funnel(stages: dict[str, DataFrame], truth: DataFrame) -> DataFrame:
    """Share of the reference facts that survive each stage, over all facts (micro) and as the mean over device types (macro)."""
    t = written(truth.select(*KEY).distinct())
    per_device = t.groupBy("device_type").agg(F.count("*").alias("total"))
    out = []
    for i, (name, df) in enumerate(stages.items()):
        kept = t.join(df.select(*KEY).distinct(), list(KEY), "left_semi").groupBy("device_type").agg(F.count("*").alias("kept"))
        shares = per_device.join(kept, "device_type", "left").fillna(0, ["kept"])
        out.append(shares.agg(F.sum("kept").alias("kept"), F.round(F.sum("kept") / F.sum("total"), 6).alias("micro"), F.round(F.avg(F.col("kept") / F.col("total")), 6).alias("macro")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "kept", "micro", "macro"))
    return reduce(DataFrame.unionByName, out)


def ranked(scored: DataFrame) -> DataFrame:
    """Facts of a device type in order of review: score first, ties by key."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("device_type").orderBy(F.desc("score"), "endpoint", "protocol", "port")))


def budget_yield(scored: DataFrame, confirmed: DataFrame, budget: int) -> DataFrame:
    """Expected, best and worst confirmed facts among the first `budget` of each device type when ties come in any order."""
    flagged = scored.join(confirmed.select(*KEY).distinct().withColumn("hit", F.lit(1)), list(KEY), "left")
    ties = flagged.groupBy("device_type", "score").agg(F.count("*").alias("size"), F.count("hit").alias("hits"))
    before = F.sum("size").over(Window.partitionBy("device_type").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    take = F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - F.col("before")))
    rows = ties.withColumn("before", before).withColumn("take", take)
    return rows.groupBy("device_type").agg(
        F.round(F.sum(F.col("hits") * F.col("take") / F.col("size")), 6).alias("expected"), F.sum(F.least("hits", "take")).alias("best"), F.sum(F.greatest(F.lit(0), F.col("take") - (F.col("size") - F.col("hits")))).alias("worst")
    )


def depth_of_hit(scored: DataFrame, confirmed: DataFrame, k: int) -> DataFrame:
    """Rank at which each device type's k-th confirmed fact comes; null if there are fewer."""
    flagged = ranked(scored).join(confirmed.select(*KEY).distinct().withColumn("hit", F.lit(1)), list(KEY), "left")
    run = F.sum(F.coalesce("hit", F.lit(0))).over(Window.partitionBy("device_type").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("run", run).groupBy("device_type").agg(F.min(F.when(F.col("run") >= k, F.col("rank"))).alias("depth"))


def tukey_spread(values: DataFrame, by: str, value: str) -> DataFrame:
    """Median, hinges (medians of the halves, the middle in neither) and nearest-rank 95th percentile."""
    sorted_ = values.groupBy(by).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("v"))
    n = F.size("v")

    def middle(start, length):
        return (F.element_at("v", (start + F.floor((length + 1) / 2)).cast("int")) + F.element_at("v", (start + F.floor(length / 2) + 1).cast("int"))) / 2

    half = F.floor(n / 2)
    q1, q3 = F.when(n < 2, F.element_at("v", 1)).otherwise(middle(F.lit(0), half)), F.when(n < 2, F.element_at("v", 1)).otherwise(middle(n - half, half))
    return sorted_.select(by, n.alias("n"), middle(F.lit(0), n).alias("median"), q1.alias("q1"), q3.alias("q3"), F.element_at("v", F.ceil(n * 0.95).cast("int")).alias("p95"))


def cross_validated(rows: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """fold, alpha, theta, f1: the setting with the best F1 on the other folds, and its F1 on the fold; ties to the smaller setting.

    rows: fold, site_confidence, temporal_confidence and t (1 for reference facts). All folds and settings come from one
    aggregate; what is chosen from is a row for each fold and setting.
    """
    settings = F.explode(F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(t).alias("theta")) for a, t in grid)))
    g = rows.withColumn("g", settings)
    hit = F.round(F.col("g.alpha") * F.col("site_confidence") + (1 - F.col("g.alpha")) * F.col("temporal_confidence"), 9) >= F.col("g.theta")
    cells = written(g.groupBy("fold", F.col("g.alpha").alias("alpha"), F.col("g.theta").alias("theta")).agg(F.count_if(hit).alias("p"), F.count(F.when(hit, F.col("t"))).alias("k"), F.count("t").alias("a")), "cells")
    every = Window.partitionBy("alpha", "theta")
    other = [(F.sum(c).over(every) - F.col(c)).alias(f"o_{c}") for c in "pka"]
    chosen = cells.select("*", *other).withColumn("o_f1", F.round(2 * F.col("o_k") / F.greatest(F.col("o_p") + F.col("o_a"), F.lit(1)), 9))
    place = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("o_f1"), "alpha", "theta"))
    best = chosen.withColumn("place", place).where("place = 1")
    return best.select("fold", "alpha", "theta", F.round(2 * F.col("k") / F.greatest(F.col("p") + F.col("a"), F.lit(1)), 6).alias("f1"))


def rule_kinds(rules: DataFrame) -> DataFrame:
    """device_type, kind, rules: what kinds of rule a policy consists of."""
    return with_kind(rules).groupBy(F.col("r_device").alias("device_type"), "kind").agg(F.count("*").alias("rules"))


def device_coverage(observed: DataFrame, rules: DataFrame) -> DataFrame:
    """device_type, facts, rules, covered: devices that are observed, have a policy, or both."""
    facts = observed.select(*KEY).distinct().groupBy("device_type").agg(F.count("*").alias("facts"))
    own = rules.groupBy("device_type").agg(F.count("*").alias("rules"))
    return facts.join(own, "device_type", "full").fillna(0, ["facts", "rules"]).withColumn("covered", (F.col("facts") > 0) & (F.col("rules") > 0))
