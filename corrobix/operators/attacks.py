"""Scores under attack: false and compromised sites added to the evidence cube, many scenarios at once.

An attack is a table of added cube rows (scenario, site_id, fact, day, n). The clean cube is aggregated once; a scenario's totals
are the clean ones and what its rows add, so days are never copied for a scenario. Only pairs of site and fact of the attacked device
type, from which weights and clusters follow, are taken once for each scenario of the grid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import ELIGIBLE_CLASSES, KEY, key_string, service_class
from ..sources.tables import written
from . import overlap, scoring

MODES = ("vanilla", "trust", "independence", "combined", "rwv")
#: Vote of a site without a frozen reputation, and the share that a vote must exceed.
UNKNOWN, VOTE = 0.1, 0.65


def busiest_device(cube: DataFrame) -> DataFrame:
    """One row: the device type with most rows, ties to the smaller name."""
    return cube.groupBy("device_type").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "device_type").limit(1).select("device_type")


def _start(cube: DataFrame) -> DataFrame:
    return cube.groupBy("device_type").agg(F.min("day").alias("start"))


def false_sites(cube: DataFrame, grid: DataFrame, endpoint: str, protocol: str = "https", port: int = 443) -> DataFrame:
    """Rows of sites `sybil-0`, ... that report one endpoint on each of `days` days from the device type's first one.

    grid: scenario, device_type, sites, days.
    """
    rows = grid.join(_start(cube), "device_type").where("sites > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("sites") - 1))).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("days") - 1)))
    return rows.select("scenario", F.concat(F.lit("sybil-"), F.col("i").cast("string")).alias("site_id"), "device_type", F.lit(endpoint).alias("endpoint"), F.lit(protocol).alias("protocol"), F.lit(port).alias("port"), F.date_add("start", F.col("d")).alias("day"), F.lit(1).cast("long").alias("n"))


def padding(cube: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows in which false sites report real facts of the device type, on its first day.

    grid: scenario, device_type, sites, padding, shared. Facts stand in a fixed order; the first `padding * shared` of them go to
    every site, and the rest is dealt out in slices that turn with the site's number, so with shared = 0 each site has others.
    Fewer facts than asked for are all taken.
    """
    facts = cube.select(*KEY).distinct().join(grid.select("device_type").distinct(), "device_type")
    w = Window.partitionBy("device_type")  # the facts of the attacked device types alone
    placed = facts.withColumn("place", F.row_number().over(w.orderBy(F.sha2(key_string().cast("binary"), 256), *KEY)) - 1)
    size = facts.groupBy("device_type").agg(F.count("*").alias("facts"))
    own = grid.join(size, "device_type").withColumn("used", F.least("padding", "facts")).where("sites > 0 and used > 0")
    own = own.withColumn("common", F.least(F.col("used"), F.round(F.col("used") * F.col("shared")).cast("long"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("sites") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("used") - 1)))
    rest, unique = F.greatest(F.col("facts") - F.col("common"), F.lit(1)), F.col("used") - F.col("common")
    place = F.when(F.col("j") < F.col("common"), F.col("j")).otherwise(F.col("common") + (F.col("i") * unique + F.col("j") - F.col("common")) % rest)
    rows = own.withColumn("place", place.cast("int")).join(placed, ["device_type", "place"]).join(_start(cube), "device_type")
    return rows.select("scenario", F.concat(F.lit("sybil-"), F.col("i").cast("string")).alias("site_id"), *KEY, F.col("start").alias("day"), F.lit(1).cast("long").alias("n"))


def chosen_sites(cube: DataFrame, grid: DataFrame) -> DataFrame:
    """scenario, device_type, site_id: the first `sites` sites of the device type in the order of a hash; grid as in compromised."""
    sites = cube.select("device_type", "site_id").distinct()
    place = F.row_number().over(Window.partitionBy("device_type").orderBy(F.sha2(F.col("site_id").cast("binary"), 256)))
    return sites.withColumn("place", place).join(grid, "device_type").where("place <= sites").drop("place")


def compromised_sites(cube: DataFrame, grid: DataFrame, malicious: DataFrame) -> DataFrame:
    """Rows in which `sites` real sites of the device type report every malicious endpoint on `days` days.

    grid: scenario, device_type, sites, days. malicious: device_type, endpoint, protocol, port, day (the first one). Fewer sites
    than asked for would misstate the attack, so they are an error.
    """
    grid = grid.select("scenario", "device_type", "sites", "days")
    hosts = cube.groupBy("device_type").agg(F.count_distinct("site_id").alias("hosts"))
    short = grid.join(hosts, "device_type", "left").where("sites > coalesce(hosts, 0)").select("scenario", "sites", "hosts").first()
    if short:
        raise ValueError(f"scenario {short.scenario} asks for {short.sites} sites, {short.hosts or 0} have the device type")
    rows = chosen_sites(cube, grid).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("days") - 1))).join(malicious, "device_type")
    return rows.select("scenario", "site_id", *KEY, F.date_add("day", F.col("d")).alias("day"), F.lit(1).cast("long").alias("n"))


def resolved_peers(malicious: DataFrame, domain: str = "peer.example.com") -> DataFrame:
    """Malicious addresses under names of their own, as if they had been resolved."""
    return malicious.withColumn("endpoint", F.concat(F.lit("api.p"), F.translate("endpoint", ".:", "--"), F.lit(f".{domain}")))


def joined_organisations(cube: DataFrame, organisations: DataFrame) -> DataFrame:
    """The cube with sites of one organisation (site_id, organisation) as one site; others keep their name."""
    rows = cube.join(organisations, "site_id", "left").withColumn("site_id", F.coalesce("organisation", "site_id"))
    return rows.groupBy("site_id", *KEY, "day").agg(F.sum("n").alias("n"))


def under_attack(cube: DataFrame, scenarios: DataFrame, injected: DataFrame, tau: float = 0.35, percent: float = 0.5, theta: float = scoring.THETA, quorum: int = scoring.QUORUM) -> DataFrame:
    """scenario, fact, injected, class, supporting_sites, temporal_confidence, and score_ and accepted_ of each mode.

    scenarios: scenario, device_type (the attacked one); a bounded grid. A fact is injected if the clean cube does not have it. Weights are calibrated on the clean cube, and rwv votes
    with its frozen weights. Every fact of the device type is scored in every scenario.
    """
    cube, scenarios = written(cube, "cube"), written(scenarios.select("scenario", "device_type"), "scenarios")
    injected = written(injected.groupBy("scenario", "site_id", *KEY, "day").agg(F.sum("n").alias("n")), "injected")
    target = cube.join(scenarios.select("device_type").distinct(), "device_type")
    fact, site = ["scenario", *KEY], ["scenario", "site_id"]

    def added(keys: list[str], what: str) -> DataFrame:
        """How many of `what` a scenario adds to each key that the clean cube has not there."""
        clean = target.select(*(k for k in keys if k != "scenario"), what).distinct()
        new = injected.select(*keys, what).distinct().join(clean, clean.columns, "left_anti")
        return new.groupBy(*keys).agg(F.count("*").alias(f"new_{what}"))

    clean = target.groupBy(*KEY).agg(F.count_distinct("day").alias("days"), F.sum("n").alias("n"))
    whole = target.groupBy("device_type").agg(F.count_distinct("day").alias("device_days"), F.sum("n").alias("device_n"))
    more = injected.groupBy(*fact).agg(F.sum("n").alias("new_n"))
    facts = scenarios.join(clean, "device_type").join(more, fact, "full").join(added(fact, "day"), fact, "left")
    of_device = scenarios.join(whole, "device_type").join(injected.groupBy("scenario", "device_type").agg(F.sum("n").alias("new_device_n")), ["scenario", "device_type"], "left")
    of_device = of_device.join(added(["scenario", "device_type"], "day").withColumnRenamed("new_day", "new_device_day"), ["scenario", "device_type"], "left").fillna(0)
    times = facts.fillna(0).join(of_device, ["scenario", "device_type"]).select(
        *fact, (F.col("days") == 0).alias("injected"), (F.col("days") + F.col("new_day")).alias("days"), (F.col("n") + F.col("new_n")).alias("n"),
        (F.col("device_days") + F.col("new_device_day")).alias("device_days"), (F.col("device_n") + F.col("new_device_n")).alias("device_n"),
    )

    pairs = target.select("site_id", *KEY).distinct()
    own = injected.select(*site, *KEY).distinct()
    every = written(scenarios.join(pairs, "device_type").select(*site, *KEY).unionByName(own).distinct(), "pairs")
    weights = scoring.trust_weights(cube, percent)
    breadth = own.join(cube.select("site_id", *KEY).distinct(), ["site_id", *KEY], "left_anti").groupBy(*site).agg(F.count("*").alias("more"))
    reference = weights.agg(F.max("reference").alias("reference"))
    sites = every.select(*site, "device_type").distinct().join(weights.select("site_id", "breadth", F.col("weight").alias("frozen")), "site_id", "left").join(breadth, site, "left").fillna(0, ["breadth", "more"]).fillna(UNKNOWN, ["frozen"])
    weight = F.when(F.col("reference") <= 0, 1.0).otherwise(F.least(F.lit(1.0), (F.col("breadth") + F.col("more")) / F.col("reference")))
    sites = sites.crossJoin(F.broadcast(reference)).withColumn("weight", weight).join(_clusters(every, tau), site)
    sites = written(sites.select(*site, "device_type", "weight", "frozen", "cluster"), "sites")
    parts = [F.count("*").alias("sites"), F.sum("weight").alias("weight"), F.max("weight").alias("heaviest"), F.sum("frozen").alias("frozen")]
    sums = [F.sum("sites").alias("sites"), F.sum("weight").alias("weight"), F.sum("heaviest").alias("heaviest"), F.sum("frozen").alias("frozen"), F.count("*").alias("clusters")]
    support = every.join(sites.drop("device_type"), site).groupBy(*fact, "cluster").agg(*parts).groupBy(*fact).agg(*sums)
    eligible = sites.groupBy("scenario", "cluster").agg(*parts).groupBy("scenario").agg(*(c for c in sums))
    eligible = eligible.select("scenario", *(F.col(c).alias(f"all_{c}") for c in ("sites", "weight", "heaviest", "frozen", "clusters")))
    rows = support.join(eligible, "scenario").join(times.withColumn("temporal_confidence", scoring.temporal()), fact).withColumn("endpoint_class", service_class())
    shares = {"vanilla": "sites", "trust": "weight", "independence": "clusters", "combined": "heaviest"}
    gate = (F.col("sites") >= quorum) & F.col("endpoint_class").isin(*ELIGIBLE_CLASSES)
    out = []
    for mode, c in shares.items():
        share = F.when(F.col(f"all_{c}") > 0, F.col(c).cast("double") / F.col(f"all_{c}")).otherwise(0.0)
        score = F.round(scoring.ALPHA * share + scoring.BETA * F.col("temporal_confidence"), 9)
        out += [score.alias(f"score_{mode}"), (gate & (score >= theta)).alias(f"accepted_{mode}")]
    vote = F.round(F.col("frozen") / F.col("all_frozen"), 9)
    out += [vote.alias("score_rwv"), (vote > VOTE).alias("accepted_rwv")]
    return rows.select(*fact, "injected", "endpoint_class", F.col("sites").alias("supporting_sites"), "temporal_confidence", *out)


def _clusters(every: DataFrame, tau: float) -> DataFrame:
    """scenario, site_id, cluster: sites whose facts overlap by tau, directly or over others.

    Sites with the same facts, as false sites mostly are, are one site here: pairs are made of different ones only.
    """
    h = F.xxhash64(*KEY)
    sets = every.groupBy("scenario", "site_id").agg(F.count("*").alias("size"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("y"))
    same = ["scenario", "size", "x", "y"]
    sets = written(sets.join(sets.groupBy(*same).agg(F.min("site_id").alias("rep")), same).select("scenario", "site_id", "rep"), "sets")
    reps = sets.where("site_id = rep").select("scenario", "site_id")
    tagged = written(every.join(reps, ["scenario", "site_id"]).select("site_id", F.col("scenario").alias("device_type"), F.concat_ws("|", "device_type", "endpoint").alias("endpoint"), "protocol", "port"), "tagged")
    found = overlap.site_clusters(overlap.site_jaccard(tagged), tagged, tau)
    return sets.join(found.select(F.col("device_type").alias("scenario"), F.col("site_id").alias("rep"), "cluster"), ["scenario", "rep"]).select("scenario", "site_id", "cluster")


def attack_report(rows: DataFrame) -> DataFrame:
    """For each scenario and mode: the best score of an injected fact, whether any is accepted, and accepted other facts."""
    aggregates = []
    for m in MODES:
        fake, ok = F.col("injected"), F.col(f"accepted_{m}")
        aggregates += [F.round(F.max(F.when(fake, F.col(f"score_{m}"))), 6).alias(f"fake_score_{m}"), F.coalesce(F.bool_or(fake & ok), F.lit(False)).alias(f"fake_accepted_{m}"), F.count_if(~fake & ok).alias(f"legit_accepted_{m}")]
    return rows.groupBy("scenario").agg(*aggregates)


def by_mode(report: DataFrame) -> DataFrame:
    """The report with a row for each scenario and mode."""
    one = [report.select("scenario", F.lit(m).alias("mode"), *(F.col(f"{c}_{m}").alias(c) for c in ("fake_score", "fake_accepted", "legit_accepted"))) for m in MODES]
    return reduce(DataFrame.unionByName, one)


def grid_summary(rows: DataFrame, budget: str) -> DataFrame:
    """For each mode: whether it resists every scenario, the smallest budget that breaks it, and the best score at the largest budget.

    rows: mode, fake_score, fake_accepted and the budget; also the smallest budget at which no other fact is accepted.
    """
    broken = F.when(F.col("fake_accepted"), F.col(budget))
    return rows.groupBy("mode").agg(
        F.bool_and(~F.col("fake_accepted")).alias("resists"), F.min(broken).alias("first_break"), F.max_by("fake_score", F.struct(budget, "fake_score")).alias("score_at_most"),
        F.min(F.when(F.col("legit_accepted") == 0, F.col(budget))).alias("first_empty"),
    )


def false_site_structure(every: DataFrame, clusters: DataFrame) -> DataFrame:
    """Of the false sites of each scenario: how many there are, in how many clusters, and the size of the largest."""
    own = clusters.where(F.col("site_id").startswith("sybil-")).groupBy("scenario", "cluster").agg(F.count("*").alias("size"))
    return own.groupBy("scenario").agg(F.sum("size").alias("false_sites"), F.count("*").alias("clusters"), F.max("size").alias("largest"))


def compromised_report(rows: DataFrame, cube: DataFrame, malicious: DataFrame) -> DataFrame:
    """For each scenario and mode: the share of malicious facts admitted, and benign local facts that the policy lacks, a site."""
    flags = rows.join(malicious.select(*KEY).distinct().withColumn("bad", F.lit(1)), list(KEY), "left")
    total = malicious.select(*KEY).distinct().groupBy("device_type").agg(F.count("*").alias("bad_facts"))
    hosts = cube.groupBy("device_type").agg(F.count_distinct("site_id").alias("hosts"))
    support = cube.groupBy(*KEY).agg(F.count_distinct("site_id").alias("clean_sites"))
    flags = flags.join(support, list(KEY), "left").fillna(0, ["clean_sites"])
    out = []
    for m in MODES:
        ok = F.col(f"accepted_{m}")
        out.append(flags.groupBy("scenario", "device_type").agg(F.count_if(ok & F.col("bad").isNotNull()).alias("admitted"), F.sum(F.when(~ok & F.col("bad").isNull(), F.col("clean_sites")).otherwise(0)).alias("lacking")).withColumn("mode", F.lit(m)))
    found = reduce(DataFrame.unionByName, out).join(total, "device_type").join(hosts, "device_type")
    return found.select("scenario", "mode", F.round(F.col("admitted") / F.col("bad_facts"), 6).alias("malicious_admission_rate"), F.round(F.col("lacking") / F.col("hosts"), 6).alias("benign_exceptions_per_site"))


STRATEGIES = ("local only", "pooled union", "majority", "frequency", "rwv", "vanilla", "trust", "independence")


def management_report(rows: DataFrame, cube: DataFrame, scenarios: DataFrame, injected: DataFrame, share: float = 0.5, least: int = 2) -> DataFrame:
    """For each scenario and way of managing policies: scenario, strategy, units, policy_size, fake_accepted, false_grant_rate, fake_score.

    rows: of `under_attack`. Local policies are those of the device type's genuine sites: their mean size, and the share of them
    that holds an injected fact. All other ways make one policy: every fact, those of at least `share` of the sites, those with
    `least` rows, and what each score admits; fake_score is the best score of an injected fact, where there is a score.
    """
    target = cube.join(scenarios.select("scenario", "device_type"), "device_type")
    genuine = target.select("scenario", "site_id").distinct()
    every = genuine.unionByName(injected.select("scenario", "site_id")).distinct().groupBy("scenario").agg(F.count("*").alias("all_sites"))
    local = target.select("scenario", "site_id", *KEY).unionByName(injected.select("scenario", "site_id", *KEY).join(genuine, ["scenario", "site_id"], "left_semi")).distinct()
    fake = rows.where("injected").select("scenario", *KEY, F.lit(1).alias("fake"))
    own = local.join(fake, ["scenario", *KEY], "left").groupBy("scenario", "site_id").agg(F.count("*").alias("size"), F.coalesce(F.max("fake"), F.lit(0)).alias("fake"))
    own = own.groupBy("scenario").agg(F.count("*").alias("units"), F.avg("size").alias("policy_size"), F.avg("fake").alias("rate")).select("scenario", F.lit("local only").alias("strategy"), "units", "policy_size", "rate", F.lit(None).cast("double").alias("fake_score"))
    n = target.select("scenario", *KEY, "n").unionByName(injected.select("scenario", *KEY, "n")).groupBy("scenario", *KEY).agg(F.sum("n").alias("n"))
    facts = rows.join(n, ["scenario", *KEY]).join(every, "scenario")
    none = F.lit(None).cast("double")
    tests = {"pooled union": (F.lit(True), none), "majority": (F.col("supporting_sites") / F.col("all_sites") >= share, none), "frequency": (F.col("n") >= least, none)}
    tests |= {m: (F.col(f"accepted_{m}"), F.col(f"score_{m}")) for m in STRATEGIES[4:]}
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("strategy"), ok.alias("ok"), score.alias("score")) for k, (ok, score) in tests.items())))
    one = facts.select("scenario", "injected", cells.alias("c")).groupBy("scenario", F.col("c.strategy").alias("strategy"))
    one = one.agg(F.lit(1).cast("long").alias("units"), F.count_if("c.ok").cast("double").alias("policy_size"), F.coalesce(F.max((F.col("injected") & F.col("c.ok")).cast("double")), F.lit(0.0)).alias("rate"), F.max(F.when(F.col("injected"), F.col("c.score"))).alias("fake_score"))
    return own.unionByName(one).select("scenario", "strategy", "units", F.round("policy_size", 6).alias("policy_size"), (F.col("rate") > 0).alias("fake_accepted"), F.round("rate", 6).alias("false_grant_rate"), F.round("fake_score", 6).alias("fake_score"))
