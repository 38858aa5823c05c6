"""What evidence is worth elsewhere: groups of sites left out, and priors for a site that has just begun.

Nobody's evidence is aggregated again. Totals without a group are all totals less the group's part, and a prior joined with a
site's own facts has the prior's size and what of those facts the prior lacks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import KEY
from ..sources.tables import written
from .scoring import device_totals, fact_totals, finish, ratio, receivers, temporal

METHODS = ("local only", "registry", "pooled union", "nearest site", "mismatched type")


def leave_group_out(cube: DataFrame, groups: DataFrame, **gate) -> DataFrame:
    """left_out and the scores of all facts from the sites outside that group; facts that no other site has are not in it.

    groups: site_id, left_out; sites without a group stay in always. A site of a group counts once for a fact, a day is the
    group's alone if all sites that saw it then are in the group.
    """
    groups = written(groups, "groups")  # small tables are written, so that the cube and its facts are not shuffled to meet them
    marked = cube.join(groups.select("site_id", "left_out"), "site_id", "left")

    def own(keys: tuple[str, ...], name: str) -> DataFrame:
        inside = marked.where("left_out is not null")
        parts = inside.groupBy("left_out", *keys).agg(F.count_distinct("site_id").alias(f"own_{name}sites"), F.sum("n").alias(f"own_{name}n"))
        day = marked.groupBy(*keys, "day").agg(F.min("left_out").alias("left_out"), F.max("left_out").alias("other"), F.count_if(F.col("left_out").isNull()).alias("outside"))
        alone = day.where("left_out = other and outside = 0").groupBy("left_out", *keys).agg(F.count("*").alias(f"own_{name}days"))
        return parts.join(alone, ["left_out", *keys], "left")

    facts, devices = fact_totals(cube), device_totals(cube)
    rows = groups.select("left_out").where("left_out is not null").distinct().join(devices)  # a row for each group and device type
    rows = written(rows.join(own(("device_type",), "device_"), ["left_out", "device_type"], "left"), "devices").join(facts, "device_type").join(own(KEY, ""), ["left_out", *KEY], "left").na.fill(0)
    minus = {"supporting_sites": "own_sites", "days": "own_days", "n": "own_n", "eligible_sites": "own_device_sites", "device_days": "own_device_days", "device_n": "own_device_n"}
    rows = rows.select("left_out", *KEY, *((F.col(a) - F.col(b)).alias(a) for a, b in minus.items())).where("supporting_sites > 0")
    return finish(rows.withColumn("temporal_confidence", temporal()).withColumn("site_confidence", ratio("supporting_sites", "eligible_sites")), **gate)


def nearest_by_all_facts(jaccard: DataFrame, cube: DataFrame) -> DataFrame:
    """site_id, nearest: the other site with the largest Jaccard of all facts of all device types; ties to the smaller name."""
    sizes = cube.select("site_id", *KEY).distinct().groupBy("site_id").agg(F.count("*").alias("size"))
    common = jaccard.groupBy("a", "b").agg(F.sum("common").alias("common"))
    both = common.selectExpr("a as site_id", "b as other", "common").unionByName(common.selectExpr("b as site_id", "a as other", "common"))
    sized = both.join(sizes, "site_id").join(sizes.toDF("other", "other_size"), "other")
    value = F.col("common").cast("double") / (F.col("size") + F.col("other_size") - F.col("common"))
    return sized.groupBy("site_id").agg(F.min(F.struct((-value).alias("less"), "other")).alias("m")).select("site_id", F.col("m.other").alias("nearest"))


def cold_start(cube: DataFrame, truth: DataFrame, nearest: DataFrame, windows: tuple[int, ...], **gate) -> DataFrame:
    """receiver, window, method, devices, predicted, precision, recall, f1: profiles of a site after its first days, by prior.

    A profile is what the site has seen in its first `window` days and what the prior holds: nothing, the facts that the other
    sites' evidence admits, all facts of other sites, those of the nearest site, or the admitted ones of the device type that
    follows in order of name, which stands for a wrong fingerprint. Means are over the site's device types that have a truth.
    """
    sizes = written(truth.groupBy("device_type").agg(F.count("*").alias("all_true")), "types")  # small tables are written, so that facts are not shuffled to meet them
    types = sizes.select("device_type")
    follow = F.coalesce(F.lead("device_type").over(Window.orderBy("device_type")), F.min("device_type").over(Window.partitionBy()))  # a row for each device type
    before = written(types.select(F.col("device_type").alias("before"), follow.alias("device_type")), "following")
    begin = cube.groupBy("site_id").agg(F.min("day").alias("begin"))
    targets = receivers(cube).join(begin.withColumnRenamed("site_id", "receiver"), "receiver").join(types, "device_type", "left_semi")
    targets = written(targets.withColumn("target", F.lit(True)), "targets")
    # Who asks for the facts of a device type: its own sites, and those whose prior of another type it is.
    asked = targets.select("device_type", "receiver").unionByName(targets.select(F.col("device_type").alias("before"), "receiver").join(before, "before").select("device_type", "receiver"))
    asked = written(asked.groupBy("device_type").agg(F.collect_set("receiver").alias("asked")).join(device_totals(cube), "device_type"), "asked")
    nearest_to = written(nearest.groupBy(F.col("nearest").alias("site_id")).agg(F.collect_set(nearest["site_id"]).alias("nearest_to")), "nearest")

    # The cube is shuffled once, by facts: what follows, up to a row for each receiver and fact, stays where that has put it.
    fact, days = Window.partitionBy(*KEY), Window.partitionBy(*KEY, "day")
    marked = cube.join(types, "device_type", "left_semi").repartition(*KEY).withColumns({"alone": F.min("site_id").over(days) == F.max("site_id").over(days), "first": (F.row_number().over(days.orderBy("site_id")) == 1).cast("long")})
    seen = marked.groupBy("site_id", *KEY).agg(F.min("day").alias("day"), F.sum("n").alias("own_n"), F.count_if("alone").alias("own_days"), F.sum("first").alias("first"))
    total = {"supporting_sites": F.count("site_id").over(fact), "days": F.sum("first").over(fact), "n": F.sum("own_n").over(fact), "leads": F.row_number().over(fact.orderBy("site_id")) == 1}
    seen = seen.withColumns(total).join(truth.select(*KEY, F.lit(True).alias("t")), list(KEY), "left").join(asked, "device_type").join(nearest_to, "site_id", "left")
    known = reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in KEY))
    everywhere = finish(seen.withColumn("temporal_confidence", temporal()).withColumn("site_confidence", ratio(F.col("supporting_sites"), F.nullif("eligible_sites", F.lit(0)))), **gate)
    none = F.array().cast("array<string>")

    def sent(to, own: bool, near: bool):
        return F.transform(to, lambda r: F.struct(r.alias("receiver"), F.lit(own).alias("own"), F.lit(near).alias("near")))

    to = F.concat(sent(F.array("site_id"), True, False), sent(F.coalesce("nearest_to", none), False, True), sent(F.when(F.col("leads"), F.col("asked")).otherwise(none), False, False))
    sums = ("supporting_sites", "days", "n", "t", "everywhere")
    rows = everywhere.withColumn("everywhere", F.col("accepted") & known).select(*KEY, *sums, "own_n", "own_days", "day", F.explode(to).alias("to")).select("*", "to.*")
    rows = rows.groupBy("receiver", *KEY).agg(*(F.max(c).alias(c) for c in ("own", "near", *sums)), *(F.max(F.when(F.col("own"), F.col(c))).alias(c) for c in ("own_n", "own_days", "day")))
    rows = rows.na.fill(0, ["own_n", "own_days"]).join(targets, ["receiver", "device_type"], "left")
    others = rows.select(
        "receiver", *KEY, "own", "near", "t", "target", "everywhere", F.datediff("day", "begin").alias("age"), (F.col("supporting_sites") - F.col("own").cast("int")).alias("supporting_sites"), F.nullif(F.col("eligible_sites") - 1, F.lit(0)).alias("eligible_sites"), (F.col("days") - F.col("own_days")).alias("days"),
        (F.col("device_days") - F.col("own_device_days")).alias("device_days"), (F.col("n") - F.col("own_n")).alias("n"), (F.col("device_n") - F.col("own_device_n")).alias("device_n"),
    )
    others = finish(others.withColumn("temporal_confidence", temporal()).withColumn("site_confidence", ratio("supporting_sites", "eligible_sites")), **gate)
    held = F.when(F.col("target"), F.col("accepted") & known & (F.col("supporting_sites") > 0)).otherwise(F.col("everywhere"))  # a site without the device type is told what all sites admit
    flags = {c: F.coalesce(x, F.lit(False)) for c, x in {"target": F.col("target"), "t": F.col("t"), "in1": held, "in2": F.col("supporting_sites") > 0, "in3": F.col("near")}.items()}
    rows = written(others.withColumns(flags).where("receiver is not null").select("receiver", *KEY, "own", "age", *flags), "cold")

    # Facts of the wrong type meet the receiver's own facts and the true ones of its type.
    itself = F.when(F.col("target") & (F.col("own") | F.col("t")), F.struct("device_type", "own", "age", "t", F.lit(False).alias("in4")))
    wrong = F.when(F.col("in1"), F.struct(F.col("before").alias("device_type"), F.lit(False).alias("own"), F.lit(None).cast("int").alias("age"), F.lit(False).alias("t"), F.lit(True).alias("in4")))
    moved = rows.join(before, "device_type").select("receiver", *KEY[1:], F.explode(F.array_compact(F.array(itself, wrong))).alias("x")).select("receiver", *KEY[1:], "x.*")
    moved = moved.groupBy("receiver", *KEY).agg(F.max("own").alias("own"), F.max("age").alias("age"), F.max("t").alias("t"), F.max("in4").alias("in4"))

    def counted(of: DataFrame, methods: tuple[int, ...]) -> DataFrame:
        """Of each prior its facts and hits, and of the receiver's own facts those that the prior lacks, by window."""
        sums = []
        for i in methods:
            held, t = F.col(f"in{i}") if i else F.lit(False), F.col("t")
            sums += [F.count_if(held).alias(f"p{i}"), F.count_if(held & t).alias(f"h{i}")]
            for w in windows:
                lacks = F.col("own") & (F.col("age") < w) & ~held
                sums += [F.count_if(lacks).alias(f"l{i}_{w}"), F.count_if(lacks & t).alias(f"lt{i}_{w}")]
        return of.groupBy("receiver", "device_type").agg(*sums)

    rows = targets.select("receiver", "device_type").join(counted(rows.where("target"), (0, 1, 2, 3)), ["receiver", "device_type"]).join(counted(moved, (4,)), ["receiver", "device_type"], "left").na.fill(0).join(sizes, "device_type")
    cells = [F.struct(F.lit(m).alias("method"), F.lit(w).alias("window"), (F.col(f"p{i}") + F.col(f"l{i}_{w}")).alias("n"), (F.col(f"h{i}") + F.col(f"lt{i}_{w}")).alias("hits")) for i, m in enumerate(METHODS) for w in windows]
    each = rows.select("receiver", "device_type", "all_true", F.explode(F.array(*cells)).alias("c")).select("receiver", "all_true", "c.*")
    precision, recall = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("n")), F.lit(0.0)), F.col("hits").cast("double") / F.col("all_true")
    each = each.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", 2.0 * F.col("hits") / (F.col("n") + F.col("all_true")))
    return each.groupBy("receiver", "window", "method").agg(F.count("*").alias("devices"), F.sum("n").alias("predicted"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))
