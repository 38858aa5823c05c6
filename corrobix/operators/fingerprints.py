"""Device types from fingerprints: trained classifiers, routing by key, and predicted types in place of the reported ones."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import KEY
from ..sources.tables import written
from .perturb import stable_fold
from .scoring import finish, ratio, temporal

KINDS = ("forest", "boosted", "stump")


def routed(rows: DataFrame, key: str, folds: int, held: int) -> tuple[DataFrame, DataFrame]:
    """Rows for training and for testing: a key is wholly in one of them, by the fold of its hash; null keys are in neither."""
    placed = rows.where(F.col(key).isNotNull()).withColumn("_key", F.col(key).cast("string")).withColumn("_fold", stable_fold("_key", folds)).drop("_key")
    return placed.where(F.col("_fold") != held).drop("_fold"), placed.where(F.col("_fold") == held).drop("_fold")


def usable(rows: DataFrame, features: str, size: int) -> DataFrame:
    """Rows with `size` finite features, as a vector column `features`."""
    values = F.transform(features, lambda x: x.cast("double"))
    whole = rows.withColumn("_values", values).where((F.size("_values") == size) & F.forall("_values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return whole.withColumn("features", array_to_vector("_values")).drop("_values")


def predicted_labels(train: DataFrame, test: DataFrame, features: str, label: str, size: int, kind: str = "forest", seed: int = 7) -> DataFrame:
    """test's rows with usable features, and `predicted`: the label (as text) that a classifier fitted on train gives them.

    A forest of 20 trees, boosted trees for one label against the rest, or a single split. Trees are fitted on histograms that
    tasks sum, so the model and 32 splits a feature are all that reaches the driver. Rows without a label are not trained on.
    """
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {KINDS}")
    known = usable(train.where(F.col(label).isNotNull()), features, size).select("features", F.col(label).cast("string").alias("label_text"))
    common = {"featuresCol": "features", "labelCol": "label_index", "seed": seed}
    trees = {
        "forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=6, **common),
        "boosted": lambda: OneVsRest(classifier=GBTClassifier(maxIter=8, maxDepth=3, seed=seed), featuresCol="features", labelCol="label_index"),
        "stump": lambda: DecisionTreeClassifier(maxDepth=1, **common),
    }[kind]()
    names = StringIndexer(inputCol="label_text", outputCol="label_index", stringOrderType="alphabetAsc").fit(known)
    model = Pipeline(stages=[trees, IndexToString(inputCol="prediction", outputCol="predicted", labels=names.labels)]).fit(names.transform(known))
    return model.transform(usable(test, features, size)).select(*test.columns, "predicted") if features != "features" else model.transform(usable(test, features, size)).select(*(c for c in test.columns if c != "features"), "predicted")


def relabelled(observations: DataFrame, predictions: DataFrame, key: tuple[str, ...], label: str = "device_type") -> DataFrame:
    """Observations with the predicted label of their key (predictions: key, predicted, one row a key) in place of their own."""
    return observations.join(predictions.select(*key, "predicted"), list(key), "left").withColumn(label, F.coalesce("predicted", label)).drop("predicted")


def variants(observations: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """The evidence cube under several labellings at once: device_type is a label, n_0, n_1, ... its rows under each labelling.

    observations: site_id, endpoint, protocol, port, day, n and what the labels are made of. Most rows have one label under all
    labellings and stay one row.
    """
    told = {f"_label_{i}": label for i, label in enumerate(labels.values())}
    rows = observations.select("site_id", "endpoint", "protocol", "port", "day", "n", *(label.alias(c) for c, label in told.items()))
    rows = rows.withColumn("device_type", F.explode(F.array_distinct(F.array(*told))))
    sums = [F.sum(F.when(F.col(c) == F.col("device_type"), F.col("n")).otherwise(0)).alias(f"n_{i}") for i, c in enumerate(told)]
    return rows.groupBy("site_id", "device_type", "endpoint", "protocol", "port", "day").agg(*sums)


def score_variants(observations: DataFrame, labels: dict[str, Column], **gate) -> DataFrame:
    """Scores of all facts under each labelling, where device_type is `variant|label`: the labellings are columns until facts are counted."""
    cube = written(variants(observations, labels), "variants")
    names, ns = list(labels), [f"n_{i}" for i in range(len(labels))]

    def counted(keys: tuple[str, ...], sites: str, days: str, n: str) -> DataFrame:
        parts = []
        for by, some in (("site_id", [F.sum(c).alias(c) for c in ns]), ("day", [F.max(c).alias(c) for c in ns])):
            rows = cube.select(*keys, by, *ns)
            rows = (rows.repartition(*keys) if len(keys) > 1 else rows).groupBy(*keys, by).agg(*some).groupBy(*keys)
            seen = [F.count(F.when(F.col(c) > 0, F.col(by))) for c in ns]
            none = F.lit(0).cast("long")
            cells = [(x, none, F.sum(c)) if by == "site_id" else (none, x, none) for x, c in zip(seen, ns, strict=True)]
            parts.append(rows.agg(*(F.struct(*(e.alias(a) for e, a in zip(cell, (sites, days, n), strict=True))).alias(f"c_{c}") for cell, c in zip(cells, ns, strict=True))))
        both = parts[0].unionByName(parts[1]).groupBy(*keys).agg(*(F.struct(*(F.sum(f"c_{c}.{a}").alias(a) for a in (sites, days, n))).alias(f"c_{c}") for c in ns))
        each = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(f"c_{c}").alias("c")) for v, c in zip(names, ns, strict=True))))
        rows = both.select(*keys, each.alias("v")).select("v.variant", *keys, "v.c.*").where(F.col(n) > 0)
        return rows.withColumn("device_type", F.concat("variant", F.lit("|"), "device_type")).drop("variant")

    facts = counted(KEY, "supporting_sites", "days", "n")
    devices = written(counted(("device_type",), "eligible_sites", "device_days", "device_n"), "devices")
    rows = facts.join(devices, "device_type").withColumn("temporal_confidence", temporal()).withColumn("site_confidence", ratio("supporting_sites", "eligible_sites"))
    return finish(rows, **gate)


def fed_through(scored: DataFrame, variant: str = "true") -> DataFrame:
    """variant, types, facts, accepted, reach: what admission makes of each labelling.

    reach is the share of the endpoints admitted under `variant`, of whatever type, that a labelling still admits.
    """
    rows = written(scored.select("device_type", "endpoint", "protocol", "port", "accepted"), "scored").withColumn("variant", F.substring_index("device_type", "|", 1)).withColumn("type", F.expr("substring(device_type, instr(device_type, '|') + 1)"))
    where = ["endpoint", "protocol", "port"]
    ends = rows.where("accepted").select("variant", *where).distinct()
    base = ends.where(F.col("variant") == variant).select(*where)
    reach = ends.join(base, where, "left_semi").groupBy("variant").agg(F.count("*").alias("reached"))
    counts = rows.groupBy("variant").agg(F.count_distinct("type").alias("types"), F.count("*").alias("facts"), F.count_if("accepted").alias("accepted"))
    whole = base.agg(F.count("*").alias("whole"))
    out = counts.join(reach, "variant", "left").join(whole)
    return out.select("variant", "types", "facts", "accepted", F.coalesce(F.try_divide(F.coalesce("reached", F.lit(0)).cast("double"), F.col("whole")), F.lit(0.0)).alias("reach"))
