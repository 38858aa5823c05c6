"""Gaussian naive Bayes over vectors as joins, held-out classes, confusion and per-class reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Added to every variance, as a share of the largest one of all dimensions.
SMOOTHING = 1e-9


def long_form(rows: DataFrame, id_col: str, label: str, vector: str) -> DataFrame:
    """id, label, dimension, x; rows with a null or non-finite component are left out."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = rows.where(F.col(label).isNotNull() & F.coalesce(fine, F.lit(False)))
    return good.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.posexplode(vector).alias("dimension", "x")).withColumn("x", F.col("x").cast("double"))


def fit(cells: DataFrame) -> DataFrame:
    """label, dimension, mean, variance, prior: one row for each label and dimension."""
    moments = cells.groupBy("label", "dimension").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))
    spread = cells.groupBy("dimension").agg(F.var_pop("x").alias("v")).agg((F.max("v") * SMOOTHING).alias("floor"))
    counts = cells.where("dimension = 0").groupBy("label").agg(F.count("*").alias("n"))
    prior = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("label", (F.col("n") / F.col("all")).alias("prior"))
    return moments.crossJoin(F.broadcast(spread)).join(prior, "label").select("label", "dimension", "mean", (F.col("variance") + F.col("floor")).alias("variance"), "prior")


def predict(cells: DataFrame, model: DataFrame, hold_out: bool = False) -> DataFrame:
    """id, label, predicted: the label of greatest likelihood, ties to the smaller. hold_out leaves a row's own label out.

    Rows meet the model on the dimension, which has a row for each label; sums are partial before they are shuffled.
    """
    m = model.select(F.col("label").alias("candidate"), "dimension", "mean", "variance", "prior")
    both = cells.join(m, "dimension")
    if hold_out:
        both = both.where("candidate <> label")
    one = -F.log(2 * F.pi() * F.col("variance")) / 2 - F.pow(F.col("x") - F.col("mean"), 2) / (2 * F.col("variance"))
    odds = both.groupBy("id", "label", "candidate").agg(F.round(F.sum(one) + F.log(F.max("prior")), 6).alias("odds"))
    best = F.min(F.struct((-F.col("odds")).alias("o"), "candidate"))
    return odds.groupBy("id", "label").agg(best.alias("b")).select("id", "label", F.col("b.candidate").alias("predicted"))


def confusion(predictions: DataFrame) -> DataFrame:
    """label, predicted, n over the whole grid of labels: cells without rows are 0."""
    labels = predictions.select("label").unionByName(predictions.select(F.col("predicted").alias("label"))).distinct()
    grid = labels.crossJoin(F.broadcast(labels.withColumnRenamed("label", "predicted")))  # labels by labels
    return grid.join(predictions.groupBy("label", "predicted").agg(F.count("*").alias("n")), ["label", "predicted"], "left").fillna(0, ["n"])


def report(matrix: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support from a confusion grid; a share of nothing is 0."""
    hit = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    actual = matrix.groupBy("label").agg(F.sum("n").alias("support"), hit.alias("hit"))
    said = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    p, r = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0), F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    rows = actual.join(said, "label").withColumn("p", p).withColumn("r", r)
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return rows.select("label", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def next_label(rows: DataFrame, label: str) -> DataFrame:
    """label, next: each distinct label with the following one, the last with the first."""
    w = Window.orderBy(label)  # a row for each label
    labels = rows.select(label).distinct()
    return labels.select(F.col(label).alias("label"), F.coalesce(F.lead(label).over(w), F.min(label).over(Window.partitionBy())).alias("next"))
