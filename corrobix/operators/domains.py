"""Registrable domains by a table of public-suffix rules: the longest rule that a name ends with, by a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import is_address


def suffix_rules(lines: DataFrame) -> DataFrame:
    """rule, kind of lines (line) as suffix lists write them: `com`, `*.ck`, `!www.ck`; comments and blank lines are no rules.

    `rule` is the suffix that a name must end with: without the star, which stands for one more label, or the exclamation mark.
    """
    line = F.lower(F.trim(F.element_at(F.split(F.trim("line"), r"\s+"), 1)))
    rules = lines.select(line.alias("line")).where("line <> '' and not startswith(line, '//')").distinct()
    kind = F.when(F.startswith("line", F.lit("!")), "exception").when(F.startswith("line", F.lit("*.")), "wildcard").otherwise("plain")
    return rules.select(F.regexp_replace("line", r"^(!|\*\.)", "").alias("rule"), kind.alias("kind"))


def with_registrable(rows: DataFrame, rules: DataFrame, name: str = "fqdn", result: str = "domain") -> DataFrame:
    """rows and the registrable domain of `name`: one label more than its public suffix; null for a bare suffix or no name.

    An exception wins over all rules and makes its own first label registrable; else the rule with most labels wins, a wildcard
    counting one more than it writes; without any the last label is the suffix. Addresses stay as they are. Each distinct name
    meets the rules once, through its own suffixes.
    """
    host = F.lower(F.regexp_replace(F.trim(F.col(name)), r"\.$", ""))
    names = rows.select(host.alias("_host")).where("_host <> ''").distinct()
    named = names.where(~is_address("_host")).withColumn("_labels", F.split("_host", r"\."))
    n = F.size("_labels")
    suffixes = named.select("_host", n.alias("_n"), F.explode(F.sequence(F.lit(1), n)).alias("_k"), "_labels").withColumn("rule", F.array_join(F.slice("_labels", F.col("_n") - F.col("_k") + 1, F.col("_k")), "."))
    # Labels of the public suffix by each rule; a wildcard needs a label before what it writes.
    length = F.when(F.col("kind") == "plain", F.col("_k")).when((F.col("kind") == "wildcard") & (F.col("_k") < F.col("_n")), F.col("_k") + 1)
    found = suffixes.join(rules, "rule").groupBy("_host").agg(F.max(length).alias("_long"), F.max(F.when(F.col("kind") == "exception", F.col("_k") - 1)).alias("_free"))
    suffix = F.coalesce("_free", "_long", F.lit(1))
    domain = F.when(n > suffix, F.array_join(F.slice("_labels", n - suffix, suffix + 1), "."))
    known = named.join(found, "_host", "left").select("_host", domain.alias(result)).unionByName(names.where(is_address("_host")).select("_host", F.col("_host").alias(result)))
    return rows.withColumn("_host", host).join(known, "_host", "left").drop("_host")
