"""What folders of staged data hold, and what is wrong with them, in one scan for each kind of file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ISSUES = "dataset string, path string, reason string"
FLOW_COLUMNS = ("srcIp", "dstIp", "dstPort", "time")


def folder_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _matching(spark: SparkSession, path: str, glob: str) -> bool:
    """Whether the folder has such a file, at any depth; names only are listed."""
    return not spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path").limit(1).isEmpty()


def flow_files(spark: SparkSession, path: str) -> DataFrame:
    """file, device, header, records of every `*_flows.csv` under path: lines are counted, nothing is parsed."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_flows.csv").text(path)
    placed = lines.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("row"), "value")
    found = placed.groupBy("file").agg(F.min_by("value", "row").alias("header"), (F.count_if(F.trim("value") != "") - 1).alias("records"))
    return found.withColumn("device", F.regexp_extract("file", r"([^/]+)_flows\.csv$", 1))


def profile_files(spark: SparkSession, path: str) -> DataFrame:
    """file, device, whole (a JSON object), records (its rules) of every `*.json` under path."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    doc = F.try_parse_json("value")
    rules = F.coalesce(F.size(F.try_variant_get(doc, "$.rules", "array<variant>")), F.lit(0))
    return text.select(F.col("_metadata.file_path").alias("file"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("device"), F.coalesce(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(False)).alias("whole"), rules.cast("long").alias("records"))


def flow_issues(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """dataset, path, reason: a missing folder, a folder without flow tables, tables without a column that is needed."""
    if not folder_exists(spark, path):
        return spark.createDataFrame([(dataset, path, "the folder is missing")], ISSUES)
    if not _matching(spark, path, "*_flows.csv"):
        return spark.createDataFrame([(dataset, path, "there are no *_flows.csv files")], ISSUES)
    have = F.transform(F.split("header", ","), lambda c: F.trim(F.regexp_replace(c, '["﻿]', "")))
    missing = F.array_except(F.array(*map(F.lit, sorted(FLOW_COLUMNS))), have)
    rows = flow_files(spark, path).withColumn("missing", missing)
    reason = F.when(F.size("missing") > 0, F.concat(F.lit("missing columns: "), F.array_join("missing", ", "))).when(F.col("records") < 1, "no rows")
    return rows.select(F.lit(dataset).alias("dataset"), F.col("file").alias("path"), reason.alias("reason")).where("reason is not null")


def profile_issues(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """dataset, path, reason: a missing or empty folder, and files that are no JSON object."""
    if not folder_exists(spark, path):
        return spark.createDataFrame([(dataset, path, "the folder is missing")], ISSUES)
    if not _matching(spark, path, "*.json"):
        return spark.createDataFrame([(dataset, path, "there are no *.json files")], ISSUES)
    return profile_files(spark, path).where("not whole").select(F.lit(dataset).alias("dataset"), F.col("file").alias("path"), F.lit("malformed profile").alias("reason"))


def inventory(files: DataFrame, dataset: str, role: str) -> DataFrame:
    """dataset, role, files, devices, records of scanned files (file, device, records); a row also where there are none."""
    return files.agg(F.lit(dataset).alias("dataset"), F.lit(role).alias("role"), F.count("*").alias("files"), F.count_distinct("device").alias("devices"), F.coalesce(F.sum(F.greatest("records", F.lit(0))), F.lit(0)).alias("records"))


def report(inventories: list[DataFrame], issues: list[DataFrame]) -> tuple[DataFrame, str]:
    """dataset, role, files, devices, records, issues of several datasets, and the same as a JSON document.

    A row for each dataset reaches the driver, never one for each file.
    """
    every, wrong = inventories[0], issues[0]
    for x in inventories[1:]:
        every = every.unionByName(x)
    for x in issues[1:]:
        wrong = wrong.unionByName(x)
    summary = every.join(wrong.groupBy("dataset").agg(F.count("*").alias("issues")), "dataset", "left").fillna(0, ["issues"])
    return summary, json.dumps({"datasets": [r.asDict() for r in summary.orderBy("dataset").collect()]})
