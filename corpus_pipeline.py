"""From raw documents to packed training tokens: quality, near duplicates, benchmark leaks, source mix, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrobix.llm.bitpack_output import default_tokenizer, read_packed, write_packed
from corrobix.llm.common import BROADCAST_IDS, Table, with_ids
from corrobix.llm.decontaminate import find_leaks
from corrobix.llm.jaccard_join import jaccard_components
from corrobix.llm.quality import score_quality, train_quality
from corrobix.llm.source_mix import WORDS, mix_sources

#: Near duplicates share 80 % of their five-word shingles.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; rows with a null id cannot be judged apart and stay."""
    scores = score_quality(docs, train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return _without(docs, scores.where("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked ones stays, once; rows with a null id stay."""
    groups = Table(jaccard_components(docs, k=SHINGLE, percent=PERCENT), "groups").df
    rows = _without(docs, groups.where("doc_id <> component_id"))
    repeated = Table(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated").df
    if repeated.isEmpty():
        return rows
    once = with_ids(rows, repeated, "doc_id").dropDuplicates(["doc_id"])
    return _without(rows, repeated).unionByName(once.select(*rows.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows with a null id, blank texts and an empty benchmark leave all as it is."""
    return _without(docs, find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mix takes.

    Rows of one id (or none), source and size are told apart by their text's hash: the first of them get the larger copies.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    chosen = mix_sources(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("_rows"), F.min("copies").alias("_low"), F.sum("copies").alias("_all"))
    chosen = Table(chosen.where("_all > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "_rows", "_low", "_all"), "copies").df
    few = chosen.count() <= BROADCAST_IDS // 8  # a row has an id, a name and four numbers
    key = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size"))
    taken = docs.withColumn("_words", size).join(F.broadcast(chosen) if few else chosen, key)
    shared = "_low * _rows < _all"
    alike = taken.where(f"_rows = 1 or not {shared}").withColumn("_copies", F.when(F.col("_rows") == 1, F.col("_all")).otherwise(F.col("_low")))
    if not chosen.where(f"_rows > 1 and {shared}").isEmpty():
        place = F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns)))
        apart = taken.where(f"_rows > 1 and {shared}").withColumn("_copies", F.col("_low") + F.when(place <= F.col("_all") - F.col("_low") * F.col("_rows"), 1).otherwise(0))
        alike = alike.unionByName(apart)
    return alike.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*(F.col(c) for c in docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as packed token ids; returns where each starts and a digest, read back from the blocks.

    Copies of a document are written side by side; null ids come first, null and empty texts are the end id alone.
    """
    return read_packed(write_packed(docs, default_tokenizer()).df)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("token_ids", token_ids)]

#: Trained models, hashes and a tokenizer decide the rows: no SQL says the same. tests/llm/test_pipeline.py compares each stage
#: with brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written before the next.

    Nulls in any column, blank and very long texts and repeated rows go through every stage as its docstring says; extra columns
    are carried to the mix. An empty table gives an empty result with the last stage's columns.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = Table(stage(spark, docs, sf_dir), name).df
    return docs


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose doc_id is not among gone's; the ids are broadcast only while they are few."""
    ids = Table(gone.where("doc_id is not null").select("doc_id").distinct(), "gone").df
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*docs.columns)
