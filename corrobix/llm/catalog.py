"""Queries over the corpus tables, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bitpack_output import default_tokenizer, read_packed, write_packed
from .centroid_clusters import cluster_vectors
from .decontaminate import find_leaks
from .embedding_dedup import link_embeddings
from .html_extract import extract_text, train_labeller
from .jaccard_join import jaccard_components
from .language_id import held_out, learn_profiles, predict_language
from .line_dedup import drop_repeated_lines
from .oracle import ORACLE_SQL
from .quality import score_quality, train_quality
from .secret_scan import digest, learn_dictionary, scan_secrets
from .source_divergence import audit_sources
from .source_mix import mix_sources
from .substring_dedup import remove_repeats


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every text; profiles from texts outside the held-out fold. Null or letterless texts are `und`."""
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", held_out())
    return predict_language(docs, learn_profiles(docs.where("not held_out")), keep=("held_out",))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by 4-word shingles, 85 %. Blank texts link with nothing."""
    return jaccard_components(_read(spark, sf_dir, "documents"), k=4, percent=85)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the two co-trained views. Nulls are values of their own."""
    docs = _read(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, _read(spark, sf_dir, "labels")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors by cosine 0.95. Unusable vectors link with nothing."""
    return link_embeddings(_read(spark, sf_dir, "embeddings"), cosine=0.95)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written in blocks and read back: start, length and digest of every document. Null texts are the end id."""
    return read_packed(write_packed(_read(spark, sf_dir, "documents"), default_tokenizer()).df)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Null and empty pages have none."""
    pages = _read(spark, sf_dir, "pages")
    return extract_text(pages, train_labeller(pages))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a repeated 13-word window covers are removed. Null texts have no words."""
    return remove_repeats(_read(spark, sf_dir, "documents"), width=13)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of benchmark items in documents, one row for each pair. Null and blank texts match nothing."""
    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken. Null texts have size 0, a null source is one of its own."""
    return mix_sources(_read(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every text, counted and digested. Null and empty texts have none."""
    docs = _read(spark, sf_dir, "documents")
    return digest(scan_secrets(docs, learn_dictionary(docs)))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 code points and more that at least 3 documents hold stay in the largest doc_id alone.

    Null and empty texts are one empty line; repeated ids are one document; null ids keep all lines; an empty table gives no rows.
    """
    return drop_repeated_lines(_read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of each language's sources in their words, and each source's own words.

    Null texts, languages and sources read as empty; every row is a document; ties go by item; an empty table gives no rows.
    """
    return audit_sources(_read(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 finite components after 10 rounds; others have no row. Ties go to the smaller centroid.

    Repeated ids are vectors of their own; null ids start no centroid; an empty table gives no rows.
    """
    return cluster_vectors(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_ngram_jaccard, op3_quality, op4_embedding_dedup, op5_token_output, op6_html_extract, op7_substring_dedup, op8_decontaminate, op9_source_mix, op10_secret_scan, op11_line_dedup, op12_source_divergence, op13_centroid_clusters)}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that have any; the others are held against brute force in tests/llm."""
    return dict(ORACLE_SQL)
