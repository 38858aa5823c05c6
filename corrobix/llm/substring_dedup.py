"""Exact substring deduplication over a log-structured fingerprint index.

The index is a list of sorted, immutable runs of (fingerprint, doc_id). A fingerprint is the smallest hash of the 5-word runs
inside a 13-word window, so equal windows have equal fingerprints and neighbouring windows mostly share theirs: a run is about
a fifth of all windows. Each new batch becomes a run, is merge-joined with the older runs, and windows whose fingerprint was met
in several documents are verified on 128 bits of hashes of all their words. Runs are compacted once there are more than `fan_in`.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Table, bounded_batches, ngram_hashes, release, utf8, with_ids, word_hashes

GRAM = 5
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def window_fingerprints(words: np.ndarray, width: int) -> np.ndarray:
    """For every start of `width` words, the smallest hash of the GRAM-word runs inside. Row borders are not looked at."""
    grams, _ = ngram_hashes(words, np.array([0, len(words)]), GRAM)
    span = width - GRAM + 1
    low, have = grams, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:]) if len(low) > step else low[:0]
        have += step
    return low


class FingerprintIndex:
    """Runs of window fingerprints of all documents seen so far.

    Batches come in ascending doc_id ranges; `archive` gives the texts of earlier batches back for verification.
    """

    def __init__(self, spark: SparkSession, width: int = 13, fan_in: int = 4):
        self.spark, self.width, self.fan_in = spark, width, fan_in
        self.runs: list[Table] = []

    def _postings(self, docs: DataFrame) -> DataFrame:
        width = self.width

        def posted(batches):
            for b in batches:
                words, rows = word_hashes(b.column(1))
                prints = window_fingerprints(words, width)
                row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[: len(prints)]
                at = np.arange(len(prints))
                ok = at + width <= rows[row + 1]
                prints, row = prints[ok], row[ok]
                new = np.ones(len(prints), bool)
                new[1:] = (prints[1:] != prints[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(prints[new].view(np.int64)), b.column(0).take(pa.array(row[new]))], names=["fp", "doc_id"])

        return docs.mapInArrow(posted, "fp long, doc_id long")

    def add(self, batch: DataFrame, archive: DataFrame | None) -> Table:
        """Append a batch as a new run; return (doc_id, windows): hashes of its windows that start in an earlier document.

        Rows without an id or with fewer words than a window add nothing; an empty batch adds an empty run. Rows that repeat an
        id never count as each other's earlier document.
        """
        self.runs.append(Table(self._postings(batch).hint("rebalance", F.col("fp")).sortWithinPartitions("fp", "doc_id"), "run", "zstd", delta=True))
        old, new = [r.df.withColumn("fresh", F.lit(False)) for r in self.runs[:-1]], self.runs[-1].df.withColumn("fresh", F.lit(True))
        every = reduce(DataFrame.unionByName, [*old, new])
        met = every.groupBy("fp").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("fresh").alias("fresh"))
        met = Table(met.where("fresh and first < last").select("fp"), "met")
        lists = Table(every.join(met.df, "fp").groupBy("doc_id").agg(F.collect_set("fp").alias("fps")), "lists", "zstd", delta=True)
        met.drop()
        release(self.spark)
        texts = with_ids(batch if archive is None else archive.unionByName(batch), lists.df.select("doc_id"), "doc_id").join(lists.df, "doc_id")
        width = self.width

        def windows(batches):
            for b in batches:
                words, rows = word_hashes(b.column(1))
                wide, first = ngram_hashes(words, rows, width)
                check, _ = ngram_hashes(words, rows, width, turn=1)
                prints = window_fingerprints(words, width)
                fps = b.column(2)
                found, row = [], []
                for i in range(len(rows) - 1):
                    n = first[i + 1] - first[i]
                    own = np.sort(fps[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                    mine = prints[rows[i] : rows[i] + n]
                    at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                    hit = first[i] + np.flatnonzero(own[at] == mine)
                    hit = hit[np.unique(wide[hit], return_index=True)[1]]
                    found.append(hit)
                    row.append(np.full(len(hit), i))
                flat = np.concatenate(found) if found else np.zeros(0, np.int64)
                columns = [pa.array(wide[flat].view(np.int64)), pa.array(check[flat].view(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, b.column(0).take(pa.array(np.concatenate(row) if row else np.zeros(0, np.int64)))], names=["window", "check", "doc_id"])

        seen = Table(texts.mapInArrow(windows, "window long, check long, doc_id long"), "windows", "zstd", delta=True)
        lists.drop()
        del texts, every
        release(self.spark)
        firsts = seen.df.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("check").alias("check"), F.max("check").alias("other")).where("first < last")
        firsts = Table(firsts.select("window", "first", (F.col("check") != F.col("other")).alias("differs")), "firsts", "zstd", delta=True)
        release(self.spark)
        later = seen.df.join(firsts.df, "window").where("doc_id > first")
        if not firsts.df.where("differs").isEmpty():  # one hash of several windows: the other hash tells them apart
            mixed = seen.df.join(firsts.df.where("differs").select("window"), "window", "left_semi")
            again = mixed.join(mixed.groupBy("window", "check").agg(F.min("doc_id").alias("first")), ["window", "check"]).where("doc_id > first")
            later = later.where("not differs").select("window", "doc_id").unionByName(again.select("window", "doc_id"))
        if archive is not None:
            later = later.join(F.broadcast(batch.agg(F.min("doc_id").alias("low"))), F.col("doc_id") >= F.col("low"))
        out = Table(later.groupBy("doc_id").agg(F.collect_set("window").alias("windows")), "repeats", "zstd", delta=True)
        for t in (seen, firsts):
            t.drop()
        release(self.spark)
        if len(self.runs) > self.fan_in:
            self.compact()
        return out

    def compact(self) -> None:
        """Merge all runs into one sorted run without repeated entries."""
        merged = Table(reduce(DataFrame.unionByName, [r.df for r in self.runs]).distinct().hint("rebalance", F.col("fp")).sortWithinPartitions("fp", "doc_id"), "run", "zstd", delta=True)
        self.close()
        self.runs = [merged]

    def close(self) -> None:
        for r in self.runs:
            r.drop()
        self.runs = []


def remove_repeats(docs: DataFrame, width: int = 13, n_batches: int = 2, fan_in: int = 4, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window of `width` words that also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256 (and kept_text: the kept words joined by a space, if asked). Windows are
    judged on the input. Null texts have no words; texts with fewer words than a window are kept whole; rows with a null id
    are kept whole and are no one's earlier document. Repeated rows of an id are each judged against smaller ids only, so
    equal ids never remove each other's words. An empty table gives an empty result. Other columns are not read, whatever their
    names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    index, found = FingerprintIndex(spark, width, fan_in), []
    if low is not None:
        step = max(1, -(-(high - low + 1) // n_batches))
        for at in range(low, high + 1, step):
            batch = docs.where((F.col("doc_id") >= at) & (F.col("doc_id") < at + step))
            found.append(index.add(batch, docs.where(F.col("doc_id") < at) if at > low else None))
    index.close()
    schema = _RESULT + (", kept_text string" if keep_text else "")

    def kept(batches):
        for b in batches:
            lists = b.column(2) if b.num_columns > 2 else None
            raw, off = utf8(b.column(1))
            raw = raw.tobytes()
            words, rows = word_hashes(b.column(1)) if lists is not None else (None, None)
            wide, first = ngram_hashes(words, rows, width) if lists is not None else (None, None)
            made = []
            for i in range(b.num_rows):
                own = raw[off[i] : off[i + 1]].split()
                n, removed = len(own), 0
                if lists is not None and lists[i].is_valid and first[i + 1] > first[i]:
                    known = np.sort(lists[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                    mine = wide[first[i] : first[i + 1]]
                    hit = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
                    edge = np.zeros(n + 1, np.int64)
                    edge[: len(hit)] += hit
                    edge[width : width + len(hit)] -= hit
                    keep = np.cumsum(edge)[:n] == 0
                    own = list(compress(own, keep.tolist()))
                    removed = n - len(own)
                text = b" ".join(own)
                made.append((n, removed, hashlib.sha256(text).hexdigest(), text))
            n, removed, sha, text = zip(*made, strict=True) if made else ((),) * 4
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            if keep_text:
                columns.append(pa.array([x.decode() for x in text], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(columns)])

    if not found:
        return docs.mapInArrow(kept, schema)
    repeats = reduce(DataFrame.unionByName, [t.df for t in found])
    ids = repeats.select("doc_id")
    if ids.count() > BROADCAST_IDS:
        return docs.join(repeats, "doc_id", "left").select("doc_id", "text", "windows").mapInArrow(kept, schema)
    whole = docs.join(F.broadcast(ids), "doc_id", "left_anti").mapInArrow(kept, schema)
    return whole.unionByName(docs.join(F.broadcast(ids), "doc_id", "left_semi").join(repeats, "doc_id").select("doc_id", "text", "windows").mapInArrow(kept, schema))
