"""Helpers shared by the corpus operators: materialised tables, components, vectorised word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that may be broadcast as a semi-join filter (8 bytes each); larger sets are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Without it only a local session has one, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/corrobix-{os.getpid()}"


def bounded_batches(spark: SparkSession) -> None:
    """Texts may be long, so Arrow batches are kept to fewer rows than Spark's default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


#: What a Python worker keeps from task to task, by the operator that keeps it.
_kept: dict[str, dict] = {}
_turn: list[str] = []


def kept(operator: str) -> dict:
    """A table of what an operator keeps in a worker between its tasks, until the worker turns to another operator."""
    return _kept.setdefault(operator, {})


def give_back() -> None:
    """Return memory that Python and Arrow have freed to the system: drivers and workers live longer than an operator's arrays."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems than Linux with glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def turn_to(operator: str) -> None:
    """Called at a task's start: workers serve one operator after another, and give back what the one before has kept."""
    if _turn[:1] == [operator]:
        return
    _turn[:] = [operator]
    for name, own in _kept.items():
        if name != operator:
            own.clear()
    give_back()


class Table:
    """A DataFrame written as Parquet in the shared folder: cuts lineage and survives lost executors.

    `delta` stores integers as differences, which sorted hashes and ids need fewer bits for.
    """

    def __init__(self, df: DataFrame, name: str, compression: str = "snappy", delta: bool = False):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/corrobix/{name}-{uuid.uuid4().hex}"
        writer = df.write.option("compression", compression)
        (writer.option("parquet.writer.version", "v2") if delta else writer).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced; else they stay until the driver's next collection."""
    give_back()
    spark._jvm.System.gc()


def with_ids(df: DataFrame, ids: DataFrame, col: str, n_ids: int | None = None) -> DataFrame:
    """Rows of df whose col is in ids (one column of distinct values): a broadcast filter while the set is small, a shuffle beyond."""
    n = ids.count() if n_ids is None else n_ids
    ids = ids.select(F.col(ids.columns[0]).alias(col))
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, col, "left_semi")


def components(edges: DataFrame) -> Table:
    """Connected components of edges (a, b): a table (node, root) where root is the smallest node reachable.

    Alternating large-star and small-star rounds, until a round changes nothing. Each round attaches nodes to the smallest neighbour with a
    partially aggregated min and a join on a unique side, so a node with many edges is never gathered into one task.
    """
    e = Table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        before = _digest(e.df)
        if before[0] == 0:
            break
        both = e.df.unionByName(e.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = Table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = both.join(low.df, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        mid = Table(large.distinct(), "large")
        low.drop()
        low = Table(mid.df.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = mid.df.join(low.df, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v"))).where("u <> v")
        new = Table(small.distinct(), "edges")
        after = _digest(new.df)
        for t in (e, low, mid):
            t.drop()
        e = new
        if after == before:
            break
    out = Table(e.df.select(F.col("u").alias("node"), F.col("v").alias("root")), "components")
    e.drop()
    return out


def spanning(edges: np.ndarray) -> np.ndarray:
    """Edges from each node to the smallest node of its component in a block."""
    if not len(edges):
        return edges
    nodes, flat = np.unique(edges, return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            break
        low = new
    moved = low != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[low[moved]]], axis=1)


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum((F.xxhash64("v", "u") % 1000003)), F.lit(0))).first())


_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_LOWER_BYTE = np.arange(256, dtype=np.uint8)
_LOWER_BYTE[65:91] += 32
#: An odd base that is 3 modulo 8, so differences of its powers keep almost all bits, and its inverse.
_BASE = np.uint64(0x9E3779B97F4A7C1B)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_COEFF = _RNG.integers(0, 2**63, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column without copying; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def small_batches(batch: pa.RecordBatch, text: int, size: int = 1 << 20):
    """Slices of whole rows with about `size` bytes of the text column each."""
    off = utf8(batch.column(text))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word [^\\x20\\x09-\\x0D]+, and per row the index of its first word (one more at the end)."""
    inside = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[off] = True
    before = np.empty(len(raw), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(raw), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(column, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the column in order, and the first word's index for each row.

    Polynomial prefix sums modulo 2**64 make the cost a few array passes over the bytes, in chunks cut between words.
    """
    raw, off = utf8(column)
    starts, ends, rows = word_bounds(raw, off)
    return hash_spans(raw, starts, ends, lower), rows


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of ascending spans of bytes."""
    out = np.empty(len(starts), np.uint64)
    table = _LOWER if lower else _BYTE
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(int(np.searchsorted(ends, at + _CHUNK, "right")), i + 1)
        size = int(ends[j - 1]) - at
        power, inverse = _power_table(size)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(table[raw[at : at + size]] * power[:size], out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    keep = size <= _CHUNK
    size = _CHUNK if keep else size
    if size in _powers:
        return _powers[size]
    made = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=np.uint64))
    if keep:
        _powers[size] = tuple(made)
    return tuple(made)


def ngram_hashes(words: np.ndarray, rows: np.ndarray, k: int, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside each row, in order, and each row's first index. Rows with fewer words have none.

    Another `turn` gives hashes that are independent of those of the first.
    """
    n = max(len(words) - k + 1, 0)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * _COEFF[j + 64 * turn]
    total = mix(total)
    counts = np.maximum(np.diff(rows) - k + 1, 0)
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    if len(total) == first[-1]:
        return total, first
    take = np.arange(first[-1]) + np.repeat(rows[:-1] - first[:-1], counts)
    return total[take], first


def shingle_sets(column, k: int, lower: bool = True) -> list[np.ndarray]:
    """Per row, the sorted distinct hashes of its k-word shingles; a row with fewer words has its whole sequence as one."""
    words, rows = word_hashes(column, lower)
    grams, first = ngram_hashes(words, rows, k)
    out = []
    for i in range(len(rows) - 1):
        if first[i + 1] > first[i]:
            out.append(np.unique(grams[first[i] : first[i + 1]]))
        elif rows[i + 1] > rows[i]:
            own = words[rows[i] : rows[i + 1]]
            out.append(mix(np.array([(own * _COEFF[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
