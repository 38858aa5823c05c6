"""Removal of lines that many documents share, with two Bloom filters in front of the exact count.

Hashes of lines, distinct in each task, are dealt to segments. A segment's once-seen filter tells which hashes were met before;
those go into the twice-seen filter, which is sized by their number and sent to all tasks. Only lines that it suspects are
shuffled, with their text: counted exactly, and compared by text where one hash stands for several lines.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER_BYTE, _SPACE, BROADCAST_IDS, Table, bounded_batches, hash_spans, mix, release, small_batches, utf8

#: Bits of a segment, bits for each hash, and positions that a hash sets.
SEGMENT, BITS, SETS = 1 << 20, 16, 4
#: Segments of the twice-seen filter at most (64 MB in all): beyond 33 million repeated lines it suspects more, never less.
BROADCAST_SEGMENTS = 512
#: Hashes that a task gathers before it deals them out.
FLUSH = 1 << 20


def line_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start and end byte of every line of every row, of its key (the line without white space around), and the lines of each row.

    A row of n line feeds has n + 1 lines; a blank line's key is empty.
    """
    feeds = np.flatnonzero(raw == 10)
    starts, ends = np.sort(np.concatenate([off[:-1], feeds + 1]), kind="stable"), np.sort(np.concatenate([feeds, off[1:]]), kind="stable")
    n_lines = np.diff(np.searchsorted(feeds, off)) + 1
    solid = np.append(np.flatnonzero(~_SPACE[raw]), len(raw))
    first = solid[np.searchsorted(solid, starts)]
    last = solid[np.maximum(np.searchsorted(solid, ends) - 1, 0)] + 1
    blank = first >= ends
    return starts, ends, np.where(blank, starts, first), np.where(blank, starts, last), n_lines


class _Lines:
    """Lines of a slice of texts: hashes of the keys that are long enough."""

    def __init__(self, column, least_chars: int, hash_bits: int):
        self.raw, self.off = utf8(column)
        self.starts, self.ends, self.key, self.stop, self.n = line_spans(self.raw, self.off)
        points = np.concatenate([[0], np.cumsum((self.raw & 0xC0) != 0x80)])
        self.long = np.flatnonzero(points[self.stop] - points[self.key] >= least_chars)
        self.row = np.repeat(np.arange(len(self.n)), self.n)[self.long]
        self.hash = hash_spans(self.raw, self.key[self.long], self.stop[self.long], lower=True) >> np.uint64(64 - hash_bits)

    def distinct(self) -> np.ndarray:
        """Places among the long lines, one for each row and hash, first occurrences in order."""
        order = np.lexsort((np.arange(len(self.hash)), self.hash, self.row))
        h, row = self.hash[order], self.row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        return np.sort(order[new])

    def keys(self, at: np.ndarray) -> pa.Array:
        """Keys of long lines, A-Z in lower case."""
        s, n = self.key[self.long[at]], (self.stop - self.key)[self.long[at]]
        bounds = np.concatenate([[0], np.cumsum(n)])
        body = _LOWER_BYTE[self.raw[np.arange(bounds[-1]) + np.repeat(s - bounds[:-1], n)]]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())).cast(pa.string())


def _places(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each hash, and the bits that it sets there."""
    x = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    step = (x >> np.uint64(20)) & np.uint64(SEGMENT - 1) | np.uint64(1)
    bits = (x[:, None] + np.arange(SETS, dtype=np.uint64) * step[:, None]) & np.uint64(SEGMENT - 1)
    return ((x >> np.uint64(40)) % np.uint64(segments)).astype(np.int64), bits.astype(np.int64)


def _dealt(h: np.ndarray, more: np.ndarray, segments: int):
    """A row for each segment: its hashes, and those of them that were met more than once."""
    at, _ = _places(h, segments)
    order = np.argsort(at, kind="stable")
    h, more = h[order], more[order]
    used, first = np.unique(at[order], return_index=True)
    bounds = np.append(first, len(h)).tolist()
    own = [h[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
    twice = [h[a:b][more[a:b]].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(own, pa.binary()), pa.array(twice, pa.binary())], names=["segment", "once", "twice"])


def _by_segment(batches):
    """Rows of a sorted partition: segment and its column values, a row at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.column(0)[i].as_py(), *(np.frombuffer(c[i].as_py(), np.uint64) for c in b.columns[1:])


def suspected(docs: DataFrame, least_chars: int = 20, hash_bits: int = 64) -> tuple[np.ndarray, int]:
    """The twice-seen filter over (doc_id, text): packed bits of all segments, and how many those are.

    It holds every hash that two rows share, and few others. The once-seen filter grows with the lines and stays in the tasks
    that build it, a segment at a time; of the twice-seen one at most BROADCAST_SEGMENTS are made.
    """
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    segments = max(1, math.ceil(lines * BITS / SEGMENT))

    def hashed(batches):
        held, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return _dealt(h, n > 1, segments)

        for b in (x for whole in batches for x in small_batches(whole, 0)):
            found = _Lines(b.column(0), least_chars, hash_bits)
            held.append(found.hash[found.distinct()])
            size += len(held[-1])
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def sighted(batches):
        now, once, again = None, None, []

        def row():
            h = np.unique(np.concatenate(again)) if again else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_pydict({"n": pa.array([len(h)], pa.int64()), "hashes": pa.array([h.tobytes()], pa.binary())})

        for segment, h, twice in _by_segment(batches):
            if segment != now:
                if again:
                    yield row()
                now, once, again = segment, np.zeros(SEGMENT, bool), []
            _, bits = _places(h, segments)
            known = once[bits].all(axis=1)
            if known.any():
                again.append(h[known])
            if len(twice):
                again.append(twice)
            once[bits] = True
        if again:
            yield row()

    dealt = docs.select("text").mapInArrow(hashed, "segment long, once binary, twice binary")
    again = Table(dealt.repartition("segment").sortWithinPartitions("segment").mapInArrow(sighted, "n long, hashes binary"), "again")
    repeated = again.df.agg(F.sum("n")).first()[0] or 0
    parts = min(BROADCAST_SEGMENTS, max(1, math.ceil(repeated * BITS / SEGMENT)))

    def parted(batches):
        for b in batches:
            for body in b.column(0).to_pylist():
                h = np.frombuffer(body, np.uint64)
                if len(h):
                    yield _dealt(h, np.zeros(len(h), bool), parts)

    def packed(batches):
        now, twice = None, None
        for part, h, _ in _by_segment(batches):
            if part != now:
                if now is not None:
                    yield pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int64()), "bits": pa.array([np.packbits(twice).tobytes()], pa.binary())})
                now, twice = part, np.zeros(SEGMENT, bool)
            twice[_places(h, parts)[1]] = True
        if now is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int64()), "bits": pa.array([np.packbits(twice).tobytes()], pa.binary())})

    out = np.zeros((parts, SEGMENT // 8), np.uint8)
    filled = again.df.select("hashes").mapInArrow(parted, "segment long, once binary, twice binary").repartition("segment").sortWithinPartitions("segment").mapInArrow(packed, "part long, bits binary")
    for part, bits in filled.collect():  # 128 kB each, BROADCAST_SEGMENTS at most
        out[part] = np.frombuffer(bytes(bits), np.uint8)
    again.drop()
    return out, parts


def _held(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    part, at = _places(h, len(bits))
    return ((bits[part[:, None], at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def drop_repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, keep_text: bool = False, hash_bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines whose key at least `least_docs` documents hold (3 or more), except in the largest doc_id that holds it.

    A line's key is the line without white space around and with A-Z in lower case; keys of fewer than `least_chars` code points
    are left alone. Returns doc_id, n_lines (before), n_dropped, kept_sha256 (and kept_text, if asked: the other lines joined by
    line feeds). All lines of the largest document stay, also those that repeat inside it. Null and empty texts are one empty
    line. Rows of one id are one document when documents are counted, and each a row of the result; rows with a null id count
    for nothing and are kept whole. An empty table gives an empty result. Very long lines are keys like others. Other columns
    are not read, whatever their names. `hash_bits` shortens hashes, for tests: equal hashes of other keys are told apart.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = docs.where("doc_id is not null and text is not null")
    bits, _ = suspected(known, least_chars, hash_bits)
    release(spark)
    given = spark.sparkContext.broadcast(bits)

    def lines(batches):
        for b in (x for whole in batches for x in small_batches(whole, 1)):
            found = _Lines(b.column(1), least_chars, hash_bits)
            at = np.flatnonzero(_held(found.hash, given.value))
            chosen = list(dict.fromkeys(zip(found.row[at].tolist(), found.hash[at].tolist(), found.keys(at).to_pylist(), strict=True)))
            row, h, key = np.array([x[0] for x in chosen], np.int64), np.array([x[1] for x in chosen], np.uint64), pa.array([x[2] for x in chosen], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(h.view(np.int64)), key], names=["doc_id", "hash", "key"])

    seen = Table(known.mapInArrow(lines, "doc_id long, hash long, key string"), "lines", "zstd")
    repeated = Table(known.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    held = seen.df if repeated.df.isEmpty() else seen.df.join(repeated.df, "doc_id", "left_anti").unionByName(seen.df.join(repeated.df, "doc_id", "left_semi").distinct())
    found = Table(held.groupBy("hash", "key").agg(F.count("*").alias("n"), F.max("doc_id").alias("stays")), "found")
    mixed = Table(found.df.groupBy("hash").count().where("count > 1").select("hash"), "mixed")
    common = found.df.where(F.col("n") >= least_docs)
    collided = not mixed.df.isEmpty()
    single = common.join(mixed.df, "hash", "left_anti") if collided else common
    gone = seen.df.select("doc_id", "hash").join(single.select("hash", "stays"), "hash").where("doc_id <> stays").select("doc_id", "hash", F.lit(None).cast("string").alias("key"))
    if collided:
        several = common.join(mixed.df, "hash", "left_semi").select("hash", "key", "stays")
        gone = gone.unionByName(seen.df.join(several, ["hash", "key"]).where("doc_id <> stays").select("doc_id", "hash", "key"))
    plain = F.collect_set(F.when(F.col("key").isNull(), F.col("hash")))
    drops = Table(gone.groupBy("doc_id").agg(plain.alias("hashes"), F.collect_set("key").alias("keys")), "drops")
    for t in (seen, repeated, found, mixed):
        t.drop()
    release(spark)
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept_text string" if keep_text else "")

    def kept(batches):
        for b in (x for whole in batches for x in small_batches(whole, 1)):
            found = _Lines(b.column(1), least_chars, hash_bits)
            drop = np.zeros(len(found.starts), bool)
            if b.num_columns > 2:
                bounds = np.searchsorted(found.row, np.arange(b.num_rows + 1))
                for i in range(b.num_rows):
                    own = slice(bounds[i], bounds[i + 1])
                    if b.column(2)[i].is_valid:
                        drop[found.long[own]] = np.isin(found.hash[own], b.column(2)[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                        if keys := set(b.column(3)[i].as_py()):
                            drop[found.long[own]] |= [k in keys for k in found.keys(np.arange(own.start, own.stop)).to_pylist()]
            raw, made, at = found.raw.tobytes(), [], 0
            starts, ends = found.starts.tolist(), found.ends.tolist()
            for i, n in enumerate(found.n.tolist()):
                mine = drop[at : at + n]
                if mine.any():
                    text = b"\n".join(raw[starts[j] : ends[j]] for j in (at + np.flatnonzero(~mine)).tolist())
                else:
                    text = raw[found.off[i] : found.off[i + 1]]
                made.append((n, int(mine.sum()), hashlib.sha256(text).hexdigest(), text))
                at += n
            n, dropped, sha, text = zip(*made, strict=True) if made else ((),) * 4
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())]
            if keep_text:
                columns.append(pa.array([x.decode() for x in text], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"][: len(columns)])

    # Texts meet their lists by a shuffle at every size: a list holds a document's lines, so no bound holds for all lists.
    lists, ids = drops.df.hint("merge"), drops.df.select("doc_id")
    if ids.count() > BROADCAST_IDS:
        return docs.join(lists, "doc_id", "left").select("doc_id", "text", "hashes", "keys").mapInArrow(kept, schema)
    whole = docs.join(F.broadcast(ids), "doc_id", "left_anti").mapInArrow(kept, schema)
    return whole.unionByName(docs.join(F.broadcast(ids), "doc_id", "left_semi").join(lists, "doc_id").select("doc_id", "text", "hashes", "keys").mapInArrow(kept, schema))
