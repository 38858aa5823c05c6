"""N-gram Jaccard join with token-combination prefixes.

A document is its set of distinct k-word shingles. Shingles are ordered by frequency class, rare ones by how rare, then by
hash. A document indexes the shortest prefix that any partner must meet: single shingles of the rare class and, where a prefix
reaches frequent classes, pairs or triples of shingles that fall in the same subclass. If fewer than k of a subclass's prefix shingles are shared, at
least c - k + 1 of its c are missing; the prefix grows until these sum to more than a linked document can miss, so every
linked pair shares a key. A prefix of rare shingles alone is extended by `spare` more, and then a linked pair shares more than
the smaller spare of its two documents. Candidates are verified on the whole sets.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Table, bounded_batches, components, mix, release, shingle_sets, spanning, turn_to, with_ids

#: A sketch has 2**SKETCH_BITS buckets, and twice as many until BUCKET_LOAD shingles or fewer meet in one, up to 2**MOST_BITS.
SKETCH_BITS, MOST_BITS, BUCKET_LOAD = 22, 28, 16
_PART = 1 << 16
#: Shingles that a task counts at once.
_AT_ONCE = 1 << 22
#: A shingle is rare below RARE counts above the sketch's noise, in the middle class below FREQUENT.
RARE, FREQUENT = 24, 2048
#: Rare shingles are ordered by so many levels of their counts; with the other classes these fill four bits.
LEVELS = 14
_VALUES = np.array([level << 2 for level in range(LEVELS)] + [1, 2], np.uint8)
_SMALL_LEVEL = 16
#: A key with more documents than this is not paired row by row: its documents are compared in blocks of so many shingles and documents.
HOT_KEY, BLOCK_SHINGLES, BLOCK_DOCS = 32, 400_000, 1024
_FINGERPRINT = "doc_id long, n long, spare long, sig1 long, sig2 long, keys array<long>"


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents when 100 * |intersection| >= percent * |union| of their k-word shingles (A-Z lower-cased).

    Returns doc_id, n_shingles, component_id (smallest id reachable by links, itself included), one row per input row.
    Null, empty and blank texts have no shingles and link with nothing. Rows with a null id get a null component. Repeated
    rows give repeated results; rows that repeat an id with another text count as one document of all of these texts' links,
    but for blank texts, which keep their own id.
    Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    classes = spark.sparkContext.broadcast(frequency_classes(docs, k))

    def fingerprints(batches):
        turn_to("jaccard")
        for b in batches:
            sets = shingle_sets(b.column(1), k)
            keys, spare = zip(*(prefix_keys(s, classes.value, percent) for s in sets), strict=True) if sets else ((), ())
            offsets = np.zeros(len(keys) + 1, np.int32)
            np.cumsum([len(x) for x in keys], out=offsets[1:])
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            sums = [(s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(spare, pa.int64()),
                    *(pa.array(np.array([x[i] for x in sums], np.uint64).view(np.int64)) for i in range(2)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))),
                ],
                names=["doc_id", "n", "spare", "sig1", "sig2", "keys"],
            )

    release(spark)
    prints = Table(docs.mapInArrow(fingerprints, _FINGERPRINT), "prints")
    classes.unpersist()
    same = ["n", "sig1", "sig2"]
    copies = Table(prints.df.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "copies")
    member = prints.df.select("doc_id", *same).join(copies.df, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"))
    member = Table(member, "member")
    # Rows, not ids, leave the search as copies: an id that repeats with other texts keeps its other rows, and joins them all.
    dropped = prints.df.select("doc_id", *same).join(copies.df, same).where("rep <> doc_id").select("doc_id", *same).distinct()
    n_dropped = dropped.count()
    singles = prints.df.where("n > 0 and doc_id is not null").join(F.broadcast(dropped) if n_dropped <= BROADCAST_IDS else dropped, ["doc_id", *same], "left_anti")
    several = member.df.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("doc_id")
    own = Table(member.df.join(several, "doc_id", "left_semi").where("n_shingles > 0 and rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "own")
    rows = singles.select("doc_id", "n", "spare", F.explode(F.array_distinct("keys")).alias("key"))
    # Most keys are in one row: all are counted alone, and only rows of the others meet with what they carry.
    shared = Table(rows.groupBy("key").count().where("count > 1").select("key"), "shared")
    release(spark)
    met = Table(rows.join(shared.df, "key"), "met")
    for t in (shared, prints, copies):
        t.drop()
    release(spark)
    pivots = met.df.groupBy("key").agg(F.min(F.struct("doc_id", "n", "spare")).alias("pivot"), F.max("doc_id").alias("last"), F.count("*").alias("c"))
    posted = Table(met.df.join(pivots.where("pivot.doc_id < last").drop("last"), "key"), "postings")
    met.drop()
    release(spark)
    alike = f"{percent} * greatest(n1, n2) <= 100 * least(n1, n2)"
    # Each key's documents against its smallest one first: most groups of near copies are one component after that.
    stars = posted.df.where("doc_id <> pivot.doc_id").select(F.col("pivot.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("pivot.n").alias("n1"), F.col("n").alias("n2"), F.least("spare", "pivot.spare").alias("spare"))
    tried = Table(stars.where(alike).groupBy("a", "b").agg(F.count("*").alias("c"), F.min("spare").alias("spare")).where("c > spare").select("a", "b"), "stars")
    linked = verify(tried.df, docs, k, percent)
    labels = components(linked.df.where("similar"))
    # Then what a key still holds of other components, against all documents of the key.
    by_doc, by_pivot = labels.df.toDF("doc_id", "label"), labels.df.toDF("first", "top")
    labelled = posted.df.withColumn("first", F.col("pivot.doc_id")).join(by_doc, "doc_id", "left").join(by_pivot, "first", "left")
    labelled = Table(labelled.select("key", "c", "first", "doc_id", F.col("n").alias("n2"), F.col("spare").alias("s2"), F.coalesce("label", "doc_id").alias("label"), F.coalesce("top", "first").alias("top")), "labelled")
    posted.drop()
    light = labelled.df.where(F.col("c") <= HOT_KEY)
    odd = light.where("label <> top").select("key", F.col("doc_id").alias("x"), F.col("n2").alias("n1"), F.col("s2").alias("s1"), F.col("label").alias("own"))
    cross = odd.join(light, "key").where(f"own <> label and (label = top or x < doc_id) and {alike}")
    cross = cross.groupBy(F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b")).agg(F.count("*").alias("c"), F.min(F.least("s1", "s2")).alias("spare")).where("c > spare")
    more = verify(cross.select("a", "b").join(tried.df, ["a", "b"], "left_anti"), docs, k, percent)
    blocks = compare_groups(labelled.df.where(F.col("c") > HOT_KEY), docs, k, percent)
    edges = linked.df.unionByName(more.df).where("similar").select("a", "b").unionByName(blocks.df).unionByName(own.df)
    final = components(edges)
    for t in (tried, labelled, labels, linked, more, blocks, own):
        t.drop()
    release(spark)
    roots = final.df.toDF("rep", "root")
    return member.df.join(roots, "rep", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep")).alias("component_id"))


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> Table:
    """pairs (a, b) with a column similar: whether the whole texts' shingle sets reach the threshold. Texts go once it is written."""
    pairs = Table(pairs, "pairs")
    ids = Table(pairs.df.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = Table(with_ids(docs, ids.df, "doc_id"), "texts")
    ids.drop()
    release(docs.sparkSession)
    left, right = texts.df.toDF("a", "text_a"), texts.df.toDF("b", "text_b")
    both = pairs.df.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def judged(batches):
        for batch in batches:
            xs, ys = shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k)
            ok = []
            for x, y in zip(xs, ys, strict=True):
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if not len(small) or 100 * len(small) < percent * len(large):
                    ok.append(False)
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "similar"])

    out = Table(both.mapInArrow(judged, "a long, b long, similar boolean"), "linked")
    pairs.drop()
    texts.drop()
    release(docs.sparkSession)
    return out


def compare_groups(rows: DataFrame, docs: DataFrame, k: int, percent: int) -> Table:
    """Edges (a, b) that span all links among documents that share a key of rows.

    Keys with the same first document form one group, as the many keys of near copies mostly do, so a pair is compared about
    once. Groups are cut into blocks of bounded size; a task intersects two blocks by matrix products and returns no pairs.
    """
    members = Table(rows.select(F.col("first").alias("g"), "doc_id", "n2", "label").distinct(), "members")
    mixed = members.df.groupBy("g").agg(F.count("*").alias("docs"), F.sum("n2").alias("shingles"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    mixed = Table(mixed.select("g", F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("docs") / BLOCK_DOCS)).alias("nb")), "mixed")
    dealt = Table(members.df.join(mixed.df, "g").select("g", "doc_id", "nb", F.pmod(F.xxhash64("doc_id"), "nb").alias("block")), "dealt")
    ids = Table(dealt.df.select("doc_id").distinct(), "ids")
    texts = Table(with_ids(docs, ids.df, "doc_id"), "texts")
    for t in (members, mixed, ids):
        t.drop()
    release(docs.sparkSession)
    sent = dealt.df.join(texts.df, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    sent = sent.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "text")

    def linked(table: pa.Table) -> pa.Table:
        sets = shingle_sets(table.column("text"), k)
        ids, block = table.column("doc_id").to_numpy(), table.column("block").to_numpy()
        left, right = np.flatnonzero(block == table.column("i")[0].as_py()), np.flatnonzero(block == table.column("j")[0].as_py())
        a, b = similar_pairs(sets, left, right, percent)
        edges = spanning(np.stack([ids[a], ids[b]], axis=1))
        return pa.table({"a": pa.array(edges[:, 0], pa.int64()), "b": pa.array(edges[:, 1], pa.int64())})

    out = Table(sent.groupBy("g", "i", "j").applyInArrow(linked, "a long, b long"), "blocks")
    dealt.drop()
    texts.drop()
    return out


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, width: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indexes from left and right whose sets reach the threshold; shingles in a single set are left out of the products."""
    if not len(left) or not len(right):
        return left[:0], right[:0]
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(n > 1) - 1
    keep = n[at] > 1
    row, at = row[keep], shared[at[keep]]
    common = np.zeros((len(left), len(right)), np.float32)
    by = np.argsort(at, kind="stable")
    row, at = row[by], at[by]
    total = int(at[-1]) + 1 if len(at) else 0
    for start in range(0, total, width):
        s, e = np.searchsorted(at, (start, start + width))
        chunk = np.zeros((len(sets), width), np.float32)
        chunk[row[s:e], at[s:e] - start] = 1
        common += chunk[left] @ chunk[right].T
    i, j = np.nonzero(common)
    n = common[i, j].astype(np.int64)
    ok = 100 * n >= percent * (sizes[left][i] + sizes[right][j] - n)
    i, j = i[ok], j[ok]
    a, b = left[i], right[j]
    return a[a != b], b[a != b]


def sketch_bits(docs: DataFrame) -> int:
    """Bits of a bucket's number, by the bytes of all texts: about five make a shingle."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = SKETCH_BITS
    while bits < MOST_BITS and size / 5 > BUCKET_LOAD << bits:
        bits += 1
    return bits


class Classes:
    """A value for each hash bucket, of four bits: class 0, 1 or 2 (rare to frequent) in its low two bits, a rare one's level above them."""

    def __init__(self, halves: np.ndarray):
        self.halves = halves

    def __len__(self) -> int:
        return 2 * len(self.halves)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return _VALUES[self.halves[at >> 1] >> (at % 2 * 4).astype(np.uint8) & 15]


def frequency_classes(docs: DataFrame, k: int) -> Classes:
    """Classes of all hash buckets, from counts over all documents.

    A task counts a bounded number of shingles at once and sends the counts compressed, in parts; parts are summed where they
    meet and leave as classes. Any fixed classes give exact results: they only decide how selective the keys are. Four bits of
    each bucket reach the driver: 2 MB, and up to 128 MB as texts grow, so that a bucket's count still tells rare shingles apart.
    """
    bits = sketch_bits(docs)
    shift = np.uint64(64 - bits)

    def counted(sets):
        at = np.sort((np.concatenate(sets) >> shift).astype(np.uint32))
        bounds = np.searchsorted(at, np.arange((1 << bits) // _PART + 1) * _PART)
        for part in np.flatnonzero(np.diff(bounds)).tolist():
            piece = np.bincount(at[bounds[part] : bounds[part + 1]] % _PART, minlength=_PART)
            wide = bool(piece.max() > 255)
            yield pa.RecordBatch.from_pydict({"part": [part], "wide": [wide], "body": [zlib.compress(piece.astype(np.uint32 if wide else np.uint8).tobytes(), 1)]})

    def count(batches):
        turn_to("jaccard")
        held, n = [], 0
        for b in batches:
            held += (sets := shingle_sets(b.column(1), k))
            n += sum(map(len, sets))
            if n >= _AT_ONCE:
                yield from counted(held)
                held, n = [], 0
        if n:
            yield from counted(held)

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, wide, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                piece = np.frombuffer(zlib.decompress(body), np.uint32 if wide else np.uint8)
                sums.setdefault(part, np.zeros(_PART, np.int64))
                sums[part] += piece
        for part, v in sums.items():
            yield pa.RecordBatch.from_pydict({"part": [part], "body": [zlib.compress(_classed(v).tobytes(), 1)]})

    parts = docs.mapInArrow(count, "part long, wide boolean, body binary").repartition(64, "part").mapInArrow(total, "part long, body binary")
    halves = np.zeros(1 << bits - 1, np.uint8)
    for part, body in parts.collect():
        halves[part * _PART // 2 : (part + 1) * _PART // 2] = np.frombuffer(zlib.decompress(bytes(body)), np.uint8)
    return Classes(halves)


def _classed(counts: np.ndarray) -> np.ndarray:
    """Classes and levels of a part's buckets, whose median count is noise, two in a byte."""
    rare = RARE + 2 * int(np.median(counts))
    kind = (counts >= rare).astype(np.uint8) + (counts >= rare - RARE + FREQUENT)
    found = np.where(kind, LEVELS - 1 + kind, np.minimum(counts, rare - 1) * LEVELS // rare).astype(np.uint8)
    return found[::2] | found[1::2] << 4


@lru_cache
def _levels(percent: int) -> np.ndarray:
    """Size bounds such that the sizes of linked documents lie in the same level or in adjacent ones."""
    bounds = [1]
    while bounds[-1] < 10**12:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return np.array(bounds)


def prefix_keys(tokens: np.ndarray, classes: Classes | np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Index keys of a sorted set of shingle hashes, and by how many the prefix is longer than it must be.

    classes has a value for each bucket of a power of two: the class in two bits, and above them the level of a rare one.
    """
    n = len(tokens)
    if not n:
        return tokens, 0
    budget = n - (percent * n + 99) // 100 + 1
    bounds = _levels(percent)
    level = int(np.searchsorted(bounds, n, "right")) - 1
    found = classes[(tokens >> np.uint64(65 - len(classes).bit_length())).astype(np.int64)]
    by = np.argsort((found & 3) << 6 | found >> 2, kind="stable")
    tokens, kind = tokens[by], found[by] & 3
    if bounds[level] < _SMALL_LEVEL:  # sets this small index single shingles of any class
        keys = tokens[:budget]
        if bounds[level + 1] >= _SMALL_LEVEL:
            keys = np.unique(np.concatenate([keys, _at_level(tokens, kind, budget, level + 1, bounds)]))
        return keys, 0
    rare = tokens[kind == 0]
    if len(rare) >= budget:
        spare = min(budget // 4, len(rare) - budget)
        return rare[: budget + spare], spare
    return np.unique(np.concatenate([_at_level(tokens, kind, budget, x, bounds) for x in (level, level + 1)])), 0


def _at_level(tokens: np.ndarray, kind: np.ndarray, budget: int, level: int, bounds: np.ndarray) -> np.ndarray:
    rare = tokens[kind == 0][:budget]
    left = budget - len(rare)
    keys = [rare]
    groups = max(1, int(bounds[level]) // 32)
    for c in (1, 2):
        if left <= 0:
            break
        own = tokens[kind == c]
        group = (own % np.uint64(groups)).astype(np.int64)
        by = np.argsort(group, kind="stable")
        place = np.empty(len(own), np.int64)
        first = np.searchsorted(group[by], np.arange(groups))
        place[by] = np.arange(len(own)) - first[group[by]]
        gain = np.cumsum(place >= c)
        used = len(own) if not len(own) or gain[-1] < left else int(np.searchsorted(gain, left)) + 1
        left -= int(gain[used - 1]) if used else 0
        for g in range(groups):
            keys.append(_combinations(own[:used][group[:used] == g], c + 1, level))
    return np.concatenate(keys)


def _combinations(x: np.ndarray, size: int, level: int) -> np.ndarray:
    """One key for each combination of size 2 or 3 of x, tagged with the level."""
    if len(x) < size:
        return x[:0]
    i, j = np.triu_indices(len(x), 1)
    if size == 2:
        total = mix(x[i]) + mix(x[j])
    else:
        at = np.repeat(np.arange(len(i)), len(x) - 1 - j)
        first = np.cumsum(len(x) - 1 - j) - (len(x) - 1 - j)
        third = np.arange(len(at)) - first[at] + j[at] + 1
        total = mix(x[i[at]]) + mix(x[j[at]]) + mix(x[third])
    return mix(total + np.uint64(level * 4 + size))
