"""Near-duplicate embeddings by product quantisation.

Coarse centroids split the unit vectors into inverted lists, and many vectors are split once more by their residuals; residuals
are coded by subspace. Of two linked vectors in different lists at least one lies within half a link's length of the border
between them, so a query that probes all lists whose border is that near loses no link (see `probes`). Lists are compared by
table lookups, which keep a vector when the looked-up distance is no more than a link's length plus that vector's own coding
error. Survivors are compared exactly in double precision, and a link found from both of its ends counts once. Lists are dealt
out in blocks of bounded size, and a block returns counts and a spanning forest instead of pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, components, release, spanning

#: Bounds of the training sample, and of the members and queries that one task compares.
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 32 << 20
MEMBERS, QUERIES = 1024, 2048
#: Lists hold about so many vectors: as many lists as the sample can fit, each split by residuals in up to MOST_PARTS.
LIST_SIZE, MOST_PARTS = 128, 256
#: What rounding can change in a distance from a border.
ROUNDING = 1e-7


@dataclass
class Index:
    centroids: np.ndarray
    parts: np.ndarray  # residuals that split every list
    codebooks: np.ndarray  # subspaces x codes x width
    radius: float
    reach: float


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(axis=1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ c.T).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def train(sample: np.ndarray, n_vectors: int, cosine: float, reach: float | None = None, seed: int = 7) -> Index:
    """Fit centroids and codebooks on unit vectors. The sample is bounded; every vector is indexed afterwards."""
    rng = np.random.default_rng(seed)
    n, d = sample.shape
    lists = max(1, min(n_vectors // LIST_SIZE, n // 8))
    centroids = _kmeans(sample, lists, 8, rng)
    residual = sample - centroids[_nearest(sample, centroids)]
    parts = max(1, min(n_vectors // (lists * 2 * LIST_SIZE), n // 8, MOST_PARTS))
    split = _kmeans(residual, parts, 6, rng) if parts > 1 else np.zeros((1, d))
    residual -= split[_nearest(residual, split)]
    width = 8 if d % 8 == 0 else 1 if d < 8 else d
    codes = max(1, min(256, n // 4))
    books = np.stack([_kmeans(residual[:, s : s + width], codes, 6, rng) for s in range(0, d, width)])
    radius = math.sqrt(2 - 2 * cosine) * (1 + 1e-9) + 1e-9
    return Index(centroids, split, books, radius, radius / 2 if reach is None else min(reach, radius / 2))


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List, codes and coding error of unit vectors."""
    own = _nearest(x, index.centroids)
    residual = x - index.centroids[own]
    part = _nearest(residual, index.parts)
    residual -= index.parts[part]
    m, _, width = index.codebooks.shape
    codes = np.stack([_nearest(residual[:, s * width : (s + 1) * width], index.codebooks[s]) for s in range(m)], axis=1)
    decoded = np.concatenate([index.codebooks[s][codes[:, s]] for s in range(m)], axis=1)
    return own * len(index.parts) + part, codes.astype(np.uint8), np.linalg.norm(residual - decoded, axis=1)


def _past(x: np.ndarray, own: np.ndarray, c: np.ndarray) -> np.ndarray:
    """How far each row lies from its own cell's border with the cell of every centroid."""
    far = (c**2).sum(axis=1) - 2 * x @ c.T
    between = np.sqrt(np.maximum((c[own] ** 2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * c[own] @ c.T, 1e-24))
    return (far - far[np.arange(len(x)), own][:, None]) / (2 * between)


def _from_border(x: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The same for a row, its own centroid and one other, by sums whose order never changes."""
    return (((x - other) ** 2).sum(axis=1) - ((x - own) ** 2).sum(axis=1)) / (2 * np.maximum(np.sqrt(((own - other) ** 2).sum(axis=1)), 1e-12))


def probes(index: Index, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) for every list that a row asks.

    The border between the cells of two centroids is a plane, so the distances of two linked vectors from it add up to a link's
    length at most, and the smaller one to half of it. Between centroids that half decides; behind such a border all parts within
    a whole link's length are asked, and of the own centroid's parts those within the half.
    """
    top, part = own // len(index.parts), own % len(index.parts)
    row, lst = np.nonzero(_past(x, top, index.centroids) <= index.reach + ROUNDING)
    if len(index.parts) == 1:
        return row, lst
    out = []
    for at in range(0, len(row), 4096):
        r, c = row[at : at + 4096], lst[at : at + 4096]
        rest = x[r] - index.centroids[c]
        mine = c == top[r]
        nearest = np.where(mine, part[r], _nearest(rest, index.parts))
        i, j = np.nonzero(_past(rest, nearest, index.parts) <= np.where(mine, index.reach, 2 * index.reach)[:, None] + ROUNDING)
        out.append((r[i], c[i] * len(index.parts) + j))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (row, lst)


def _counts_here(index: Index, q_list: np.ndarray, q: np.ndarray, lst: int, v: np.ndarray, q_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a link of a query and a member of a list counts here, not where the member is the query; one of both it is."""
    parts = len(index.parts)
    a, b = q_list // parts, np.full(len(q_list), lst // parts)
    here = np.where(q_list == lst, q_ids < ids, q_list < lst)
    for level in (0, 1):
        at = np.flatnonzero(a != b if level == 0 else (a == b) & (q_list != lst))
        if len(at):
            shift = 0 if level == 0 else index.centroids[a[at]]
            c = (index.centroids[a[at]], index.centroids[b[at]]) if level == 0 else (index.parts[q_list[at] % parts], np.repeat(index.parts[[lst % parts]], len(at), axis=0))
            asks = _from_border(q[at] - shift, *c) <= index.reach
            asked = _from_border(v[at] - shift, *c[::-1]) <= index.reach
            here[at] = asks & (~asked | here[at]) | ~asks & ~asked & here[at]
    return here


def link_block(index: Index, lst: int, ids: np.ndarray, weights: np.ndarray, codes: np.ndarray, errors: np.ndarray, vectors: np.ndarray, q_ids: np.ndarray, q_weights: np.ndarray, q_lists: np.ndarray, queries: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a block of a list: the weights linked with each query and each member, and edges (rows of two ids) that span the links."""
    m, _, width = index.codebooks.shape
    unit_q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    unit_v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    q_counts, counts, edges = np.zeros(len(q_ids), np.int64), np.zeros(len(ids), np.int64), []
    bound = (index.radius + errors) ** 2 + 1e-9
    centre = index.centroids[lst // len(index.parts)] + index.parts[lst % len(index.parts)]
    for at in range(0, len(q_ids), 256):
        rest = unit_q[at : at + 256] - centre
        distance = np.zeros((len(rest), len(ids)))
        for s in range(m):
            own, book = rest[:, s * width : (s + 1) * width], index.codebooks[s]
            table = (own**2).sum(axis=1)[:, None] + (book**2).sum(axis=1) - 2 * own @ book.T
            distance += table[:, codes[:, s]]
        row, col = np.nonzero(distance <= bound)
        for i in range(0, len(row), 1 << 16):
            r, c = row[i : i + (1 << 16)] + at, col[i : i + (1 << 16)]
            linked = np.flatnonzero((np.einsum("ij,ij->i", unit_q[r], unit_v[c]) >= cosine) & (q_ids[r] != ids[c]))
            r, c = r[linked], c[linked]
            here = _counts_here(index, q_lists[r], unit_q[r], lst, unit_v[c], q_ids[r], ids[c])
            r, c = r[here], c[here]
            np.add.at(q_counts, r, weights[c])
            np.add.at(counts, c, q_weights[r])
            edges.append(spanning(np.stack([q_ids[r], ids[c]], axis=1)))
    return q_counts, counts, spanning(np.concatenate(edges)) if edges else np.zeros((0, 2), np.int64)


def link_embeddings(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", reach: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    No link is lost. `reach`, a distance, makes probes end sooner, for vectors of so many independent directions that half a link's
    length reaches most lists; links whose ends both lie farther from a border are lost then.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors of different lengths
    are compared only with their own length. Equal vectors are one class in the search and count as links of each other.
    Rows that repeat an id count as rows of their own; null ids link with nothing and get a null component. Other columns are
    not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    of_floats = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "float" if of_floats else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    size = F.size("v")
    finite = F.col("v").isNotNull() & (size > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull())
    sig = [F.xxhash64(F.lit(1), "v").alias("s1"), F.xxhash64(F.lit(2), "v").alias("s2"), size.alias("d")]
    same = ["s1", "s2", "d"]
    member = rows.where("good").select("vec_id", *sig)
    classes = Table(member.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).withColumn("id", F.monotonically_increasing_id()), "classes")
    reps = rows.where("good").select("vec_id", "v", *sig).join(classes.df, same).where("vec_id = rep").dropDuplicates(["id"])
    reps = Table(reps.select("id", "weight", "d", "v"), "reps")
    parts = []
    for d, n in reps.df.groupBy("d").count().orderBy("d").collect():
        parts += _links_of(reps.df.where(F.col("d") == d), d, n, kind, cosine, reach)
    found = Table(parts[0] if len(parts) == 1 else _union(parts), "links") if parts else None
    result = rows.select("vec_id", "good", *sig)
    if found is None:
        return result.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    roots = components(found.df.where("b is not null").select("a", "b"))
    lowest = roots.df.unionByName(roots.df.select(F.col("root").alias("node"), "root").distinct()).distinct()
    lowest = lowest.join(classes.df.select(F.col("id").alias("node"), "rep"), "node")
    lowest = lowest.join(lowest.groupBy("root").agg(F.min("rep").alias("low")), "root").select(F.col("node").alias("id"), "low")
    counts = found.df.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    known = classes.df.join(counts, "id", "left").join(lowest, "id", "left")
    known = Table(known.select(*same, (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("low", "rep").alias("component_id")), "known")
    for t in (classes, reps, found, roots):
        t.drop()
    release(spark)
    linked = result.where("good").join(known.df, same).select("vec_id", "n_links", "component_id")
    other = result.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(other).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _links_of(reps: DataFrame, d: int, n: int, kind: str, cosine: float, reach: float | None) -> list[DataFrame]:
    """Links among n vectors of length d: rows (a, b, links), edges with a and b, counts with b null."""
    spark = reps.sparkSession
    dtype = np.dtype("<f4" if kind == "float" else "<f8")
    rows = max(256, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * d)))
    sample = reps.select("id", "v").orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(rows).toArrow()
    x = _matrix(sample.column("v"), d)
    index = spark.sparkContext.broadcast(train(x / np.linalg.norm(x, axis=1, keepdims=True), n, cosine, reach))

    def encoded(batches):
        for b in batches:
            x = _matrix(b.column(1), d)
            for at in range(0, len(x), 2048):
                raw = x[at : at + 2048]
                unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
                own, codes, errors = encode(index.value, unit)
                row, lst = probes(index.value, unit, own)
                blobs = [v.tobytes() for v in raw.astype(dtype)]
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(len(raw) + 1))
                near = [lst[order[cut[i] : cut[i + 1]]].tolist() for i in range(len(raw))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(raw)), b.column(2).slice(at, len(raw)), pa.array(own, pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors), pa.array(blobs, pa.binary()), pa.array(near, pa.list_(pa.int64()))],
                    names=["id", "weight", "list", "codes", "error", "v", "probes"],
                )

    coded = Table(reps.select("id", "v", "weight").mapInArrow(encoded, "id long, weight long, list long, codes binary, error double, v binary, probes array<long>"), "coded")
    asked = coded.df.select("id", "v", "weight", F.col("list").alias("own"), F.explode("probes").alias("list"))
    sizes = coded.df.groupBy("list").agg(F.count("*").alias("n")).join(asked.groupBy("list").agg(F.count("*").alias("q")), "list")
    sizes = sizes.select("list", F.ceil(F.col("n") / MEMBERS).alias("nb"), F.ceil(F.col("q") / QUERIES).alias("qb"))  # a row for each list
    mine = F.pmod(F.xxhash64(F.lit(5), "id"), F.col("nb")).alias("mine")
    block = F.pmod(F.xxhash64(F.lit(6), "id"), F.col("qb")).alias("block")
    members = coded.df.select("id", "weight", "list", "codes", "error", "v").join(F.broadcast(sizes), "list").select("list", mine, F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("block"), "id", "weight", "codes", "error", "v").toDF("l_list", "l_mine", "l_block", "id", "weight", "codes", "error", "v")
    queries = asked.join(F.broadcast(sizes), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("mine"), block, F.col("id").alias("q_id"), F.col("weight").alias("q_weight"), F.col("own").alias("q_list"), F.col("v").alias("q"))

    def linked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "links": []})
        v, q = (np.frombuffer(b"".join(x), dtype).reshape(-1, d).astype(np.float64) for x in (left["v"], right["q"]))
        codes = np.frombuffer(b"".join(left["codes"]), np.uint8).reshape(len(left), -1)
        q_counts, counts, edges = link_block(index.value, int(left["l_list"].iloc[0]), left["id"].to_numpy(), left["weight"].to_numpy(), codes, left["error"].to_numpy(), v, *(right[c].to_numpy() for c in ("q_id", "q_weight", "q_list")), q, cosine)
        ids, n = np.concatenate([right["q_id"], left["id"]]), np.concatenate([q_counts, counts])
        ids, n = ids[n > 0], n[n > 0]
        return pd.DataFrame({"a": np.concatenate([ids, edges[:, 0]]), "b": pd.array([None] * len(ids) + edges[:, 1].tolist(), "Int64"), "links": np.concatenate([n, np.zeros(len(edges), np.int64)])})

    key = ["list", "mine", "block"]
    return [members.groupBy(*(f"l_{k}" for k in key)).cogroup(queries.groupBy(*key)).applyInPandas(linked, "a long, b long, links long")]


def _matrix(column, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
