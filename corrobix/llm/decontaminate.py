"""Benchmark decontamination by latent semantic retrieval.

Words are hashed into buckets weighted by inverse document frequency over all documents. A randomised SVD of the distinct
passages, summed over Spark tasks, gives every bucket a short vector, without the leading directions that only tell languages
and house styles apart. All passages of documents and all pieces of benchmark items are compared by cosine in that space; what
is close, and nothing else, is verified by the longest common subsequence of words and by whether the item's answer, its last
sentence, is there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _COEFF, bounded_batches, mix, release, small_batches, turn_to, word_hashes

BUCKETS, RANK, EXTRA = 1 << 15, 64, 32
#: Directions are left out whose singular value is so many times the median one, EXTRA / 2 at most.
LEADING = 1.5
#: Passages of BLOCK * SPAN words, one starting every BLOCK words.
BLOCK, SPAN = 8, 3
COSINE, WHOLE, PART, ANSWER = 0.5, 0.75, 0.5, 0.8
ITEMS_AT_ONCE = 4096
#: Variance of a direction, as a share of the largest, that single precision cannot tell from none.
ROUNDING = 1e-5
#: Passages whose vectors are held at once, rows of a partial sum, and the ways that partial sums of one part are first dealt.
_PASSAGES, _PART, _WAYS = 1 << 11, 1 << 9, 8
#: Items whose tables are one array, and pairs compared at once.
_GROUP, _PAIRS = 256, 1 << 14
#: How much likelier a word is in texts of its language than in all, and what a window costs against a word found; only guesses
#: for speed, no result depends on them.
TOGETHER, WINDOW_COST = 8, 60


@dataclass
class Basis:
    vectors: np.ndarray  # BUCKETS + 1 x RANK, weighted and scaled; the last row is for no word
    rate: np.ndarray  # about how many of a text's words are in each bucket


def _buckets(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(49)).astype(np.int64)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents that hold each bucket, all documents and all words: one fixed-size row of counts a task."""

    def count(batches):
        df, n, total = np.zeros(BUCKETS, np.int64), 0, 0
        for b in (x for whole in batches for x in small_batches(whole, 0)):
            words, rows = word_hashes(b.column(0), lower=True)
            row = np.repeat(np.arange(len(rows) - 1, dtype=np.int32), np.diff(rows))
            own = _buckets(words).astype(np.uint16)
            by = np.argsort(own, kind="stable")
            own, row = own[by], row[by]
            first = np.ones(len(own), bool)
            first[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
            df += np.bincount(own[first], minlength=BUCKETS)
            n, total = n + b.num_rows, total + len(words)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [BUCKETS, BUCKETS + 1]])), pa.array(np.concatenate([df[at], [n, total]]))], names=["bucket", "n"])

    found = dict(docs.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect())
    df = np.array([found.get(i, 0) for i in range(BUCKETS)])
    return df, found.get(BUCKETS, 0), found.get(BUCKETS + 1, 0)


def dealt_passages(docs: DataFrame) -> DataFrame:
    """hash, words (buckets as 16-bit numbers, BUCKETS where a passage has no more words) of the passages of docs (text), equal
    ones side by side for `_once`.

    Copies would else lend the basis directions of their own. A task drops its repeats before the shuffle, so a passage that is
    everywhere arrives about once from each task.
    """
    size = BLOCK * SPAN

    def passed(batches):
        cache = np.zeros(1 << 20, np.uint64)  # hashes met last: a repeat that slips through goes after the shuffle
        for b in (x for whole in batches for x in small_batches(whole, 0)):
            words, rows = word_hashes(b.column(0), lower=True)
            if not len(words):
                continue
            starts, counts = _block_starts(rows, size)
            at = starts[:, None] + np.arange(size)
            own = np.where(at < np.repeat(rows[1:], counts)[:, None], _buckets(words)[np.minimum(at, len(words) - 1)], BUCKETS).astype(np.uint16)
            h = mix((own.astype(np.uint64) * _COEFF[:size]).sum(axis=1, dtype=np.uint64))
            new, first = np.unique(h, return_index=True)
            place = (new & np.uint64(len(cache) - 1)).astype(np.int64)
            first = first[cache[place] != new]
            cache[place] = new
            if len(first):
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array([x.tobytes() for x in own[first]], pa.binary())], names=["hash", "words"])

    found = docs.select("text").mapInArrow(passed, "hash long, words binary")
    return found.repartition("hash").sortWithinPartitions("hash")


def _once(batches):
    """Words of sorted rows (hash, words), each hash once."""
    last = None
    for b in batches:
        h = b.column(0).to_numpy()
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        if len(h):
            new[0] = h[0] != last
            last = h[-1]
        yield b.filter(pa.array(new)).column(1)


def fit_basis(docs: DataFrame, seed: int = 7) -> Basis:
    """Right singular vectors of the weighted matrix A of distinct passages, from one pass: G = A'A O for random O, then Nystrom's formula.

    A task adds up one array of fixed size for all of its passages; the tasks' arrays are added in two levels, in parts.
    """
    df, n, total = document_frequency(docs.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 0.1
    rate = -np.log1p(-df / (n + 1)) * n / max(1, total)
    rng = np.random.default_rng(seed)
    probe = rng.standard_normal((BUCKETS, RANK + EXTRA)).astype(np.float32)
    given = docs.sparkSession.sparkContext.broadcast(_padded(probe * idf[:, None]))

    def sketch(batches):
        turn_to("leaks")
        out = np.zeros((BUCKETS + 1, RANK + EXTRA), np.float32)
        for b in _once(batches):
            for at in range(0, len(b), 1 << 13):
                own = np.frombuffer(b"".join(b.slice(at, 1 << 13).to_pylist()), np.uint16).reshape(-1, BLOCK * SPAN).astype(np.int64)
                y = np.zeros((len(own), RANK + EXTRA), np.float32)
                for first in range(0, len(own), _PASSAGES):
                    for k in range(BLOCK * SPAN):
                        y[first : first + _PASSAGES] += given.value.take(own[first : first + _PASSAGES, k], axis=0)
                flat = own.ravel()
                _add_by_bucket(out, flat, np.repeat(np.arange(len(own)), BLOCK * SPAN), y)
        if out.any():
            way = TaskContext.get().partitionId() % _WAYS
            for part in range(0, BUCKETS, _PART):
                yield pa.RecordBatch.from_pydict({"part": [part], "way": [way], "g": [out[part : part + _PART].tobytes()]})

    def total(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for part, way, g in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = sums.setdefault(part, [way, 0])
                own[1] = own[1] + np.frombuffer(g, np.float32).astype(np.float64)
        for part, (way, g) in sums.items():
            yield pa.RecordBatch.from_pydict({"part": [part], "way": [way], "g": [g.astype(np.float32).tobytes()]})

    row = "part long, way long, g binary"
    spark = docs.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)  # a sketch has one size, however few passages a task has
    parts = dealt_passages(docs).coalesce(tasks).mapInArrow(sketch, row).repartition("part", "way").mapInArrow(total, row).repartition("part").mapInArrow(total, row)
    g = np.zeros((BUCKETS, RANK + EXTRA))
    for part, _, body in parts.collect():
        g[part : part + _PART] = np.frombuffer(bytes(body), np.float32)[: (BUCKETS - part) * (RANK + EXTRA)].reshape(-1, RANK + EXTRA)
    g *= idf[:, None]
    q, _ = np.linalg.qr(g)
    core = sum(probe[at : at + _PART].T.astype(np.float64) @ g[at : at + _PART] for at in range(0, BUCKETS, _PART))
    inner = (q.T @ g) @ np.linalg.pinv((core + core.T) / 2, rcond=1e-9) @ (q.T @ g).T
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    real = int((values > values[0] * ROUNDING + 1e-12).sum())  # few passages span few directions, the rest is rounding
    leading = int((values[: EXTRA // 2] > LEADING**2 * np.median(values[: max(1, real)])).sum())
    kept = slice(leading, min(max(real, leading + 1), leading + RANK))
    scale = 1 / np.sqrt(np.maximum(values[kept], 1e-12))  # all directions weigh alike
    vectors = np.zeros((BUCKETS, RANK))
    vectors[:, : kept.stop - kept.start] = (q @ turn[:, kept]) * scale * idf[:, None]
    basis = Basis(_padded(vectors), rate)
    del g, q, vectors, probe, given
    release(spark)
    return basis


def _add_by_bucket(out: np.ndarray, buckets: np.ndarray, passage: np.ndarray, y: np.ndarray) -> None:
    """Add to each bucket the rows of y of all passages that hold it, as often as they do."""
    by = np.argsort(buckets.astype(np.uint16), kind="stable")
    passage = passage[by]
    used, first, n = np.unique(buckets[by], return_index=True, return_counts=True)
    often = n > 64
    for bucket, at, to in zip(used[often].tolist(), first[often].tolist(), (first + n)[often].tolist(), strict=True):
        for i in range(at, to, 1 << 13):
            out[bucket] += y.take(passage[i : min(to, i + (1 << 13))], axis=0).sum(axis=0)
    used, first, n = (x[~often][np.argsort(-n[~often], kind="stable")] for x in (used, first, n))
    for k in range(int(n.max(initial=0))):  # the k-th place of all buckets that have so many
        some = int(np.searchsorted(-n, -k))
        out[used[:some]] += y.take(passage[first[:some] + k], axis=0)


def _padded(x: np.ndarray) -> np.ndarray:
    """Single precision, and a last row of zeros for places where no word is."""
    return np.concatenate([x, np.zeros((1, x.shape[1]))]).astype(np.float32)


def _block_starts(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of `size` words inside each row, and how many each row has."""
    counts = -(-np.diff(rows) // size)
    first = np.cumsum(counts) - counts
    return np.repeat(rows[:-1] - first * size, counts) + np.arange(int(counts.sum())) * size, counts


def _sums(buckets: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, vectors: np.ndarray) -> np.ndarray:
    """Sums of the vectors of `size` words from each start, up to its end."""
    out = np.zeros((len(starts), vectors.shape[1]), np.float32)
    for at in range(0, len(starts), _PASSAGES):
        s, e = starts[at : at + _PASSAGES], ends[at : at + _PASSAGES]
        for k in range(size):
            out[at : at + _PASSAGES] += vectors.take(np.where(s + k < e, buckets[np.minimum(s + k, len(buckets) - 1)], BUCKETS), axis=0)
    return out


def passages(words: np.ndarray, rows: np.ndarray, basis: Basis) -> tuple[np.ndarray, np.ndarray]:
    """First word and unit vector of every passage; a row shorter than a passage is one."""
    starts, counts = _block_starts(rows, BLOCK)
    sums = _sums(_buckets(words), starts, np.repeat(rows[1:], counts), BLOCK, basis.vectors)
    end = np.repeat(np.cumsum(counts), counts)
    place = np.arange(len(starts))
    keep = (place == np.repeat(np.cumsum(counts) - counts, counts)) | (place + SPAN <= end)
    total = sums[keep]
    for k in range(1, SPAN):
        total += np.where((place + k < end)[keep, None], sums[np.minimum(place[keep] + k, len(sums) - 1)], 0)
    return starts[keep], total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)


def lcs(item: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel in the item's words."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in region:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def answer_length(text: str) -> int:
    """Words of the item's last sentence or line."""
    body = text.strip().rstrip(".!?")
    cut = max(body.rfind(x) for x in (". ", "! ", "? ", "\n", ".\n"))
    return len(body[cut + 1 :].split())


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", gate: float = COSINE) -> DataFrame:
    """doc_id, item_id, cosine (best), common (words of the longest common subsequence), item_words, answered.

    An item is leaked if WHOLE of its words are found in order near a passage whose cosine with one of the item's pieces is at
    least `gate`, or PART of them with its answer. With a gate of -1 every passage is verified: what no basis can miss, to measure
    recall by. Whole texts are searched, every document against every item, items in blocks of ITEMS_AT_ONCE. Null, empty and
    blank texts and items match nothing, and an empty table of documents or items gives no rows; of passages that tie for an
    item's best the first is reported; repeated rows give repeated results, null ids a null. Very long texts go through in slices
    of rows, a text's passages in blocks. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("item_text")).where("item is not null and item_text is not null").distinct()
    basis = fit_basis(docs)
    blocks = max(1, -(-items.count() // ITEMS_AT_ONCE))
    found = [_search(docs, gate, sorted(items.where(F.pmod(F.xxhash64(F.lit(11), "item"), F.lit(blocks)) == i).collect()), basis) for i in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _bits(known: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted words of some items, and a table word x item of the places where an item of at most 64 words has the word.

    The last row stands for all other words. Longer items only tell, by a 1, that they have the word.
    """
    own = [np.array(words, np.uint64) for _, words, _ in known]
    vocabulary, at = np.unique(np.concatenate(own), return_inverse=True)
    column = np.repeat(np.arange(len(own)), [len(x) for x in own])
    place = np.concatenate([np.arange(len(x)) if len(x) <= 64 else np.zeros(len(x), np.int64) for x in own]).astype(np.uint64)
    table = np.zeros((len(vocabulary) + 1, len(own)), np.uint64)
    np.bitwise_or.at(table, (at, column), np.uint64(1) << place)
    return vocabulary, table


def _needed(known: list, rate: np.ndarray) -> list[tuple[int, list[int]]]:
    """For each item a number of words and a set of its words, so that no text without so many words of the set holds a leak.

    A leak has at least `least` of the item's words in order. Of any length - least + k of these, k at least are among them; the
    rarest are taken, with the k that other texts of that length are least likely to reach.
    """
    out = []
    for _, own, last in known:
        n, last = len(own), min(last, len(own))
        least = int(max(1, min(np.ceil(WHOLE * n), max(np.ceil(PART * n), np.ceil(ANSWER * last - 1e-9)))))
        each = rate[_buckets(np.array(own, np.uint64))]
        order = np.argsort(each, kind="stable")
        new = np.zeros(n)
        new[np.unique(np.array(own, np.uint64)[order], return_index=True)[1]] = 1
        k = np.arange(1, least + 1)
        found = np.maximum(1e-12, np.cumsum(new * each[order])[n - least + k - 1])
        mean = found * TOGETHER * (2 * n + 2 * BLOCK * SPAN)
        best = int(np.argmin(found * (1 + WINDOW_COST * np.exp(np.where(k > mean, k - mean - k * np.log(k / mean), 0)))))
        out.append((int(k[best]), [own[i] for i in order[: n - least + int(k[best])]]))
    return out


class _Items:
    """Tables of a group of items, made once in a task."""

    def __init__(self, known: list, queries: np.ndarray, owner: np.ndarray, rate: np.ndarray):
        self.known, self.queries, self.pieces = known, queries, np.searchsorted(owner, np.arange(len(known) + 1))
        self.owner = owner
        self.vocabulary, self.table = _bits(known)
        self.length = np.array([len(own) for _, own, _ in known])
        self.last = np.array([min(x, len(own)) for _, own, x in known])
        self.reach = self.length + BLOCK * SPAN // 2
        needed = _needed(known, rate)
        self.enough = np.array([n for n, _ in needed])
        pairs = [(np.searchsorted(self.vocabulary, np.unique(np.array(own, np.uint64))), i) for i, (_, own) in enumerate(needed)]
        word, item = np.concatenate([x for x, _ in pairs]), np.repeat([i for _, i in pairs], [len(x) for x, _ in pairs])
        by = np.argsort(word, kind="stable")
        self.item, self.post = item[by].astype(np.uint16), np.searchsorted(word[by], np.arange(len(self.vocabulary) + 2))
        self.some = np.diff(self.post) > 0

    def ids(self, words: np.ndarray) -> np.ndarray:
        """Places of words in the vocabulary; its length for other words."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, len(self.vocabulary))


def _hits(ids: np.ndarray, g: _Items) -> np.ndarray:
    """Places of words of the items' sets, item after item: item * words + place, ascending."""
    at = np.flatnonzero(g.some[ids])
    n = (g.post[ids[at] + 1] - g.post[ids[at]]).astype(np.int64)
    first = np.cumsum(n) - n
    item = g.item[np.repeat(g.post[ids[at]] - first, n) + np.arange(int(n.sum()))]
    by = np.argsort(item, kind="stable")
    return item[by].astype(np.int64) * (len(ids) + 1) + np.repeat(at, n)[by]


def _common(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, table: np.ndarray, skip: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Longest common subsequences of words lo to hi and an item's words from `skip` on, bit-parallel for all pairs at once."""
    one = np.uint64(1)
    full = np.where(length >= 64, ~np.uint64(0), (one << np.minimum(length, 63).astype(np.uint64)) - one)
    shift = np.minimum(skip, 63).astype(np.uint64)
    v = full.copy()
    for t in range(int((hi - lo).max(initial=0))):
        at = lo + t
        word = np.where(at < hi, ids[np.minimum(at, len(ids) - 1)], len(table) - 1)
        u = v & (table[word, item] >> shift)
        v = ((v + u) | (v - u)) & full
    return length - np.bitwise_count(v).astype(np.int64)


def _search(docs: DataFrame, gate: float, items: list, basis: Basis) -> DataFrame:
    texts = [r.item_text for r in items]
    words, rows = word_hashes(pa.array(texts, pa.string()), lower=True)
    starts, vectors = passages(words, rows, basis)
    owner = np.searchsorted(rows, starts, "right") - 1
    order = [i for i in np.argsort(np.diff(rows), kind="stable").tolist() if rows[i + 1] > rows[i]]
    known = [(items[i].item, words[rows[i] : rows[i + 1]].tolist(), answer_length(texts[i])) for i in order]
    vectors = np.concatenate([vectors[:0], *(vectors[slice(*np.searchsorted(owner, [i, i + 1]))] for i in order)])
    owner = np.repeat(np.arange(len(order)), np.bincount(owner, minlength=len(texts))[order])
    given = docs.sparkSession.sparkContext.broadcast((basis, vectors, owner, known))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("common", pa.int64()), ("item_words", pa.int64()), ("answered", pa.bool_())])

    def search(batches):
        turn_to("leaks")
        basis, queries, owner, known = given.value
        groups = []
        for first in range(0, len(known), _GROUP):
            own = slice(*np.searchsorted(owner, [first, first + _GROUP]))
            groups.append(_Items(known[first : first + _GROUP], queries[own], owner[own] - first, basis.rate))
        for b in (x for whole in batches for x in small_batches(whole, 1)):
            words, rows = word_hashes(b.column(1), lower=True)
            if not len(words) or not groups:
                continue
            made = _leaks(words, rows, basis, groups, gate)
            if made:
                made = [(b.column(0)[i].as_py(), *leak) for i, *leak in sorted(made, key=lambda x: x[0])]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(search, "doc_id long, item_id long, cosine double, common long, item_words long, answered boolean")


def _leaks(words: np.ndarray, rows: np.ndarray, basis: Basis, groups: list[_Items], gate: float) -> list[tuple]:
    """Row, item, cosine, common words, item's words and whether it is answered, of the best passage of each row and leaked item."""
    starts, vectors = passages(words, rows, basis)
    row = np.searchsorted(rows, starts, "right") - 1
    out = []
    for g in groups:
        ids = g.ids(words)
        hits, span = _hits(ids, g), len(ids) + 1
        for first in range(0, len(starts), _PASSAGES):
            cosine = vectors[first : first + _PASSAGES] @ g.queries.T
            at, piece = np.nonzero(cosine >= gate)
            at, item = np.divmod(np.unique(at * len(g.known) + g.owner[piece]), len(g.known))
            at += first
            lo, hi = np.maximum(rows[row[at]], starts[at] - g.reach[item]), np.minimum(rows[row[at] + 1], starts[at] + BLOCK * SPAN + g.reach[item])
            enough = np.searchsorted(hits, item * span + hi) - np.searchsorted(hits, item * span + lo) >= g.enough[item]  # else too few of the item's words are there
            out += _verified(words, ids, rows, g, at[enough], item[enough], starts, vectors)
    best: dict[tuple[int, int], tuple] = {}
    for row, item, *leak in sorted(out, key=lambda x: (x[0], x[1], -x[2], x[-1])):
        best.setdefault((row, item), leak[:-1])
    return [(row, item, *leak) for (row, item), leak in best.items()]


def _verified(words: np.ndarray, ids: np.ndarray, rows: np.ndarray, g: _Items, at: np.ndarray, item: np.ndarray, starts: np.ndarray, vectors: np.ndarray) -> list[tuple]:
    """Leaks among passages and items: row, item, cosine, common words, item's words, whether it is answered, place."""
    start = starts[at]
    row = np.searchsorted(rows, start, "right") - 1
    reach, length, last = g.reach, g.length, g.last
    lo, hi = np.maximum(rows[row], start - reach[item]), np.minimum(rows[row + 1], start + BLOCK * SPAN + reach[item])
    common, tail = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
    short = np.flatnonzero(length[item] <= 64)
    for first in range(0, len(short), _PAIRS):
        i = short[first : first + _PAIRS]
        common[i] = _common(ids, lo[i], hi[i], item[i], g.table, np.zeros(len(i), np.int64), length[item[i]])
        i = i[common[i] >= PART * length[item[i]]]
        tail[i] = _common(ids, lo[i], hi[i], item[i], g.table, length[item[i]] - last[item[i]], last[item[i]])
    for i in np.flatnonzero(length[item] > 64).tolist():
        own, region = g.known[item[i]][1], words[lo[i] : hi[i]].tolist()
        common[i], tail[i] = lcs(own, region), lcs(own[len(own) - last[item[i]] :], region)
    answered = tail >= ANSWER * last[item]
    good = np.flatnonzero((common >= WHOLE * length[item]) | (common >= PART * length[item]) & answered)
    out = []
    for first in range(0, len(good), _PASSAGES):
        i = good[first : first + _PASSAGES]
        cos = np.maximum.reduceat(vectors[at[i]] @ g.queries.T, g.pieces[:-1], axis=1)[np.arange(len(i)), item[i]]  # of an item's pieces the closest one
        out += zip(row[i].tolist(), [g.known[j][0] for j in item[i].tolist()], cos.astype(float).tolist(), common[i].tolist(), length[item[i]].tolist(), answered[i].tolist(), start[i].tolist(), strict=True)
    return out
