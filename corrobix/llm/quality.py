"""Quality classifier by co-training.

Two logistic models see different views: the text's characters, words and repetition, and the page's metadata (source, language,
recorded length). In each round a model labels the pool documents it is sure of for the other one. Both are calibrated on labelled
documents that no round has seen, and their log odds are added to score every document.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, small_batches, turn_to, utf8, word_hashes

#: Bounds of the labelled and the unlabelled sample that the models are fitted on. All documents are scored.
LABELLED, POOL = 6000, 4000
ROUNDS, SURE, PER_ROUND = 4, 0.97, 400
REJECT_BELOW = 0.5

# Character classes; what is not listed is in class 18.
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "", " ", "\n\r\t\x0b\x0c", ".", ",;:", "!", "?", "#", "$", "%", "&", "*", "|", "\"'()[]{}", "-_")
_N = 19
_TABLE = np.full(256, 18, np.int64)
for _i, _chars in enumerate(_CLASSES):
    _TABLE[[ord(c) for c in _chars]] = _i
_TABLE[128:] = 3
_STATS = 8
TEXT_WIDTH = _N * _N + _STATS
_SOURCES, _LANGS, _LENGTHS = 64, 16, 24
META_WIDTH = _SOURCES + _LANGS + _LENGTHS


def text_features(column) -> np.ndarray:
    """Square roots of character-class bigram shares, then measures of length, variety and repetition."""
    raw, off = utf8(column)
    n = len(off) - 1
    out = np.zeros((n, TEXT_WIDTH))
    kind = _TABLE[raw]
    row = np.repeat(np.arange(n), np.diff(off))
    if len(raw) > 1:
        same = row[1:] == row[:-1]
        pair = (row[:-1] * _N * _N + kind[:-1] * _N + kind[1:])[same]
        counts = np.bincount(pair, minlength=n * _N * _N).reshape(n, -1)
        out[:, : _N * _N] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    words, first = word_hashes(column)
    lines = np.add.accumulate(raw == 10)
    for i in range(n):
        own = words[first[i] : first[i + 1]]
        if not len(own):
            continue
        _, times = np.unique(own, return_counts=True)
        two = len(np.unique(own[1:] + own[:-1] * np.uint64(3))) / max(1, len(own) - 1)
        n_lines = int(lines[off[i + 1] - 1] - (lines[off[i]] - (raw[off[i]] == 10))) + 1
        width = (off[i + 1] - off[i]) / len(own)
        out[i, _N * _N :] = (np.log1p(len(own)) / 10, len(times) / len(own), times.max() / len(own), (own[1:] == own[:-1]).mean() if len(own) > 1 else 0, two, min(width, 50) / 50, np.log1p(n_lines) / 10, 1)
    return out


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Hashed source and language, and the order of magnitude of the recorded length."""
    out = np.zeros((len(source), META_WIDTH))
    for i, (s, g, c) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, zlib.crc32(repr(s).encode()) % _SOURCES] = 1
        out[i, _SOURCES + zlib.crc32(repr(g).encode()) % _LANGS] = 1
        out[i, _SOURCES + _LANGS + (0 if c is None or c < 1 else min(_LENGTHS - 1, 1 + int(c).bit_length()))] = 1
    return out


@dataclass
class View:
    """A logistic model on standardised features, with a calibration of its log odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return self.slope * np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30) + self.shift


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _newton(z: np.ndarray, y: np.ndarray, penalty: np.ndarray, rounds: int = 12) -> np.ndarray:
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_view(x: np.ndarray, y: np.ndarray, penalty: float = 3.0) -> View:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    return View(mean, scale, _newton((x - mean) / scale, y, np.array([penalty] * x.shape[1] + [1e-6])))


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling on documents that the view was not fitted on; a view that tells nothing gets a slope near 0."""
    if len(y) and 0 < y.sum() < len(y):
        slope, shift = _newton(view.odds(x)[:, None], y, np.array([0.5, 1e-6]))
        view.slope, view.shift = max(0.0, float(slope)), float(shift)


@dataclass
class Quality:
    views: tuple[View, View] | None
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.views is None:
            one = np.full(len(text), _sigmoid(np.array(self.prior)))
            return one, one, one
        a, b = (v.odds(x) for v, x in zip(self.views, (text, meta), strict=True))
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - self.prior)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray) -> Quality:
    """Co-training over ROUNDS; a fifth of the labelled rows is kept for calibration."""
    if not len(y) or not 0 < y.sum() < len(y):
        return Quality(None, 20.0 if not len(y) or y.all() else -20.0)
    apart = np.arange(len(y)) % 5 == 0
    if not 0 < y[~apart].sum() < (~apart).sum():
        apart[:] = False
    data, pools = (text, meta), (pool_text, pool_meta)
    extra: list[dict[int, float]] = [{}, {}]
    views: list[View] = []
    for r in range(ROUNDS + 1):
        views = []
        for v in (0, 1):
            ids = sorted(extra[v])
            views.append(fit_view(np.vstack([data[v][~apart], pools[v][ids]]), np.concatenate([y[~apart], [extra[v][i] for i in ids]])))
        if r == ROUNDS or not len(pool_text):
            break
        for v in (0, 1):
            p = _sigmoid(views[v].odds(pools[v]))
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                share = y.mean() if label else 1 - y.mean()
                best = np.argsort(-sure, kind="stable")[: max(1, int(PER_ROUND * share))]
                extra[1 - v].update({int(i): label for i in best if sure[i] >= SURE and int(i) not in extra[1 - v]})
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    held = apart if apart.any() else ~apart
    for view, x in zip(views, data, strict=True):
        calibrate(view, x[held], y[held])
    return Quality((views[0], views[1]), float(np.log(base / (1 - base))))


def train_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> Quality:
    """Fit on at most LABELLED labelled and POOL other documents, chosen by a hash of their ids.

    Null ids, labels without a document and null labels are not used; of labels that repeat an id the largest counts, of
    documents that repeat one the row with the smallest hash. Null texts and columns are values of their own. Without
    documents, labels or one kind of label the model gives every document the same score. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    docs = _columns(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64(F.lit(17), "doc_id"), F.col("doc_id")]
    known = known.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi").orderBy(*order).limit(LABELLED)
    other = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(*order).limit(POOL + LABELLED)
    chosen = known.join(other, "doc_id", "full").orderBy(F.col("y").isNull(), *order).limit(LABELLED + POOL)

    def features(batches):
        for b in (x for whole in batches for x in small_batches(whole, 2)):
            text = text_features(b.column(2)).astype(np.float32)
            meta = meta_features(*(b.column(i).to_pylist() for i in (3, 4, 5))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (text, meta))], names=["doc_id", "y", "text_x", "meta_x"])

    body = F.struct("text", "source", "lang", "n_chars")
    single = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct(F.xxhash64(body).alias("h"), body.alias("d"))).alias("x"))  # one row for each id
    rows = single.select("doc_id", F.col("y").cast("long"), "x.d.text", "x.d.source", "x.d.lang", "x.d.n_chars").mapInArrow(features, "doc_id long, y long, text_x binary, meta_x binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))

    def matrix(own, width, name):
        return np.stack([np.frombuffer(bytes(r[name]), np.float32) for r in own]).astype(np.float64) if own else np.zeros((0, width))

    told, pool = [r for r in rows if r.y is not None], [r for r in rows if r.y is None]
    y = np.array([float(r.y > 0) for r in told])
    model = co_train(matrix(told, TEXT_WIDTH, "text_x"), matrix(told, META_WIDTH, "meta_x"), y, matrix(pool, TEXT_WIDTH, "text_x"), matrix(pool, META_WIDTH, "meta_x"))
    del rows, told, pool
    give_back()
    return model


def _columns(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return docs.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))


def score_quality(docs: DataFrame, model: Quality) -> DataFrame:
    """doc_id, text_score, meta_score, score and kept (score at least REJECT_BELOW) for every row.

    Nulls in any column are values of their own; a null text has no content features. Repeated rows score alike. Without
    labels of both kinds every document gets the one label known, or is kept if there is none. Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    given = spark.sparkContext.broadcast(model)

    def scored(batches):
        turn_to("quality")
        for b in (x for whole in batches for x in small_batches(whole, 1)):
            scores = given.value.score(text_features(b.column(1)), meta_features(*(b.column(i).to_pylist() for i in (2, 3, 4))))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s) for s in scores), pa.array(scores[2] >= REJECT_BELOW)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return _columns(docs).select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(scored, "doc_id long, text_score double, meta_score double, score double, kept boolean")
