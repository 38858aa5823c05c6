"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector is the product of its letters' vectors, the first two
rotated by two and one places (so order counts); a text's vector is the sum over its trigrams. A language's prototype is the sum
over its texts. Predictions compare a text with the prototypes, both less the mean prototype, by cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, utf8

DIMENSION = 1024
UNKNOWN = "und"
_SEED = 20240607
_CODES = 0x110000
_SLICE = 1 << 19
_TABLE = 2048
#: Counts that are held as one dense table (16 MB).
_DENSE = 1 << 22
_letter_class: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """For each code point: itself if a letter, else 0, which stands for any run of other characters."""
    if not _letter_class:
        table = np.zeros(_CODES, np.uint32)
        table[[i for i in range(_CODES) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = 1
        _letter_class.append(table * np.arange(_CODES, dtype=np.uint32))
    return _letter_class[0]


def letter_vectors(codes: np.ndarray, dimension: int) -> np.ndarray:
    """Random signs of each code point: bits of a counter hash, the same on every machine."""
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(dimension // 64, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(_SEED)
        for a, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(a))) * np.uint64(m)
        x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def trigram_vectors(a: np.ndarray, b: np.ndarray, c: np.ndarray, dimension: int) -> np.ndarray:
    codes, at = np.unique(np.concatenate([a, b, c]), return_inverse=True)
    letters = letter_vectors(codes, dimension)
    n = len(a)
    return np.roll(letters, 2, axis=1)[at[:n]] * np.roll(letters, 1, axis=1)[at[n : 2 * n]] * letters[at[2 * n :]]


def _slices(column):
    """(first row, text) pieces of about _SLICE bytes: whole rows, of which very long ones are alone."""
    raw, off = utf8(column)
    raw, at, n = raw.tobytes(), 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + _SLICE, "right")) - 1)
        yield at, to, [raw[off[i] : off[i + 1]].decode("utf-8", "replace") for i in range(at, to)]
        at = to


@dataclass
class Trigrams:
    """Counts of distinct trigrams (code points a, b, c) by group of texts, as entries sorted by trigram, or dense where that is small."""

    n: int
    counts: np.ndarray | tuple[np.ndarray, np.ndarray, np.ndarray]
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray

    def part(self, at: int, to: int) -> np.ndarray:
        """Counts (groups x trigrams at to to)."""
        if isinstance(self.counts, np.ndarray):
            return self.counts[:, at:to]
        trigram, group, n = self.counts
        own = slice(*np.searchsorted(trigram, [at, to]))
        out = np.zeros((self.n, to - at), np.float32)
        out[group[own], trigram[own] - at] = n[own]
        return out


def trigram_counts(texts: list[str], group: np.ndarray | None = None) -> Trigrams:
    """Trigrams of lower-cased letters, with runs of others as one break, counted for each text or each group of texts."""
    lengths, parts = [], []
    table = _classes()
    for t in texts:
        x = table[np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        x = np.concatenate([[0], x, [0]]).astype(np.uint32)
        x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
        lengths.append(len(x))
        parts.append(x)
    flat = np.concatenate(parts)
    letters = np.unique(flat)
    small = np.searchsorted(letters, flat).astype(np.int64)
    code = (small[:-2] * len(letters) + small[1:-1]) * len(letters) + small[2:]
    row = np.repeat(np.arange(len(texts)), lengths)
    ok = (row[:-2] == row[2:]) & (flat[1:-1] != 0)
    code, row = code[ok], row[:-2][ok]
    if len(letters) ** 3 <= 1 << 22:
        used = np.flatnonzero(np.bincount(code, minlength=1))
        place = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.int64)
        place[used] = np.arange(len(used))
        at = place[code]
    else:
        used, at = np.unique(code, return_inverse=True)
    n = len(texts)
    if group is not None:
        row, n = group[row], int(group.max()) + 1
    if n * len(used) <= _DENSE:
        counts = np.bincount(row * max(1, len(used)) + at, minlength=n * max(1, len(used))).astype(np.float32).reshape(n, -1)
    else:
        entry, times = np.unique(at * n + row, return_counts=True)
        counts = entry // n, entry % n, times.astype(np.float32)
    return Trigrams(n, counts, letters[used // len(letters) ** 2], letters[used // len(letters) % len(letters)], letters[used % len(letters)])


def bundle(grams: Trigrams, dimension: int) -> np.ndarray:
    """Each group's sum of trigram vectors, with the tables of counts and vectors made piecewise so that memory stays bounded."""
    out = np.zeros((grams.n, dimension), np.float32)
    for at in range(0, len(grams.a), _TABLE):
        to = min(at + _TABLE, len(grams.a))
        out += grams.part(at, to) @ trigram_vectors(grams.a[at:to], grams.b[at:to], grams.c[at:to], dimension)
    return out


@dataclass
class Profiles:
    languages: list[str]
    mean: np.ndarray
    centred: np.ndarray
    dimension: int


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimension: int = DIMENSION) -> Profiles:
    """Prototypes from all rows with a text and a language. What reaches the driver is languages x dimension numbers.

    Null texts and languages are left out; texts without letters and empty ones add nothing; repeated rows count as often as
    they are there; long texts are read whole. Languages stand in order of name, so ties do not depend on the rows' order. An
    empty table gives no prototypes. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for at, to, texts in _slices(batch.column(0)):
                names, own = np.unique(langs[at:to].astype(str), return_inverse=True)
                for name, v in zip(names.tolist(), bundle(trigram_counts(texts, own), dimension), strict=True):
                    sums[name] = sums.get(name, 0) + np.rint(v).astype(np.int64)
        for name, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name], "profile": [v.tolist()]}, schema=schema)

    schema = pa.schema([("lang", pa.string()), ("profile", pa.list_(pa.int64()))])
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(partial, "lang string, profile array<long>").select("lang", F.posexplode("profile").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for lang, i, x in sums.collect():
        found.setdefault(lang, np.zeros(dimension))[i] = x
    names = sorted(found)
    unit = np.stack([found[x] / max(np.linalg.norm(found[x]), 1e-12) for x in names]) if names else np.zeros((0, dimension))
    mean = unit.mean(axis=0) if len(names) > 1 else np.zeros(dimension)
    centred = unit - mean
    return Profiles(names, mean, centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12), dimension)


def predict_language(docs: DataFrame, profiles: Profiles, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the columns of keep, lang_pred and score (cosine, 0 if negative) from the whole text alone.

    A text that is null or has no letter is `und` with score 0, as is every text when no language was learned. Ties go to the
    first language by name. Repeated rows and null ids give a row each; very long texts are read whole; an empty table gives no
    rows. Columns besides id, text and those of keep are not read, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = spark.sparkContext.broadcast(profiles)

    def predicted(batches):
        p = known.value
        for batch in batches:
            langs, scores = [], []
            for _, _, texts in _slices(batch.column(1)):
                letters = np.array([any(map(str.isalpha, t)) for t in texts])
                if not len(p.languages):
                    langs += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                v = bundle(trigram_counts(texts), p.dimension).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                v -= p.mean
                cos = v @ p.centred.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                best = cos.argmax(axis=1)
                langs += [p.languages[i] if ok else UNKNOWN for i, ok in zip(best, letters, strict=True)]
                scores += np.where(letters, np.clip(cos[np.arange(len(best)), best], 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(2 + i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", *keep, "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name in keep)
    return rows.mapInArrow(predicted, f"doc_id long, {kinds}lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
