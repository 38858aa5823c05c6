"""Line dedup, source divergence and clustering against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corrobix.llm import line_dedup
from corrobix.llm.centroid_clusters import cluster_vectors, nearest, scaled
from corrobix.llm.line_dedup import drop_repeated_lines, line_spans
from corrobix.llm.source_divergence import audit_sources

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def dropped_lines(rows, least_chars=20, least_docs=3):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    holders = defaultdict(set)
    for i, lines in split:
        for line in lines:
            if i is not None and len(k := line.strip(SPACE).translate(LOWER)) >= least_chars:
                holders[k].add(i)
    out = []
    for i, lines in split:
        gone = [i is not None and len(h := holders.get(x.strip(SPACE).translate(LOWER), ())) >= least_docs and max(h) != i for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((i, len(lines), sum(gone), sha(kept), kept))
    return sorted(out, key=repr)


def line_table():
    rng = random.Random(5)
    pool = ["Licensed under the terms of nothing", "  licensed UNDER the terms of nothing\t", "exactly twenty chars", "nineteen characters", "ÄÖÜ äöü ÄÖÜ äöü ßß 2", "A common header of many pages", "x" * 5000, "  a line with a hard space  ", "İstanbul is a line with a dotted i", "", "   "]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"a line of its own, number {rng.randrange(10**6)}" for _ in range(rng.randrange(1, 9)))) for i in range(1, 120)]
    hot = [(i, f"the very same line for all of them\nline {i} of a group of copies") for i in range(200, 260)]
    twice = [(300, "only two documents hold this line\n" * 3), (301, "only two documents hold this line")]
    odd = [(400, None), (401, ""), (402, "\n"), (403, "\n\n a trailing line feed of some length\n"), (None, "the very same line for all of them"), (None, None)]
    again = [(7, rows[6][1]), (7, rows[6][1]), (410, "one id in three rows has this line"), (410, "one id in three rows has this line"), (410, "one id in three rows has this line")]
    return rows + hot + twice + odd + again


@pytest.mark.parametrize("bits", [64, 5])
@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_line_dedup(spark, monkeypatch, bits, broadcast):
    """Also with hashes so short that most stand for several lines, and with ids that are too many to broadcast."""
    monkeypatch.setattr(line_dedup, "BROADCAST_IDS", broadcast)
    rows = line_table()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_lines int, hash string").repartition(5)
    got = drop_repeated_lines(docs, keep_text=True, hash_bits=bits).collect()
    assert sorted((tuple(r) for r in got), key=repr) == dropped_lines(rows)


def test_line_dedup_other_limits_and_empty_table(spark):
    rows = line_table()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = drop_repeated_lines(docs, least_chars=5, least_docs=4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == [r[:4] for r in dropped_lines(rows, 5, 4)]
    assert drop_repeated_lines(docs.limit(0)).collect() == []


def test_few_lines_are_suspected(spark):
    """The filters let through what two rows share and hardly anything else."""
    docs = spark.createDataFrame([(i, f"line number {i} is in one text alone\nand line {i % 2000 + 10**6} is in two of the texts") for i in range(4000)], "doc_id long, text string").repartition(6)
    bits, _ = line_dedup.suspected(docs)
    texts = [f"line number {i} is in one text alone" for i in range(4000)], [f"and line {i + 10**6} is in two of the texts" for i in range(2000)]
    import pyarrow as pa

    alone, shared = (line_dedup._held(line_dedup._Lines(pa.array(x), 20, 64).hash, bits) for x in texts)
    assert shared.all() and alone.mean() < 0.01


def test_line_spans():
    texts = ["", "\n", "a", " b \n\n c", "\n\n", "d\n"]
    raw, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    starts, ends, key, stop, n = line_spans(raw, off)
    whole = "".join(texts)
    lines = [whole[a:b] for a, b in zip(starts, ends, strict=True)]
    assert lines == [x for t in texts for x in t.split("\n")] and n.tolist() == [len(t.split("\n")) for t in texts]
    assert [whole[a:b] for a, b in zip(key, stop, strict=True)] == [x.strip() for x in lines]


def divergence(rows, least=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [(lang, source, [w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]) for lang, source, text in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, own in words:
        df[lang].update(set(own))
        n[lang, source].update(own)
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted(w for w, c in df[lang].items() if c >= least)
        sources = sorted({r[1] for r in rows if r[0] == lang}, key=str.encode)

        def share(counts, kept=kept):
            total = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 2) // (total + 2 * len(kept)) for w in kept}

        p = {s: share(n[lang, s]) for s in sources}
        q = share(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(t, sum((p[s][w] - p[t][w]) ** 2 // (p[s][w] + p[t][w]) for w in kept)) for t in sources if t != s]
            own = [(w, (p[s][w] - q[w]) ** 2 // (p[s][w] + q[w])) for w in kept if n[lang, s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", own, top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found)]
    return sorted(out)


def test_source_divergence(spark):
    rng = random.Random(3)
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"] + ["Über", "ÜBER", "naïve", "日本", "don't", "x1y", "Z"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "B", "b", "ä", None]), " ".join(rng.choices(words, k=rng.randrange(30)))) for _ in range(400)]
    rows += [("fr", "only", "deux mots"), ("fr", "other", None), ("it", "one", ""), ("en", "wordless", "12 34"), ("en", "a", "wa " * 20000), ("en", "a", "wa " * 20000), (None, None, None)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, source string, text string, n int, term string, value int").repartition(5)
    assert sorted(tuple(r) for r in audit_sources(docs).collect()) == divergence(rows)
    assert sorted(tuple(r) for r in audit_sources(docs, least_docs=3, top=4).collect()) == divergence(rows, 3, 4)
    assert audit_sources(docs.limit(0)).collect() == []


def test_source_divergence_large_counts():
    """The two steps of the share's SQL are the floor of the exact quotient."""
    import duckdb

    from corrobix.llm.source_divergence import _share

    rng = random.Random(1)
    for _ in range(200):
        total, kept = rng.randrange(2 * 10**14), rng.randrange(1, 10**9)
        n = rng.randrange(total + 1)
        sql = _share(f"{n}::BIGINT", f"{total}::BIGINT", f"{kept}::BIGINT").replace(" div ", " // ")
        assert duckdb.sql(f"select {sql}").fetchall()[0][0] == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def clusters(rows, k=8, rounds=10, size=64, scale=1024, seed=3):
    from fractions import Fraction

    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((sha(f"{seed}:{i}"), ",".join(map(str, v)), v) for i, v in kept if i is not None)[:k]
    centroids = [v for *_, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            if mine := [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == j]:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = assign()
    total = Counter()
    for d, j in own:
        total[j] += d

    def fits(v):
        return v if v < 2**63 else None

    return sorted(((i, j, fits(d), fits(total[j]), fits(sum(total.values())), sha(",".join(map(str, centroids[j])))) for (i, _), (d, j) in zip(kept, own, strict=True)), key=repr)


def vector_rows(seed, n=150, top=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, 64)) * top
    rows = [(i, (middle[i % 5] + rng.normal(size=64) * 0.3 * top).tolist()) for i in range(n)]
    rows += [(3, rows[3][1]), (3, rows[8][1]), (None, rows[5][1]), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [math.nan] * 64), (906, [math.inf] + [0.0] * 63), (907, [0.0] * 64), (908, [-0.0005] * 64)]
    return rows


@pytest.mark.parametrize("huge", [0, 3e4, 1e12, 1e300])
def test_clusters(spark, huge):
    """Also with components beyond what double precision and 64 bits hold."""
    rows = vector_rows(1)
    if huge:
        rows += [(1000 + i, [huge * (i + 1)] + [-huge] * 63) for i in range(3)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, ids string").repartition(4)
    assert sorted((tuple(r) for r in cluster_vectors(table, rounds=3).collect()), key=repr) == clusters(rows, rounds=3)


def test_few_and_no_vectors(spark):
    rows = vector_rows(2)[:4]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in cluster_vectors(table).collect()), key=repr) == clusters(rows)
    assert cluster_vectors(table.where("vec_id < 0")).collect() == []
    assert cluster_vectors(table.where("vec_id < 0").unionByName(spark.createDataFrame([(None, [1.0] * 64)], table.schema))).collect() == []


def test_exact_arithmetic():
    """Scaling and distances agree with Python's integers on both sides of every bound."""
    rng = np.random.default_rng(4)
    for top in (1e-320, 1e-3, 1.0, 2.0**12, 2.0**20, 2.0**42, 2.0**52, 2.0**60, 1e300):
        x = rng.normal(size=(6, 8)) * top
        from fractions import Fraction

        y = scaled(x, 1024)
        want = [[math.floor(Fraction(v) * 1024) for v in row] for row in x.tolist()]
        assert [[int(v) for v in row] for row in y.tolist()] == want
        c = want[:2] + [[v + 1 for v in want[0]]]
        cluster, distance = nearest(y, c)
        exact = [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for v in want]
        assert [(int(d), int(j)) for d, j in zip(distance.tolist(), cluster.tolist(), strict=True)] == exact
