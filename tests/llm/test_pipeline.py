"""Pipeline stages against brute force on a small table with nulls, repeated rows, blanks and columns of clashing names; registered SQL."""

import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corrobix.llm import bitpack_output, decontaminate, quality, source_mix
from corrobix.llm.catalog import oracle_sql, queries

from .test_corpus_operators import WORDS, components_of, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rank int, score double, kept boolean, size long, copies int, component_id long, item_id long"


def say(rng, n, pool=900):
    return " ".join(f"w{rng.integers(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(3)
    items = [say(rng, n) + ". " + say(rng, 6) for n in (12, 20, 30)]
    base = say(rng, 70).split()
    texts = [(i, say(rng, int(rng.integers(20, 120)))) for i in range(60)]
    texts += [(100 + i, " ".join(w if j % 23 != i else "other" for j, w in enumerate(base))) for i in range(6)]
    texts += [(200 + i, f"{say(rng, 30)} {item} {say(rng, 30)}") for i, item in enumerate(items)]
    texts += [(300 + i, "BUY!! NOW!! " * int(rng.integers(10, 40)) + f"#{i}") for i in range(30)]
    texts += [(400, None), (401, ""), (402, " \n"), (403, "one"), (404, say(rng, 6000)), (5, texts[5][1]), (5, texts[5][1]), (6, texts[7][1]), (None, say(rng, 40)), (None, say(rng, 40)), (None, None)]
    rows = [(i, t, [None, "en", "de"][n % 3], [None, "a", "b", "c"][n % 4], None if t is None else len(t), "k", n, 0.5, True, 3, 2, 1, 9) for n, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 0 if 300 <= i < 400 else 1, 0) for i, _ in texts if i is not None and i % 3 == 0] + [(None, 1, 0), (7, None, 1), (9999, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (7, None), (8, ""), (None, "x y z")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, items


def shown(rows):
    return sorted(map(repr, rows))


def test_stages(spark, tables):
    at, items = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, at).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        after = docs.collect()
        assert name == "token_ids" or docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        globals()[f"check_{name}"](spark, at, items, before, after)
    assert shown(corpus_pipeline.run(spark, at).collect()) == shown(after)


def check_quality(spark, at, items, before, after):
    model = quality.train_quality(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    text = quality.text_features(pa.array([r.text for r in before], pa.string()))
    score = model.score(text, quality.meta_features([r.source for r in before], [r.lang for r in before], [r.n_chars for r in before]))[2]
    gone = {r.doc_id for r, s in zip(before, score, strict=True) if s < quality.REJECT_BELOW and r.doc_id is not None}
    assert shown(after) == shown(r for r in before if r.doc_id not in gone)
    assert sum(300 <= i < 330 for i in gone) >= 27 and sum(i < 100 or 200 <= i < 210 for i in gone) <= 4


def check_near_duplicates(spark, at, items, before, after):
    sets = {}
    for r in before:
        if r.doc_id is not None:
            sets.setdefault(r.doc_id, []).append(shingles(r.text, 5))
    linked = [(a, b) for a in sets for b in sets if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    low = components_of(sets, linked)
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted({i for i in sets if low[i] == i})
    assert shown(r for r in after if r.doc_id is None) == shown(r for r in before if r.doc_id is None) and set(map(repr, after)) <= set(map(repr, before))


def check_decontaminate(spark, at, items, before, after):
    size, gone = decontaminate.BLOCK * decontaminate.SPAN, set()
    for r in before:
        words = WORDS.findall(r.text or "")
        for item in items:
            own, last = WORDS.findall(item.lower()), decontaminate.answer_length(item)
            reach = len(own) + size // 2
            for start in range(0, max(1, len(words) - size + 8), decontaminate.BLOCK):
                region = [w.lower() for w in words[max(0, start - reach) : start + size + reach]]
                common = decontaminate.lcs(own, region)
                if common >= 0.75 * len(own) or common >= 0.5 * len(own) and decontaminate.lcs(own[-last:], region) >= 0.8 * last:
                    gone.add(r.doc_id)
    assert shown(after) == shown(r for r in before if r.doc_id is None or r.doc_id not in gone) and {200, 201, 202} & {r.doc_id for r in before} <= gone


def check_mix(spark, at, items, before, after):
    want = {}
    for r in source_mix.mix_sources(spark.createDataFrame(before, SCHEMA)).collect():
        want.setdefault((r.doc_id, r.source, r.size), []).append(r.copies)
    rows = {}
    for r in after:
        rows[r] = rows.get(r, 0) + 1
    got = {}
    for r in set(before):
        key = r.doc_id, r.source, len(WORDS.findall(r.text or ""))
        n, most = rows.pop(r, 0), before.count(r)
        got.setdefault(key, []).extend([n // most + (j < n % most) for j in range(most)])
    assert not rows and {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def check_token_ids(spark, at, items, before, after):
    tokenizer = bitpack_output.Tokenizer.from_file(bitpack_output.default_tokenizer())
    start, expected = 0, []
    for r in sorted(before, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, bitpack_output.END_ID]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, after), key=lambda x: x[1]) == expected


def test_empty_tables(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    out = corpus_pipeline.run(spark, at)
    assert out.collect() == [] and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(out.columns)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_equal_their_sql(spark, tables, name):
    """On the smallest given tables, and on the table above with links among vectors."""
    at, _ = tables
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((60, 8))
    vectors = [*vectors.tolist(), *(vectors[:30] + rng.standard_normal((30, 8)) * 0.1).tolist(), vectors[3].tolist(), None, [0.0] * 8, [float("nan")] * 8, [None] * 8, []]
    spark.createDataFrame([*enumerate(vectors), (4, vectors[7])], "vec_id long, embedding array<float>").write.mode("overwrite").parquet(f"{at}/embeddings.parquet")
    for folder, files in (("/root/testdata/sf0.001", "{}.parquet"), (at, "{}.parquet/*.parquet")):
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{files.format(t)}'")
        want = con.execute(oracle_sql()[name])
        columns = [x[0] for x in want.description]
        assert shown(map(tuple, queries()[name](spark, folder).select(*columns).collect())) == shown(want.fetchall())

