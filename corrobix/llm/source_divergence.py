"""How far the sources of a language differ in their words: a term is a vector over the language's sources.

Terms are counted in Arrow batches and summed by language, source and term. Each kept term then becomes one row with an array of
its counts by source; higher-order functions give its smoothed shares and its part of each pair of sources, and sums that start
in the tasks add the parts up. All arithmetic is on integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER_BYTE, BROADCAST_IDS, Table, bounded_batches, small_batches, utf8

#: Bytes of terms: letters, and all of characters beyond ASCII.
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
#: A share of one. floor(SHARE * a / b) is taken in two steps of 31250 and 32000, so nothing overflows below 2.8e14 words.
SHARE = 1_000_000_000


def terms_of(column) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Every term of the column in order, A-Z in lower case, and the row of each."""
    raw, off = utf8(column)
    inside = _TERM[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    bounds = np.append(np.concatenate([[0], np.cumsum(inside)])[starts], int(inside.sum()))
    body = _LOWER_BYTE[raw[inside]]
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes()))
    return terms.dictionary_encode(), np.searchsorted(off, starts, "right") - 1


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it) of docs (lang, source, text)."""

    def counted(batches):
        for b in (x for whole in batches for x in small_batches(whole, 2)):
            terms, row = terms_of(b.column(2))
            groups = pa.StructArray.from_arrays([b.column(0), b.column(1)], names=["lang", "source"])
            names = list(dict.fromkeys((x["lang"], x["source"]) for x in groups.to_pylist()))
            place = {x: i for i, x in enumerate(names)}
            group = np.array([place[x["lang"], x["source"]] for x in groups.to_pylist()], np.int64)
            code, size = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(terms.dictionary))
            each, n = np.unique(row * size + code, return_counts=True)  # one entry for a row and term
            own, at = np.unique(group[each // size] * size + each % size, return_inverse=True)
            times, held = np.zeros(len(own), np.int64), np.bincount(at, minlength=len(own))
            np.add.at(times, at, n)
            langs, sources = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
            of = pa.array(own // size)
            yield pa.RecordBatch.from_arrays([langs.take(of), sources.take(of), terms.dictionary.take(pa.array(own % size)).cast(pa.string()), pa.array(times), pa.array(held.astype(np.int64))], names=["lang", "source", "term", "n", "docs"])

    found = docs.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n, total, kept) -> str:
    """1 + floor(SHARE * (n + 2) / (total + 2 * kept)) as SQL over 64-bit integers."""
    a, b = f"({n} + 2)", f"({total} + 2 * {kept})"
    return f"(1 + ({a} * 31250) div {b} * 32000 + ((({a} * 31250) % {b}) * 32000) div {b})"


def _far(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def audit_sources(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and by which terms.

    Terms are runs of letters and characters beyond ASCII, A-Z in lower case; a language keeps those in at least `least_docs` of
    its rows. A group's share of a term is 1 + floor(10**9 (n + 2) / (N + 2 V)). Part `pair` sums floor((p - q)**2 / (p + q))
    over the kept terms for every other source of the language (0 without kept terms); part `term` has the `top` terms of which
    a source holds a larger share than its language. Ranks go by value, largest first, then item. Null text, lang and source
    read as empty; every row is a document, repeated ones too. An empty table gives an empty result. Very long texts go through
    in slices of rows. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = Table(docs.select("lang", "source").distinct(), "groups").df
    few = groups.count() <= BROADCAST_IDS // 64

    def with_lang(df: DataFrame, small: DataFrame) -> DataFrame:
        return df.join(F.broadcast(small) if few else small, "lang")

    sources = groups.groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    held = count_terms(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    counts = F.expr("transform(sources, s -> coalesce(element_at(by_source, s), 0L))")
    wide = Table(with_lang(held.where(F.col("docs") >= least_docs), sources).select("lang", "term", counts.alias("counts")), "terms").df

    sums = wide.select("lang", F.posexplode("counts").alias("i", "n")).groupBy("lang", "i").agg(F.sum("n").alias("n"), F.count("*").alias("kept"))
    totals = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("totals"), F.sum("n").alias("total"), F.max("kept").alias("kept"))
    langs = Table(sources.join(totals, "lang", "left").fillna(0, ["total", "kept"]), "langs").df

    shared = with_lang(wide, langs).withColumn("p", F.expr(f"transform(counts, (n, i) -> {_share('n', 'totals[i]', 'kept')})"))
    parts = shared.select("lang", F.posexplode("p").alias("i", "a"), "p").where(F.col("i") < F.size("p") - 1)
    parts = parts.select("lang", "i", F.explode(F.expr(f"transform(sequence(i + 1, size(p) - 1), j -> struct(j, {_far('a', 'p[j]')} as value))")).alias("x")).groupBy("lang", "i", F.col("x.j").alias("j")).agg(F.sum("x.value").alias("value"))
    both = parts.select("lang", "i", "j", "value").unionByName(parts.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    every = langs.select("lang", F.posexplode("sources").alias("i", "source"), "sources").select("lang", "i", "source", F.posexplode("sources").alias("j", "item")).where("i <> j")
    pairs = every.join(both, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    q = F.expr(_share("aggregate(counts, 0L, (s, n) -> s + n)", "total", "kept"))
    over = shared.withColumn("q", q).select("lang", "term", "sources", "q", F.posexplode("p").alias("i", "a"), "counts").where("counts[i] > 0 and a > q")
    terms = over.select("lang", F.expr("sources[i]").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_far("a", "q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionByName(terms.withColumn("rank", place).where(F.col("rank") <= top))
