"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source should be taken target / source_size times on average. The whole part is certain; the fractional
parts are rounded in pairs: word mass moves at random from one document of a pair to the other until one is integral, with
odds that leave every expectation unchanged, so a source's total of words is kept exactly. The document left over of each
leaf of 32 goes to the next level of a tree; only a source's last document is rounded on its own. A leaf goes from large to
small, so what is left over tends to be a small document and the last rounding moves few words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table

LEAF = 32
#: Equal rows that one task numbers.
_EQUAL = 4096
#: Weights by order of the source names, repeating; the share of all words; how often a source may be repeated.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
WORDS = r"[^\x20\x09-\x0D]+"


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 20240607, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Choose how often each document is taken so that sources near their target words.

    Returns doc_id, size, source_size, target, taken, copies and source, one row per input row. Sources are ranked by code point, null
    (a source of its own) last, and weigh `weights`, repeating. Targets share `share` of all words by weight, at most `most`
    times a source's size, excess reshared. Null and blank texts have size 0 and take no words. Decisions are hashes of seed
    and ids: reruns agree. Rows of one id (or none) are mixed as rows of their own, those of one size alike. Other columns are not read. An empty table gives none.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
    sized = Table(sized, "sized")
    sources = Table(targets(sized.df.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, most), "sources")
    rows = sized.df.join(sources.df.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "rank", "size", "odds", "n")
    apart = (F.col("size") == 0) | (F.col("odds") == 0)
    alone = rows.where(apart).select("rank", "doc_id", "size", F.when((F.col("size") == 0) & (_uniform(F.lit(seed), "doc_id") < F.col("odds")), 1).otherwise(0).alias("up"))
    # Rows of one id and size are counted and numbered, so that they are dealt to as many leaves as other rows are.
    counted = Table(rows.where(~apart).groupBy("rank", "doc_id", "size", "odds", "n").agg(F.count("*").alias("m")), "counted")
    parts = counted.df.where(F.col("m") > _EQUAL).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / _EQUAL)))).repartition("rank", "doc_id", "size", "part")
    numbered = counted.df.where(F.col("m") <= _EQUAL).withColumn("part", F.lit(0).cast("long")).unionByName(parts)
    numbered = numbered.withColumn("k", F.explode(F.sequence(F.col("part") * _EQUAL, F.least("m", (F.col("part") + 1) * _EQUAL) - 1)))
    items = numbered.select("rank", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size", "k"), F.ceil(F.col("n") / LEAF)).alias("leaf"), F.struct("size", "doc_id", "k", F.col("odds").alias("f")).alias("item"))
    leaves = int(sources.df.agg(F.max(F.ceil(F.col("n") / LEAF))).first()[0] or 1)
    decided, level = [alone], 0
    while True:
        level += 1
        last = leaves == 1
        groups = items.groupBy("rank", "leaf").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        folded = Table(groups.select("rank", "leaf", _fold("items", seed + 1 + level).alias("s")), "folded")
        done = folded.df.select("rank", F.explode("s.done").alias("d")).select("rank", "d.doc_id", "d.size", "d.up")
        decided.append(done)
        left = folded.df.select("rank", "leaf", "s.carry")
        if last:
            decided.append(left.select("rank", "carry.doc_id", "carry.size", F.when(_uniform(F.lit(seed), "rank", "carry.doc_id", "carry.k") < F.col("carry.f"), 1).otherwise(0).alias("up")))
            break
        items = left.select("rank", F.floor(F.col("leaf") / LEAF).alias("leaf"), F.col("carry").alias("item"))
        leaves = -(-leaves // LEAF)
    out = reduce(DataFrame.unionByName, decided).join(sources.df.select("rank", "source", "source_size", "target", "base"), "rank")
    copies = F.col("base") + F.col("up")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.cast("long").alias("copies"), "source")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """rank, target, base (whole copies) and odds (of one more) for each (source, source_size, n).

    Filling by weight with caps: in order of cap / weight, sources are full while their cap lies under the level that the
    rest would get. There is one row per source here, so windows over all of them are small.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    filled = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    water = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "rank", "level"))).over(everything)["level"]
    filled = filled.withColumn("target", F.least(F.col("cap"), F.coalesce(water * F.col("w"), F.col("cap"))))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return filled.withColumn("rate", rate).select("source", "source_size", "n", "rank", "target", F.floor("rate").alias("base"), (F.col("rate") - F.floor("rate")).alias("odds"))


def _uniform(*cols: Column | str) -> Column:
    """A number in [0, 1) from the hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(2**53))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(items: str, salt: int) -> Column:
    """Round items (doc_id, size, k, f) pairwise: struct of done (doc_id, size, up) and the carry, the last one still fractional."""
    carry_type, done_type = "struct<size:bigint,doc_id:bigint,k:bigint,f:double>", "array<struct<doc_id:bigint,size:bigint,up:int>>"
    start = F.struct(F.element_at(items, 1).cast(carry_type).alias("carry"), F.array().cast(done_type).alias("done"))

    def settled(who: Column, up: int) -> Column:
        return F.struct(who["doc_id"].alias("doc_id"), who["size"].alias("size"), F.lit(up).alias("up"))

    def moved(who: Column, f: Column) -> Column:
        return F.struct(who["size"].alias("size"), who["doc_id"].alias("doc_id"), who["k"].alias("k"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), f)).alias("f"))

    def merge(acc: Column, x: Column) -> Column:
        c = acc["carry"]
        facts = F.struct(
            (c["size"] * c["f"]).alias("mass_c"), (x["size"] * x["f"]).alias("mass_x"), (c["size"] * (1 - c["f"])).alias("room_c"), (x["size"] * (1 - x["f"])).alias("room_x"),
            _uniform(F.lit(salt), c["doc_id"], c["k"], x["doc_id"], x["k"]).alias("u"),
        )

        def choose(s: Column) -> Column:
            to_x, to_c = F.least(s["mass_c"], s["room_x"]), F.least(s["mass_x"], s["room_c"])

            def outcome(done: Column, carry: Column) -> Column:
                return F.struct(carry.alias("carry"), F.concat(acc["done"], F.array(done)).alias("done"))

            give = s["u"] * (to_x + to_c) < to_c
            return (
                F.when(give & (s["mass_c"] <= s["room_x"]), outcome(settled(c, 0), moved(x, x["f"] + s["mass_c"] / x["size"])))
                .when(give, outcome(settled(x, 1), moved(c, c["f"] - s["room_x"] / c["size"])))
                .when(s["mass_x"] <= s["room_c"], outcome(settled(x, 0), moved(c, c["f"] + s["mass_x"] / c["size"])))
                .otherwise(outcome(settled(c, 1), moved(x, x["f"] - s["room_c"] / x["size"])))
            )

        return _let(facts, choose)

    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, merge)
