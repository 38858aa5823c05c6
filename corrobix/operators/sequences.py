"""Order, time and change: flips, splits, churn, as-of enrichment, event folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import KEY


def top_facts(facts: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("device_type").orderBy(F.desc("supporting_sites"), F.desc("n"), "endpoint", "protocol", "port")
    return facts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def flip_rate(rows: DataFrame, by: str, order: tuple[str, ...], value: str) -> DataFrame:
    """Share of steps at which value changes."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("before", before).where("before is not null").groupBy(by).agg(F.round(F.avg((F.col(value) != F.col("before")).cast("int")), 6).alias("flip_rate"), F.count("*").alias("steps"))


def chronological_split(rows: DataFrame, by: str, order: tuple[str, ...], share: float) -> DataFrame:
    """train = the first max(1, floor(n * share)) rows of each group."""
    w = Window.partitionBy(by)
    return rows.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("train", F.col("place") <= F.greatest(F.lit(1), F.floor(F.count("*").over(w) * share)))


def daily_queue(cube: DataFrame, quorum: int) -> DataFrame:
    """day, queue (facts with `quorum` sites by then), new: running counts from each fact's quorum day alone."""
    first = cube.groupBy(*KEY, "site_id").agg(F.min("day").alias("day"))
    reached = first.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("day", "site_id"))).where(F.col("place") == quorum)
    new = reached.groupBy("day").agg(F.count("*").alias("new"))
    days = cube.select("day").distinct().join(new, "day", "left").fillna(0, ["new"])
    return days.withColumn("queue", F.sum("new").over(Window.orderBy("day")))  # a row a day


def churn(accepted: DataFrame) -> DataFrame:
    """step, kept, added, removed between the accepted facts (step, fact) of consecutive steps."""
    now = accepted.select("step", *KEY).distinct()
    then = now.withColumn("step", F.col("step") + 1)
    both = now.withColumn("n", F.lit(1)).join(then.withColumn("o", F.lit(1)), ["step", *KEY], "full")
    steps = now.agg(F.max("step").alias("last"))
    return both.groupBy("step").agg(F.count(F.col("n") + F.col("o")).alias("kept"), F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed")).crossJoin(F.broadcast(steps)).where("step <= last").drop("last")


def nearest_evidence(rows: DataFrame, evidence: DataFrame, by: tuple[str, ...], hours: int) -> DataFrame:
    """Nearest-in-time evidence (by, timestamp, name) of each row (by, timestamp, seq) within the window; ties to the earlier.

    Time is cut into spans of the window's length, and evidence also stands in the spans before and after its own, so all that
    is near enough to a row lies in the row's span. Rows and evidence of a span are merged by time; the last before and the first
    after come from two windows over that, one in either direction, as a frame that only grows takes linear time and one that
    shrinks is read again for each row. A site with most of all rows is so many tasks as it has spans. known_here: there is
    evidence of the row's `by` at any time.
    """
    width = hours * 3600
    span = F.floor(F.col("timestamp").cast("long") / width)
    facts = evidence.select(*by, "timestamp", F.lit(None).cast("long").alias("seq"), "name").distinct()
    spread = facts.withColumn("span", F.explode(F.array(span - 1, span, span + 1))).withColumn("is_row", F.lit(0))
    merged = rows.select(*by, "timestamp", "seq", F.lit(None).cast("string").alias("name"), span.alias("span"), F.lit(1).alias("is_row")).unionByName(spread)
    given = F.when(F.col("is_row") == 0, F.struct("timestamp", "name"))
    w = Window.partitionBy(*by, "span")
    before = F.last(given, ignorenulls=True).over(w.orderBy("timestamp", "is_row", "name").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(given, ignorenulls=True).over(w.orderBy(F.desc("timestamp"), "is_row", F.desc("name")).rowsBetween(Window.unboundedPreceding, 0))
    found = merged.withColumn("b", before).withColumn("a", after).where("is_row = 1")
    gap_b, gap_a = F.col("timestamp").cast("long") - F.col("b.timestamp").cast("long"), F.col("a.timestamp").cast("long") - F.col("timestamp").cast("long")
    use_b = F.col("a").isNull() | (F.col("b").isNotNull() & (gap_b <= gap_a))
    out = found.withColumn("gap_seconds", F.when(use_b, gap_b).otherwise(gap_a)).withColumn("hit", F.when(use_b, F.col("b.name")).otherwise(F.col("a.name")))
    known = facts.select(*by).distinct().withColumn("known_here", F.lit(True))
    inside = F.col("gap_seconds") <= width
    return out.join(known, list(by), "left").select("seq", F.when(inside, F.col("hit")).alias("name"), F.when(inside, F.col("gap_seconds")).alias("gap_seconds"), F.coalesce("known_here", F.lit(False)).alias("known_here"))


def first_name(observations: DataFrame) -> DataFrame:
    """remote_ip -> first name by seq."""
    return observations.where("fqdn is not null").groupBy("remote_ip").agg(F.min_by("fqdn", "seq").alias("name"))


def busiest_day(cube: DataFrame) -> DataFrame:
    n = cube.groupBy("site_id", "day").agg(F.sum("n").alias("n"))
    return n.groupBy("site_id").agg(F.max_by("day", F.struct("n", (-F.unix_date("day")).alias("d"))).alias("day"), F.max("n").alias("n"))


def newest(log: DataFrame, by: tuple[str, ...], seq: str = "seq") -> DataFrame:
    """Latest row of each key."""
    rest = [c for c in log.columns if c not in by]
    return log.groupBy(*by).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*by, "r.*")
