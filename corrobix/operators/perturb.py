"""What-if rows: injected endpoints, false sites, drift, partitions of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import key_string


def inject_endpoint(observations: DataFrame, sites: list[str], device_type: str, fqdn: str, port: int = 443, protocol: str = "https", days: int = 1, offset: int = 0) -> DataFrame:
    """The given sites report a new endpoint on `days` days from each site's first row of the device type, `offset` days later."""
    base = observations.where((F.col("device_type") == device_type) & F.col("site_id").isin(sites)).groupBy("site_id", "device_type").agg(F.min_by(F.struct("timestamp", "device_id"), "seq").alias("t"))
    rows = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    return rows.select("site_id", "device_type", F.col("t.device_id").alias("device_id"), F.lit(fqdn).alias("fqdn"), F.lit(None).cast("string").alias("remote_ip"), F.lit(protocol).alias("protocol"), F.lit(port).alias("port"), (F.col("t.timestamp") + F.make_dt_interval(F.col("i") + offset)).alias("timestamp"))


def inject_sybils(observations: DataFrame, k: int, device_type: str, fqdn: str, days: int = 1) -> DataFrame:
    """k false sites report one endpoint on `days` days from the device type's first row."""
    base = observations.where(F.col("device_type") == device_type).agg(F.min("timestamp").alias("start"))
    rows = base.select("start", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("s")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    return rows.select(F.concat(F.lit("sybil-"), F.col("s").cast("string")).alias("site_id"), F.lit(device_type).alias("device_type"), F.lit(fqdn).alias("fqdn"), F.lit(None).cast("string").alias("remote_ip"), F.lit("https").alias("protocol"), F.lit(443).alias("port"), (F.col("start") + F.make_dt_interval(F.col("i"))).alias("timestamp"))


def time_window_sites(observations: DataFrame, n: int) -> DataFrame:
    """Relabel sites by equal spans of time."""
    span = observations.agg(F.min("timestamp").cast("long").alias("lo"), F.max("timestamp").cast("long").alias("hi"))
    place = F.least(F.floor((F.col("timestamp").cast("long") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)) * n), F.lit(n - 1))
    return observations.crossJoin(F.broadcast(span)).withColumn("site_id", F.concat(F.lit("window-"), place.cast("string"))).drop("lo", "hi")


def balanced_sites(observations: DataFrame, n: int) -> DataFrame:
    """Relabel sites so that each device type's devices are dealt out in turn."""
    devices = observations.select("device_type", "device_id").distinct().withColumn("place", (F.row_number().over(Window.partitionBy("device_type").orderBy("device_id")) - 1) % n)
    return observations.drop("site_id").join(devices, ["device_type", "device_id"]).withColumn("site_id", F.concat(F.lit("part-"), F.col("place").cast("string"))).drop("place")


def stable_fold(c: str, k: int):
    """Fold of a key: its SHA-256's first eight bytes, modulo k."""
    return (F.conv(F.substring(F.sha2(F.col(c).cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)") % k).cast("int")


def shared_facts(pairs: DataFrame, share: float, fanout: int) -> DataFrame:
    """Pairs of site and fact with a share of the facts, chosen by hash, also at the next `fanout` sites in order of name."""
    order = Window.orderBy("site_id")  # a row a site
    sites = pairs.select("site_id").distinct().withColumn("i", F.row_number().over(order) - 1)
    n = F.count("*").over(Window.partitionBy())
    steps = sites.withColumn("k", n).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(fanout)))).withColumn("j", (F.col("i") + F.col("step")) % F.col("k"))
    target = steps.join(sites.select(F.col("i").alias("j"), F.col("site_id").alias("target")), "j").select("site_id", "target")
    number = F.conv(F.substring(F.sha2(key_string().cast("binary"), 256), 1, 8), 16, 10).cast("long") % 1000
    copies = pairs.where(number % 10 < round(share * 10)).join(target, "site_id").drop("site_id").withColumnRenamed("target", "site_id")
    return pairs.unionByName(copies).distinct()


def fragmented(label: str, rate: float, parts: int = 2, by: tuple[str, ...] = ("device_id",)):
    """The label, for a share of the devices (or of what `by` names) with the number of one of `parts`: one type seen as several."""
    part = _hash_share("part", *by)
    return F.when(_hash_share("fragment", *by) < rate, F.concat(F.col(label), F.lit("#"), F.floor(part * parts).cast("string"))).otherwise(F.col(label))


def collided(label: str, rate: float, following: str, by: tuple[str, ...] = ("device_id",)):
    """The label, for a share of the devices the one in column `following`: several types seen as one."""
    return F.when(_hash_share("collide", *by) < rate, F.coalesce(following, label)).otherwise(F.col(label))


def _hash_share(salt: str, *cols: str):
    """A number in [0, 1) from the SHA-256 of a salt and columns."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(salt), *cols).cast("binary"), 256), 1, 8), 16, 10).cast("double") / float(2**32)
