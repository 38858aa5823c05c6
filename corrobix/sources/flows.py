"""Flow tables of a corpus with a folder of names: flows of each device, names from web hosts and TLS client hellos."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import PROTOCOL_NUMBERS, clean_address, clean_host, in_blocks, lenient_int

# Private blocks without link-local ones.
DEVICE_BLOCKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "192.0.0.0/29", "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "0.0.0.0/8")
FLOWS = "srcIp string, dstIp string, dstPort string, protocol string, ipProto string, time string, dstNumPackets string"


def server_name(extensions: bytes) -> str | None:
    """The first host name in the server-name extension of a TLS client hello; anything malformed has none."""
    at = 0
    while at + 4 <= len(extensions):
        kind, size = int.from_bytes(extensions[at : at + 2], "big"), int.from_bytes(extensions[at + 2 : at + 4], "big")
        body, at = extensions[at + 4 : at + 4 + size], at + 4 + size
        if kind != 0 or len(body) < 5:
            continue
        end, place = 2 + int.from_bytes(body[:2], "big"), 2
        while place + 3 <= min(end, len(body)):
            length = int.from_bytes(body[place + 1 : place + 3], "big")
            name = body[place + 3 : place + 3 + length]
            if body[place] == 0 and len(name) == length:
                try:
                    return name.decode("ascii")
                except UnicodeDecodeError:
                    return None
            place += 3 + length
    return None


def _with_server_name(rows: DataFrame) -> DataFrame:
    """Adds `name` from the hex text of client-hello extensions, in batches."""

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = []
            for text in b["hello"]:
                try:
                    names.append(server_name(bytes.fromhex((text or "").strip())))
                except ValueError:
                    names.append(None)
            yield b.assign(name=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", name string"
    return rows.mapInPandas(decoded, schema)


def _csv(spark: SparkSession, path: str, glob: str, columns: list[str]) -> DataFrame:
    """The named columns of CSV files as text, null where a file lacks one, with the file and an order of its rows."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(path, header=True)
    found = [F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return raw.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("row"), *found)


def device_addresses(flows: DataFrame) -> DataFrame:
    """file, device_ip: the private address that most rows of a file have on either side, ties to the one met first."""
    ends = flows.select("file", F.posexplode(F.array("srcIp", "dstIp")).alias("side", "ip"), "row").where(clean_address("ip").isNotNull() & in_blocks("ip", DEVICE_BLOCKS))
    counts = ends.groupBy("file", "ip").agg(F.count("*").alias("n"), F.min(F.struct("row", "side")).alias("first"))
    return counts.groupBy("file").agg(F.min_by("ip", F.struct((-F.col("n")).alias("n"), "first")).alias("device_ip"))


def name_index(spark: SparkSession, path: str) -> DataFrame:
    """device_id, remote_ip, port, fqdn, named_by: the last web host of a peer, else the first TLS server name."""
    peer = [clean_address("dstIp").alias("remote_ip"), lenient_int("dstPort").alias("port")]
    device = F.regexp_extract("file", r"([^/]+)/request/[^/]+$", 1)
    device = F.when(F.contains(device, F.lit("_")), F.substring_index(device, "_", -1)).otherwise(device).alias("device_id")
    hosts = _csv(spark, path, "httpattributes.csv", ["host", "dstIp", "dstPort"]).select(device, *peer, clean_host("host").alias("name"), "row", F.lit("http_host").alias("by"))
    hello = _csv(spark, path, "tlsattributes.csv", ["client-hello-extensions", "dstIp", "dstPort"]).select(device, *peer, F.col("client-hello-extensions").alias("hello"), "row")
    hello = _with_server_name(hello).select("device_id", "remote_ip", "port", clean_host("name").alias("name"), "row", F.lit("tls_sni").alias("by"))
    rows = hosts.unionByName(hello).where("name is not null and name <> 'null' and remote_ip is not null")
    web, tls = F.col("by") == "http_host", F.col("by") == "tls_sni"
    best = rows.groupBy("device_id", "remote_ip", "port").agg(F.max_by(F.when(web, F.col("name")), F.when(web, F.col("row"))).alias("web"), F.min_by(F.when(tls, F.col("name")), F.when(tls, F.col("row"))).alias("tls"))
    return best.select("device_id", "remote_ip", "port", F.coalesce("web", "tls").alias("fqdn"), F.when(F.col("web").isNotNull(), "http_host").otherwise("tls_sni").alias("named_by"))


def flow_protocol(protocol: Column, number: Column) -> Column:
    """The application's name if the flow has one, else the IP protocol's, else ip- and its number."""
    name, n = F.lower(F.trim(F.coalesce(protocol, F.lit("")))), F.trim(F.coalesce(number, F.lit("")))
    known = F.element_at(F.create_map(*(F.lit(x) for kv in PROTOCOL_NUMBERS.items() for x in kv)), n)
    return F.when((name != "") & (name != "none"), name).otherwise(F.coalesce(known, F.concat(F.lit("ip-"), F.coalesce(F.nullif(n, F.lit("")), F.lit("unknown")))))


def flow_time(c: str) -> Column:
    """ISO text with a fraction of any length and any offset; without an offset it is UTC."""
    text = F.regexp_replace(F.trim(F.col(c)), r"(\.\d{6})\d+", "$1")
    return F.try_to_timestamp(text)


def read_flows(spark: SparkSession, path: str, names: DataFrame | None = None, site_id: str = "flows", dataset: str = "flows", counters: Observation | None = None) -> DataFrame:
    """Observations of all `<type>_<id>_flows.csv` files: what the device itself sent, with names where the index has them.

    Files without a private address, and rows whose peer is no usable address, give none. A response was seen if packets came
    back. `counters` gets the rows by what became of them (STATUSES) while the observations are read, without another scan.
    """
    flows = _csv(spark, path, "*_flows.csv", [c.split()[0] for c in FLOWS.split(", ")])
    stem = F.regexp_extract("file", r"([^/]+)_flows\.csv$", 1)
    split = F.contains(stem, F.lit("_"))
    judged = flows.join(device_addresses(flows), "file", "left").withColumn("status", flow_status())
    if counters is not None:
        judged = judged.observe(counters, F.count("*").alias("rows"), *(F.count_if(F.col("status") == x).alias(x) for x in STATUSES))
    rows = judged.where("status = 'observation'").select(
        F.when(split, F.regexp_extract(stem, r"^(.*)_[^_]*$", 1)).otherwise(stem).alias("device_type"), F.substring_index(stem, "_", -1).alias("device_id"), clean_address("dstIp").alias("remote_ip"), lenient_int("dstPort").alias("port"),
        flow_protocol(F.col("protocol"), F.col("ipProto")).alias("protocol"), flow_time("time").alias("timestamp"), (lenient_int("dstNumPackets") > 0).alias("response_observed"),
    )
    rows = rows.join(names, ["device_id", "remote_ip", "port"], "left") if names is not None else rows.withColumn("fqdn", F.lit(None).cast("string")).withColumn("named_by", F.lit(None).cast("string"))
    return rows.select(
        F.lit(site_id).alias("site_id"), "device_id", "device_type", "fqdn", "remote_ip", "protocol", "port", "timestamp", F.lit(dataset).alias("source_dataset"),
        F.when(F.col("named_by").isNotNull(), F.concat(F.lit("flow+"), "named_by")).otherwise("flow").alias("evidence_type"), "response_observed", F.lit("out").alias("direction"),
    )


def read_attacks(spark: SparkSession, path: str, devices: dict[str, str]) -> DataFrame:
    """Malicious endpoints from headerless attack flows (epoch milliseconds, source, target, protocol number, port) of known devices.

    devices: address of a device -> its type. Rows from other sources and to no usable address are dropped.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").schema("at string, src string, dst string, proto string, port string").csv(path)
    if not devices:
        raise ValueError("no device addresses are given")
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in devices.items() for x in kv)), F.trim("src"))
    rows = raw.select(kind.alias("device_type"), clean_address(F.trim("dst")).alias("endpoint"), flow_protocol(F.lit(None).cast("string"), F.col("proto")).alias("protocol"), lenient_int("port").alias("port"), F.timestamp_millis(F.col("at").try_cast("long")).alias("timestamp"))
    return rows.where("device_type is not null and endpoint is not null and timestamp is not null")


def federated(corpora: dict[str, DataFrame], devices: DataFrame, organisations: dict[str, str] | None = None) -> DataFrame:
    """Several corpora as the sites of one federation: rows of the shared device types, each corpus under its organisation."""
    parts = [rows.withColumn("site_id", F.lit((organisations or {}).get(name, name))) for name, rows in corpora.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    return every.join(devices.select("device_type").distinct(), "device_type", "left_semi")


def parse_statistics(rows: DataFrame, status: Column) -> DataFrame:
    """file, status, rows: what became of the rows of every file (see `status` expressions of the readers)."""
    return rows.groupBy("file", status.alias("status")).agg(F.count("*").alias("rows"))


#: What becomes of a row of a flow table.
STATUSES = ("no device address", "not sent by the device", "no usable peer", "observation")


def flow_status() -> Column:
    """Why a flow row (with device_ip) gives an observation or none."""
    return F.when(F.col("device_ip").isNull(), "no device address").when(F.col("srcIp").isNull() | (F.col("srcIp") != F.col("device_ip")), "not sent by the device").when(clean_address("dstIp").isNull(), "no usable peer").otherwise("observation")


def conditional_rows(rows: DataFrame, groups: list[str], home: str, least: int = 5) -> DataFrame:
    """Rows of the groups that at least `least` homes have; null group columns never qualify."""
    known = rows.where(" and ".join(f"{g} is not null" for g in groups))
    enough = known.groupBy(*groups).agg(F.count_distinct(home).alias("_homes")).where(F.col("_homes") >= least).drop("_homes")
    return known.join(enough, groups, "left_semi")


def flow_features(rows: DataFrame, features: list[str]) -> DataFrame:
    """Rows whose features are all finite numbers, with them as one array of doubles."""
    values = F.array(*(F.col(c).try_cast("double") for c in features))
    return rows.withColumn("features", values).where(F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
