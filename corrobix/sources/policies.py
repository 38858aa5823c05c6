"""Reference policies (RFC 8520 JSON) as rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import KEY, is_address, lenient_int, protocol_name, slug, transport

_LISTS = "struct<`access-lists`: struct<`access-list`: array<struct<name: string>>>>"
_PORTS = "struct<`destination-port`: struct<port: int>, `source-port`: struct<port: int>>"
_IP = "struct<protocol: int, `ietf-acldns:dst-dnsname`: string, `ietf-acldns:src-dnsname`: string, `destination-ipv4-network`: string, `source-ipv4-network`: string>"
_MATCHES = f"struct<ipv4: {_IP}, ipv6: {_IP}, tcp: {_PORTS}, udp: {_PORTS}, `ietf-mud:mud`: struct<controller: string>>"
SCHEMA = f"struct<`ietf-mud:mud`: struct<`from-device-policy`: {_LISTS}, `to-device-policy`: {_LISTS}>, `ietf-access-control-list:acls`: struct<acl: array<struct<name: string, aces: struct<ace: array<struct<name: string, matches: {_MATCHES}>>>>>>>"


def _file():
    """Path of a row's file as it was named: Spark gives it percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """device_type, direction, endpoint, protocol, port, one row a rule of every JSON file under path.

    The direction is that of the policy container that lists the ACL; an ACL in both or in neither is an error. Missing
    protocols read `unknown`, missing ports 0, missing peers `*`.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    stem = F.regexp_extract(_file(), r"([^/]+)\.json$", 1)
    doc = text.select(slug(stem).alias("device_type"), F.from_json("value", SCHEMA).alias("d"))

    def names(policy: str):
        return F.coalesce(F.col(f"d.`ietf-mud:mud`.`{policy}`.`access-lists`.`access-list`.name"), F.array().cast("array<string>"))

    acls = doc.select("device_type", names("from-device-policy").alias("out"), names("to-device-policy").alias("in"), F.explode("d.`ietf-access-control-list:acls`.acl").alias("acl"))
    out, in_ = F.array_contains("out", F.col("acl.name")), F.array_contains("in", F.col("acl.name"))
    direction = F.when(out & ~in_, "from-device").when(in_ & ~out, "to-device").otherwise(F.raise_error(F.concat(F.lit("ACL in both policies or in none: "), F.coalesce("acl.name", F.lit("?")))))
    rules = acls.select("device_type", direction.alias("direction"), F.explode("acl.aces.ace.matches").alias("m"))
    peer = F.coalesce(
        *(F.col(f"m.{v}.`ietf-acldns:{end}-dnsname`") for v in ("ipv4", "ipv6") for end in ("dst", "src")), F.col("m.ipv4.`destination-ipv4-network`"), F.col("m.ipv4.`source-ipv4-network`"), F.col("m.`ietf-mud:mud`.controller"), F.lit("*")
    )
    number = F.coalesce("m.ipv4.protocol", "m.ipv6.protocol")
    protocol = F.when(F.col("m.tcp").isNotNull() | (number == 6), "tcp").when(F.col("m.udp").isNotNull() | (number == 17), "udp").when(number == 1, "icmp").otherwise("unknown")
    port = F.coalesce(*(F.col(f"m.{t}.`{e}-port`.port") for t in ("tcp", "udp") for e in ("destination", "source")), F.lit(0))
    return rules.select("device_type", "direction", F.lower(peer).alias("endpoint"), protocol.alias("protocol"), port.alias("port"))


def read_policy_tables(spark: SparkSession, path: str) -> DataFrame:
    """The same columns as read_policies, of every CSV file under path; the device type is the file's name.

    The peer is dst_class, else dst_dnsname, else dst_ip; rows without one are left out. A file without a direction, or a row
    with another than from-device, to-device, out or in, is an error: it cannot be guessed.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("mergeSchema", True).csv(path, header=True)
    if "direction" not in raw.columns:
        raise ValueError("policy table without a direction")

    def first(*names: str):
        return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in names if c in raw.columns), F.lit(None).cast("string"))

    given = F.lower(F.trim("direction"))
    direction = F.when(given.isin("from-device", "out"), "from-device").when(given.isin("to-device", "in"), "to-device").otherwise(F.raise_error(F.concat(F.lit("unknown direction: "), F.coalesce(given, F.lit("none")))))
    kind = slug(F.regexp_extract(_file(), r"([^/]+)\.csv$", 1))
    port = F.coalesce(lenient_int(first("dst_port", "port")), F.lit(0))
    rows = raw.select(kind.alias("device_type"), direction.alias("direction"), F.lower(first(*(c for c in ("dst_class", "dst_dnsname", "dst_ip")))).alias("endpoint"), F.coalesce(protocol_name(first("protocol", "ip_proto")), F.lit("unknown")).alias("protocol"), port.alias("port"))
    return rows.where("endpoint is not null").distinct()


def mud_entries(accepted: DataFrame, answered: DataFrame | None = None) -> DataFrame:
    """fact, place, transport, entry (from-device, to-device or skipped) of the accepted facts of each device type.

    Facts stand in order of endpoint, protocol and port. Facts without a portable transport and addresses, which name matches
    cannot express, are skipped, not guessed. `answered` (facts with an observed response) adds the return leg of what is sent.
    """
    order = Window.partitionBy("device_type").orderBy("endpoint", "protocol", "port")  # the admitted facts of a device type
    rows = accepted.select(*KEY).distinct().withColumn("place", (F.row_number().over(order) - 1).cast("long")).withColumn("transport", transport("protocol"))
    sent = F.coalesce(F.col("transport").isin("tcp", "udp"), F.lit(False)) & ~is_address("endpoint")
    rows = rows.withColumn("entry", F.when(sent, "from-device").otherwise("skipped"))
    if answered is None:
        return rows
    back = rows.where("entry = 'from-device'").join(answered.select(*KEY).distinct(), list(KEY), "left_semi").withColumn("entry", F.lit("to-device"))
    return rows.unionByName(back.select(*rows.columns))


def policy_documents(accepted: DataFrame, answered: DataFrame | None = None, version: int = 1) -> DataFrame:
    """device_type, mud, skipped: a JSON policy of the accepted facts of each device type, and how many could not be expressed."""
    rows = mud_entries(accepted, answered)
    number = F.when(F.col("transport") == "udp", 17).otherwise(6).alias("protocol")

    def ace(entry: str, end: str):
        port = F.struct(F.struct(F.lit("eq").alias("operator"), F.col("port").alias("port")).alias(f"{end}-port"), F.lit("from-device").alias("ietf-mud:direction-initiated"))
        side = "dst" if end == "destination" else "src"
        ip = F.struct(F.col("endpoint").alias(f"ietf-acldns:{side}-dnsname"), number)
        matches = F.struct(ip.alias("ipv4"), F.when(F.col("transport") == "tcp", port).alias("tcp"), F.when(F.col("transport") == "udp", port).alias("udp"))
        body = F.struct(F.concat(slug("device_type"), F.lit("-fr-" if side == "dst" else "-to-"), F.col("place").cast("string")).alias("name"), matches.alias("matches"), F.struct(F.lit("accept").alias("forwarding")).alias("actions"))
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("entry") == entry, F.struct("place", F.to_json(body).alias("body"))))), lambda x: x["body"])

    made = rows.groupBy("device_type").agg(ace("from-device", "destination").alias("fr"), ace("to-device", "source").alias("to"), F.count_if(F.col("entry") == "skipped").alias("skipped"))

    def acl(side: str):
        return F.concat(F.lit('{"name":"'), slug("device_type"), F.lit(f'-{side}","type":"ipv4-acl-type","aces":{{"ace":['), F.array_join(side, ","), F.lit("]}}"))

    def listed(side: str):
        return F.struct(F.struct(F.array(F.struct(F.concat(slug("device_type"), F.lit(f"-{side}")).alias("name"))).alias("access-list")).alias("access-lists"))

    head = F.to_json(F.struct(F.lit(version).alias("mud-version"), F.col("device_type").alias("systeminfo"), F.lit(48).alias("cache-validity"), F.lit(True).alias("is-supported"), listed("fr").alias("from-device-policy"), listed("to").alias("to-device-policy")))
    doc = F.concat(F.lit('{"ietf-mud:mud":'), head, F.lit(',"ietf-access-control-list:acls":{"acl":['), acl("fr"), F.lit(","), acl("to"), F.lit("]}}"))
    return made.select("device_type", doc.alias("mud"), "skipped")
