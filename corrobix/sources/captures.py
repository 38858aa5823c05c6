"""Packet captures (PCAP and PCAPNG, also in archives) as observations.

Files are read whole by Spark, one row a file, and decoded to a row a packet; names come from the latest DNS answer before a
packet, by a window over each capture, and repeats within a second are dropped by a distinct.
"""

from __future__ import annotations

import csv
import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import PRIVATE, canonical_device, clean_address, clean_host, epoch_or_iso, in_blocks, is_address, is_global, lenient_int, optional, protocol_name
from .observations import ALIASES

# Link type, ether types and IP protocols that are decoded; the largest record that is believed.
_ETHERNET, _IPV4, _VLAN, _ICMP, _TCP, _UDP = 1, 0x0800, 0x8100, 1, 6, 17
MOST_BYTES = 16 << 20
PACKETS = "path string, packet long, seconds long, src_ip string, dst_ip string, protocol string, src_port int, dst_port int, answer_name string, answer_ip string"


def _name(data: bytes, at: int, depth: int = 0) -> tuple[str, int]:
    labels = []
    while at < len(data):
        n = data[at]
        if n == 0:
            return ".".join(labels), at + 1
        if n >= 0xC0:
            if depth >= 8 or at + 1 >= len(data):
                return ".".join(labels), at + 2
            rest, _ = _name(data, (n & 0x3F) << 8 | data[at + 1], depth + 1)
            return ".".join([*labels, rest] if rest else labels), at + 2
        labels.append(data[at + 1 : at + 1 + n].decode("ascii", "replace"))
        at += 1 + n
    return ".".join(labels), at


def dns_answers(data: bytes) -> list[tuple[str, str]]:
    """(question, address) for the A records of a DNS response; anything malformed gives what came before it."""
    found: list[tuple[str, str]] = []
    try:
        _, flags, questions, answers = struct.unpack_from(">HHHH", data)
        at, asked = 12, ""
        for _ in range(questions):
            asked, at = _name(data, at)
            at += 4
        for _ in range(answers if flags & 0x8000 else 0):
            _, at = _name(data, at)
            kind, _, _, size = struct.unpack_from(">HHIH", data, at)
            at += 10
            if kind == 1 and size == 4:
                found.append((asked.lower(), ".".join(map(str, data[at : at + 4]))))
            at += size
    except (struct.error, IndexError):
        pass
    return found


def packets(content: bytes) -> Iterator[tuple]:
    """(packet, seconds, src, dst, protocol, source port, target port, answers) of a capture of Ethernet and IPv4.

    Classic captures and PCAPNG are told apart by their first bytes. A capture that is cut off ends there; a record larger than
    MOST_BYTES is an error, since what follows could not be trusted and would be lost without a word.
    """
    number = 0
    for seconds, p in _records(content):
        number += 1
        link = 18 if p[12:14] == struct.pack(">H", _VLAN) else 14
        if len(p) < link + 20 or struct.unpack_from(">H", p, link - 2)[0] != _IPV4:
            continue
        head = (p[link] & 15) * 4
        kind, body = p[link + 9], p[link + head :]
        src, dst = (".".join(map(str, p[link + i : link + i + 4])) for i in (12, 16))
        if kind == _ICMP:
            yield number, seconds, src, dst, "icmp", 0, 0, []
        if kind not in (_TCP, _UDP) or len(body) < 8:
            continue
        sport, dport = struct.unpack_from(">HH", body)
        yield number, seconds, src, dst, "tcp" if kind == _TCP else "udp", sport, dport, dns_answers(body[8:]) if kind == _UDP and sport == 53 else []


def _records(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(seconds, packet) of every record."""
    if content[:4] == b"\x0a\x0d\x0d\x0a":
        yield from _blocks(content)
        return
    order = {b"\xd4\xc3\xb2\xa1": "<", b"\x4d\x3c\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">", b"\xa1\xb2\x3c\x4d": ">"}.get(content[:4])
    if order is None or len(content) < 24 or struct.unpack_from(order + "I", content, 20)[0] != _ETHERNET:
        return
    at = 24
    while at + 16 <= len(content):
        seconds, _, size, _ = struct.unpack_from(order + "IIII", content, at)
        if size > MOST_BYTES:
            raise ValueError(f"capture record of {size} bytes")
        if at + 16 + size > len(content):
            return
        yield seconds, content[at + 16 : at + 16 + size]
        at += 16 + size


def _blocks(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Packets of enhanced packet blocks of Ethernet interfaces. A section header sets the byte order and drops the interfaces."""
    at, order, interfaces = 0, "<", []
    while at + 12 <= len(content):
        kind = struct.unpack_from(order + "I", content, at)[0]
        if content[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order, interfaces = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}.get(content[at + 8 : at + 12], ""), []
            if not order:
                return
        size = struct.unpack_from(order + "I", content, at + 4)[0]
        if size > MOST_BYTES:
            raise ValueError(f"capture block of {size} bytes")
        if size < 12 or at + size > len(content):
            return
        body = content[at + 8 : at + size - 4]
        if kind == 1 and len(body) >= 8:
            interfaces.append((struct.unpack_from(order + "H", body)[0], _ticks(body[8:], order)))
        elif kind == 6 and len(body) >= 20:
            which, high, low, held, _ = struct.unpack_from(order + "IIIII", body)
            if which < len(interfaces) and interfaces[which][0] == _ETHERNET and 20 + held <= len(body):
                yield ((high << 32) + low) // interfaces[which][1], body[20 : 20 + held]
        at += size


def _ticks(options: bytes, order: str) -> int:
    """Clock ticks a second from the options of an interface: a million unless the resolution option says otherwise."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 0:
            break
        if code == 9 and size >= 1:
            value = options[at + 4]
            return 2 ** (value & 127) if value & 128 else 10**value
        at += 4 + size + -size % 4
    return 1_000_000


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """A row a packet, and one more for each further DNS answer it carries, of captures under path and in archives there."""

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in PACKETS.split(", ")]
        for b in batches:
            for path_, content in zip(b["path"], b["content"], strict=True):
                for name, inner in members(path_, bytes(content), (".pcap", ".pcapng")):
                    rows = [(name, *p[:7], *a) for p in packets(inner) for a in p[7] or [(None, None)]]
                    if rows:
                        yield pd.DataFrame(rows, columns=columns)

    return _files(spark, path, "*.{pcap,pcapng,zip,tar,tar.gz,tgz}").mapInPandas(decoded, PACKETS)


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")


def members(path: str, content: bytes, endings: tuple[str, ...]) -> Iterator[tuple[str, bytes]]:
    """(name, content) of a file, or of the files with these endings inside an archive; broken archives have none."""
    if path.endswith(endings):
        yield path, content
        return
    try:
        if path.endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in sorted(z.namelist()):
                    if name.lower().endswith(endings):
                        yield f"{path}/{name}", z.read(name)
        elif path.endswith((".tar", ".tar.gz", ".tgz")):
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
                for m in t:
                    if m.isfile() and m.name.lower().endswith(endings):
                        yield f"{path}/{m.name}", t.extractfile(m).read()
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, zlib.error):
        return


def read_archived_csv(spark: SparkSession, path: str) -> DataFrame:
    """file, line, cells (header -> text) of every row of the CSV files in archives under path, each with its own header."""

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path_, content in zip(b["path"], b["content"], strict=True):
                for name, inner in members(path_, bytes(content), (".csv",)):
                    rows = csv.DictReader(io.StringIO(inner.decode("utf-8", "replace"), newline=""))
                    made = [(name, i, {k: v for k, v in r.items() if k and isinstance(v, str)}) for i, r in enumerate(rows)]
                    for at in range(0, len(made), 4096):
                        yield pd.DataFrame(made[at : at + 4096], columns=["file", "line", "cells"])

    return _files(spark, path, "*.{zip,tar,tar.gz,tgz}").mapInPandas(decoded, "file string, line long, cells map<string, string>")


def archived_observations(rows: DataFrame, site_id: str, dataset: str) -> DataFrame:
    """Observations of rows of archived CSV files (file, line, cells), whose headers vary from file to file.

    Headers are matched once for each file, by the same names as those of plain logs. Rows without an endpoint, a port or a time
    are dropped, as are files without such columns. The device is the row's, else its address, else its device type.
    """
    headers = rows.groupBy("file").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("cells"))))).alias("names"))

    def header(meaning: str):
        forms = (lambda c: c, F.lower, lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", ""))

        def found(form, name: str):
            return F.get(F.filter("names", lambda k: form(k) == form(F.lit(name))), F.lit(0))

        return F.coalesce(*(found(f, n) for f in forms for n in ALIASES[meaning])).alias(f"h_{meaning}")

    known = headers.select("file", *map(header, ALIASES)).where("h_timestamp is not null and coalesce(h_dst_ip, h_hostname) is not null")

    def get(meaning: str):
        return F.expr(f"cells[h_{meaning}]")

    folder = F.element_at(F.split("file", "/"), -2)
    kind, host = F.coalesce(optional(get("device")), folder), clean_host(get("hostname"))
    found = rows.join(known, "file").select(
        F.lit(site_id).alias("site_id"), F.coalesce(optional(get("device_id")), optional(get("src_ip")), kind).alias("device_id"), kind.alias("device_type"), host.alias("fqdn"), clean_address(get("dst_ip")).alias("remote_ip"), protocol_name(get("protocol")).alias("protocol"),
        lenient_int(get("dst_port")).alias("port"), epoch_or_iso(get("timestamp")).alias("timestamp"), F.lit(dataset).alias("source_dataset"), F.when(host.isNotNull(), "flow+hostname").otherwise("flow").alias("evidence_type"), F.lit(False).alias("response_observed"), F.lit("out").alias("direction"),
    )
    return found.where(F.coalesce("fqdn", "remote_ip").isNotNull() & (F.col("port") > 0) & F.col("timestamp").isNotNull())


def device_mapping(spark: SparkSession, path: str) -> DataFrame:
    """ip, device of a table of `name,address` rows without a header; rows without a name or a valid address are left out."""
    rows = spark.read.schema("name string, ip string").csv(path).select(F.trim("ip").alias("ip"), F.trim("name").alias("device"))
    return rows.where((F.col("device") != "") & is_address("ip")).groupBy("ip").agg(F.max("device").alias("device"))


def read_mapped_captures(spark: SparkSession, path: str, devices: DataFrame, site_id: str, dataset: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Observations of captures in which several devices are known by their addresses (devices: ip, device).

    What a known device sends to a usable port counts once a second, with the name that the capture last gave the peer. Peers
    without a name must be global addresses. Device types are the devices' canonical names.
    """
    rows = read_packets(spark, path)
    answers = rows.where("answer_ip is not null").select("path", "packet", F.col("answer_ip").alias("remote_ip"), F.col("answer_name").alias("name"), F.lit(0).alias("sent"))
    sent = rows.join(devices.withColumnRenamed("ip", "src_ip"), "src_ip").where("dst_port > 0").select("path", "packet", F.col("dst_ip").alias("remote_ip"), "seconds", "protocol", F.col("dst_port").alias("port"), F.col("src_ip").alias("device_id"), "device").distinct().withColumn("sent", F.lit(1))
    known = F.last("name", ignorenulls=True).over(Window.partitionBy("path", "remote_ip").orderBy("packet", "sent").rowsBetween(Window.unboundedPreceding, 0))
    named = sent.unionByName(answers, allowMissingColumns=True).withColumn("fqdn", clean_host(known)).where("sent = 1").dropDuplicates(["path", "device_id", "remote_ip", "protocol", "port", "seconds"])
    return named.where(F.col("fqdn").isNotNull() | is_global("remote_ip")).select(
        F.lit(site_id).alias("site_id"), "device_id", canonical_device("device", aliases).alias("device_type"), "fqdn", "remote_ip", "protocol", "port", F.timestamp_seconds("seconds").alias("timestamp"), F.lit(dataset).alias("source_dataset"),
        F.when(F.col("fqdn").isNotNull(), "flow+dns_answer").otherwise("flow").alias("evidence_type"), F.lit(False).alias("response_observed"), F.lit("out").alias("direction"),
    )


def read_captures(spark: SparkSession, path: str, site_id: str, dataset: str) -> DataFrame:
    """Observations of all captures under path: the device type is the folder, the device the busiest private address."""
    rows = read_packets(spark, path)
    ends = rows.select("path", "packet", F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct().where(in_blocks("ip", PRIVATE))
    seen = ends.groupBy("path", "ip").agg(F.count("*").alias("n"), F.min("packet").alias("first"))
    device = seen.groupBy("path").agg(F.min_by("ip", F.struct(-F.col("n"), "first")).alias("device_id"))
    answers = rows.where("answer_ip is not null").select("path", "packet", F.col("answer_ip").alias("remote_ip"), F.col("answer_name").alias("name"), F.lit(0).alias("sent"))
    sent = rows.join(device, "path").where(F.col("src_ip") == F.col("device_id")).select("path", "packet", F.col("dst_ip").alias("remote_ip"), "seconds", "protocol", F.col("dst_port").alias("port"), "device_id").where("port > 0").distinct().withColumn("sent", F.lit(1))
    merged = sent.unionByName(answers, allowMissingColumns=True)
    known = F.last("name", ignorenulls=True).over(Window.partitionBy("path", "remote_ip").orderBy("packet", "sent").rowsBetween(Window.unboundedPreceding, 0))
    named = merged.withColumn("fqdn", clean_host(known)).where("sent = 1").dropDuplicates(["path", "remote_ip", "protocol", "port", "seconds"])
    return named.select(
        F.lit(site_id).alias("site_id"), "device_id", F.element_at(F.split("path", "/"), -2).alias("device_type"), "fqdn", "remote_ip", "protocol", "port", F.timestamp_seconds("seconds").alias("timestamp"), F.lit(dataset).alias("source_dataset"),
        F.when(F.col("fqdn").isNotNull(), "flow+dns").otherwise("flow").alias("evidence_type"), F.lit(False).alias("response_observed"), F.lit("out").alias("direction"),
    )
