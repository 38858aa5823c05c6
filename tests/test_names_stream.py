"""The streamed names against the window over whole captures, on micro-batches in any order."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corrobix.sources.captures import PACKETS
from corrobix.streaming import names, windows


def packet_rows(seed):
    rng, rows = random.Random(seed), []
    for path in ("/c/cam/a.pcap", "/c/tv/b.pcap"):
        seconds = 1000
        for packet in range(60):
            seconds += rng.choice((0, 0, 1, 3))
            if rng.random() < 0.3:
                for ip in rng.sample(["8.8.4.1", "8.8.4.2", "8.8.4.3"], rng.randrange(1, 3)):
                    rows.append((path, packet, seconds, "192.168.0.1", "192.168.0.9", "udp", 53, 5000, f"n{rng.randrange(4)}.example.com", ip))
            else:
                src, dst = ("192.168.0.9", f"8.8.4.{rng.randrange(1, 5)}") if rng.random() < 0.8 else ("8.8.4.1", "192.168.0.9")
                rows.append((path, packet, seconds, src, dst, "tcp", 40000, 443, None, None))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_names_equal_the_window(spark, tmp_path, seed):
    rows = packet_rows(seed)
    packets = spark.createDataFrame(rows, PACKETS)
    devices = spark.createDataFrame([("/c/cam/a.pcap", "192.168.0.9"), ("/c/tv/b.pcap", "192.168.0.9")], "path string, device_id string")
    answers = packets.where("answer_ip is not null").select("path", "packet", F.col("answer_ip").alias("ip"), F.col("answer_name").alias("name"), F.lit(0).alias("sent"))
    sends = packets.where("src_ip = '192.168.0.9'").select("path", "packet", F.col("dst_ip").alias("ip"), F.lit(None).cast("string").alias("name"), F.lit(1).alias("sent"))
    known = F.last("name", ignorenulls=True).over(Window.partitionBy("path", "ip").orderBy("packet", "sent"))
    want = sorted(tuple(r) for r in answers.unionByName(sends).withColumn("name", F.coalesce(known, F.lit(""))).where("sent = 1").select("path", "packet", "ip", "name").collect())

    rng = random.Random(seed)
    parts = [rows[i::4] for i in range(4)]
    rng.shuffle(parts)
    parts.append([(p, 10_000, 9_000, "1.1.1.1", "2.2.2.2", "tcp", 1, 1, None, None) for p in ("/c/cam/a.pcap", "/c/tv/b.pcap")])  # time goes on
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = tmp_path / "in"
    source.mkdir()
    try:
        stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        named = names.named_packets(stream, devices, delay="600 seconds")
        q = named.writeStream.format("memory").queryName(f"named{seed}").option("checkpointLocation", str(tmp_path / "c")).start()
        for part in parts:
            spark.createDataFrame(part, PACKETS).coalesce(1).write.mode("append").parquet(str(source))
            q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted((r.path, r.packet, r.remote_ip, r["name"] or "") for r in spark.table(f"named{seed}").collect())
    assert got == want


def test_once_a_second_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"d{i % 3}", f"2026-01-01 00:00:{i % 7:02d}.{i}00") for i in range(1, 60) if i % 10], "seq long, device string, at string").select("seq", "device", F.col("at").cast("timestamp").alias("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windows.once_a_second(stream, ("device",)).writeStream.format("memory").queryName("seconds").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("seconds").select("device", "timestamp").collect()
    assert sorted(got) == sorted(rows.select("device", F.date_trunc("second", "timestamp").alias("timestamp")).distinct().collect())
