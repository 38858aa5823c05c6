"""Names for what devices send, from DNS answers met earlier in the same capture, over a stream of packets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

NAMED = "path string, packet long, seconds long, device_id string, remote_ip string, protocol string, port int, name string"


class _Names(StatefulProcessor):
    """Per capture: packets that wait for the watermark, by number, and the latest name of each address.

    Rows come in any order within the delay. A timer for each second fires once the watermark has passed it; what waits until
    then goes in order of packets, a send before the answers of its own packet would be met.
    """

    def __init__(self, keeps: int | None):
        self.keeps = keeps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "packet long", "seconds long, sent string, answers string")
        self.names = handle.getMapState("names", "ip string", "name string, seconds long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for packet, own in batch.groupby("packet"):
                first = own.iloc[0]
                sent = [first.device_id, first.dst_ip, first.protocol, int(first.dst_port)] if first.src_ip == first.device_id else None
                answers = [[r.answer_ip, r.answer_name] for r in own.itertuples() if isinstance(r.answer_ip, str)]
                if self.waiting.containsKey((int(packet),)):  # the rest of a packet that came apart
                    old = self.waiting.getValue((int(packet),))
                    answers = json.loads(old[2]) + [a for a in answers if a not in json.loads(old[2])]
                self.waiting.updateValue((int(packet),), (int(first.seconds), json.dumps(sent), json.dumps(answers)))
                self.handle.registerTimer(int(first.seconds) * 1000)
        yield pd.DataFrame(columns=[c.split()[0] for c in NAMED.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = expiredTimerInfo.getExpiryTimeInMs() // 1000
        ready = sorted((k[0], v) for k, v in self.waiting.iterator() if v[0] <= limit)
        out = []
        for packet, (seconds, sent, answers) in ready:
            for ip, name in json.loads(answers):
                self.names.updateValue((ip,), (name, seconds))
            if (own := json.loads(sent)) is not None:
                device, remote, protocol, port = own
                known = self.names.getValue((remote,)) if self.names.containsKey((remote,)) else None
                name = known[0] if known and (self.keeps is None or seconds - known[1] <= self.keeps) else None
                out.append((key[0], packet, seconds, device, remote, protocol, port, name))
            self.waiting.removeKey((packet,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in NAMED.split(", ")])


def named_packets(stream: DataFrame, devices: DataFrame, delay: str = "60 seconds", keeps: int | None = None) -> DataFrame:
    """What each capture's device sends, with the name that the capture last gave the address up to that packet.

    stream: rows of `captures.PACKETS`; devices: path, device_id, a static table. Rows may come in any order within the delay;
    later ones are dropped. `keeps`: seconds after which a name is forgotten. State holds a capture's packets of the delay and
    its names; it needs the RocksDB state store.
    """
    rows = stream.join(devices.select("path", "device_id"), "path").withColumn("at", F.timestamp_seconds("seconds")).withWatermark("at", delay)
    return rows.groupBy("path").transformWithStateInPandas(_Names(keeps), NAMED, "append", "eventTime")
