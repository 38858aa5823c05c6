import struct

import pytest

from corrobix.sources.captures import dns_answers, packets, read_captures


def frame(src, dst, kind, sport, dport, body=b""):
    transport = struct.pack(">HHHH", sport, dport, 8 + len(body), 0) + body
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(transport), 0, 0, 64, kind, 0, bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
    return b"\0" * 12 + b"\x08\x00" + ip + transport


def capture(*frames, order="<"):
    out = struct.pack(order + "IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for seconds, f in frames:
        out += struct.pack(order + "IIII", seconds, 0, len(f), len(f)) + f
    return out


def answer(name, ip):
    q = b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0"
    return struct.pack(">HHHHHH", 1, 0x8180, 1, 1, 0, 0) + q + struct.pack(">HH", 1, 1) + b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + bytes(map(int, ip.split(".")))


def test_names_come_from_earlier_answers(spark, tmp_path):
    (tmp_path / "camera").mkdir()
    me, far = "192.168.1.5", "8.8.4.4"
    data = capture((100, frame(me, far, 17, 5000, 443)), (101, frame("192.168.1.1", me, 17, 53, 5001, answer("Api.Example.com", far))), (102, frame(me, far, 17, 5000, 443)), (102, frame(me, far, 17, 5002, 443)), (103, frame(far, me, 17, 443, 5000)))
    (tmp_path / "camera" / "a.pcap").write_bytes(data)
    (tmp_path / "camera" / "broken.pcap").write_bytes(b"nothing")
    rows = sorted((r.fqdn, r.remote_ip, r.port, r.device_type, r.device_id) for r in read_captures(spark, str(tmp_path), "s", "unit").collect() if r.fqdn)
    assert rows == [("api.example.com", far, 443, "camera", me)]
    assert read_captures(spark, str(tmp_path), "s", "unit").where("fqdn is null").count() == 1


def test_guards():
    good = frame("10.0.0.1", "8.8.8.8", 6, 1, 2)
    assert len(list(packets(capture((1, good), order=">")))) == 1
    assert list(packets(capture((1, good))[:-3])) == [] and list(packets(b"")) == []
    huge = capture((1, good))[:24] + struct.pack("<IIII", 1, 0, 1 << 30, 1 << 30) + good
    with pytest.raises(ValueError, match="bytes"):
        list(packets(huge))
    loop = struct.pack(">HHHHHH", 1, 0x8180, 1, 1, 0, 0) + b"\xc0\x0c" * 20
    assert dns_answers(loop) == []


def block(kind, body, order="<"):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))


@pytest.mark.parametrize("order", ["<", ">"])
def test_next_generation_captures(order):
    """Byte order of the section, clock of the interface, blocks of other kinds and links."""
    good = frame("10.0.0.1", "8.8.8.8", 6, 1, 2)
    section = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)
    plain = block(1, struct.pack(order + "HHI", 1, 0, 0), order)
    fine = block(1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HHB3x", 9, 1, 9) + struct.pack(order + "HH", 0, 0), order)
    radio = block(1, struct.pack(order + "HHI", 105, 0, 0), order)

    def packet(which, ticks):
        return block(6, struct.pack(order + "IIIII", which, ticks >> 32, ticks & 0xFFFFFFFF, len(good), len(good)) + good, order)

    data = section + plain + fine + radio + block(5, b"\0" * 12, order) + packet(0, 7_000_000) + packet(1, 9_000_000_000) + packet(2, 1) + packet(3, 1)
    assert [p[1] for p in packets(data)] == [7, 9]
    assert [p[1] for p in packets(data[:-5] + b"")] == [7, 9] and list(packets(section[:20])) == []
    with pytest.raises(ValueError, match="bytes"):
        list(packets(section + struct.pack(order + "III", 6, 1 << 30, 0)))
