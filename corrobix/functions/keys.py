"""Column expressions for cleaning names, addresses and protocols, and for the key of a fact."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A fact: what a type of device talks to.
KEY = ("device_type", "endpoint", "protocol", "port")

# IPv4 blocks that are not globally reachable (RFC 6890).
NON_GLOBAL = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/8", "240.0.0.0/4")
UPDATE_WORDS = ("update", "upgrade", "firmware", "ota", "fw.", "-fw", "swupdate")
# Labels below which countries register names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "go", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
ELIGIBLE_CLASSES = ("dns", "ntp", "update", "vendor-cloud")
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
# IP protocol numbers and the transports of common applications.
PROTOCOL_NUMBERS = {"1": "icmp", "2": "igmp", "6": "tcp", "17": "udp", "58": "icmpv6"}
TRANSPORT = {"https": "tcp", "http": "tcp", "tls": "tcp", "ssl": "tcp", "mqtt": "tcp", "dns": "udp", "ntp": "udp", "mdns": "udp", "ssdp": "udp", "dhcp": "udp"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def optional(c: Column | str) -> Column:
    """Trimmed text; empty is null."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def flag(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(c))).isin("true", "1", "yes"), F.lit(False))


def lenient_int(c: Column | str) -> Column:
    """Whole part of a number in text, 0 where it is none."""
    return F.coalesce(F.expr(f"try_cast(try_cast({c} AS DOUBLE) AS INT)") if isinstance(c, str) else col(c).try_cast("double").try_cast("int"), F.lit(0))


def epoch_or_iso(c: Column | str) -> Column:
    """Timestamp of ISO text, or of epoch seconds, or milliseconds above 1e10."""
    number = col(c).try_cast("double")
    return F.when(number.isNotNull(), F.timestamp_micros((F.when(F.abs(number) > 1e10, number / 1000).otherwise(number) * 1_000_000).cast("long"))).otherwise(F.try_to_timestamp(col(c)))


def endpoint(fqdn: Column | str = "fqdn", remote_ip: Column | str = "remote_ip") -> Column:
    return F.lower(F.coalesce(F.nullif(col(fqdn), F.lit("")), F.nullif(col(remote_ip), F.lit(""))))


def key_string(*cols: str) -> Column:
    return F.concat_ws("|", *(F.col(c).cast("string") for c in cols or KEY))


def is_ipv4(c: Column | str) -> Column:
    return col(c).rlike(_IPV4)


def ipv4_number(c: Column | str) -> Column:
    """The address as a number; null if it is none."""
    parts = F.split(col(c), r"\.")
    return F.when(is_ipv4(c), sum((F.element_at(parts, i + 1).cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("long")))


def cidr_bounds(cidr: str) -> tuple[int, int]:
    address, _, bits = cidr.partition("/")
    size = 1 << 32 - int(bits or 32)
    low = sum(int(x) * 256 ** (3 - i) for i, x in enumerate(address.split("."))) // size * size
    return low, low + size - 1


def in_blocks(c: Column | str, blocks: tuple[str, ...]) -> Column:
    bounds = [cidr_bounds(b) for b in blocks]
    inside = F.exists(F.array(ipv4_number(c)), lambda n: reduce(or_, (n.between(low, high) for low, high in bounds)))  # the number is worked out once
    return F.coalesce(inside, F.lit(False))


def is_ipv6(c: Column | str) -> Column:
    """Eight groups, or fewer with one double colon; a zone or an embedded IPv4 tail is allowed as in other parsers."""
    text = F.regexp_replace(F.lower(col(c)), r"%.*$", "")
    text = F.regexp_replace(text, r":(\d{1,3}\.){3}\d{1,3}$", ":0:0")
    groups = F.size(F.filter(F.split(text, ":"), lambda x: x != ""))
    plain = text.rlike(r"^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$")
    short = text.rlike(r"^(([0-9a-f]{1,4})(:[0-9a-f]{1,4})*)?::(([0-9a-f]{1,4})(:[0-9a-f]{1,4})*)?$") & (groups <= 7)
    return F.coalesce(plain | short, F.lit(False))


def ipv6_groups(c: Column | str) -> Column:
    """The address as eight numbers of 16 bits; null if it is none."""
    text = F.regexp_replace(F.lower(col(c)), r"%.*$", "")
    tail = [F.regexp_extract(text, r":(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int") for i in range(1, 5)]
    text = F.when(tail[0].isNotNull(), F.concat(F.regexp_replace(text, r"(\d{1,3}\.){3}\d{1,3}$", ""), F.hex(tail[0] * 256 + tail[1]), F.lit(":"), F.hex(tail[2] * 256 + tail[3]))).otherwise(text)
    sides = [F.filter(F.split(F.substring_index(text, "::", i), ":"), lambda x: x != "") for i in (1, -1)]
    full = F.when(F.contains(text, F.lit("::")), F.concat(sides[0], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(sides[0]) - F.size(sides[1]))), sides[1])).otherwise(F.split(text, ":"))
    return F.when(is_ipv6(c), F.transform(full, lambda x: F.conv(x, 16, 10).cast("int")))


def _global_ipv6(c: Column | str) -> Column:
    """Not in the blocks of RFC 6890 and its successors that are not globally reachable."""

    def mapped(n: Column) -> Column:
        return reduce(or_, (n.between(*cidr_bounds(b)) for b in NON_GLOBAL))

    def blocked(g: Column) -> Column:
        a, b, rest = g[0], g[1], F.slice(g, 1, 6)
        zeros = F.forall(rest, lambda x: x == 0)
        return (
            (zeros & (g[6] == 0) & (g[7] <= 1)) | (F.forall(F.slice(g, 1, 5), lambda x: x == 0) & (g[5] == 0xFFFF) & mapped(g[6].cast("long") * 65536 + g[7])) | ((a == 0x64) & (b == 0xFF9B) & (g[2] == 1)) | ((a == 0x100) & F.forall(F.slice(g, 2, 3), lambda x: x == 0))
            | ((a == 0x2001) & (b < 0x200) & ~((b == 1) & (g[7] <= 3) & F.forall(F.slice(g, 3, 5), lambda x: x == 0)) & (b != 3) & ~((b == 4) & (g[2] == 0x112)) & ~b.between(0x20, 0x3F)) | ((a == 0x2001) & (b == 0xDB8))
            | (a == 0x2002) | a.between(0xFC00, 0xFDFF) | a.between(0xFE80, 0xFEBF)
        )

    return F.coalesce(F.exists(F.array(ipv6_groups(c)), lambda g: ~blocked(g)), F.lit(False))


def is_address(c: Column | str) -> Column:
    return is_ipv4(c) | is_ipv6(c)


def is_global(c: Column | str) -> Column:
    return F.when(is_ipv4(c), ~in_blocks(c, NON_GLOBAL)).otherwise(_global_ipv6(c))


def keeps_global(fqdn: str = "fqdn", remote_ip: str = "remote_ip") -> Column:
    """Row filter: drop rows known only by an address that is not globally reachable."""
    name = F.coalesce(F.col(fqdn), F.lit(""))
    only_address = F.col(fqdn).isNull() | is_address(name) | is_address(F.regexp_replace(name, r":[0-9]+$", ""))
    return ~(only_address & F.col(remote_ip).isNotNull() & ~is_global(remote_ip))


def service_class(endpoint_: str = "endpoint", protocol: str = "protocol", port: str = "port") -> Column:
    """dns, ntp, update, vendor-cloud or other; addresses that are not global are other before anything else."""
    e = F.col(endpoint_)
    word = F.lit(False)
    for w in UPDATE_WORDS:
        word = word | F.contains(F.lower(e), F.lit(w))
    return (
        F.when(is_address(e) & ~is_global(e), "other")
        .when((F.lower(protocol) == "dns") | (F.col(port) == 53), "dns")
        .when((F.lower(protocol) == "ntp") | (F.col(port) == 123), "ntp")
        .when(~is_address(e) & word, "update")
        .when(~is_address(e), "vendor-cloud")
        .otherwise("other")
    )


def admitted(theta: float, quorum: int, score: str = "score", cls: str = "endpoint_class", support: str = "supporting_sites", disputed: Column | None = None) -> Column:
    """Enough sites (not asked of facts whose support is unknown), a class that may be admitted, enough score, no open dispute."""
    enough = F.coalesce(F.col(support) >= quorum, F.lit(True)) & F.col(cls).isin(*ELIGIBLE_CLASSES) & (F.col(score) >= theta)
    return enough if disputed is None else enough & ~F.coalesce(disputed, F.lit(False))


def blocked_reason(theta: float, quorum: int, disputed: Column | None = None) -> Column:
    """The conjuncts of admission that fail, joined by +."""
    open_ = F.when(F.lit(False) if disputed is None else F.coalesce(disputed, F.lit(False)), "dispute")
    return F.concat_ws("+", open_, F.when(F.col("supporting_sites") < quorum, "quorum"), F.when(~F.col("endpoint_class").isin(*ELIGIBLE_CLASSES), "class"), F.when(F.col("score") < theta, "score"))


def protocol_name(c: Column | str) -> Column:
    """Protocol numbers as names, lower case."""
    low = F.lower(F.trim(col(c)))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PROTOCOL_NUMBERS.items() for x in kv)), low), low)


def transport(c: Column | str) -> Column:
    low = protocol_name(c)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TRANSPORT.items() for x in kv)), low), low)


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean_host(c: Column | str) -> Column:
    """Lower-case host without outer dots; null if it holds a slash or white space."""
    host = F.lower(F.regexp_replace(F.trim(col(c)), r"^\.+|\.+$", ""))
    return F.when((host != "") & ~host.rlike(r"[/\s]"), host)


def clean_address(c: Column | str) -> Column:
    """Unspecified, loopback, multicast and broadcast addresses are null."""
    g = ipv6_groups(c)
    v6 = F.exists(F.array(g), lambda x: (x[0] < 0xFF00) & ~(F.forall(F.slice(x, 1, 7), lambda y: y == 0) & (x[7] <= 1)))
    v4 = is_ipv4(c) & ~in_blocks(c, ("0.0.0.0/32", "127.0.0.0/8", "224.0.0.0/4", "255.255.255.255/32"))
    return F.when(v4 | F.coalesce(v6, F.lit(False)), col(c))


def registered_domain(c: Column | str, second_level: tuple[str, ...] = SECOND_LEVEL) -> Column:
    """The registrable part of a host name: two labels, three below a country's second-level suffix; addresses stay.

    The suffixes follow a rule, one of `second_level` before a label of two letters; a table of public suffixes, where there is
    one, can be joined instead.
    """
    name = F.lower(col(c))
    labels = F.split(name, r"\.")
    deep = (F.size(labels) >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(F.concat(F.array(F.lit("")), labels), -2).isin(*second_level)
    return F.when(is_address(c), col(c)).when(deep, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def representable(endpoint_: str = "endpoint", protocol: str = "protocol", protocols: tuple[str, ...] = ("tcp", "udp", "https", "http", "dns", "ntp")) -> Column:
    """Facts that a policy can state: a name, not an address, and a protocol of the list."""
    return F.col(endpoint_).isNotNull() & ~is_address(endpoint_) & F.lower(protocol).isin(*protocols)


def response_legs(observations, key: tuple[str, ...] = KEY):
    """Distinct facts of device-initiated rows with an observed response."""
    return observations.where((F.col("direction") == "out") & F.col("response_observed")).select(*key).distinct()


def canonical_device(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """A device name as written in policies: slug without file ending, then an alias table."""
    name = slug(F.regexp_replace(col(c), r"(?i)\.(json|csv|txt)$", ""))
    if not aliases:
        return name
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)), name), name)
