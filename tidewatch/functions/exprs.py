"""Column expressions that the operators share. All are built-in Spark expressions."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("info", "low", "medium", "high", "critical")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; null and empty texts have 0."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda d: d == c)) / n
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits).otherwise(0.0)


def ipv4_number(ip: Column) -> Column:
    """A dotted address as a number; null for anything else."""
    parts = F.split(ip, r"\.")
    value = reduce(lambda a, i: a * 256 + parts[i].cast("long"), range(4), F.lit(0).cast("long"))
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), value)


def ipv6_hex(ip: Column) -> Column:
    """An IPv6 address as 32 hex digits, so that ranges compare as text; null for anything else."""
    ends = F.split(F.lower(ip), "::")
    words = lambda c: F.filter(F.split(c, ":"), lambda w: w != "")
    head, tail = words(ends[0]), F.when(F.size(ends) > 1, words(ends[1])).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(head) - F.size(tail)))
    return F.when(ip.contains(":"), F.array_join(F.transform(F.concat(head, zeros, tail), lambda w: F.lpad(w, 4, "0")), ""))


def cidr_bounds(cidr: str) -> tuple[int | None, int | None, str | None, str | None]:
    """First and last address of a range: as numbers for IPv4, as hex digits for IPv6."""
    net = ipaddress.ip_network(cidr)
    lo, hi = int(net.network_address), int(net.broadcast_address)
    return (lo, hi, None, None) if net.version == 4 else (None, None, f"{lo:032x}", f"{hi:032x}")


def nearest_rank(values: Column, percent: int) -> Column:
    """Element floor(n * percent / 100) of the sorted values, the last one at most."""
    sorted_ = F.array_sort(values)
    return F.get(sorted_, F.least(F.floor(F.size(values) * percent / 100).cast("int"), F.size(values) - 1))


def z_score(value: Column, mean: Column, sigma: Column) -> Column:
    """Standard deviations from the mean; 0 where there is no spread."""
    return F.when(sigma > 0, F.abs(value - mean) / sigma).otherwise(0.0)


def ladder(value: Column, edges: tuple[float, ...]) -> Column:
    """The number of edges that the value reaches: its bin."""
    return reduce(lambda a, e: a + F.when(value >= e, 1).otherwise(0), edges, F.lit(0))


def is_broadcast(ip: Column) -> Column:
    """Broadcast or multicast: ends in 255, or starts with 224 to 239."""
    return ip.endswith(".255") | F.split(ip, r"\.")[0].cast("int").between(224, 239)


def url_decoded(text: Column) -> Column:
    """Percent escapes and + decoded; malformed input stays as it is."""
    return F.coalesce(F.try_url_decode(text), text)


def flow_key(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, protocol: Column) -> Column:
    """The same key for both directions of a flow."""
    a, b = F.concat_ws(":", src_ip, src_port), F.concat_ws(":", dst_ip, dst_port)
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b), protocol)


def severity_norm(severity: Column) -> Column:
    """Lower case without blanks; null is medium."""
    return F.lower(F.trim(F.coalesce(severity, F.lit("medium"))))


def severity_rank(severity: Column) -> Column:
    """info 0 to critical 4; unknown values count as medium."""
    return reduce(lambda a, s: F.when(severity == s[1], s[0]).otherwise(a), enumerate(SEVERITIES), F.lit(2))


def is_actionable(severity: Column) -> Column:
    """Everything but info; unknown values too."""
    return severity_norm(severity) != "info"


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Name of the first (name, pattern) that the text matches."""
    chain = F.lit(default).cast("string")
    for name, pattern in reversed(rules):
        chain = F.when(text.rlike(pattern), F.lit(name)).otherwise(chain)
    return chain


def clip_label(text: Column, length: int = 64) -> Column:
    return F.substring(text, 1, length)


def ja4(version: Column, ciphers: Column, extensions: Column, sni: Column, alpn: Column) -> Column:
    """Client fingerprint: a prefix and two digests of 12 hex digits, lists in the order they came, extensions 0 and 16 left out."""
    hexed = lambda a: F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), ",")
    kept = F.filter(extensions, lambda x: ~x.isin(0, 16))
    count = lambda a: F.lpad(F.least(F.size(a), F.lit(99)).cast("string"), 2, "0")
    tls = F.when(version == 772, "13").when(version == 771, "12").when(version == 770, "11").otherwise("10")
    name = F.when(F.length(sni) > 0, "d").otherwise("i")
    app = F.when(F.length(alpn) > 0, F.concat(F.substring(alpn, 1, 1), F.substring(alpn, -1, 1))).otherwise("00")
    digest = lambda a: F.substring(F.sha2(hexed(a), 256), 1, 12)
    return F.concat_ws("_", F.concat(F.lit("t"), tls, name, count(ciphers), count(extensions), app), digest(ciphers), digest(kept))
