"""Stateless detectors: one scan, one array of conditional rows, one explode.

A rule is a predicate with what it reports. ``detect`` emits every rule that holds; ``detect_first`` the first one only, for
chains where an earlier hit hides the later ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import entropy, url_decoded
from ..sources.reference import OVERRIDE_HEADERS, PROXY_HEADERS, SCRIPT_ENDINGS, SENSITIVE_PATHS, SERVICES, WEB_FOLDERS, WEB_SIGNATURES
from .parse import chunked_body, multipart, normalise

PATTERN = {name: pattern for name, pattern, _ in WEB_SIGNATURES}


@dataclass
class Rule:
    attack_type: str
    severity: str
    where: Column
    confidence: Column | float = 0.5

    def hit(self) -> Column:
        score = self.confidence if isinstance(self.confidence, Column) else F.lit(float(self.confidence))
        return F.when(self.where, F.struct(F.lit(self.attack_type).alias("attack_type"), F.lit(self.severity).alias("severity"), score.cast("double").alias("confidence")))


def detect(df: DataFrame, rules: list[Rule], source: str = "src_ip") -> DataFrame:
    """event_id, ts, source_ip, attack_type, severity, confidence of every rule that holds."""
    hits = F.filter(F.array(*[r.hit() for r in rules]), lambda h: h.isNotNull())
    return df.select("event_id", "ts", F.col(source).alias("source_ip"), F.explode(hits).alias("h")).select("event_id", "ts", "source_ip", "h.*")


def detect_first(df: DataFrame, rules: list[Rule], source: str = "src_ip") -> DataFrame:
    """The first rule that holds, for each row with one.

    The hit passes through an array of one, so that the filter stays above and no decoded column is computed once a mention.
    """
    hit = F.explode(F.array(F.coalesce(*[r.hit() for r in rules])))
    rows = df.select("event_id", "ts", F.col(source).alias("source_ip"), hit.alias("h"))
    return rows.filter("h is not null").select("event_id", "ts", "source_ip", "h.*")


def _flags(*letters: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col("flags").contains(x) for x in letters])


def header_rules(tor_exits: tuple[str, ...] = (), bad_ports: tuple[int, ...] = (4444, 5555, 31337)) -> list[Rule]:
    """Rules on header columns of packets."""
    tcp, proto = F.col("protocol") == "tcp", F.col("protocol")
    sp, dp = F.col("src_port"), F.col("dst_port")
    low = (sp < 1024) & (dp < 1024) & (sp != dp)
    well_known = F.lit(False) | sp.isin(22, 80, 443) | dp.isin(22, 80, 443)
    return [
        Rule("null_scan", "medium", tcp & (F.col("flags") == "")),
        Rule("xmas_scan", "medium", tcp & (_flags("F", "S") | _flags("F", "U") | _flags("P", "U"))),
        Rule("invalid_tcp_flags", "medium", tcp & (F.col("flags").contains("FS") | F.col("flags").contains("FR") | F.col("flags").contains("SR"))),
        Rule("fragmentation_attack", "medium", (F.col("frag_offset") > 0) | F.col("more_fragments")),
        Rule("protocol_anomaly", "low", ~proto.isin("tcp", "udp", "icmp", "ipv6")),
        Rule("service_mismatch", "medium", tcp & (sp < 1024) & dp.isin(*SERVICES)),
        Rule("rare_port_pairing", "low", low & well_known),
        Rule("jumbo_frame", "low", F.col("raw_len") > 9000),
        Rule("slow_drip", "medium", _flags("P") & (F.col("payload_len") == 1)),
        Rule("icmp_tunnel", "high", (proto == "icmp") & (F.col("payload_len") > 500)),
        Rule("http_tunnel", "high", dp.isin(80, 443, 8080, 8443) & (F.col("payload_len") > 50000)),
        Rule("tor_traffic", "high", F.col("src_ip").isin(*tor_exits) if tor_exits else F.lit(False)),
        Rule("suspicious_port", "high", dp.isin(*bad_ports)),
        Rule("ttl_anomaly", "medium", F.col("ttl") < 64, F.least(0.3 + 0.01 * (64 - F.col("ttl")), F.lit(0.8))),
        Rule("suspicious_tls", "medium", F.col("tls_sni").contains(".onion"), 0.6),
        Rule("proxy_traffic", "low", F.col("http_uri").rlike("^(?i)https?://")),
    ]


def _sql(c: Column) -> Column:
    return c.rlike(PATTERN["sql_injection"])


def _xss(c: Column) -> Column:
    return c.rlike(PATTERN["xss"])


def _cmd(c: Column) -> Column:
    return c.rlike(PATTERN["command_injection"])


def _traversal(c: Column) -> Column:
    return c.rlike(PATTERN["path_traversal"])


def decoded_request(df: DataFrame) -> DataFrame:
    """``df`` with what the web chain reads decoded once: uri, body, cookie, forwarded header, parts of a chunked body, values of repeated parameters.

    All texts of a request are decoded by one expression over an array. Columns that a table of requests lacks (body,
    content_type) count as empty.
    """
    for name in ("body", "content_type"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(""))
    df = df.withColumn("body", F.coalesce("body", F.lit(""))).withColumn("_plain", F.when(F.col("chunked"), chunked_body(F.col("body"))))
    none = F.array().cast("array<string>")
    parts = F.when(F.col("_plain") != F.col("body"), multipart(F.coalesce("content_type", F.lit("")), F.col("_plain"))).otherwise(none)
    query = F.regexp_extract("http_uri", r"(?s)^[^?]*\?(.*)$", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(p.contains("="), F.regexp_replace(p, "(?s)^[^=]*=", "")).otherwise("").alias("v")))
    df = df.withColumn("_parts", F.coalesce(parts, none)).withColumn("_pairs", F.when(query.contains("&"), pairs))
    again = F.transform(F.filter("_pairs", lambda p: F.size(F.filter("_pairs", lambda q: q["k"] == p["k"])) > 1), lambda p: url_decoded(p["v"]))
    df = df.withColumn("_again", F.coalesce(again, none))
    texts = F.concat(F.array(*[F.coalesce(c, F.lit("")) for c in ("http_uri", "body", "cookie", "forwarded")]), "_parts", "_again")
    df = df.withColumn("_texts", F.transform(texts, lambda t: normalise(t)))
    own = {name: F.get("_texts", i) for i, name in enumerate(("_uri", "_body", "_cookie", "_forwarded"))}
    return df.withColumns(own | {"_hidden": F.slice("_texts", 5, F.size("_parts")), "_again": F.slice("_texts", F.size("_parts") + 5, F.size("_again"))})


def web_rules() -> list[Rule]:
    """The ordered chain over decoded requests: of several, the first counts; smuggling is tried last."""
    uri, body, agent, cookie, forwarded = F.col("_uri"), F.col("_body"), F.lower("user_agent"), F.col("_cookie"), F.col("_forwarded")
    bad = lambda c: _sql(c) | _xss(c) | _cmd(c)
    return [
        Rule("sql_injection", "critical", _sql(body) | _sql(uri), 0.9),
        Rule("xss_attempt", "high", _xss(body) | _xss(uri), 0.85),
        Rule("command_injection", "critical", _cmd(body) | _cmd(uri), 0.9),
        Rule("path_traversal", "high", _traversal(uri), 0.85),
        Rule("scanner_detected", "low", agent.rlike(PATTERN["scanner_signature"]) | uri.rlike(PATTERN["scanner_signature"]), 0.7),
        Rule("http_parameter_pollution", "high", F.exists("_again", bad), 0.85),
        Rule("cookie_injection", "high", _sql(cookie) | _xss(cookie), 0.85),
        Rule("header_injection", "high", _sql(forwarded) | _xss(forwarded) | _traversal(forwarded), 0.8),
        Rule("websocket_upgrade", "low", F.lower("upgrade") == "websocket", 0.3),
        Rule("bypass_encoding", "high", F.exists("_hidden", bad), 0.85),
        Rule("http_smuggling_cl_te", "critical", (F.col("n_content_length") > 0) & F.col("chunked"), 0.9),
        Rule("http_smuggling_dual_cl", "critical", F.col("n_content_length") > 1, 0.85),
    ]


def web_attacks(requests: DataFrame) -> DataFrame:
    """The first rule of the web chain that holds, for each request with one."""
    return detect_first(decoded_request(requests), web_rules())


def host_rules() -> list[Rule]:
    """Exec, connect, open and kill events, each kind in order."""
    kind, name, args = F.col("event_kind"), F.lower("filename"), F.lower("args")
    shell = name.contains("/bin/sh") | name.contains("/bin/bash")
    some = lambda c, words: reduce(lambda a, w: a | c.contains(w), words, F.lit(False))
    run, link, read = kind == "exec", kind == "connect", kind == "open"
    opened = [Rule(attack, severity, read & name.contains(path), 0.8 if severity == "high" else 0.6) for path, attack, severity in SENSITIVE_PATHS]
    return [
        Rule("reverse_shell", "critical", run & shell & some(args, ["/dev/tcp", "bash -i", "sh -i", "nc -e", "ncat"]), 0.9),
        Rule("download_execute", "high", run & shell & some(args, ["wget", "curl"]) & some(args, ["|sh", "|bash", ">"]), 0.85),
        Rule("privilege_escalation_attempt", "medium", run & shell & args.contains("sudo") & (F.col("uid") != 0), 0.7),
        Rule("reverse_shell", "critical", run & name.contains("nc") & some(args, ["-e", "--exec"]), 0.9),
        Rule("reverse_shell", "high", run & name.contains("python") & some(args, ["socket", "subprocess", "os.system", "pty.spawn"]), 0.8),
        Rule("suspicious_connection", "high", link & F.col("dst_port").isin(4444, 5555, 31337, 1337, 6667), 0.8),
        Rule("high_port_connection", "medium", link & (F.col("dst_port") > 10000) & (F.col("protocol") == "TCP"), 0.5),
        Rule("external_ssh", "low", link & (F.col("dst_port") == 22), 0.4),
        *opened,
        Rule("webshell_creation", "critical", read & some(name, WEB_FOLDERS) & some(name, SCRIPT_ENDINGS), 0.8),
        Rule("process_termination", "low", kind == "kill", 0.4),
    ]


def tunnel_rules() -> list[Rule]:
    """Tunnels in http, on payload_text and payload_len: large payloads, tunnel headers, binary content."""
    line = lambda p: F.coalesce(F.col("payload_text").rlike(r"(?im)^" + p), F.lit(False))
    large = F.coalesce(F.col("payload_len") > 50_000, F.lit(False))
    return [
        Rule("http_tunnel", "medium", large),
        Rule("http_tunnel", "high", ~large & line(r"[^\r\n]*(x-tunnel|proxy-authorization|proxy-connection)")),
        Rule("http_tunnel", "high", ~large & ~line(r"[^\r\n]*(x-tunnel|proxy-authorization|proxy-connection)") & line(r"content-type:[^\r\n]*application/octet-stream")),
    ]


def override_injection(requests: DataFrame) -> DataFrame:
    """Requests one of whose override headers (OVERRIDE_HEADERS, in ``headers``, a map of any case) holds SQL, script or a path upwards once decoded."""
    texts = F.transform(F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]).isin(*OVERRIDE_HEADERS)), lambda e: normalise(e["value"]))
    # an array of one, so that headers are decoded once a row
    rows = requests.withColumn("_x", F.explode(F.array(texts))).filter(F.exists("_x", lambda t: _sql(t) | _xss(t) | _traversal(t)))
    return detect(rows, [Rule("header_injection", "high", F.lit(True), 0.8)])


def proxy_headers(packets: DataFrame, at_least: int = 3) -> DataFrame:
    """Packets with a proxy header (``payload_text``) once their source has sent ``at_least`` such headers; a packet counts up to the one that is reported."""
    named = F.size(F.filter(F.split("payload_text", "\r\n"), lambda x: x.contains(":") & F.lower(F.trim(F.substring_index(x, ":", 1))).isin(*PROXY_HEADERS)))
    rows = packets.filter("protocol = 'tcp'").withColumn("_n", named).filter("_n > 0")
    # before the mark all of a packet's headers count, from it on one is enough
    total = F.sum("_n").over(Window.partitionBy("src_ip").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return detect(rows.withColumn("_t", total).filter(F.col("_t") >= at_least), [Rule("proxy_traffic", "medium", F.lit(True))])


def wire_rules() -> list[Rule]:
    """Rules on decoded wire columns: ethertypes (outer, inner), next_header, ext_headers (array), inner_version and inner_protocol of
    an encapsulated header with its inner_length, payload_text and payload_len, and header_value of a listed request header.

    Null columns match nothing.
    """
    n = F.size("ext_headers")
    shown = F.length(F.regexp_replace("header_value", r"[^\x20-\x7e]", ""))
    fits = F.when(F.col("inner_version") == 4, F.col("inner_length") >= 20).when(F.col("inner_version") == 6, (F.col("inner_length") > 0) & (F.col("inner_length") <= F.col("payload_len") + 64))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return [
        Rule("qinq_double_vlan", "low", yes((F.col("ethertype") == 0x8100) & (F.col("inner_ethertype") == 0x8100))),
        Rule("ipv6_atomic_fragment", "high", yes(F.col("next_header") == 44)),
        Rule("ipv6_extension_overload", "high", yes(n > 15)),
        Rule("ipv6_extension_chain", "medium", yes((n >= 5) & (n <= 15))),
        Rule("ipv6_destination_header", "low", yes((n > 0) & (n < 5) & (F.element_at("ext_headers", -1) == 60))),
        Rule("ipv6_tunnel", "high", yes(F.col("inner_version").isin(4, 6) & fits & F.col("inner_protocol").isin(4, 41))),
        Rule("ssh_detected", "low", yes(F.substring("payload_text", 1, 64).contains("SSH-")), 0.5),
        Rule("header_covert_channel", "medium", yes((F.length("header_value") > 50) & (shown > 0.9 * F.length("header_value")))),
    ]


def dns_entropy(df: DataFrame, more_than: float = 4.0) -> DataFrame:
    """Queries whose first label has many bits a character; confidence grows with them."""
    rows = df.filter("dns_qname is not null").withColumn("bits", entropy(F.substring_index("dns_qname", ".", 1))).filter(F.col("bits") > more_than)
    return rows.select("event_id", "ts", F.col("src_ip").alias("source_ip"), F.lit("dns_tunnel_high_entropy").alias("attack_type"), F.lit("high").alias("severity"), F.round(F.least(0.5 + 0.15 * (F.col("bits") - 4), F.lit(0.95)), 6).alias("confidence"))


def policy_violations(df: DataFrame, ports: tuple[int, ...], protocols: tuple[str, ...], hours: tuple[int, int]) -> DataFrame:
    """Rows outside a device policy: port, protocol, or hour of day; a range past midnight wraps."""
    hour, (a, b) = F.hour("ts"), hours
    inside = (hour >= a) & (hour < b) if a <= b else (hour >= a) | (hour < b)
    bad = ~F.col("dst_port").isin(*ports) | ~F.col("protocol").isin(*protocols) | ~inside
    return detect(df, [Rule("zt_policy_violation", "medium", bad)])
