"""Parsers of raw lines and requests into columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip_label, first_match, ladder, url_decoded  # noqa: F401
from ..sources.reference import APP_PORTS, DIRECT_LOG_TYPES, ENTITIES, FACILITIES, LEVELS, LOG_PATTERNS, SYSLOG_KEYWORDS, WEB_LAST, WEB_SIGNATURES

# Edges of a packet token's bins.
LENGTH_EDGES, GAP_EDGES, TTL_EDGES, PORT_EDGES = (64, 128, 256, 512, 1024, 1500), (0.001, 0.01, 0.1, 1.0, 10.0), (32, 64, 128, 255), (1024, 5000, 10000, 30000, 50000)

FIELDS = ("ip", "user", "port", "method", "path", "status", "ua", "cmd", "service")


def _field(line: Column, kind: Column, field: str) -> Column:
    """The field's group of the pattern that the line's kind names."""
    out = F.lit(None).cast("string")
    for name, pattern, fields in LOG_PATTERNS:
        if field in fields:
            out = F.when(kind == name, F.regexp_extract(line, pattern, fields.index(field) + 1)).otherwise(out)
    return out


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, however many expressions above name it: an array of one, exploded."""
    return df.withColumn(name, F.explode(F.array(value)))


def log_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """log_type and fields of every line; the first pattern that matches decides, none gives null."""
    df = _once(df, "log_type", first_match(F.col(line), [(n, p) for n, p, _ in LOG_PATTERNS]))
    return df.select("*", *[_field(F.col(line), F.col("log_type"), f).alias(f"log_{f}") for f in FIELDS])


def web_signature(text: Column, signatures=WEB_SIGNATURES, decoded: Column | None = None) -> Column:
    """Attack type of the first signature that the text or its decoded form matches."""
    decoded = url_decoded(text) if decoded is None else decoded
    out = F.lit(None).cast("string")
    for _, pattern, kind in reversed(signatures):
        out = F.when(text.rlike(pattern) | decoded.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def timestamp(text: Column, year: int) -> Column:
    """ISO, access-log, plain and syslog stamps (with ``year``); anything else is null."""
    plain = F.regexp_replace(text, r"\.\d+", "")
    syslog = F.concat_ws(" ", F.lit(str(year)), F.regexp_replace(plain, r"\s+", " "))
    return F.coalesce(
        F.try_to_timestamp(plain, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(plain, F.lit("dd/MMM/yyyy:HH:mm:ss Z")),
        F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(syslog, F.lit("yyyy MMM d HH:mm:ss")),
    )


def syslog(df: DataFrame, raw: str = "raw") -> DataFrame:
    """hostname, facility, severity, app_name, pid, message; rows in neither format are dropped."""
    new, old = r"^<(\d+)>(\d+) (\S+) (\S+) (\S+) (\S+) (\S+) (.*)", r"^(\w+\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)"
    line = F.col(raw)
    is_new, is_old = line.rlike(new), line.rlike(old)
    pri = F.regexp_extract(line, new, 1).cast("int")
    group = lambda p, i: F.regexp_extract(line, p, i)
    names = lambda values: F.array(*map(F.lit, values))
    facility = F.coalesce(F.get(names(FACILITIES), F.shiftright(pri, 3)), F.concat(F.lit("local"), F.shiftright(pri, 3)))
    pid = F.when(is_new, group(new, 6)).otherwise(group(old, 4))
    return df.filter(is_new | is_old).select(
        "*",
        F.when(is_new, group(new, 4)).otherwise(group(old, 2)).alias("hostname"),
        F.when(is_new, facility).otherwise("user").alias("facility"),
        F.when(is_new, F.get(names(LEVELS), pri.bitwiseAND(7))).otherwise("info").alias("level"),
        F.when(is_new, group(new, 5)).otherwise(group(old, 3)).alias("app_name"),
        F.when(~pid.isin("", "-"), pid).alias("pid"),
        F.when(is_new, F.concat_ws(" ", group(new, 7), group(new, 8))).otherwise(group(old, 5)).alias("message"),
    )


def syslog_attack(message: Column, level: Column) -> Column:
    """``syslog_`` and the first keyword class; else syslog_critical for the three highest levels; else null."""
    kind = first_match(message, list(SYSLOG_KEYWORDS))
    return F.when(kind.isNotNull(), F.concat(F.lit("syslog_"), kind)).when(level.isin(*LEVELS[:3]), "syslog_critical")


def syslog_severity(attack: Column) -> Column:
    return F.when(attack.isin("syslog_bruteforce", "syslog_intrusion", "syslog_malware"), "critical").otherwise("high")


def exploit_signature(line: Column) -> Column:
    """Fixed strings in a raw line, in order."""
    low = F.lower(line)
    return (
        F.when(line.contains("() {"), "shellshock_attempt")
        .when(line.contains("\xffSMB"), "eternalblue_attempt")
        .when(low.contains("${jndi:"), "log4j_attempt")
        .when(low.contains("spectre") | low.contains("meltdown"), "spectre_meltdown")
    )


def log_attacks(df: DataFrame, line: str = "line") -> DataFrame:
    """``log_lines`` with attack_type: what a line's type says by itself, null for none and for types that only count in windows.

    Web signatures are tried on access lines and others that name http; the exploits' fixed strings on what no rule before takes.
    """
    df = _once(log_lines(df, line), "_plain", url_decoded(F.col(line)))
    kind, text = F.col("log_type"), F.col(line)
    web = F.when((kind == "web_access") | (kind.isNotNull() & F.lower(text).contains("http")), web_signature(text, WEB_SIGNATURES[: WEB_LAST + 1], F.col("_plain")))
    chain = F.when(F.col("_web").isNotNull(), F.col("_web"))
    for name, attack in DIRECT_LOG_TYPES:
        chain = chain.when(kind.contains(name), F.lit(attack).cast("string"))
    return _once(_once(df, "_web", web), "attack_type", chain.when(kind.isNotNull(), exploit_signature(text))).drop("_plain", "_web")


def http_request(payload: Column) -> Column:
    """Struct of method, uri (blanks kept), headers (lower-cased names) and body."""
    parts = F.split(payload, "\r\n\r\n", 2)
    lines = F.split(parts[0], "\r\n")
    head = r"^(\S+)\s+(.*?)(?:\s+HTTP/[\d.]+)?$"
    pairs = F.transform(F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda h: h.contains(":")), lambda h: F.struct(F.lower(F.trim(F.substring_index(h, ":", 1))).alias("k"), F.trim(F.regexp_replace(h, "^[^:]*:", "")).alias("v")))
    headers = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
    return F.struct(F.regexp_extract(lines[0], head, 1).alias("method"), F.regexp_extract(lines[0], head, 2).alias("uri"), headers.alias("headers"), F.coalesce(F.get(parts, 1), F.lit("")).alias("body"))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _replaced(text: Column, pattern: str, group: int, to) -> Column:
    """Each match of the pattern replaced by ``to`` of its group."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    ends = F.concat(F.transform(found, to), F.array(F.lit("")))
    return F.when(text.rlike(pattern), F.array_join(F.flatten(F.zip_with(pieces, ends, lambda p, e: F.array(p, e))), "")).otherwise(text)


def _character(code: Column) -> Column:
    """The character of a code point in hex digits; what is none becomes the replacement character."""
    short = F.lpad(F.regexp_replace(code, "^0+(?=.)", ""), 8, "0")
    fine = (F.length(F.regexp_replace(code, "^0+(?=.)", "")) <= 6) & (short <= "0010FFFF") & ~short.between("0000D800", "0000DFFF")
    return F.when(fine, F.decode(F.unhex(F.when(fine, short).otherwise("0000FFFD")), "UTF-32")).otherwise("\ufffd")


def _utf8(octets: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(octets.cast("string"))


def _percent(text: Column) -> Column:
    return _replaced(F.translate(text, "+", " "), "((?:%[0-9a-fA-F]{2})+)", 1, lambda m: _utf8(F.unhex(F.replace(m, F.lit("%"), F.lit("")))))


def _utf7(text: Column) -> Column:
    octets = lambda m: F.hex(F.try_to_binary(F.rpad(m, ((F.length(m) + 3) / 4).cast("int") * 4, "="), F.lit("base64")))
    word = lambda m: F.array_join(F.transform(F.regexp_extract_all(octets(m), F.lit("([0-9A-F]{4})"), F.lit(1)), _character), "")
    return _replaced(text, r"\+([A-Za-z0-9+/]+)-", 1, lambda m: F.coalesce(word(m), F.concat(F.lit("+"), m, F.lit("-"))))


def _base64(text: Column) -> Column:
    """Runs of the base64 alphabet, of a length divisible by four, whose text is printable for more than four fifths."""
    plain = lambda m: _utf8(F.when(F.length(m) % 4 == 0, F.try_to_binary(m, F.lit("base64"))))
    odd = lambda t: F.length(F.regexp_replace(t, r"[\x20-\x7e\n\r\t]", ""))
    chosen = lambda m: _bound(plain(m), lambda t: F.when((F.length(t) > 0) & (odd(t) < 0.2 * F.length(t)), t).otherwise(m))
    return _replaced(text, r"([A-Za-z0-9+/]{8,}={0,2})", 1, chosen)


def _entities(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


#: The kinds of encoding that a pass of ``normalise`` undoes, in order.
DECODERS = (
    _percent,
    lambda t: _replaced(t, r"\\u([0-9a-fA-F]{4})", 1, lambda m: _character(F.upper(m))),
    lambda t: _replaced(t, r"\\x([0-9a-fA-F]{2})", 1, lambda m: _character(F.upper(m))),
    lambda t: _replaced(t, r"&#x([0-9a-fA-F]+);", 1, lambda m: _character(F.upper(m))),
    lambda t: _replaced(t, r"&#(\d+);", 1, lambda m: _character(F.conv(m, 10, 16))),
    _entities,
    _utf7,
    lambda t: F.regexp_replace(t, r"(?s)/\*.*?\*/", ""),
    _base64,
)
#: A text without any of these is as it is: marks of an encoding, or a run that base64 could be.
ENCODED = r"[%+\\&]|/\*|(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{4}){2,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?(?![A-Za-z0-9+/])"


def normalise(text: Column, rounds: int = 10, kinds: int = 5) -> Column:
    """Passes over all kinds of encoding until nothing changes, ``rounds`` passes at most; none after ``kinds`` kinds were met.

    The pass stands once in the expression and each of its steps names its input through a lambda variable, so the expression
    doesn't grow with the passes. Null is empty.
    """

    def step(state: Column, place: int, decode) -> Column:
        return _bound(state, lambda s: _bound(decode(s["text"]), lambda t: F.struct(t.alias("text"), F.when(t != s["text"], s["met"].bitwiseOR(1 << place)).otherwise(s["met"]).alias("met"))))

    def one(state: Column) -> Column:
        before = state
        passed = F.struct(state["text"].alias("text"), state["met"].alias("met"))
        for place, decode in enumerate(DECODERS):
            passed = step(passed, place, decode)
        after = lambda t: F.struct(t["text"].alias("text"), t["met"].alias("met"), ((t["text"] == before["text"]) | (F.bit_count(t["met"]) >= kinds)).alias("done"))
        return F.when(state["done"], state).otherwise(_bound(passed, after))

    text = F.coalesce(text, F.lit(""))
    begun = F.struct(text.alias("text"), F.lit(0).alias("met"), F.lit(False).alias("done"))
    passes = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begun, lambda s, _: one(s), lambda s: s["text"])
    return F.when(text.rlike(ENCODED), passes).otherwise(text)


def chunked_body(body: Column) -> Column:
    """The chunks of a body joined, each cut to its size, up to the one of size 0; a body without chunks stays."""
    pattern = r"(?s)([0-9a-fA-F]+)\r\n(.*?)\r\n"
    sizes = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("int"))
    data = F.regexp_extract_all(body, F.lit(pattern), F.lit(2))
    upto = F.when(F.array_position(sizes, 0) > 0, F.array_position(sizes, 0) - 1).otherwise(F.size(sizes)).cast("int")
    joined = F.array_join(F.slice(F.zip_with(data, sizes, lambda d, n: F.substring(d, F.lit(1), n)), 1, upto), "")
    return F.when(joined != "", joined).otherwise(body)


def multipart(content_type: Column, body: Column) -> Column:
    """The contents of a multipart body's parts, as an array; the body itself where it has none."""
    boundary = F.regexp_extract(content_type, r'(?i)boundary=(?:"([^"]+)"|([^\s;]+))', 1)
    boundary = F.when(boundary == "", F.regexp_extract(content_type, r'(?i)boundary=(?:"([^"]+)"|([^\s;]+))', 2)).otherwise(boundary)
    parts = F.split(body, F.concat(F.lit(r"\Q--"), boundary, F.lit(r"\E")), -1)
    held = F.filter(parts, lambda p: p.contains("Content-Disposition") & (F.locate("\r\n\r\n", p) > 1))
    texts = F.transform(held, lambda p: F.regexp_replace(F.regexp_replace(p, r"(?s)^.*?\r\n\r\n", ""), r"^\s+|\s+$", ""))
    return F.when((boundary != "") & (F.size(texts) > 0), texts).otherwise(F.array(body))


def is_text(payload: Column) -> Column:
    """At least 85 % printable and under 5 % replacement characters; short ones must be ASCII."""
    n = F.length(payload)
    odd = n - F.length(F.regexp_replace(payload, r"[^\x20-\x7e\r\n\t]", ""))
    lost = n - F.length(F.replace(payload, F.lit("�"), F.lit("")))
    return F.when(n < 8, odd == 0).otherwise((odd <= 0.15 * n) & (lost < 0.05 * n)) & (n > 0)


def app_protocol(src_port: Column, dst_port: Column, payload: Column) -> Column:
    """By the payload's first bytes, else by the destination's port, else by the source's."""
    chain = F.lit(None).cast("string")
    for port, name in APP_PORTS.items():
        chain = F.when(src_port == port, name).otherwise(chain)
    for port, name in APP_PORTS.items():
        chain = F.when(dst_port == port, name).otherwise(chain)
    return (
        F.when(payload.rlike(r"^(GET|POST|PUT|HEAD|DELETE|OPTIONS|PATCH) "), "http").when(payload.startswith("SSH-"), "ssh").when(payload.startswith("\x16\x03"), "tls")
        .when(payload.startswith("EHLO") | payload.startswith("HELO"), "smtp").when(payload.rlike("^(USER|PASS) "), "ftp").otherwise(chain)
    )


def port_in_text(text: Column) -> Column:
    """``port N``, else ``N/tcp``."""
    pick = lambda p: F.when(text.rlike(p), F.regexp_extract(text, p, 1).cast("int"))
    return F.coalesce(pick(r"(?i)port\s+(\d+)"), pick(r"(?i)(\d+)/tcp"))


TEMPLATES = {
    "port_scan": "{ip} probed {n} ports", "syn_flood": "{ip} sent {n} SYN packets", "sql_injection": "{ip} tried SQL injection", "ssh_bruteforce": "{ip} failed to log in {n} times",
}


def explanation(attack_type: Column, ip: Column, n: Column, templates: dict[str, str] = TEMPLATES) -> Column:
    """The type's template with its variables filled; unknown ones read ``unknown``."""
    text = F.lit("{ip}: {type}")
    for name, template in templates.items():
        text = F.when(attack_type == name, template).otherwise(text)
    for mark, value in (("{ip}", ip), ("{n}", n.cast("string")), ("{type}", attack_type)):
        text = F.replace(text, F.lit(mark), F.coalesce(value, F.lit("unknown")))
    return text


def packet_token(iat: Column | None = None) -> Column:
    """A packet as eleven binned values, joined: direction, payload length, gap, ttl, protocol, S, A, F, both ports, window.

    A value's bin is the number of edges that it exceeds.
    """
    over = lambda value, edges: reduce(lambda a, e: a + F.when(value > e, 1).otherwise(0), edges, F.lit(0))
    flag = lambda x: F.coalesce(F.col("flags").contains(x), F.lit(False)).cast("int")
    return F.concat_ws(
        ".", F.when(F.col("src_port") > 1024, 0).otherwise(1), over(F.col("payload_len"), LENGTH_EDGES), over(F.coalesce(iat, F.lit(0.0)) if iat is not None else F.lit(0.0), GAP_EDGES), over(F.col("ttl"), TTL_EDGES),
        F.when(F.col("protocol") == "tcp", 0).otherwise(1), flag("S"), flag("A"), flag("F"), over(F.col("src_port"), PORT_EDGES), over(F.col("dst_port"), PORT_EDGES), F.least(F.floor(F.col("win") / 4096), F.lit(15)).cast("int"),
    )
