"""Queries of detectors that look at a host's behaviour, at decoded headers, and of the shipped rules, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse, report, rules, stateless, suppress, windowed
from ..sources import reference
from ..sources.derive import derive, derived_sql
from .detect import PATTERN_SQL, packets
from .registry import query, table

DAY = 86_400

# Sequence numbers by host: some repeat, some rise by little, the rest are as derived. Every fifth host's SYNs are answered.
SEQUENCE = "CASE user_id % 4 WHEN 0 THEN 7 WHEN 1 THEN event_id % 50 WHEN 2 THEN 0 ELSE tcp_seq END"
TALK_SQL = f"""{derived_sql('packets')}, talk AS (SELECT event_id, ts, src_ip, dst_ip, flags, CAST({SEQUENCE} AS BIGINT) AS tcp_seq FROM packets
    UNION ALL SELECT -event_id, ts + INTERVAL 1 SECOND, dst_ip, src_ip, 'SA', 0 FROM packets WHERE flags = 'S' AND user_id % 5 = 0),
    roles AS (SELECT event_id, ts, src_ip AS host, true AS sends, flags, tcp_seq FROM talk UNION ALL SELECT event_id, ts, dst_ip, false, flags, tcp_seq FROM talk),
    seen AS (SELECT *, sum(CASE WHEN flags = 'S' AND sends THEN 1 ELSE 0 END) OVER w AS syns, sum(CASE WHEN flags = 'SA' AND NOT sends THEN 1 ELSE 0 END) OVER w AS answers FROM roles WINDOW w AS (PARTITION BY host ORDER BY ts, event_id, sends ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def talk(spark: SparkSession, d: str) -> DataFrame:
    """Packets with telling sequence numbers, and the answers to some hosts' SYNs."""
    p = packets(spark, d)
    own = p.selectExpr("event_id", "ts", "src_ip", "dst_ip", "flags", f"CAST({SEQUENCE} AS BIGINT) AS tcp_seq")
    answers = p.filter("flags = 'S' AND user_id % 5 = 0").selectExpr("-event_id AS event_id", "ts + INTERVAL 1 SECOND AS ts", "dst_ip AS src_ip", "src_ip AS dst_ip", "'SA' AS flags", "0L AS tcp_seq")
    return own.unionByName(answers)


@query("win18_slow_loris_unanswered", f"""{TALK_SQL}, s AS (SELECT host, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS i FROM seen WHERE sends AND flags = 'S' AND answers = 0),
    r AS (SELECT host, event_id, i, [t] AS kept, false AS hit FROM s WHERE i = 1 UNION ALL
      SELECT host, event_id, i, CASE WHEN h THEN [] ELSE k END, h FROM (SELECT *, len(k) >= 3 AND t - k[1] >= 1000000 AND len(k) * 1e6 > 0.00001 * (t - k[1]) AS h FROM (
        SELECT s.host, s.event_id, s.i, s.t, list_append(CASE WHEN len(r.kept) >= 5 THEN r.kept[2:] ELSE r.kept END, s.t) AS k FROM r JOIN s ON s.host = r.host AND s.i = r.i + 1) a) b)
    SELECT event_id, host AS source_ip FROM r WHERE hit""")
def slow_loris(spark: SparkSession, d: str) -> DataFrame:
    return windowed.slow_loris(talk(spark, d), last=5, at_least=3, span=1.0, per_second=0.00001).select("event_id", "source_ip")


@query("win22_isn_spoofed", f"""{TALK_SQL}, g AS (SELECT host, event_id, ts, tcp_seq, answers = 0 AND syns - answers >= 3 AS spoofed, abs(tcp_seq - lag(tcp_seq) OVER (PARTITION BY host ORDER BY ts, event_id)) AS gap FROM seen WHERE sends AND flags = 'S'),
    f AS (SELECT *, count(*) OVER w AS n, max(tcp_seq) OVER w AS top, min(gap) OVER v AS low, max(gap) OVER v AS high FROM g
      WINDOW w AS (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), v AS (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT event_id, host AS source_ip FROM f WHERE n >= 4 AND top > 0 AND (high < 100 OR low = high AND high < 10000) AND spoofed""")
def low_entropy_isn(spark: SparkSession, d: str) -> DataFrame:
    return windowed.low_entropy_isn(talk(spark, d)).select("event_id", "source_ip")


@query("win29_short_connections_vetoed", f"""{TALK_SQL}, l AS (SELECT host, event_id, ts, flags, answers, (epoch_us(ts) - max(CASE WHEN flags = 'S' THEN epoch_us(ts) END) OVER (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 1e6 AS lived FROM seen WHERE sends),
    c AS (SELECT *, count(*) OVER w AS n, sum(CASE WHEN lived < 172800 THEN 1 ELSE 0 END) OVER w AS short FROM l WHERE (flags LIKE '%F%' OR flags LIKE '%R%') AND lived IS NOT NULL WINDOW w AS (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT event_id, host AS source_ip FROM c WHERE n >= 2 AND short >= 2 AND answers = 0""")
def short_connections(spark: SparkSession, d: str) -> DataFrame:
    return windowed.short_connections(talk(spark, d), shorter=2 * DAY, last=5, at_least=2, short=2).select("event_id", "source_ip")


def _fragments_sql() -> str:
    # DuckDB's patterns know no look-behind: the one that keeps the star of an Accept header out is left to a test
    plain = lambda p: p.replace(r"(?<!\*)/\*|", "").replace("'", "''")
    return " UNION ALL ".join(f"SELECT event_id, ts, ip, '{name}' AS class FROM log_lines WHERE regexp_matches(line, '{plain(pattern)}')" for name, pattern in reference.FRAGMENTS)


@query("win30_session_attacks", f"""{derived_sql('log_lines')}, x AS ({_fragments_sql()}), n AS (SELECT *, count(*) OVER (PARTITION BY ip, class ORDER BY epoch_us(ts) RANGE BETWEEN {2 * DAY * 10**6 - 1} PRECEDING AND CURRENT ROW) AS n FROM x),
    f AS (SELECT *, row_number() OVER (PARTITION BY ip, class ORDER BY ts, event_id) AS i FROM n WHERE n >= 3) SELECT event_id, ip AS source_ip, concat('session_correlated_', class, '_attack') AS attack_type FROM f WHERE i = 1""")
def session_attacks(spark: SparkSession, d: str) -> DataFrame:
    lines = derive(table(spark, d, "events"), "log_lines")
    return windowed.session_fragments(lines, reference.FRAGMENTS, "line", "ip", seconds=2 * DAY, at_least=3).select("event_id", "source_ip", "attack_type")


@query("win37_closes_in_window", f"""{derived_sql('packets')}, o AS (SELECT src_ip, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY src_ip ORDER BY ts, event_id) AS i FROM packets WHERE flags LIKE '%F%' OR flags LIKE '%R%'),
    r AS (SELECT src_ip, event_id, i, [t] AS kept, false AS hit FROM o WHERE i = 1 UNION ALL
      SELECT src_ip, event_id, i, CASE WHEN len(k) >= 3 THEN [] ELSE k END, len(k) >= 3 FROM (
        SELECT o.src_ip, o.event_id, o.i, list_append(list_filter(r.kept, lambda x: x >= o.t - {5 * DAY * 10**6}), o.t) AS k FROM r JOIN o ON o.src_ip = r.src_ip AND o.i = r.i + 1) z)
    SELECT src_ip, event_id FROM r WHERE hit""")
def closes_in_window(spark: SparkSession, d: str) -> DataFrame:
    closes = packets(spark, d).filter("flags LIKE '%F%' OR flags LIKE '%R%'")
    return windowed.counter_with_reset(closes, ["src_ip"], "ts", 5 * DAY, 3).select("src_ip", "event_id")


@query("win44_throttled", f"""{derived_sql('packets')}, o AS (SELECT src_ip, event_id, raw_len, flags, epoch_us(ts) AS t, row_number() OVER (PARTITION BY src_ip ORDER BY ts, event_id) AS i FROM packets),
    r AS (SELECT src_ip, event_id, i, t, t AS opened, 1 AS n, CASE WHEN flags = 'S' THEN 1 ELSE 0 END AS syns, CAST(raw_len AS BIGINT) AS bytes FROM o WHERE i = 1 UNION ALL
      SELECT o.src_ip, o.event_id, o.i, o.t, CASE WHEN f THEN o.t ELSE opened END, CASE WHEN f THEN 1 ELSE n + 1 END, CASE WHEN f THEN 0 ELSE syns END + CASE WHEN o.flags = 'S' THEN 1 ELSE 0 END, CASE WHEN f THEN 0 ELSE bytes END + o.raw_len
      FROM (SELECT r.*, o2.t - r.opened > {DAY * 10**6} AS f FROM r JOIN o o2 ON o2.src_ip = r.src_ip AND o2.i = r.i + 1) r JOIN o ON o.src_ip = r.src_ip AND o.i = r.i + 1)
    SELECT src_ip, event_id FROM r WHERE n / greatest((t - opened) / 1e6, 0.1) > 0.00012""")
def throttled(spark: SparkSession, d: str) -> DataFrame:
    found = windowed.throttled(packets(spark, d), "src_ip", "ts", "raw_len", F.col("flags") == "S", seconds=DAY, packets=0.00012, syns=1e9, total=1e12)
    return found.select("src_ip", "event_id")


FRAMES = (
    "event_id", "ts", "src_ip", "k", "payload_len", "CASE WHEN k % 3 = 0 THEN 33024 ELSE 2048 END AS ethertype", "CASE WHEN k % 6 = 0 THEN 33024 WHEN k % 5 = 0 THEN NULL ELSE 2048 END AS inner_ethertype", "CASE WHEN k % 11 = 0 THEN 44 ELSE 6 END AS next_header", "k % 20 AS n_headers", "CASE WHEN k % 2 = 0 THEN 60 ELSE 43 END AS last_header",
    "CASE k % 7 WHEN 0 THEN 4 WHEN 1 THEN 6 WHEN 2 THEN 5 END AS inner_version", "CASE WHEN k % 2 = 0 THEN 41 ELSE 17 END AS inner_protocol", "CAST(k * 20 AS INT) AS inner_length", "CASE WHEN k % 13 = 0 THEN 'SSH-2.0-x' WHEN k % 13 = 1 THEN concat(repeat('x', 62), 'SSH-') ELSE 'GET /' END AS payload_text",
    "CASE WHEN k % 8 = 0 THEN repeat('ab', 10 + k) WHEN k % 8 = 1 THEN NULL ELSE 'x' END AS header_value",
)
FRAME_CASES = [
    ("qinq_double_vlan", "low", "ethertype = 33024 AND inner_ethertype = 33024"), ("ipv6_atomic_fragment", "high", "next_header = 44"), ("ipv6_extension_overload", "high", "n_headers > 15"), ("ipv6_extension_chain", "medium", "n_headers BETWEEN 5 AND 15"),
    ("ipv6_destination_header", "low", "n_headers BETWEEN 1 AND 4 AND last_header = 60"), ("ipv6_tunnel", "high", "inner_protocol IN (4, 41) AND (inner_version = 4 AND inner_length >= 20 OR inner_version = 6 AND inner_length > 0 AND inner_length <= payload_len + 64)"),
    ("ssh_detected", "low", "strpos(payload_text, 'SSH-') BETWEEN 1 AND 61"), ("header_covert_channel", "medium", "length(header_value) > 50"),
]


@query("st12_wire_rules", f"{derived_sql('packets')}, frames AS (SELECT {', '.join(FRAMES)} FROM packets) " + " UNION ALL ".join(f"SELECT event_id, '{n}' AS attack_type, '{s}' AS severity FROM frames WHERE {w}" for n, s, w in FRAME_CASES))
def wire_rules(spark: SparkSession, d: str) -> DataFrame:
    frames = packets(spark, d).selectExpr(*FRAMES)
    headers = F.when(F.col("n_headers") > 0, F.concat(F.array_repeat(F.lit(0), (F.col("n_headers") - 1).cast("int")), F.array("last_header"))).otherwise(F.array().cast("array<int>"))
    return stateless.detect(frames.withColumn("ext_headers", headers), stateless.wire_rules()).select("event_id", "attack_type", "severity")


# Requests with bodies: some hide an attack in chunks, some in a part of a multipart body, some carry it openly.
CRLF = "concat(chr(13), chr(10))"
REQUESTS = (
    "event_id", "ts", "src_ip", "k", "'/news/7' AS http_uri", "'Mozilla/5.0' AS user_agent", "'' AS cookie", "'' AS forwarded", "'' AS upgrade", "CAST(CASE WHEN k % 10 = 9 THEN 2 ELSE 0 END AS INT) AS n_content_length", "k % 5 < 2 AS chunked",
    "CASE WHEN k % 5 = 1 THEN 'multipart/form-data; boundary=zz' ELSE 'text/plain' END AS content_type",
    f"CASE k % 5 WHEN 0 THEN concat('4', {CRLF}, '<scr', {CRLF}, '6', {CRLF}, 'ipt>xyz', {CRLF}, '0', {CRLF}, {CRLF}) WHEN 1 THEN concat('2', {CRLF}, '--', {CRLF}, '2', {CRLF}, 'zz', {CRLF}, '4', {CRLF}, 'safe', {CRLF}, '0', {CRLF}, {CRLF}) WHEN 2 THEN 'a=1 union select b' WHEN 3 THEN 'a=%3Ciframe' ELSE 'a=1' END AS body",
)


@query("st32_request_bodies", f"""{derived_sql('packets')} SELECT event_id, CASE k % 5 WHEN 2 THEN 'sql_injection' WHEN 3 THEN 'xss_attempt' WHEN 0 THEN 'bypass_encoding' ELSE 'http_smuggling_dual_cl' END AS attack_type,
    CASE k % 5 WHEN 2 THEN 'critical' WHEN 3 THEN 'high' WHEN 0 THEN 'high' ELSE 'critical' END AS severity, CAST(CASE k % 5 WHEN 2 THEN 0.9 ELSE 0.85 END AS DOUBLE) AS confidence FROM packets WHERE k % 5 IN (0, 2, 3) OR k % 10 = 9""")
def request_bodies(spark: SparkSession, d: str) -> DataFrame:
    return stateless.web_attacks(packets(spark, d).selectExpr(*REQUESTS)).select("event_id", "attack_type", "severity", "confidence")


RULE_EVENTS = (
    "event_id", "http_uri AS path", "user_agent", "dst_port", "dns_txt_len AS dns_query_length", "CASE WHEN k % 2 = 0 THEN 'connect' ELSE 'exec' END AS event_type", "k AS connection_count", "k * 2 AS syn_count", "CASE WHEN k % 30 = 0 THEN 'anonymous' ELSE 'bob' END AS username", "k % 9 AS failed_attempts",
)


def _rule_sql(condition: dict) -> str:
    if condition["type"] == "composite":
        return "(" + " AND ".join(map(_rule_sql, condition["conditions"])) + ")"
    name = condition["field"]
    if condition["type"] == "pattern":
        return f"regexp_matches(CAST({name} AS VARCHAR), '(?i){condition['pattern']}')".replace("'\\s*or\\s*'", "''\\s*or\\s*''")
    return f"{name} > {condition['value']}" if condition["operator"] == "gt" else f"CAST({name} AS VARCHAR) = '{condition['value']}'"


RULES_SQL = " UNION ALL ".join(f"SELECT event_id, '{r['id']}' AS rule_id, '{r['severity']}' AS severity, '{','.join(r['mitre'])}' AS mitre, '{','.join(r['actions'])}' AS actions FROM ev WHERE {_rule_sql(r['condition'])}" for r in rules.SHIPPED)


@query("rul05_shipped_rules", f"{derived_sql('packets')}, ev AS (SELECT {', '.join(RULE_EVENTS)} FROM packets) {RULES_SQL}")
def shipped_rules(spark: SparkSession, d: str) -> DataFrame:
    m = rules.match_rules(packets(spark, d).selectExpr(*RULE_EVENTS), rules.SHIPPED)
    return m.select("event_id", "rule_id", "severity", F.array_join("mitre", ",").alias("mitre"), F.array_join("actions", ",").alias("actions"))


NOISE = "CASE k % 7 WHEN 0 THEN 'broadcast_storm' WHEN 1 THEN 'timing_evasion' WHEN 2 THEN 'port_scan' WHEN 3 THEN 'session_correlated_sql_attack' WHEN 4 THEN 'session_correlated_cmd_attack' WHEN 5 THEN 'syn_flood' ELSE 'packet_burst' END AS attack_type"


@query("sup04_noise_types", f"""{derived_sql('packets')} SELECT event_id FROM (SELECT event_id, {NOISE}, dst_ip FROM packets) p WHERE NOT (attack_type IN ('broadcast_storm', 'timing_evasion', 'port_scan', 'session_correlated_sql_attack', 'session_correlated_cmd_attack') AND (dst_ip LIKE '104.16.0.%' OR dst_ip LIKE '8.8.8.%'))
    AND NOT (attack_type = 'broadcast_storm' AND dst_ip LIKE '192.168.%')""")
def noise_types(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d).selectExpr("event_id", NOISE, "dst_ip")
    return suppress.drop_noise(suppress.range_label(p, "dst_ip", reference.ranges(spark))).select("event_id")


@query("sup03_disabled_label", f"{derived_sql('packets')} SELECT event_id, CASE WHEN dst_ip LIKE '192.168.%' THEN 'private' WHEN dst_ip LIKE '8.8.8.%' THEN 'google' END AS label FROM packets")
def disabled_label(spark: SparkSession, d: str) -> DataFrame:
    return suppress.range_label(packets(spark, d), "dst_ip", reference.ranges(spark), ("cloudflare",)).select("event_id", "label")


@query("sup05_whitelisted", f"{derived_sql('packets')} SELECT event_id FROM packets WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def whitelisted(spark: SparkSession, d: str) -> DataFrame:
    good = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return packets(spark, d).join(good, "user_id", "left_anti").select("event_id")


EXPLOITS = "CASE k % 10 WHEN 0 THEN 'x () { :; }; id' WHEN 1 THEN 'a ${jndi:ldap://x}' WHEN 2 THEN 'MeltDown poc' WHEN 3 THEN '${JNDI:rmi}' ELSE 'plain' END AS line"


@query("par06_exploit_lines", f"{derived_sql('packets')} SELECT event_id, CASE k % 10 WHEN 0 THEN 'shellshock_attempt' WHEN 2 THEN 'spectre_meltdown' ELSE 'log4j_attempt' END AS attack_type FROM packets WHERE k % 10 < 4")
def exploit_lines(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d).selectExpr("event_id", EXPLOITS)
    return p.select("event_id", parse.exploit_signature(F.col("line")).alias("attack_type")).filter("attack_type is not null")


@query("win13_fragment_sets", f"""{derived_sql('packets')}, f AS (SELECT event_id, src_ip, protocol, payload_len, more_fragments, frag_offset, count(*) OVER w AS nth, sum(payload_len) OVER w AS total, first_value(frag_offset + payload_len) OVER w AS fe, row_number() OVER (PARTITION BY src_ip, dst_ip, ip_id, protocol, frag_offset ORDER BY ts, event_id) > 1 AS again FROM packets
    WHERE frag_offset > 0 OR more_fragments WINDOW w AS (PARTITION BY src_ip, dst_ip, ip_id, protocol ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT event_id, kind AS attack_type FROM (SELECT event_id, CASE WHEN nth % 65 = 0 THEN 'fragment_storm' WHEN nth > 1 AND (again OR frag_offset < fe) THEN 'fragment_overlap' WHEN payload_len < 100 AND more_fragments THEN 'tiny_fragment' WHEN total > 65535 AND protocol = 'tcp' THEN 'fragment_oversize' END AS kind FROM f) t WHERE kind IS NOT NULL""")
def fragment_sets(spark: SparkSession, d: str) -> DataFrame:
    return windowed.fragment_sets(packets(spark, d)).select("event_id", "attack_type")


@query("win24_covert_numbers", f"""{derived_sql('packets')}, p AS (SELECT event_id, ts, src_ip, of, ((x - lag(x) OVER w) % 256 + 256) % 256 AS delta FROM (SELECT event_id, ts, src_ip, 'seq' AS of, tcp_seq % 256 AS x FROM packets UNION ALL SELECT event_id, ts, src_ip, 'ack', tcp_ack % 256 FROM packets) q WINDOW w AS (PARTITION BY src_ip, of ORDER BY ts, event_id)),
    l AS (SELECT event_id, of, list_filter(list(delta) OVER (PARTITION BY src_ip, of ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), lambda d: d BETWEEN 32 AND 126) AS shown FROM p WHERE delta IS NOT NULL)
    SELECT event_id, of, CAST(len(shown) AS INT) AS printable FROM l WHERE len(shown) >= CASE of WHEN 'seq' THEN 8 ELSE 10 END AND len(list_distinct(shown)) <= 0.9 * len(shown)""")
def covert_numbers(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d)
    seq = windowed.printable_deltas(p, "tcp_seq", at_least=8, most_distinct=0.9).select("event_id", F.lit("seq").alias("of"), "printable")
    return seq.unionByName(windowed.printable_deltas(p, "tcp_ack", at_least=10, most_distinct=0.9).select("event_id", F.lit("ack").alias("of"), "printable"))


@query("agg15_flow_directions", f"""{derived_sql('packets')}, t AS (SELECT event_id, ts, src_ip, dst_ip, src_port, dst_port, protocol, raw_len FROM packets UNION ALL SELECT -event_id, ts + INTERVAL 1 SECOND, dst_ip, src_ip, dst_port, src_port, protocol, CAST(raw_len // 9 AS INT) FROM packets WHERE k % 2 = 0),
    k AS (SELECT *, concat(least(concat(src_ip, ':', CAST(src_port AS STRING)), concat(dst_ip, ':', CAST(dst_port AS STRING))), '|', greatest(concat(src_ip, ':', CAST(src_port AS STRING)), concat(dst_ip, ':', CAST(dst_port AS STRING))), '|', protocol) AS flow FROM t),
    g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY flow ORDER BY ts, event_id) AS gap FROM k),
    s AS (SELECT *, sum(CASE WHEN gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY flow ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g),
    f AS (SELECT *, src_ip = first_value(src_ip) OVER (PARTITION BY flow, session ORDER BY ts, event_id) AS fwd FROM s)
    SELECT flow, CAST(session AS BIGINT) AS session, count(*) AS packets, count(*) FILTER (fwd) AS fwd_packets, count(*) FILTER (NOT fwd) AS bwd_packets, CAST(coalesce(sum(raw_len) FILTER (NOT fwd), 0) AS BIGINT) AS bwd_bytes, round(coalesce(avg(raw_len) FILTER (NOT fwd), 0), 4) AS bwd_len_mean, CAST(coalesce(max(raw_len) FILTER (fwd), 0) AS DOUBLE) AS fwd_len_max FROM f GROUP BY flow, session""")
def flow_directions(spark: SparkSession, d: str) -> DataFrame:
    from .detect import flow_features

    f = flow_features(spark, d)
    return f.select("flow", "session", "packets", "fwd_packets", "bwd_packets", "bwd_bytes", F.round("bwd_len_mean", 4).alias("bwd_len_mean"), "fwd_len_max")


@query("win49_assembled_turns", "SELECT conv_id, count(*) AS n_parts, sha256(string_agg(text, '' ORDER BY turn, text)) AS payload_sha256 FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def assembled_turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").filter("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("parts"))
    return c.select("conv_id", F.size("parts").cast("long").alias("n_parts"), F.sha2(F.array_join(F.transform("parts", lambda p: p["text"]), "").cast("binary"), 256).alias("payload_sha256"))


@query("agg20_incident_summary", f"""{derived_sql('packets')} SELECT CASE WHEN k % 4 = 0 THEN 'critical' WHEN k % 4 = 1 THEN 'high' ELSE 'low' END AS severity, count(*) AS total, count(*) FILTER (k % 3 = 0) AS resolved, count(*) FILTER (k % 3 <> 0) AS open, count(DISTINCT src_ip) AS attackers FROM packets GROUP BY 1""")
def incident_summary(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d).withColumn("severity", F.when(F.col("k") % 4 == 0, "critical").when(F.col("k") % 4 == 1, "high").otherwise("low")).withColumn("resolved", F.col("k") % 3 == 0)
    return report.incident_summary(p, "severity", "resolved", "src_ip")
