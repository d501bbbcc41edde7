"""Queries that read through the readers what they first wrote in the sensors' forms, and rules on headers and payloads; SQL twins."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules, stateless, windowed
from ..sources import readers, sinks
from ..sources.derive import derive, derived_sql
from ..sources.scratch import folder
from .detect import packets
from .registry import ORACLES, query, table
from .reports import A_SQL, attacks


@query("src01_log_folder", f"{derived_sql('log_lines')} SELECT line, count(*) AS n FROM log_lines GROUP BY line")
def log_folder(spark: SparkSession, d: str) -> DataFrame:
    spool = folder(spark, "logs")
    derive(table(spark, d, "events"), "log_lines").select("line").write.text(spool)
    return readers.log_files(spark, spool).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("src03_packet_folder", f"{derived_sql('packets')} SELECT event_id, src_ip, dst_port, protocol, tcp_seq, more_fragments FROM packets")
def packet_folder(spark: SparkSession, d: str) -> DataFrame:
    """Packets as JSON lines, read by their declared schema; columns that a feed lacks are null."""
    spool = folder(spark, "packets")
    packets(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).write.json(spool)
    return readers.packets(spark, spool, "json").select("event_id", "src_ip", "dst_port", "protocol", "tcp_seq", "more_fragments")


CODE = "CASE event_kind WHEN 'exec' THEN 1 WHEN 'connect' THEN 2 WHEN 'open' THEN 3 WHEN 'kill' THEN 4 ELSE 5 END"


@query("src05_host_codes", f"{derived_sql('host_events')} SELECT event_id, CASE WHEN k = 13 THEN NULL WHEN k = 14 THEN 'network' ELSE event_kind END AS kind FROM host_events")
def host_codes(spark: SparkSession, d: str) -> DataFrame:
    code = F.expr(f"CASE WHEN k = 13 THEN 99 WHEN k = 14 THEN 6 ELSE {CODE} END")
    return derive(table(spark, d, "events"), "host_events").select("event_id", readers.host_kind(code).alias("kind"))


@query("src06_deception_hits", "SELECT ip AS source_ip, min(event_id) AS event_id, 'honeypot_connection' AS attack_type, 'critical' AS severity FROM (SELECT event_id, concat('10.0.0.', CAST(user_id % 200 AS STRING)) AS ip, event_type FROM events WHERE event_id > 500) t WHERE event_type <> 'view' GROUP BY ip")
def deception_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits above the saved mark, once an address; other lines name no address."""
    e = readers.above_mark(table(spark, d, "events"), 500, "event_id")
    line = F.when(F.col("event_type") != "view", F.concat(F.lit("2024 [HIT] ssh from 10.0.0."), (F.col("user_id") % 200).cast("string"))).otherwise("started")
    return readers.deception_hits(e.select("event_id", line.alias("line"))).select("source_ip", "event_id", "attack_type", "severity")


@query("src07_rule_folder", ORACLES["rul05_multi_rule"])
def rule_folder(spark: SparkSession, d: str) -> DataFrame:
    """Rules of two files: a later file replaces a rule of an earlier one, disabled ones are left out."""
    where = Path(tempfile.mkdtemp(prefix="spark-"))
    stale = [{**r, "severity": "info"} for r in rules.RULES[:2]] + [{**rules.RULES[0], "id": "off", "enabled": False}]
    (where / "a.json").write_text(json.dumps({"rules": stale}))
    (where / "b.json").write_text(json.dumps({"rules": rules.RULES}))
    return rules.match_rules(packets(spark, d), rules.load_rules(str(where))).select("event_id", "rule_id", "severity")


@query("snk04_bundles", f"""{A_SQL}, h AS (SELECT event_id, source_ip, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS tm, attack_type, sha256(concat(attack_type, '|', source_ip)) AS d, k FROM attacks)
    SELECT event_id, concat('{{"type":"bundle","id":"bundle--', d[33:40], '-', d[41:44], '-4', d[46:48], '-8', d[50:52], '-', d[53:64], '","objects":[{{"type":"indicator","spec_version":"2.1","id":"indicator--', d[1:8], '-', d[9:12], '-4', d[14:16], '-8', d[18:20], '-', d[21:32], '","created":"', tm, '","modified":"', tm, '","valid_from":"', tm,
      '","pattern":"[ipv4-addr:value = ''', source_ip, ''']","pattern_type":"stix","indicator_types":["malicious-activity"],"name":"', attack_type, '"', CASE WHEN k % 2 = 0 THEN ',"external_references":[{{"source_name":"mitre-attack","url":"https://attack.mitre.org/techniques/T1110"}},{{"source_name":"mitre-attack","url":"https://attack.mitre.org/techniques/T1078"}}]' ELSE '' END, '}}]}}') AS stix_bundle FROM h""")
def bundles(spark: SparkSession, d: str) -> DataFrame:
    a = attacks(spark, d).withColumn("mitre", F.when(F.col("k") % 2 == 0, F.array(F.lit("T1110"), F.lit("T1078"))).otherwise(F.array().cast("array<string>")))
    return sinks.formatted(a, "stix_bundle")


# Payloads by number, with headers of tunnels and proxies.
LINES = ("event_id", "ts", "src_ip", "protocol", "CAST(k * 600 AS INT) AS payload_len", "CASE k % 8 WHEN 0 THEN concat('GET / HTTP/1.1', crlf, 'X-Tunnel: 1', crlf) WHEN 1 THEN concat('POST / HTTP/1.1', crlf, 'Content-Type: application/octet-stream', crlf) WHEN 2 THEN concat('GET / HTTP/1.1', crlf, 'Via: a', crlf, 'X-Real-IP: 1', crlf) WHEN 3 THEN concat('GET / HTTP/1.1', crlf, ' Proxy-Connection : x') WHEN 4 THEN NULL ELSE 'plain' END AS payload_text")
_LINES = f"{derived_sql('packets')}, l AS (SELECT {', '.join(LINES)} FROM (SELECT *, chr(13) || chr(10) AS crlf FROM packets) c)"


def payloads(spark: SparkSession, d: str) -> DataFrame:
    return packets(spark, d).withColumn("crlf", F.lit("\r\n")).selectExpr(*LINES)


@query("st11_http_tunnels", f"""{_LINES} SELECT event_id, CASE WHEN payload_len > 50000 THEN 'medium' ELSE 'high' END AS severity FROM l WHERE payload_len > 50000 OR payload_text LIKE '%X-Tunnel%' OR payload_text LIKE '%octet-stream%' OR payload_text LIKE '%Proxy-Connection%'""")
def http_tunnels(spark: SparkSession, d: str) -> DataFrame:
    return stateless.detect(payloads(spark, d), stateless.tunnel_rules()).select("event_id", "severity")


@query("win39_proxy_headers", f"""{_LINES} SELECT event_id, src_ip AS source_ip FROM (SELECT event_id, src_ip, sum(n) OVER (PARTITION BY src_ip ORDER BY ts, event_id) AS t FROM (SELECT *, CASE WHEN payload_text LIKE '%Via%' THEN 2 WHEN payload_text LIKE '%Proxy-%' THEN 1 END AS n FROM l WHERE protocol = 'tcp') x WHERE n IS NOT NULL) y WHERE t >= 3""")
def proxy_headers(spark: SparkSession, d: str) -> DataFrame:
    return stateless.proxy_headers(payloads(spark, d)).select("event_id", "source_ip")


HEADERS = "CASE k % 6 WHEN 0 THEN 'X-Original-URL' WHEN 1 THEN 'x-rewrite-url' WHEN 2 THEN 'X-HTTP-Method-Override' WHEN 3 THEN 'X-Forwarded-Host' WHEN 4 THEN 'X-Forwarded-For' ELSE 'User-Agent' END"
VALUES = "CASE k % 5 WHEN 0 THEN '/a?x=1 union select 2 from t' WHEN 1 THEN '%3Cscript%3Ealert(1)' WHEN 2 THEN '..%2F..%2Fetc' WHEN 3 THEN '10.1.1.1' ELSE 'host.example' END"


@query("st30_override_headers", f"{derived_sql('packets')} SELECT event_id FROM packets WHERE k % 6 < 5 AND k % 5 < 3")
def override_headers(spark: SparkSession, d: str) -> DataFrame:
    """Override headers of any of the five names, encoded or not; the twin knows which of the few values are attacks."""
    p = packets(spark, d).withColumn("headers", F.create_map(F.expr(HEADERS), F.expr(VALUES), F.lit("Accept"), F.lit("*/*")))
    return stateless.override_injection(p).select("event_id")


@query("win28_proto_floor", f"""{derived_sql('packets')} SELECT event_id, src_ip AS source_ip FROM (SELECT event_id, src_ip, count(*) OVER w AS n, len(list_distinct(list(protocol) OVER w)) AS kinds FROM packets WINDOW w AS (PARTITION BY src_ip ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) t WHERE n >= 30 AND kinds >= 3""")
def proto_floor(spark: SparkSession, d: str) -> DataFrame:
    return windowed.protocol_use(packets(spark, d), at_least=30).select("event_id", "source_ip")


@query("win09_hopping_steps", f"""{derived_sql('packets')}, f AS (SELECT event_id, ts, src_ip, dst_ip, row_number() OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts, event_id) = 1 AS fresh FROM (SELECT * REPLACE ('192.168.1.' || CAST(user_id % 3 AS STRING) AS dst_ip) FROM packets) p),
    c AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts, event_id) AS n FROM f) SELECT event_id, src_ip AS source_ip, CAST(n AS BIGINT) AS n FROM c WHERE fresh AND n % 5 = 0""")
def hopping_steps(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d).withColumn("dst_ip", F.concat(F.lit("192.168.1."), (F.col("user_id") % 3).cast("string")))
    return windowed.hopping(p).select("event_id", "source_ip", "n")
