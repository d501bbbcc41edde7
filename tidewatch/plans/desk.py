"""Queries of fingerprints, device policies, drill-downs, key figures, capture quality, alert rules and counters, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import desk, report, rules
from ..sources import reference
from .detect import packets
from .registry import query, table
from .reports import A_SQL, NOW, NOW_SPARK, attacks

# Fingerprints by number: a few of them are listed, some packets have none; others name no server.
HELLO = ("event_id", "ts", "src_ip", "CASE WHEN k % 9 <> 0 THEN concat('t13d', CAST(k AS STRING)) END AS ja4", "CASE WHEN k % 4 <> 0 THEN tls_sni ELSE '' END AS sni")
LISTED = "concat('t13d', CAST(s_suppkey % 30 * 3 AS STRING))"


@query("cor06_fingerprints", f"""{A_SQL}, h AS (SELECT {', '.join(HELLO)} FROM packets), m AS (SELECT DISTINCT {LISTED} AS ja4 FROM supplier)
    SELECT event_id, CASE WHEN bad THEN 'malicious_tls_fingerprint' ELSE 'tls_fingerprint' END AS attack_type, CASE WHEN bad THEN 'high' ELSE 'info' END AS severity, CASE WHEN bad THEN concat('Known malicious JA4: ', ja4) ELSE concat('JA4=', ja4, CASE WHEN sni <> '' THEN concat(' SNI=', sni) ELSE '' END) END AS details
    FROM (SELECT h.*, m.ja4 IS NOT NULL AS bad FROM h LEFT JOIN m ON m.ja4 = h.ja4 WHERE h.ja4 IS NOT NULL) x""")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "supplier").selectExpr(f"{LISTED} AS ja4")
    return desk.fingerprint_hits(packets(spark, d).selectExpr(*HELLO), listed).select("event_id", "attack_type", "severity", "details")


# Addresses of devices: registered ones end in a number, the rest are told by their first half.
MAC = "CASE WHEN k % 25 = 0 THEN '' ELSE concat(CASE user_id % 4 WHEN 0 THEN '00:0c:29' WHEN 1 THEN '08:00:27' WHEN 2 THEN 'aa:bb:cc' ELSE '00:1b:44' END, ':00:00:', CAST(10 + user_id % 60 AS STRING)) END AS src_mac"
DEVICES_SQL = "(SELECT concat('00:0c:29:00:00:', CAST(n AS STRING)) AS mac, CASE WHEN n % 2 = 0 THEN 'printer' ELSE 'camera' END AS policy FROM (SELECT DISTINCT 10 + s_suppkey % 40 AS n FROM supplier) s)"
VENDORS = [("00:0C:29", "VMware"), ("08:00:27", "VirtualBox"), ("00:1B:44", "SanDisk")]
POLICIES = [("printer", 20, [22, 80, 443], ["tcp"], None, None), ("server", 60, None, ["tcp", "udp"], 6, 20), ("workstation", 1000, [80, 443, 53, 22], None, None, None)]
POLICY_SQL = """CASE WHEN src_mac <> '' THEN coalesce(v.policy, CASE WHEN upper(substr(src_mac, 1, 8)) IN ('00:0C:29', '08:00:27') THEN 'server' ELSE 'workstation' END) END"""
_DEVICES = f"{A_SQL}, p AS (SELECT * REPLACE ({MAC.removesuffix(' AS src_mac')} AS src_mac) FROM packets), v AS {DEVICES_SQL}, w AS (SELECT p.*, {POLICY_SQL} AS policy FROM p LEFT JOIN v ON v.mac = p.src_mac)"


def policied(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d).withColumn("src_mac", F.expr(MAC.removesuffix(" AS src_mac")))
    n = (10 + F.col("s_suppkey") % 40).alias("n")
    devices = table(spark, d, "supplier").select(n).distinct().select(F.concat(F.lit("00:0c:29:00:00:"), F.col("n").cast("string")).alias("mac"), F.when(F.col("n") % 2 == 0, "printer").otherwise("camera").alias("policy"))
    return desk.with_policy(p, devices, spark.createDataFrame(VENDORS, "prefix string, vendor string"))


@query("cor08_policies", f"{_DEVICES} SELECT event_id, policy FROM w")
def device_policies(spark: SparkSession, d: str) -> DataFrame:
    return policied(spark, d).select("event_id", "policy")


@query("win43_policy_violations", f"""{_DEVICES}, n AS (SELECT *, count(*) OVER (PARTITION BY src_mac ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM w WHERE policy IN ('printer', 'server', 'workstation'))
    SELECT event_id, CASE WHEN reason = 'connections' THEN 'high' ELSE 'medium' END AS severity, reason FROM (SELECT event_id, CASE WHEN n > CASE policy WHEN 'printer' THEN 20 WHEN 'server' THEN 60 ELSE 1000 END THEN 'connections'
      WHEN policy = 'printer' AND dst_port NOT IN (22, 80, 443) OR policy = 'workstation' AND dst_port NOT IN (80, 443, 53, 22) THEN 'port' WHEN policy = 'printer' AND protocol <> 'tcp' OR policy = 'server' AND protocol NOT IN ('tcp', 'udp') THEN 'protocol'
      WHEN policy = 'server' AND NOT hour(ts) BETWEEN 6 AND 19 THEN 'hour' END AS reason FROM n) x WHERE reason IS NOT NULL""")
def policy_violations(spark: SparkSession, d: str) -> DataFrame:
    policies = spark.createDataFrame(POLICIES, "policy string, max_connections int, ports array<int>, protocols array<string>, from_hour int, to_hour int")
    return desk.policy_violations(policied(spark, d), policies).select("event_id", "severity", "reason")


TEXT = "CASE WHEN k % 3 = 0 THEN concat('from x port ', CAST(20 + k % 6 AS STRING)) WHEN k % 3 = 1 THEN concat('scan of ', CAST(k % 7 AS STRING), '/tcp') ELSE 'nothing' END"
BLOCKS_SQL = f"b AS (SELECT source_ip AS ip_address, ts AS created_at, ts + INTERVAL 3 DAY AS block_until, CASE WHEN k % 2 = 0 THEN 'inline' ELSE 'manual' END AS method FROM attacks WHERE severity = 'critical')"


def blocks(a: DataFrame) -> DataFrame:
    return a.filter("severity = 'critical'").select(F.col("source_ip").alias("ip_address"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 3 days")).alias("block_until"), F.when(F.col("k") % 2 == 0, "inline").otherwise("manual").alias("method"))


def _top_sql(of: str, rows: str) -> str:
    return f"(SELECT source_ip, string_agg(concat({of}, ':', n), ',' ORDER BY i) AS l FROM (SELECT source_ip, {of}, count(*) AS n, row_number() OVER (PARTITION BY source_ip ORDER BY count(*) DESC, {of}) AS i FROM {rows} GROUP BY source_ip, {of}) z WHERE i <= 5 GROUP BY source_ip)"


@query("agg09_attacker_detail", f"""{A_SQL}, {BLOCKS_SQL}, x AS (SELECT source_ip, CAST(CASE WHEN k % 3 = 0 THEN 20 + k % 6 ELSE k % 7 END AS INT) AS port FROM attacks WHERE k % 3 < 2)
    SELECT a.source_ip, min(a.ts) AS first_seen, max(a.ts) AS last_seen, count(*) AS attack_count, any_value(t.l) AS top_types, coalesce(any_value(p.l), '') AS top_ports, a.source_ip IN (SELECT ip_address FROM b WHERE created_at <= {NOW} AND block_until > {NOW}) AS blocked
    FROM attacks a LEFT JOIN {_top_sql('attack_type', 'attacks')} t ON t.source_ip = a.source_ip LEFT JOIN {_top_sql('port', 'x')} p ON p.source_ip = a.source_ip GROUP BY a.source_ip""")
def attacker_detail(spark: SparkSession, d: str) -> DataFrame:
    a = attacks(spark, d).withColumn("raw_line", F.expr(TEXT))
    return desk.drill_down(a, blocks(a), F.expr(NOW_SPARK), "raw_line")


@query("agg10_key_figures", f"""{A_SQL}, {BLOCKS_SQL} SELECT (SELECT count(*) FROM packets WHERE ts > {NOW} - INTERVAL 1 SECOND AND ts <= {NOW}) AS rate, (SELECT count(*) FROM attacks WHERE ts > {NOW} - INTERVAL 1 DAY AND ts <= {NOW}) AS attacks,
    (SELECT count(DISTINCT ip_address) FROM b WHERE created_at <= {NOW} AND block_until > {NOW}) AS blocked, (SELECT count(*) FROM attacks WHERE attack_type = 'sql_injection') AS critical, (SELECT source_ip FROM attacks GROUP BY 1 ORDER BY count(*) DESC, source_ip LIMIT 1) AS top_ip""")
def key_figures(spark: SparkSession, d: str) -> DataFrame:
    a = attacks(spark, d)
    return desk.key_figures(a, blocks(a), packets(spark, d), F.expr(NOW_SPARK))


@query("agg20_incident_report", f"""{A_SQL}, i AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'resolved' ELSE 'open' END AS status, CASE WHEN k % 4 = 0 THEN [] WHEN k % 4 = 1 THEN ['T1110', 'T1078'] ELSE ['T1190'] END AS mitre FROM attacks)
    SELECT 'status' AS panel, status AS name, count(*) AS n, NULL AS worst FROM i GROUP BY status UNION ALL SELECT 'severity', severity, count(*), NULL FROM i GROUP BY severity UNION ALL
    SELECT 'techniques', t, count(*), NULL FROM (SELECT unnest(CASE WHEN len(mitre) > 0 THEN mitre ELSE [attack_type] END) AS t FROM i) u GROUP BY t UNION ALL
    SELECT 'sources', source_ip, n, ['info', 'low', 'medium', 'high', 'critical'][w + 1] FROM (SELECT source_ip, count(*) AS n, max(CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) AS w FROM i GROUP BY source_ip ORDER BY n DESC, source_ip LIMIT 10) s""")
def incident_report(spark: SparkSession, d: str) -> DataFrame:
    mitre = F.when(F.col("k") % 4 == 0, F.array().cast("array<string>")).when(F.col("k") % 4 == 1, F.array(F.lit("T1110"), F.lit("T1078"))).otherwise(F.array(F.lit("T1190")))
    i = attacks(spark, d).withColumn("status", F.when(F.col("k") % 3 == 0, "resolved").otherwise("open")).withColumn("mitre", mitre)
    return desk.incident_report(i)


# Captures by user; what each is expected to hold.
EXPECTED = [("c0", ["port_scan", "sql_injection"], None), ("c1", ["of_no_kind"], None), ("c2", [], 5), ("c3", [], 10**9), ("c4", None, None)]


@query("agg25_capture_quality", f"""{A_SQL}, p AS (SELECT event_id, 'c' || CAST(user_id % 6 AS STRING) AS capture FROM base), d AS (SELECT a.*, p.capture FROM attacks a JOIN p USING (event_id) WHERE k % 5 < 2),
    t AS (SELECT capture, string_agg(DISTINCT attack_type, ',' ORDER BY attack_type) AS l, list(DISTINCT attack_type) AS f, count(DISTINCT event_id) AS n, count(DISTINCT CASE WHEN severity <> 'info' THEN event_id END) AS acts FROM d GROUP BY capture),
    s AS (SELECT capture, string_agg(source_ip, ',' ORDER BY i) AS l FROM (SELECT capture, source_ip, row_number() OVER (PARTITION BY capture ORDER BY count(*) DESC, source_ip) AS i FROM d GROUP BY capture, source_ip) z WHERE i <= 5 GROUP BY capture)
    SELECT p.capture, count(*) AS packets, any_value(coalesce(t.n, 0)) AS detected, any_value(coalesce(t.acts, 0)) AS actionable, any_value(coalesce(t.l, '')) AS types_found, any_value(s.l) AS top_sources, CASE p.capture WHEN 'c0' THEN any_value(list_has_any(t.f, ['port_scan', 'sql_injection'])) WHEN 'c1' THEN false WHEN 'c2' THEN any_value(coalesce(t.acts, 0)) <= 5 ELSE true END AS as_expected
    FROM p LEFT JOIN t USING (capture) LEFT JOIN s USING (capture) GROUP BY p.capture""")
def capture_quality(spark: SparkSession, d: str) -> DataFrame:
    a = attacks(spark, d)
    p = a.select("event_id", F.concat(F.lit("c"), (F.col("user_id") % 6).cast("string")).alias("capture"))
    expected = spark.createDataFrame(EXPECTED, "capture string, types array<string>, budget long")
    return desk.capture_quality(p, a.filter("k % 5 < 2").select("event_id", "source_ip", "attack_type", "severity"), expected)


@query("agg26_rates_against_limits", f"""{A_SQL}, {BLOCKS_SQL}, r AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS w, severity AS rule, count(*) / 21600.0 AS rate, CASE severity WHEN 'critical' THEN 0.0003 WHEN 'high' THEN 0.0004 END AS lim FROM attacks GROUP BY ALL
    UNION ALL SELECT time_bucket(INTERVAL 6 HOUR, created_at, TIMESTAMP '2024-01-01'), 'blocks', count(*) / 21600.0, 0.0005 FROM b GROUP BY ALL) SELECT strftime(w, '%Y-%m-%d %H') AS start, rule, round(rate, 9) AS rate FROM r WHERE rate > lim""")
def rates_against_limits(spark: SparkSession, d: str) -> DataFrame:
    a = attacks(spark, d)
    found = desk.alert_rules(a, blocks(a), {"critical": 0.0003, "high": 0.0004}, 0.0005, "6 hours")
    return found.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "rule", F.round("rate", 9).alias("rate"))


@query("snk07_counters", f"""{A_SQL}, {BLOCKS_SQL} SELECT 'packets' AS name, CASE WHEN k % 4 = 0 THEN 'drop' ELSE 'pass' END AS label, NULL AS level, count(*) AS n FROM packets GROUP BY 2 UNION ALL SELECT 'attacks', attack_type, severity, count(*) FROM attacks GROUP BY ALL UNION ALL SELECT 'blocks', method, NULL, count(*) FROM b GROUP BY 2""")
def counters(spark: SparkSession, d: str) -> DataFrame:
    a = attacks(spark, d)
    return desk.metrics(packets(spark, d).withColumn("verdict", F.when(F.col("k") % 4 == 0, "drop").otherwise("pass")), a, blocks(a))


@query("win32_active_hours", """WITH e AS (SELECT event_id, ts, user_id % 40 AS host, CAST(hour(ts) // 4 AS INT) * 4 AS h FROM events), w AS (SELECT *, count(*) OVER o AS n, lag(h) OVER (PARTITION BY host ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY host, h ORDER BY ts, event_id) AS nth FROM e WINDOW o AS (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    x AS (SELECT *, sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hours FROM w) SELECT event_id, host AS source_ip, h AS hour FROM x WHERE nth < 3 AND (before IS NULL OR before <> h) AND n >= 8 AND hours >= 3 AND hours / 24.0 < 0.3""")
def active_hours(spark: SparkSession, d: str) -> DataFrame:
    """Hours in steps of four, so that hosts with few events have hours they seldom use."""
    return desk.unusual_hours(table(spark, d, "events").withColumn("host", F.col("user_id") % 40), "host", "ts", 8, seldom=3, step=4).select("event_id", "source_ip", "hour")


@query("agg13_dashboard", f"""{A_SQL}, {BLOCKS_SQL}, l AS (SELECT CASE WHEN k % 2 = 0 THEN 'honeypot' ELSE 'honeyfile' END AS kind, severity, ts FROM attacks WHERE event_type <> 'view'),
    p AS (SELECT 'types' AS panel, row_number() OVER (ORDER BY count(*) DESC, attack_type) AS place, attack_type AS name, CAST(count(*) AS STRING) AS value FROM attacks GROUP BY attack_type UNION ALL
      SELECT 'attacks', row_number() OVER (ORDER BY ts DESC, source_ip, attack_type), source_ip, attack_type FROM attacks UNION ALL SELECT 'blocks', row_number() OVER (ORDER BY created_at DESC, ip_address), ip_address, strftime(block_until, '%Y-%m-%d %H:%M:%S') FROM b WHERE created_at <= {NOW} AND block_until > {NOW})
    SELECT panel, CAST(place AS INT) AS place, name, value FROM p WHERE place <= 10 UNION ALL SELECT 'deception', CAST(row_number() OVER (ORDER BY kind) AS INT), kind, CAST(count(*) AS STRING) FROM l GROUP BY kind UNION ALL
    SELECT 'alerts', CAST(row_number() OVER (ORDER BY severity) AS INT), severity, CAST(count(*) AS STRING) FROM l WHERE ts > {NOW} - INTERVAL 1 HOUR AND ts <= {NOW} GROUP BY severity""")
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    a = attacks(spark, d)
    seen = a.filter("event_type <> 'view'").select(F.when(F.col("k") % 2 == 0, "honeypot").otherwise("honeyfile").alias("kind"), "severity", F.col("ts").alias("created_at"))
    return desk.dashboard(a, blocks(a), seen, seen, F.expr(NOW_SPARK))


@query("agg05_attacker_countries", f"""{A_SQL}, x AS (SELECT source_ip, max(ts) AS last_seen, CASE WHEN min(user_id) % 4 <> 0 THEN 'C' || CAST(min(user_id) % 7 AS STRING) END AS country FROM attacks GROUP BY source_ip)
    SELECT 'total' AS panel, NULL AS name, count(*) AS n FROM x UNION ALL SELECT 'last_day', NULL, count(*) FROM x WHERE last_seen >= {NOW} - INTERVAL 1 DAY UNION ALL SELECT * FROM (SELECT 'country', country, count(*) AS n FROM x WHERE country IS NOT NULL GROUP BY country ORDER BY n DESC, country LIMIT 5) t""")
def attacker_countries(spark: SparkSession, d: str) -> DataFrame:
    host = F.min("user_id")
    per = attacks(spark, d).groupBy(F.col("source_ip").alias("ip_address")).agg(F.max("ts").alias("last_seen"), F.when(host % 4 != 0, F.concat(F.lit("C"), (host % 7).cast("string"))).alias("country"))
    return desk.attacker_countries(per, F.expr(NOW_SPARK))


@query("agg27_counters_and_rate", f"""{A_SQL}, v AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'drop' WHEN k % 4 = 1 THEN 'rate_limit' ELSE 'pass' END AS verdict FROM packets) SELECT verdict, count(*) AS n, round(avg(value), 4) AS mean_latency, round(count(*) / (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 FROM v), 8) AS rate FROM v GROUP BY verdict""")
def counters_and_rate(spark: SparkSession, d: str) -> DataFrame:
    v = packets(spark, d).withColumn("verdict", F.when(F.col("k") % 4 == 0, "drop").when(F.col("k") % 4 == 1, "rate_limit").otherwise("pass")).withColumn("latency", F.col("value"))
    return desk.pipeline_counters(v).select("verdict", "n", F.round("mean_latency", 4).alias("mean_latency"), F.round("rate", 8).alias("rate"))


@query("lkp03_technique_lists", f"""{A_SQL}, t AS (SELECT DISTINCT a.attack_type, x.technique, m.tactic FROM attacks a JOIN {reference.attack_techniques_sql()} x USING (attack_type) LEFT JOIN {reference.technique_tactics_sql()} m USING (technique))
    SELECT CAST(count(DISTINCT technique) AS INT) AS n_techniques, CAST(count(DISTINCT tactic) AS INT) AS n_tactics, string_agg(DISTINCT technique, ',' ORDER BY technique) AS techniques, string_agg(DISTINCT tactic, ',' ORDER BY tactic) AS tactics,
      (SELECT count(DISTINCT c.attack_type) FILTER (c.attack_type IN (SELECT attack_type FROM attacks)) / count(DISTINCT c.attack_type) FROM {reference.attack_types_sql()} c) AS share FROM t""")
def technique_lists(spark: SparkSession, d: str) -> DataFrame:
    return desk.technique_coverage(rules.with_techniques(attacks(spark, d), spark), reference.attack_types(spark))


def _digits(name: str) -> int:
    """Times are whole microseconds; means and deviations depend on the order of sums in their last digits."""
    return 4 if name.endswith(("mean", "std", "ratio", "pkt")) else 6


def _vector_sql() -> str:
    """Every feature as an aggregate over f: fwd, payload, gap, and their ranks and counts in the session and each way."""
    out = ["count(*) FILTER (fwd)::DOUBLE AS fwd_pkts", "count(*) FILTER (NOT fwd)::DOUBLE AS bwd_pkts", "count(*)::DOUBLE AS total_pkts", "(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS flow_duration", "sum(len) / count(*) AS bytes_per_pkt"]
    for side, keep, tag in (("", "true", "all"), ("fwd_", "fwd", "own"), ("bwd_", "NOT fwd", "own")):
        for name, label in (("len", "pkt_len"), ("iat", "iat")):
            out += [f"coalesce({fn}({name}) FILTER ({keep}), 0)::DOUBLE AS {side}{label}_{stat}" for stat, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))]
            out += [f"coalesce(max({name}) FILTER ({keep} AND {name}_{tag} = least(n_{tag} * {p} // 100, n_{tag} - 1)), 0)::DOUBLE AS {side}{label}_p{p}" for p in (25, 75)]
    for letter, label in zip("SAFR", ("syn", "ack", "fin", "rst"), strict=True):
        n = f"sum(length(flags) - length(replace(flags, '{letter}', '')))"
        out += [f"{n}::DOUBLE AS {label}_count", f"{n} / count(*) AS {label}_ratio"]
    out += [f"0.0::DOUBLE AS {x}" for x in ("tls_version", "tls_ciphers", "tls_exts")] + [f"coalesce(avg(ttl) FILTER ({keep}), 0)::DOUBLE AS {side}ttl_mean" for side, keep in (("fwd_", "fwd"), ("bwd_", "NOT fwd"))]
    return ", ".join(f"round({x}, {_digits(name)}) AS {name}" for x, name in (x.rsplit(" AS ", 1) for x in out))


_FLOW_SQL = "concat(least(concat(src_ip, ':', CAST(src_port AS STRING)), concat(dst_ip, ':', CAST(dst_port AS STRING))), '|', greatest(concat(src_ip, ':', CAST(src_port AS STRING)), concat(dst_ip, ':', CAST(dst_port AS STRING))))"


@query("agg15_flow_vector", f"""{A_SQL}, p AS (SELECT event_id, ts, src_ip, '192.168.0.1' AS dst_ip, 1000 + k % 2 AS src_port, 80 AS dst_port, payload_len, flags, ttl, k FROM packets), t AS (SELECT * FROM p UNION ALL SELECT -event_id, ts + INTERVAL 1 SECOND, dst_ip, src_ip, dst_port, src_port, CAST(payload_len // 3 AS INT), 'SA', ttl + 1, k FROM p WHERE k % 3 = 0),
    q AS (SELECT *, {_FLOW_SQL} AS flow FROM t), g AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY flow ORDER BY ts, event_id)) / 1e6 AS gap FROM q),
    s AS (SELECT *, sum(CASE WHEN gap > 432000 THEN 1 ELSE 0 END) OVER (PARTITION BY flow ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g),
    e AS (SELECT *, src_ip = first_value(src_ip) OVER w AND src_port = first_value(src_port) OVER w AS fwd, payload_len::DOUBLE AS len, CASE WHEN row_number() OVER w = 1 THEN 0.0 ELSE gap END AS iat FROM s WINDOW w AS (PARTITION BY flow, session ORDER BY ts, event_id)),
    f AS (SELECT *, {', '.join(f"row_number() OVER (PARTITION BY {by} ORDER BY {name}, ts, event_id) - 1 AS {name}_{tag}" for name in ("len", "iat") for tag, by in (("all", "flow, session"), ("own", "flow, session, fwd")))}, count(*) OVER (PARTITION BY flow, session) AS n_all, count(*) OVER (PARTITION BY flow, session, fwd) AS n_own FROM e)
    SELECT flow, CAST(session AS BIGINT) AS session, {_vector_sql()} FROM f GROUP BY flow, session""")
def flow_vector(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d).select("event_id", "ts", "src_ip", F.lit("192.168.0.1").alias("dst_ip"), (1000 + F.col("k") % 2).alias("src_port"), F.lit(80).alias("dst_port"), "payload_len", "flags", "ttl", "k")
    swapped = {"src_ip": F.col("dst_ip"), "dst_ip": F.col("src_ip"), "src_port": F.col("dst_port"), "dst_port": F.col("src_port")}
    reply = {"event_id": -F.col("event_id"), "ts": F.expr("ts + INTERVAL 1 SECOND"), "payload_len": F.floor(F.col("payload_len") / 3).cast("int"), "flags": F.lit("SA"), "ttl": F.col("ttl") + 1}
    both = p.unionByName(p.filter("k % 3 = 0").withColumns(swapped | reply))
    v = report.flow_vector(both, F.expr(_FLOW_SQL), 5 * 86_400)
    return v.select("flow", "session", *[F.round(c, _digits(c)).alias(c) for c in v.columns if c not in ("flow", "session")])
