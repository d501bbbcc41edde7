"""Queries over log lines, detections and stored tables, all derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip_label, is_actionable, nearest_rank, severity_rank, url_decoded
from ..operators import parse, report, rules, suppress, windowed
from ..sources import reference, sinks
from ..sources.derive import derive, derived_sql
from ..sources.readers import above_mark
from .registry import ORACLES, query, table

# The stored attacks: detections of several types, by source, with the country of a customer of the same number.
KIND = "CASE k % 7 WHEN 0 THEN 'port_scan' WHEN 1 THEN 'sql_injection' WHEN 2 THEN 'ssh_bruteforce' WHEN 3 THEN 'syn_flood' WHEN 4 THEN 'crypto_miner' WHEN 5 THEN 'tls_observation' ELSE 'admin_probe' END"
SEVERITY = "CASE k % 7 WHEN 0 THEN 'medium' WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'high' WHEN 4 THEN 'critical' WHEN 5 THEN 'info' ELSE 'low' END"
ATTACKS = ("event_id", "ts", "user_id", "k", "value", "event_type", "concat('10.0.', CAST(user_id % 4 AS STRING), '.', CAST(user_id % 250 AS STRING)) AS source_ip", f"{KIND} AS attack_type", f"{SEVERITY} AS severity")
A_SQL = f"{derived_sql('packets')}, attacks AS (SELECT {', '.join(ATTACKS)} FROM base)"
NOW = "TIMESTAMP '2024-01-30 00:00:00'"
NOW_SPARK = "TIMESTAMP_NTZ '2024-01-30 00:00:00'"


def attacks(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.derive import BASE, K_SPARK

    return table(spark, d, "events").selectExpr(*BASE, K_SPARK).selectExpr(*ATTACKS)


def lines(spark: SparkSession, d: str) -> DataFrame:
    return derive(table(spark, d, "events"), "log_lines")


@query("src01_log_files", f"{derived_sql('log_lines')} SELECT count(*) AS n, sum(length(line)) AS chars FROM log_lines")
def log_files(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


@query("src06_deception_high_water", "SELECT event_id FROM events WHERE event_id > 500")
def deception(spark: SparkSession, d: str) -> DataFrame:
    return above_mark(table(spark, d, "events"), 500, "event_id").select("event_id")


@query("par01_log_classifier", f"""{derived_sql('log_lines')} SELECT event_id, CASE WHEN line LIKE '%Failed password%' THEN 'ssh_failed' WHEN line LIKE '%Accepted password%' THEN 'ssh_accepted' WHEN line LIKE '%Connection closed%' THEN 'ssh_connection_closed' ELSE 'web_access' END AS log_type,
    CASE WHEN line LIKE '%Failed password%' THEN regexp_extract(line, 'from ([0-9.]+) port', 1) WHEN line LIKE '%Accepted password%' THEN regexp_extract(line, 'from ([0-9.]+) port', 1) WHEN line LIKE '%Connection closed%' THEN regexp_extract(line, 'by ([0-9.]+) port', 1) ELSE split_part(line, ' ', 1) END AS log_ip,
    CASE WHEN line LIKE '%Failed password%' OR line LIKE '%Accepted password%' THEN regexp_extract(line, '(u[0-9]+) from', 1) WHEN line LIKE '%Connection closed%' THEN NULL ELSE '-' END AS log_user FROM log_lines""")
def log_classifier(spark: SparkSession, d: str) -> DataFrame:
    return parse.log_lines(lines(spark, d)).select("event_id", "log_type", "log_ip", "log_user")


@query("par02_web_signatures", """SELECT page_id, CASE WHEN regexp_matches(url, '(?i)(php://|file://|data://|expect://|ftp://|http://|https://)') THEN 'rfi_attempt' END AS attack_type FROM pages""")
def web_signatures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", parse.web_signature(F.col("url")).alias("attack_type"))


@query("par03_timestamps", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events""")
def timestamps(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123"))
    return table(spark, d, "events").select("event_id", F.date_format(parse.timestamp(text, 2024), "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("par04_syslog", f"""{derived_sql('syslog_lines')} SELECT event_id, CASE WHEN raw LIKE '<%' THEN split_part(raw, ' ', 3) ELSE regexp_extract(raw, '(host[0-9]+)', 1) END AS hostname,
    CASE WHEN raw LIKE '<%' THEN CASE CAST(regexp_extract(raw, '^<([0-9]+)>', 1) AS INT) // 8 WHEN 0 THEN 'kern' WHEN 1 THEN 'user' WHEN 2 THEN 'mail' WHEN 3 THEN 'daemon' WHEN 4 THEN 'auth' WHEN 5 THEN 'syslog' WHEN 6 THEN 'lpr' WHEN 7 THEN 'news' WHEN 8 THEN 'uucp' WHEN 9 THEN 'cron' WHEN 10 THEN 'authpriv' WHEN 11 THEN 'ftp' ELSE 'local12' END ELSE 'user' END AS facility,
    CASE WHEN raw LIKE '<%' THEN CASE CAST(regexp_extract(raw, '^<([0-9]+)>', 1) AS INT) % 8 WHEN 0 THEN 'emergency' WHEN 1 THEN 'alert' WHEN 2 THEN 'critical' WHEN 3 THEN 'error' WHEN 4 THEN 'warning' WHEN 5 THEN 'notice' WHEN 6 THEN 'info' ELSE 'debug' END ELSE 'info' END AS level FROM syslog_lines""")
def syslog(spark: SparkSession, d: str) -> DataFrame:
    return parse.syslog(derive(table(spark, d, "events"), "syslog_lines")).select("event_id", "hostname", "facility", "level")


@query("par05_syslog_attacks", f"""{derived_sql('syslog_lines')} SELECT event_id, a AS attack_type FROM (SELECT event_id, CASE WHEN raw LIKE '%Failed password%' THEN 'syslog_bruteforce' WHEN raw LIKE '%denied by firewall%' THEN 'syslog_firewall_block' WHEN raw LIKE '%nmap seen%' THEN 'syslog_port_scan' WHEN raw LIKE '%trojan%' THEN 'syslog_malware' WHEN raw LIKE '%kernel panic%' THEN 'syslog_system_compromise'
    WHEN raw LIKE '<%' AND CAST(regexp_extract(raw, '^<([0-9]+)>', 1) AS INT) % 8 < 3 THEN 'syslog_critical' END AS a FROM syslog_lines) t WHERE a IS NOT NULL""")
def syslog_attacks(spark: SparkSession, d: str) -> DataFrame:
    s = parse.syslog(derive(table(spark, d, "events"), "syslog_lines"))
    return s.select("event_id", parse.syslog_attack(F.col("message"), F.col("level")).alias("attack_type")).filter("attack_type is not null")


@query("agg16_syslog_stats", f"""{derived_sql('syslog_lines')} SELECT CASE WHEN raw LIKE '<%' THEN CASE CAST(regexp_extract(raw, '^<([0-9]+)>', 1) AS INT) % 8 WHEN 0 THEN 'emergency' WHEN 1 THEN 'alert' WHEN 2 THEN 'critical' WHEN 3 THEN 'error' WHEN 4 THEN 'warning' WHEN 5 THEN 'notice' WHEN 6 THEN 'info' ELSE 'debug' END ELSE 'info' END AS level, count(*) AS n FROM syslog_lines GROUP BY 1""")
def syslog_stats(spark: SparkSession, d: str) -> DataFrame:
    return parse.syslog(derive(table(spark, d, "events"), "syslog_lines")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("par06_exploit_signatures", """SELECT page_id FROM pages WHERE html LIKE '%() {%' OR lower(html) LIKE '%${jndi:%' OR lower(html) LIKE '%spectre%' OR lower(html) LIKE '%meltdown%'""")
def exploit_signatures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").filter(parse.exploit_signature(F.col("html")).isNotNull()).select("page_id")


@query("par07_http_request", """SELECT page_id, 'GET' AS method, url AS uri, 'u' || (page_id % 7) AS agent FROM pages""")
def http_request(spark: SparkSession, d: str) -> DataFrame:
    payload = F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1\r\nHost: x\r\nUser-Agent: u"), (F.col("page_id") % 7).cast("string"), F.lit("\r\n\r\nbody"))
    r = table(spark, d, "pages").select("page_id", parse.http_request(payload).alias("r"))
    return r.select("page_id", "r.method", "r.uri", F.col("r.headers")["user-agent"].alias("agent"))


@query("par15_port_in_text", f"{derived_sql('log_lines')} SELECT event_id, CAST(regexp_extract(line, 'port ([0-9]+)', 1) AS INT) AS port FROM log_lines WHERE regexp_matches(line, 'port [0-9]+')")
def port_in_text(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("event_id", parse.port_in_text(F.col("line")).alias("port")).filter("port is not null")


@query("par16_explanations", f"""{A_SQL} SELECT event_id, CASE attack_type WHEN 'port_scan' THEN concat(source_ip, ' probed ', CAST(k AS STRING), ' ports') WHEN 'syn_flood' THEN concat(source_ip, ' sent ', CAST(k AS STRING), ' SYN packets') WHEN 'sql_injection' THEN concat(source_ip, ' tried SQL injection')
    WHEN 'ssh_bruteforce' THEN concat(source_ip, ' failed to log in ', CAST(k AS STRING), ' times') ELSE concat(source_ip, ': ', attack_type) END AS text FROM attacks""")
def explanations(spark: SparkSession, d: str) -> DataFrame:
    return attacks(spark, d).select("event_id", parse.explanation(F.col("attack_type"), F.col("source_ip"), F.col("k")).alias("text"))


@query("par18_actionable", f"{A_SQL} SELECT event_id FROM attacks WHERE severity <> 'info'")
def actionable(spark: SparkSession, d: str) -> DataFrame:
    return attacks(spark, d).filter(is_actionable(F.concat(F.lit(" "), F.upper("severity")))).select("event_id")


def _web_case() -> str:
    tried = [(pattern.replace("'", "''"), kind) for _, pattern, kind in reference.WEB_SIGNATURES[: reference.WEB_LAST + 1]]
    return "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') OR regexp_matches(plain, '{p}') THEN '{kind}'" for p, kind in tried) + " END"


# The derived lines are ssh lines, which say nothing by themselves, and access lines.
LOG_DISPATCH_SQL = f"""{derived_sql('log_lines')} SELECT event_id, attack_type FROM (SELECT event_id, {_web_case()} AS attack_type FROM (SELECT event_id, line, url_decode(replace(line, '+', ' ')) AS plain FROM log_lines WHERE line NOT LIKE '%sshd[%') l) t WHERE attack_type IS NOT NULL"""


@query("st38_log_dispatch", LOG_DISPATCH_SQL)
@query("st38_log_dispatch_all", LOG_DISPATCH_SQL)
def log_dispatch_all(spark: SparkSession, d: str) -> DataFrame:
    return parse.log_attacks(lines(spark, d)).select("event_id", "attack_type").filter("attack_type is not null")


@query("lkp01_severity", f"{A_SQL} SELECT a.event_id, coalesce(t.severity, 'medium') AS severity, coalesce(t.category, 'unknown') AS category FROM attacks a LEFT JOIN {reference.attack_types_sql()} t ON a.attack_type = t.attack_type")
def severity_lookup(spark: SparkSession, d: str) -> DataFrame:
    return rules.severity_of(attacks(spark, d).drop("severity"), spark).select("event_id", "severity", "category")


@query("lkp02_mitre", f"""{A_SQL}, t AS (SELECT a.attack_type, string_agg(a.technique, ',' ORDER BY a.place) AS mitre, string_agg(m.tactic, ',' ORDER BY a.place) AS tactics FROM {reference.attack_techniques_sql()} a LEFT JOIN {reference.technique_tactics_sql()} m USING (technique) GROUP BY a.attack_type)
    SELECT a.event_id, t.mitre, t.tactics FROM attacks a LEFT JOIN t USING (attack_type)""")
def mitre(spark: SparkSession, d: str) -> DataFrame:
    m = rules.with_techniques(attacks(spark, d), spark)
    return m.select("event_id", F.concat_ws(",", "mitre").alias("mitre"), F.concat_ws(",", "tactics").alias("tactics")).select("event_id", F.when(F.col("mitre") != "", F.col("mitre")).alias("mitre"), F.when(F.col("tactics") != "", F.col("tactics")).alias("tactics"))


@query("lkp03_mitre_coverage", f"""{A_SQL} SELECT count(DISTINCT t.technique) AS techniques, count(DISTINCT m.tactic) AS tactics FROM attacks JOIN {reference.attack_techniques_sql()} t USING (attack_type) LEFT JOIN {reference.technique_tactics_sql()} m ON t.technique = m.technique""")
def mitre_coverage(spark: SparkSession, d: str) -> DataFrame:
    m = rules.with_techniques(attacks(spark, d).select("attack_type").distinct(), spark)
    return m.agg(F.size(F.array_distinct(F.flatten(F.collect_list("mitre")))).cast("long").alias("techniques"), F.size(F.array_distinct(F.flatten(F.collect_list("tactics")))).cast("long").alias("tactics"))


@query("lkp04_technique_detail", f"""{A_SQL} SELECT t.technique, max(m.tactic_name) AS tactic_name, count(DISTINCT attack_type) AS types, count(*) AS attacks FROM attacks JOIN {reference.attack_techniques_sql()} t USING (attack_type) LEFT JOIN {reference.technique_tactics_sql()} m ON t.technique = m.technique GROUP BY t.technique""")
def technique_detail(spark: SparkSession, d: str) -> DataFrame:
    t = reference.attack_techniques(spark).join(reference.technique_tactics(spark), "technique", "left")
    return attacks(spark, d).join(F.broadcast(t), "attack_type").groupBy("technique").agg(F.max("tactic_name").alias("tactic_name"), F.countDistinct("attack_type").alias("types"), F.count(F.lit(1)).alias("attacks"))


RANGES_SQL = reference.sql_values([(i, label, *reference.cidr_bounds(c)[:2]) for i, (label, c) in enumerate((label, c) for label in reference.RANGES for c in reference.RANGES[label]) if reference.cidr_bounds(c)[0] is not None], ("ord", "label", "lo", "hi"))
LABELLED = f"""{A_SQL}, ips AS (SELECT DISTINCT dst_ip, CAST(split_part(dst_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(dst_ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(dst_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(dst_ip, '.', 4) AS BIGINT) AS n FROM packets),
    lab AS (SELECT dst_ip, arg_min(label, ord) AS label FROM ips JOIN {RANGES_SQL} r ON n BETWEEN r.lo AND r.hi GROUP BY dst_ip)"""


@query("sup03_range_label", f"{LABELLED} SELECT p.event_id, lab.label FROM packets p LEFT JOIN lab USING (dst_ip)")
def range_label(spark: SparkSession, d: str) -> DataFrame:
    return suppress.range_label(derive(table(spark, d, "events"), "packets"), "dst_ip", reference.ranges(spark)).select("event_id", "label")


@query("sup04_noise", f"{LABELLED} SELECT a.event_id FROM attacks a JOIN packets p USING (event_id) LEFT JOIN lab ON p.dst_ip = lab.dst_ip WHERE NOT coalesce(lab.label IN ('cloudflare', 'google', 'aws') AND a.attack_type IN ('broadcast_storm', 'timing_evasion', 'port_scan', 'session_correlated_sql_attack', 'session_correlated_cmd_attack') OR lab.label = 'private' AND a.attack_type = 'broadcast_storm', false)")
def noise(spark: SparkSession, d: str) -> DataFrame:
    p = suppress.range_label(derive(table(spark, d, "events"), "packets"), "dst_ip", reference.ranges(spark)).select("event_id", "label")
    return suppress.drop_noise(attacks(spark, d).join(p, "event_id")).select("event_id")


@query("sup05_whitelist", f"{A_SQL} SELECT event_id FROM attacks WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 95)")
def whitelist(spark: SparkSession, d: str) -> DataFrame:
    good = table(spark, d, "events").filter("value > 95").select("user_id").distinct()
    return attacks(spark, d).join(good, "user_id", "left_anti").select("event_id")


@query("sup06_protected", f"{A_SQL} SELECT event_id, CASE WHEN severity = 'critical' AND source_ip IN ('10.0.1.1', '10.0.2.2') THEN 'refused' WHEN severity = 'critical' THEN 'block' ELSE 'alert' END AS action FROM attacks")
def protected(spark: SparkSession, d: str) -> DataFrame:
    a = attacks(spark, d).withColumn("action", F.when(F.col("severity") == "critical", "block").otherwise("alert"))
    return suppress.protect(a, ["10.0.1.1", "10.0.2.2"]).select("event_id", "action")


@query("sup07_solicited", """WITH o AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM o)
    SELECT event_id FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s) t WHERE event_type <> 'click' AND m = 1""")
def solicited(spark: SparkSession, d: str) -> DataFrame:
    return suppress.solicited(table(spark, d, "events"), F.col("user_id"), F.col("event_type") == "click", 43200).filter("solicited").select("event_id")


@query("sup08_dampening", f"""{A_SQL}, p AS (SELECT source_ip, attack_type, count(*) AS n FROM attacks WHERE (source_ip, attack_type) NOT IN (SELECT source_ip, attack_type FROM attacks WHERE value > 60) GROUP BY ALL), t AS (SELECT attack_type, max(n) AS worst FROM p GROUP BY attack_type)
    SELECT source_ip, attack_type, n, n >= 3 AS damped, CASE WHEN worst >= 6 THEN 3.0 WHEN worst >= 3 THEN 1.5 ELSE 1.0 END::DOUBLE AS multiplier FROM p JOIN t USING (attack_type)""")
def dampening(spark: SparkSession, d: str) -> DataFrame:
    a = attacks(spark, d)
    return suppress.dampen(a, a.filter("value > 60").select("source_ip", "attack_type").distinct())


@query("cor01_active_block", """WITH b AS (SELECT user_id, ts AS created, ts + INTERVAL 2 DAY AS until FROM events WHERE event_type = 'error' AND value > 40) SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM b WHERE b.user_id = e.user_id AND e.ts >= b.created AND e.ts < b.until)""")
def active_block(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    b = e.filter("event_type = 'error' AND value > 40").select(F.col("user_id").alias("ip_address"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 2 days")).alias("block_until"))
    return suppress.active_block(e, b, "user_id").select("event_id")


@query("cor02_intel", f"""{A_SQL}, f AS (SELECT source_ip AS ip, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS provider, k AS s, k > 97 AS m, ts, event_id FROM attacks WHERE ts + INTERVAL 15 DAY > TIMESTAMP '2024-01-30'), n AS (SELECT ip, provider, arg_max(s, (ts, s)) AS s, arg_max(m, (ts, s)) AS m FROM f GROUP BY ip, provider)
    SELECT ip, max(s) AS abuse_score, max(CASE WHEN m THEN 1 ELSE 0 END) = 1 OR max(s) >= 50 AS malicious FROM n GROUP BY ip""")
def intel(spark: SparkSession, d: str) -> DataFrame:
    f = attacks(spark, d).select(F.col("source_ip").alias("ip"), F.when(F.col("k") % 2 == 0, "a").otherwise("b").alias("provider"), F.col("k").alias("abuse_score"), (F.col("k") > 97).alias("malicious"), F.col("ts").alias("fetched_at"))
    return suppress.intel(f, F.unix_micros(F.expr(NOW_SPARK).cast("timestamp")), 15 * 86_400)


@query("cor04_incident_score", f"{A_SQL} SELECT event_id, round(greatest(k / 100.0, (k % 9) / 8.0), 6) AS score FROM attacks")
def incident_score(spark: SparkSession, d: str) -> DataFrame:
    return attacks(spark, d).select("event_id", F.round(F.greatest(F.col("k") / 100.0, (F.col("k") % 9) / 8.0), 6).alias("score"))


@query("cor05_ioc_merge", """SELECT DISTINCT s_suppkey AS peer, n_name AS ioc FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE (s_acctbal / 10000.0) * CASE WHEN s_suppkey % 3 = 0 THEN 0.9 ELSE 0.5 END > 0.3""")
def ioc_merge(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    trust = F.when(F.col("s_suppkey") % 3 == 0, 0.9).otherwise(0.5)
    return s.filter(F.col("s_acctbal") / 10000.0 * trust > 0.3).select(F.col("s_suppkey").alias("peer"), F.col("n_name").alias("ioc")).distinct()


@query("cor06_fingerprint_blocklist", f"{derived_sql('packets')} SELECT event_id, CASE WHEN tls_sni IN ('edge3.example', 'edge15.onion.ws') THEN 'high' ELSE 'info' END AS severity FROM packets")
def fingerprint_blocklist(spark: SparkSession, d: str) -> DataFrame:
    p = derive(table(spark, d, "events"), "packets")
    bad = spark.createDataFrame([("edge3.example",), ("edge15.onion.ws",)], "tls_sni string").withColumn("bad", F.lit(True))
    return p.join(F.broadcast(bad), "tls_sni", "left").select("event_id", F.when(F.col("bad"), "high").otherwise("info").alias("severity"))


@query("cor07_fallback", """SELECT event_id, user_id, next_id FROM (SELECT v.event_id, v.user_id, arg_min(c.event_id, (c.ts, c.event_id)) AS next_id, min(epoch_us(c.ts)) - any_value(epoch_us(v.ts)) AS gap FROM events v JOIN events c ON c.user_id = v.user_id AND c.event_type = 'click' AND c.ts >= v.ts WHERE v.event_type = 'view' GROUP BY v.event_id, v.user_id) t WHERE gap <= 7200000000""")
def fallback(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return suppress.first_within(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), "user_id", 7200).select("event_id", "user_id", "next_id")


@query("cor08_device_policy", """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'registered' WHEN c_mktsegment = 'BUILDING' THEN 'vendor' ELSE 'workstation' END AS policy FROM customer""")
def device_policy(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    known = c.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("registered").alias("own"))
    vendor = c.select("c_mktsegment").distinct().filter("c_mktsegment = 'BUILDING'").withColumn("vendor", F.lit("vendor"))
    return c.join(known, "c_custkey", "left").join(vendor, "c_mktsegment", "left").select("c_custkey", F.coalesce("own", "vendor", F.lit("workstation")).alias("policy"))


@query("ver01_verdicts", f"""{A_SQL}, x AS (SELECT event_id, severity FROM attacks), e AS (SELECT event_id, k AS reputation, event_type = 'view' AS throttled FROM base), t AS (SELECT event_id, max(CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) AS w, count(*) AS n FROM x GROUP BY event_id)
    SELECT e.event_id, coalesce(n, 0) AS n_detections, CASE WHEN w IS NULL THEN 'pass' WHEN w >= 3 THEN 'drop' WHEN w = 2 THEN 'log_only' WHEN reputation >= 70 THEN 'drop' WHEN reputation >= 40 THEN 'log_only' WHEN throttled THEN 'rate_limit' ELSE 'pass' END AS verdict FROM e LEFT JOIN t USING (event_id)""")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    a = attacks(spark, d)
    return suppress.verdicts(a, a.select("event_id", F.col("k").alias("reputation"), (F.col("event_type") == "view").alias("throttled")))


@query("ver02_actions", f"""{A_SQL}, c AS (SELECT source_ip, attack_type, event_id, epoch_us(ts) AS t FROM attacks WHERE severity IN ('high', 'critical')), r AS (SELECT source_ip, attack_type, min(t) AS t FROM c GROUP BY ALL UNION ALL SELECT r.source_ip, r.attack_type, min(c.t) FROM r JOIN c ON c.source_ip = r.source_ip AND c.attack_type = r.attack_type AND c.t >= r.t + 86400000000 GROUP BY r.source_ip, r.attack_type, r.t)
    SELECT a.event_id, a.severity <> 'info' AS records, r.t IS NOT NULL AS alerts, a.severity = 'critical' AS blocks FROM attacks a LEFT JOIN r ON r.source_ip = a.source_ip AND r.attack_type = a.attack_type AND r.t = epoch_us(a.ts) WHERE a.severity <> 'info'""")
def actions(spark: SparkSession, d: str) -> DataFrame:
    a = attacks(spark, d).filter("severity <> 'info'").withColumn("grave", F.col("severity").isin("high", "critical"))
    gate = windowed.cooldown(a, ["source_ip", "attack_type", "grave"], "ts", 86400, carry=("severity",))
    return gate.select("event_id", F.lit(True).alias("records"), (F.col("grave") & F.col("passed")).alias("alerts"), (F.col("severity") == "critical").alias("blocks"))


@query("ver03_incidents", f"{A_SQL} SELECT event_id, CASE severity WHEN 'critical' THEN 'isolate' WHEN 'high' THEN 'block' WHEN 'medium' THEN 'watch' ELSE 'record' END AS playbook, k * 20 > CASE severity WHEN 'critical' THEN 300 WHEN 'high' THEN 600 WHEN 'medium' THEN 1800 ELSE 3600 END AS breached FROM attacks")
def incidents(spark: SparkSession, d: str) -> DataFrame:
    return suppress.incidents(attacks(spark, d), F.col("k") * 20).select("event_id", "playbook", "breached")


@query("agg01_attacker_upsert", f"""{A_SQL}, o AS (SELECT source_ip, min(ts) AS f, max(ts) AS l, count(*) AS n FROM attacks WHERE ts < TIMESTAMP '2024-01-15' GROUP BY source_ip), w AS (SELECT source_ip, min(ts) AS f, max(ts) AS l, count(*) AS n FROM attacks WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY source_ip)
    SELECT coalesce(o.source_ip, w.source_ip) AS ip_address, coalesce(o.f, w.f) AS first_seen, coalesce(w.l, o.l) AS last_seen, coalesce(o.n, 0) + coalesce(w.n, 0) AS attack_count FROM o FULL JOIN w ON o.source_ip = w.source_ip""")
def attacker_upsert(spark: SparkSession, d: str) -> DataFrame:
    a = attacks(spark, d).withColumn("country", F.lit(None).cast("string"))
    cut = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    return report.attackers(a.filter(F.col("ts") >= cut), report.attackers(a.filter(F.col("ts") < cut))).drop("country")


@query("agg02_threat_score", f"""{A_SQL}, c AS (SELECT source_ip, attack_type, severity, epoch_us(ts) AS t FROM attacks), r AS (SELECT source_ip, attack_type, min(t) AS t, min(severity) AS severity FROM c GROUP BY source_ip, attack_type UNION ALL SELECT r.source_ip, r.attack_type, min(c.t), min(r.severity) FROM r JOIN c ON c.source_ip = r.source_ip AND c.attack_type = r.attack_type AND c.t >= r.t + 432000000000 GROUP BY r.source_ip, r.attack_type, r.t)
    SELECT source_ip, CAST(least(100, sum(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 3 WHEN 'high' THEN 10 WHEN 'critical' THEN 25 ELSE 3 END)) AS BIGINT) AS threat_score FROM r GROUP BY source_ip""")
def threat_score(spark: SparkSession, d: str) -> DataFrame:
    a = attacks(spark, d)
    return report.threat_scores(windowed.cooldown(a, ["source_ip", "attack_type"], "ts", 432000, carry=("severity",)).filter("passed"))


@query("agg03_count_score", f"{A_SQL} SELECT source_ip, least(100, 20 * count(*)) AS score FROM attacks GROUP BY source_ip")
def count_score(spark: SparkSession, d: str) -> DataFrame:
    return report.count_scores(attacks(spark, d))


@query("agg03_count_score_all", f"{A_SQL} SELECT source_ip, least(100, 20 * count(*)) AS score FROM attacks GROUP BY source_ip")
def count_score_all(spark: SparkSession, d: str) -> DataFrame:
    return report.count_scores(attacks(spark, d))


@query("agg04_attackers_page", f"{A_SQL} SELECT source_ip, count(*) AS n, max(ts) AS last_seen FROM attacks GROUP BY source_ip ORDER BY last_seen DESC, source_ip LIMIT 20 OFFSET 10")
def attackers_page(spark: SparkSession, d: str) -> DataFrame:
    per = attacks(spark, d).groupBy("source_ip").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_seen"))
    return report.top(per, [F.desc("last_seen"), F.col("source_ip")], 20, 10)


@query("agg05_attacker_stats", f"{A_SQL} SELECT count(DISTINCT source_ip) AS total, count(DISTINCT CASE WHEN ts >= {NOW} - INTERVAL 1 DAY THEN source_ip END) AS last_day FROM attacks")
def attacker_stats(spark: SparkSession, d: str) -> DataFrame:
    recent = F.when(F.col("ts") >= F.expr(f"{NOW_SPARK} - interval 1 day"), F.col("source_ip"))
    return attacks(spark, d).agg(F.countDistinct("source_ip").alias("total"), F.countDistinct(recent).alias("last_day"))


@query("agg06_recent_attacks", f"{A_SQL} SELECT event_id, source_ip, attack_type, c_name FROM attacks JOIN customer ON c_custkey = user_id ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_attacks(spark: SparkSession, d: str) -> DataFrame:
    j = attacks(spark, d).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("user_id"))
    return report.top(j, [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "source_ip", "attack_type", "c_name")


@query("agg07_top_attackers", f"{A_SQL} SELECT source_ip, count(*) AS n, CASE WHEN count(*) >= 80 THEN 'critical' WHEN count(*) >= 50 THEN 'high' WHEN count(*) >= 20 THEN 'medium' ELSE 'low' END AS band FROM attacks GROUP BY source_ip ORDER BY n DESC, source_ip LIMIT 25")
def top_attackers(spark: SparkSession, d: str) -> DataFrame:
    per = attacks(spark, d).groupBy("source_ip").agg(F.count(F.lit(1)).alias("n"))
    return report.top(per.withColumn("band", report.band(F.col("n"))), [F.desc("n"), F.col("source_ip")], 25)


@query("agg08_threat_stats", f"{A_SQL} SELECT attack_type, count(*) AS n, count(CASE WHEN ts >= {NOW} - INTERVAL 1 DAY THEN 1 END) AS last_day FROM attacks GROUP BY attack_type ORDER BY n DESC, attack_type LIMIT 20")
def threat_stats(spark: SparkSession, d: str) -> DataFrame:
    recent = F.col("ts") >= F.expr(f"{NOW_SPARK} - interval 1 day")
    per = attacks(spark, d).groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(recent, 1)).alias("last_day"))
    return report.top(per, [F.desc("n"), F.col("attack_type")], 20)


@query("agg09_drill_down", f"{A_SQL} SELECT source_ip, attack_type, n, CAST(rank AS INT) AS rank FROM (SELECT source_ip, attack_type, count(*) AS n, row_number() OVER (PARTITION BY source_ip ORDER BY count(*) DESC, attack_type) AS rank FROM attacks GROUP BY source_ip, attack_type) t WHERE rank <= 5")
def drill_down(spark: SparkSession, d: str) -> DataFrame:
    return report.top_per_group(attacks(spark, d), ["source_ip"], "attack_type", 5)


@query("agg10_kpi_row", f"{A_SQL} SELECT count(*) AS attacks, count(CASE WHEN severity = 'critical' THEN 1 END) AS critical, round(count(*) / 86400.0, 6) AS rate, (SELECT source_ip FROM attacks GROUP BY source_ip ORDER BY count(*) DESC, source_ip LIMIT 1) AS top_ip FROM attacks")
def kpi_row(spark: SparkSession, d: str) -> DataFrame:
    per = attacks(spark, d).groupBy("source_ip").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("severity") == "critical", 1)).alias("c"))
    ranked = per.agg(F.sum("n").alias("attacks"), F.sum("c").alias("critical"), F.max("n").alias("m"), F.min_by("source_ip", F.struct(-F.col("n"), F.col("source_ip"))).alias("top_ip"))
    return ranked.select("attacks", "critical", F.round(F.col("attacks") / 86400.0, 6).alias("rate"), "top_ip")


@query("agg11_rate_history", """SELECT strftime(b, '%Y-%m-%d %H') AS bucket, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-12', INTERVAL 1 HOUR)) AS b) g LEFT JOIN (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1) c ON c.h = g.b""")
def rate_history(spark: SparkSession, d: str) -> DataFrame:
    at = lambda t: F.to_timestamp(F.lit(t))
    h = report.rate_history(table(spark, d, "events"), "ts", at("2024-01-10 00:00:00"), at("2024-01-12 00:00:00"), "1 hour")
    return h.select(F.date_format("bucket", "yyyy-MM-dd HH").alias("bucket"), "n")


@query("agg12_protocol_share", f"{derived_sql('packets')} SELECT protocol, count(*) AS n, round(count(*) / (SELECT count(*) FROM packets), 6) AS share FROM packets GROUP BY protocol")
def protocol_share(spark: SparkSession, d: str) -> DataFrame:
    per = derive(table(spark, d, "events"), "packets").groupBy("protocol").agg(F.count(F.lit(1)).alias("n"))
    # a row for each protocol
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query("agg13_dashboard_severity", f"{A_SQL} SELECT severity, count(*) AS n FROM attacks WHERE ts >= {NOW} - INTERVAL 5 DAY GROUP BY severity")
def dashboard_severity(spark: SparkSession, d: str) -> DataFrame:
    return attacks(spark, d).filter(F.col("ts") >= F.expr(f"{NOW_SPARK} - interval 5 days")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("agg14_baselines", """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM events)
    SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS low, max(value) AS high, round(median(value), 6) AS median, max(CASE WHEN i = least(c * 95 // 100, c - 1) THEN value END) AS p95 FROM r GROUP BY user_id HAVING count(*) >= 10""")
def baselines(spark: SparkSession, d: str) -> DataFrame:
    b = report.baselines(table(spark, d, "events"), ["user_id"], "value")
    return b.select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd")], "low", "high", F.round("median", 6).alias("median"), "p95")


@query("fn_nearest_rank", """SELECT event_type, sort[least(len(sort) * 75 // 100, len(sort) - 1) + 1] AS p75 FROM (SELECT event_type, list_sort(list(CAST(json_extract_string(props, '$.k') AS INT))) AS sort FROM events GROUP BY event_type) t""")
def nearest_rank_query(spark: SparkSession, d: str) -> DataFrame:
    return nearest_rank_all(spark, d)


@query("fn_nearest_rank_all", """SELECT event_type, max(CASE WHEN i = least(c * 75 // 100, c - 1) THEN k END) AS p75 FROM (SELECT event_type, k, row_number() OVER (PARTITION BY event_type ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) e) r GROUP BY event_type""")
def nearest_rank_all(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return report.nearest_ranks(e, ["event_type"], "k", 75).withColumnRenamed("rank", "p75")


@query("agg17_sniffer_stats", f"{derived_sql('packets')} SELECT protocol, count(*) AS packets, CAST(sum(raw_len) AS BIGINT) AS bytes FROM packets GROUP BY protocol")
def sniffer_stats(spark: SparkSession, d: str) -> DataFrame:
    return derive(table(spark, d, "events"), "packets").groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum("raw_len").alias("bytes"))


@query("agg18_top_talkers", f"{derived_sql('packets')} SELECT src_ip, count(*) AS n FROM packets WHERE ts >= {NOW} - INTERVAL 3 DAY GROUP BY src_ip ORDER BY n DESC, src_ip LIMIT 10")
def top_talkers(spark: SparkSession, d: str) -> DataFrame:
    live = derive(table(spark, d, "events"), "packets").filter(F.col("ts") >= F.expr(f"{NOW_SPARK} - interval 3 days"))
    return report.top(live.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.col("src_ip")], 10)


@query("agg19_connection_stats", f"{derived_sql('packets')} SELECT protocol, count(DISTINCT concat(src_ip, '>', dst_ip)) AS connections FROM packets GROUP BY protocol")
def connection_stats(spark: SparkSession, d: str) -> DataFrame:
    return derive(table(spark, d, "events"), "packets").groupBy("protocol").agg(F.countDistinct(F.concat_ws(">", "src_ip", "dst_ip")).alias("connections"))


@query("agg20_incident_heatmap", f"""{A_SQL} SELECT coalesce(m.tactic, t.technique) AS tactic, count(*) AS n, max(CASE a.severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) AS worst FROM attacks a JOIN {reference.attack_techniques_sql()} t USING (attack_type) LEFT JOIN {reference.technique_tactics_sql()} m ON t.technique = m.technique GROUP BY 1""")
def incident_heatmap(spark: SparkSession, d: str) -> DataFrame:
    t = reference.attack_techniques(spark).join(reference.technique_tactics(spark), "technique", "left")
    j = attacks(spark, d).join(F.broadcast(t), "attack_type")
    return j.groupBy(F.coalesce("tactic", "technique").alias("tactic")).agg(F.count(F.lit(1)).alias("n"), F.max(severity_rank(F.col("severity"))).alias("worst"))


@query("agg21_active_blocks", f"""SELECT event_id, user_id, CAST((epoch_us(ts + INTERVAL 3 DAY) - epoch_us({NOW})) // 1000000 AS BIGINT) AS remaining FROM events WHERE event_type = 'error' AND ts + INTERVAL 3 DAY > {NOW} AND ts <= {NOW}""")
def active_blocks(spark: SparkSession, d: str) -> DataFrame:
    now = F.expr(NOW_SPARK)
    until = F.col("ts") + F.expr("interval 3 days")
    left = (F.unix_micros(until.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1_000_000
    return table(spark, d, "events").filter("event_type = 'error'").filter((until > now) & (F.col("ts") <= now)).select("event_id", "user_id", F.floor(left).alias("remaining"))


@query("agg22_newest_alerts", f"{A_SQL} SELECT event_id, attack_type, severity FROM attacks WHERE severity IN ('high', 'critical') ORDER BY ts DESC, event_id DESC LIMIT 100")
def newest_alerts(spark: SparkSession, d: str) -> DataFrame:
    return report.top(attacks(spark, d).filter("severity IN ('high', 'critical')"), [F.desc("ts"), F.desc("event_id")], 100).select("event_id", "attack_type", "severity")


@query("agg23_session_fold", "SELECT conv_id, min(turn) AS opened, max(turn) AS closed, count(*) AS commands, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def session_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("opened"), F.max("turn").alias("closed"), F.count(F.lit(1)).alias("commands"), F.max_by("role", "turn").alias("last_role"))


@query("agg24_countries", "SELECT DISTINCT user_id, coalesce(n_name, '??') AS country FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey")
def countries(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct()
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return users.join(c, F.col("user_id") == F.col("c_custkey"), "left").select("user_id", F.coalesce("n_name", F.lit("??")).alias("country"))


@query("agg25_quality_report", "SELECT lang, count(*) AS labelled, CAST(sum(toxic) AS BIGINT) AS toxic, CAST(sum(CASE WHEN toxic = 1 AND quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS both FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("labelled"), F.sum("toxic").alias("toxic"), F.sum(((F.col("toxic") == 1) & (F.col("quality") == 1)).cast("long")).alias("both"))


@query("agg26_alert_rules", f"{A_SQL} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS bucket, count(*) AS n FROM attacks WHERE severity = 'critical' GROUP BY 1 HAVING count(*) > 2")
def alert_rules(spark: SparkSession, d: str) -> DataFrame:
    w = attacks(spark, d).filter("severity = 'critical'").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return w.filter("n > 2").select(F.date_format("b", "yyyy-MM-dd HH").alias("bucket"), "n")


@query("agg27_pipeline_counters", f"{A_SQL} SELECT CASE WHEN severity IN ('high', 'critical') THEN 'drop' WHEN severity = 'medium' THEN 'log_only' ELSE 'pass' END AS verdict, count(*) AS n, round(avg(value), 4) AS mean_latency FROM attacks GROUP BY 1")
def pipeline_counters(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("severity").isin("high", "critical"), "drop").when(F.col("severity") == "medium", "log_only").otherwise("pass")
    return attacks(spark, d).groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_latency"))


@query("agg28_catalogue_coverage", f"{A_SQL} SELECT t.attack_type FROM {reference.attack_types_sql()} t WHERE t.attack_type NOT IN (SELECT attack_type FROM attacks)")
def catalogue_coverage(spark: SparkSession, d: str) -> DataFrame:
    return reference.attack_types(spark).join(attacks(spark, d).select("attack_type").distinct(), "attack_type", "left_anti").select("attack_type")


@query("set01_detector_union", f"{derived_sql('packets')} SELECT event_id, 'icmp' AS attack_type FROM packets WHERE protocol = 'icmp' UNION ALL SELECT event_id, 'scan' FROM packets WHERE flags = 'S'")
def detector_union(spark: SparkSession, d: str) -> DataFrame:
    p = derive(table(spark, d, "events"), "packets").withColumn("source_ip", F.col("src_ip"))
    a = p.filter("protocol = 'icmp'").select("event_id", "source_ip", F.lit("icmp").alias("attack_type"))
    b = p.filter("flags = 'S'").select("event_id", "source_ip", F.lit("scan").alias("attack_type"), F.lit(1).alias("n"))
    return report.union_detections(a, b, a.withColumn("attack_type", F.lit(""))).select("event_id", "attack_type")


@query("set02_ioc_union", "SELECT user_id AS ioc FROM events WHERE value > 50 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000")
def ioc_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("value > 50").select(F.col("user_id").alias("ioc")).union(table(spark, d, "customer").filter("c_acctbal > 9000").select("c_custkey")).distinct()


@query("set03_not_yet_seen", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def not_yet_seen(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "events"), F.col("c_custkey") == F.col("user_id"), "left_anti").select("c_custkey")


@query("set04_newest_keys", "SELECT user_id, max(ts) AS last FROM events GROUP BY user_id ORDER BY last DESC, user_id LIMIT 50")
def newest_keys(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return report.top(per, [F.desc("last"), F.col("user_id")], 50)


@query("ret01_retention", f"SELECT event_id FROM events WHERE ts >= {NOW} - INTERVAL 10 DAY")
def retention(spark: SparkSession, d: str) -> DataFrame:
    return report.retain(table(spark, d, "events"), "ts", F.expr(NOW_SPARK), 10).select("event_id")


@query("snk01_ecs", f"""{A_SQL} SELECT event_id, concat('{{"timestamp":"', strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '","event":{{"kind":"alert","action":"', attack_type, '","severity":', CASE severity WHEN 'critical' THEN '100' WHEN 'high' THEN '80' WHEN 'low' THEN '20' WHEN 'info' THEN '10' ELSE '50' END, '}},"source":{{"ip":"', source_ip, '"}}}}') AS ecs FROM attacks""")
def ecs(spark: SparkSession, d: str) -> DataFrame:
    return sinks.formatted(attacks(spark, d), "ecs")


@query("snk02_cef", f"""{A_SQL} SELECT event_id, concat('CEF:0|tidewatch|sensor|1|', attack_type, '|', attack_type, '|', CASE severity WHEN 'critical' THEN '10' WHEN 'high' THEN '8' WHEN 'low' THEN '3' WHEN 'info' THEN '1' ELSE '5' END, '|src=', source_ip, ' externalId=', CAST(event_id AS STRING)) AS cef FROM attacks""")
def cef(spark: SparkSession, d: str) -> DataFrame:
    return sinks.formatted(attacks(spark, d), "cef")


@query("snk03_syslog", f"""{A_SQL} SELECT event_id, concat('<', CAST(128 + CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 3 WHEN 'low' THEN 5 WHEN 'info' THEN 6 ELSE 4 END AS STRING), '>1 ', strftime(ts, '%Y-%m-%d %H:%M:%S'), ' sensor tidewatch - - [det type="', attack_type, '" src="', source_ip, '"] ', severity) AS syslog FROM attacks""")
def syslog_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.formatted(attacks(spark, d), "syslog")


@query("snk05_fan_out", f"""{A_SQL} SELECT a.event_id, e.ecs, c.cef, s.syslog, concat('{{"type":"indicator","id":"indicator--', sha256(concat(a.attack_type, '|', a.source_ip))[1:32], '","name":"', a.attack_type, '","pattern":"[ipv4-addr:value = ''', a.source_ip, ''']"}}') AS stix
    FROM attacks a JOIN ({ORACLES['snk01_ecs']}) e USING (event_id) JOIN ({ORACLES['snk02_cef']}) c USING (event_id) JOIN ({ORACLES['snk03_syslog']}) s USING (event_id)""")
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    return sinks.formatted(attacks(spark, d), "ecs", "cef", "syslog", "stix")


@query("snk06_outbox", f"{A_SQL} SELECT event_id AS alert_id FROM attacks WHERE severity = 'critical' AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def outbox(spark: SparkSession, d: str) -> DataFrame:
    a = attacks(spark, d)
    alerts = a.filter("severity = 'critical'").select(F.col("event_id").alias("alert_id"), F.col("ts").alias("created_at"))
    return sinks.unsent(alerts, a.filter("event_type = 'click'").select(F.col("event_id").alias("alert_id"))).select("alert_id")


@query("snk07_metrics", f"{A_SQL} SELECT substr(attack_type, 1, 8) AS kind, severity, count(*) AS n FROM attacks GROUP BY ALL")
def metrics(spark: SparkSession, d: str) -> DataFrame:
    return attacks(spark, d).groupBy(clip_label(F.col("attack_type"), 8).alias("kind"), "severity").agg(F.count(F.lit(1)).alias("n"))


@query("fn_url_decode", f"{derived_sql('packets')} SELECT event_id, CASE k % 16 WHEN 13 THEN '/search?q=<script>' ELSE replace(http_uri, '+', ' ') END AS uri FROM packets")
def url_decode(spark: SparkSession, d: str) -> DataFrame:
    return derive(table(spark, d, "events"), "packets").select("event_id", url_decoded(F.col("http_uri")).alias("uri"))


@query("str02_tumbling", "SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming import stateful

    w = stateful.tumbling(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "1 day")
    return w.select("user_id", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


@query("str04_sessions", """WITH o AS (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap >= 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM o) SELECT user_id, CAST(i AS BIGINT) AS i, count(*) AS n FROM s GROUP BY user_id, i""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming import stateful

    w = stateful.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "12 hours")
    return w.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("start")) - 1).cast("long").alias("i"), "n")


# The protocol that an attack type uses.
PROTOCOLS = {"port_scan": "tcp", "syn_flood": "tcp", "sql_injection": "http", "admin_probe": "http", "ssh_bruteforce": "ssh"}


@query("par14_attack_protocol", f"{A_SQL} SELECT CASE attack_type WHEN 'port_scan' THEN 'tcp' WHEN 'syn_flood' THEN 'tcp' WHEN 'sql_injection' THEN 'http' WHEN 'admin_probe' THEN 'http' WHEN 'ssh_bruteforce' THEN 'ssh' ELSE 'other' END AS protocol, count(*) AS n FROM attacks GROUP BY 1")
def attack_protocol(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame(list(PROTOCOLS.items()), "attack_type string, protocol string")
    j = attacks(spark, d).join(F.broadcast(known), "attack_type", "left")
    return j.groupBy(F.coalesce("protocol", F.lit("other")).alias("protocol")).agg(F.count(F.lit(1)).alias("n"))


@query("cor03_reputation_normalise", f"{A_SQL} SELECT source_ip AS ip, 'feed' AS provider, CAST(sum(k % 3) AS BIGINT) AS malicious, CAST(sum(k % 5) AS BIGINT) AS suspicious, CAST(sum(k % 3) + sum(k % 5) + sum(k % 7) AS BIGINT) AS total FROM attacks GROUP BY source_ip")
def reputation_normalise(spark: SparkSession, d: str) -> DataFrame:
    per = attacks(spark, d).groupBy(F.col("source_ip").alias("ip")).agg(*[F.sum(F.col("k") % m).cast("long").alias(n) for n, m in (("malicious", 3), ("suspicious", 5), ("harmless", 7))])
    return suppress.reputation(per, "feed")


@query("src05_host_events", f"{derived_sql('host_events')} SELECT event_kind, count(*) AS n FROM host_events GROUP BY event_kind")
def host_events(spark: SparkSession, d: str) -> DataFrame:
    return derive(table(spark, d, "events"), "host_events").groupBy("event_kind").agg(F.count(F.lit(1)).alias("n"))


@query("src03_packets", f"{derived_sql('packets')} SELECT protocol, flags, count(*) AS n FROM packets GROUP BY ALL")
def packet_source(spark: SparkSession, d: str) -> DataFrame:
    return derive(table(spark, d, "events"), "packets").groupBy("protocol", "flags").agg(F.count(F.lit(1)).alias("n"))


def _rule(name: str, condition: dict, where: str) -> None:
    sql = f"{derived_sql('packets')} SELECT event_id FROM packets WHERE {where}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        p = derive(table(spark, d, "events"), "packets").withColumn("headers", F.create_map(F.lit("cookie"), F.col("cookie"), F.lit("agent"), F.col("user_agent"))).withColumn("ports", F.array("src_port", "dst_port"))
        return p.filter(rules.compile_condition(condition)).select("event_id")

    query(name, sql)(run)


_rule("rul01_pattern_rule", {"type": "pattern", "field": "user_agent", "pattern": "(nikto|SQLMAP)"}, "lower(user_agent) LIKE '%nikto%' OR lower(user_agent) LIKE '%sqlmap%'")
_rule("rul02_field_rule", {"type": "field", "field": "raw_len", "operator": "gt", "value": "5000"}, "raw_len > 5000")
_rule("rul02_in_rule", {"type": "field", "field": "dst_port", "operator": "in", "value": "22, 23, 445"}, "dst_port IN (22, 23, 445)")
_rule("rul03_composite_rule", {"type": "composite", "logic": "or", "conditions": [{"type": "field", "field": "flags", "operator": "equals", "value": "S"}, {"type": "composite", "logic": "and", "conditions": [{"type": "field", "field": "protocol", "operator": "startswith", "value": "ud"}, {"type": "field", "field": "ttl", "operator": "lt", "value": 64}]}]}, "flags = 'S' OR (protocol LIKE 'ud%' AND ttl < 64)")
_rule("rul04_nested_field", {"type": "composite", "logic": "and", "conditions": [{"type": "field", "field": "headers.cookie", "operator": "contains", "value": "theme"}, {"type": "field", "field": "ports.1", "operator": "gt", "value": 50}]}, "cookie LIKE '%theme%' AND dst_port > 50")


@query("win05_icmp_burst", f"""{derived_sql('packets')} SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY src_ip ORDER BY epoch_us(ts) RANGE BETWEEN 863999999999 PRECEDING AND CURRENT ROW) AS slow, count(*) OVER (PARTITION BY src_ip ORDER BY epoch_us(ts) RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW) AS fast FROM packets WHERE protocol = 'icmp') t WHERE slow > 6 OR fast >= 2""")
def icmp_burst(spark: SparkSession, d: str) -> DataFrame:
    p = derive(table(spark, d, "events"), "packets").filter("protocol = 'icmp'")
    slow, fast = (F.count(F.lit(1)).over(windowed.sliding(["src_ip"], "ts", s)) for s in (864000, 43200))
    return p.withColumn("slow", slow).withColumn("fast", fast).filter("slow > 6 OR fast >= 2").select("event_id")


@query("agg13_dashboard_types", f"{A_SQL} SELECT attack_type, count(*) AS n FROM attacks GROUP BY attack_type ORDER BY n DESC, attack_type LIMIT 10")
def dashboard_types(spark: SparkSession, d: str) -> DataFrame:
    per = attacks(spark, d).groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"))
    return report.top(per, [F.desc("n"), F.col("attack_type")], 10)


@query("cor05_trust_update", f"{A_SQL} SELECT source_ip AS peer, round(least(1.0, greatest(0.0, 0.5 + 0.05 * sum(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) - 0.1 * sum(CASE WHEN k % 2 = 1 THEN 1 ELSE 0 END))), 6) AS trust FROM attacks GROUP BY source_ip")
def trust_update(spark: SparkSession, d: str) -> DataFrame:
    ok = F.sum((F.col("k") % 2 == 0).cast("int"))
    bad = F.sum((F.col("k") % 2 == 1).cast("int"))
    return attacks(spark, d).groupBy(F.col("source_ip").alias("peer")).agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 0.05 * ok - 0.1 * bad)), 6).alias("trust"))
