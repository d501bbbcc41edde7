"""Detector queries over packets, requests and host events derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import entropy, flow_key, is_broadcast, ja4, ladder
from ..operators import folds, parse, report, rules, stateless, windowed
from ..sources.derive import derive, derived_sql
from ..sources.reference import APP_PORTS, WEB_SIGNATURES
from .registry import query, table

HOUR = 3600
#: The web patterns as SQL literals.
PATTERN_SQL = {name: pattern.replace("'", "''") for name, pattern, _ in WEB_SIGNATURES}


def packets(spark: SparkSession, d: str) -> DataFrame:
    return derive(table(spark, d, "events"), "packets")


def sliding_sql(seconds: float) -> str:
    return f"RANGE BETWEEN {int(seconds * 1e6) - 1} PRECEDING AND CURRENT ROW"


def _rate(name: str, where: str, seconds: float, more: float, kind: str, severity: str, weight: str | None = None) -> None:
    measure = f"CAST(sum({weight}) OVER w AS BIGINT)" if weight else "count(*) OVER w"
    sql = f"""{derived_sql('packets')} SELECT event_id, ts, source_ip, '{kind}' AS attack_type, '{severity}' AS severity, n FROM (
        SELECT event_id, ts, src_ip AS source_ip, {measure} AS n FROM packets WHERE {where} WINDOW w AS (PARTITION BY src_ip ORDER BY epoch_us(ts) {sliding_sql(seconds)})) t WHERE n > {more}"""
    query(name, sql)(lambda s, d: windowed.rate(packets(s, d), kind, severity, "src_ip", "ts", seconds, more, where, weight))


_rate("win01_syn_flood_rate", "flags = 'S'", 24 * HOUR, 1, "syn_flood", "critical")
_rate("win03_syn_flood_burst", "flags = 'S'", 12 * HOUR, 1, "syn_flood", "critical")
_rate("win04_connection_flood", "protocol <> 'none'", 12 * HOUR, 4, "connection_flood", "high")
_rate("win05_icmp_flood", "protocol = 'icmp'", 48 * HOUR, 2, "icmp_flood", "high")
_rate("win06_bandwidth", "raw_len > 0", 24 * HOUR, 20000, "bandwidth_attack", "high", "raw_len")
_rate("win17_broadcast_storm", "dst_ip LIKE '%.255'", 240 * HOUR, 1, "broadcast_storm", "high")
_rate("win26_syn_burst", "flags = 'S'", 6 * HOUR, 1, "syn_burst", "medium")
_rate("win27_packet_burst", "protocol <> 'none'", 6 * HOUR, 3, "packet_burst", "medium")
_rate("win40_rapid_reset", "flags LIKE '%R%'", 72 * HOUR, 1, "h2_rapid_reset", "critical")


@query("win00_burst_hits", f"""SELECT event_id, user_id, ts, n FROM (SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS n FROM events) t WHERE n >= 4""")
def burst_hits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "ts", F.count(F.lit(1)).over(windowed.sliding(["user_id"], "ts", 6 * HOUR, closed=True)).alias("n")).filter("n >= 4")


@query("top_burst_sources", """SELECT user_id, count(*) AS hits, max(n) AS peak, CASE WHEN 20 * count(*) >= 80 THEN 'critical' WHEN 20 * count(*) >= 50 THEN 'high' WHEN 20 * count(*) >= 20 THEN 'medium' ELSE 'low' END AS band
    FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS n FROM events) t WHERE n >= 4 GROUP BY user_id ORDER BY hits DESC, user_id LIMIT 50""")
def top_burst_sources(spark: SparkSession, d: str) -> DataFrame:
    per = burst_hits(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"), F.max("n").alias("peak"))
    return report.top(per.withColumn("band", report.band(20 * F.col("hits"))), [F.desc("hits"), F.col("user_id")], 50)


def _distinct(name: str, key: list[str], of: str, at_least: int, seconds: float | None, kind: str, severity: str, where: str = "true") -> None:
    frame = f"ORDER BY epoch_us(ts) {sliding_sql(seconds)}" if seconds else "ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    sql = f"""{derived_sql('packets')} SELECT event_id, ts, source_ip, '{kind}' AS attack_type, '{severity}' AS severity, n FROM (
        SELECT event_id, ts, {key[0]} AS source_ip, CAST(len(list_distinct(list({of}) OVER (PARTITION BY {', '.join(key)} {frame}))) AS BIGINT) AS n FROM packets WHERE {where}) t WHERE n >= {at_least}"""
    query(name, sql)(lambda s, d: windowed.distinct_in_window(packets(s, d), kind, severity, key, "ts", of, at_least, seconds, where))


_distinct("win07_port_scan", ["src_ip"], "dst_port", 3, 96 * HOUR, "port_scan", "medium", "flags = 'S'")
_distinct("win08_port_scan_lifetime", ["src_ip"], "dst_port", 12, None, "port_scan", "high", "flags = 'S' OR protocol <> 'tcp'")
_distinct("win09_port_hopping", ["src_ip", "dst_ip"], "dst_port", 2, None, "port_hopping", "medium")
_distinct("win28_proto_scan", ["src_ip"], "protocol", 3, 24 * HOUR, "proto_scan", "low")
_distinct("win16_mac_spoofing", ["src_ip"], "src_mac", 3, 96 * HOUR, "mac_spoofing", "high")


@query("win02_syn_flood_anchored", f"""{derived_sql('packets')}, s AS (SELECT src_ip, event_id, ts FROM packets WHERE protocol = 'tcp'),
    o AS (SELECT src_ip, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY src_ip ORDER BY ts, event_id) AS i FROM s),
    r AS (SELECT src_ip, event_id, t, i, t AS opened, 1 AS n FROM o WHERE i = 1 UNION ALL
      SELECT o.src_ip, o.event_id, o.t, o.i, CASE WHEN o.t - r.opened > 86400000000 THEN o.t ELSE r.opened END, CASE WHEN o.t - r.opened > 86400000000 THEN 1 ELSE r.n + 1 END FROM r JOIN o ON o.src_ip = r.src_ip AND o.i = r.i + 1)
    SELECT src_ip, event_id FROM r WHERE n > 2""")
def syn_flood_anchored(spark: SparkSession, d: str) -> DataFrame:
    return windowed.anchored_rate(packets(spark, d).filter("protocol = 'tcp'"), ["src_ip"], "ts", 24 * HOUR, 2).select("src_ip", "event_id")


@query("win36_bruteforce", """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error'),
    r AS (SELECT user_id, event_id, i, [t] AS kept, false AS hit FROM o WHERE i = 1 UNION ALL
      SELECT user_id, event_id, i, CASE WHEN len(k) >= 3 THEN [] ELSE k END, len(k) >= 3 FROM (
        SELECT o.user_id, o.event_id, o.i, list_append(list_filter(r.kept, lambda x: x >= o.t - 172800000000), o.t) AS k FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) z)
    SELECT user_id, event_id FROM r WHERE hit""")
def bruteforce(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'error'")
    return windowed.counter_with_reset(e, ["user_id"], "ts", 48 * HOUR, 3).select("user_id", "event_id")


COOLDOWN_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t FROM events),
    r AS (SELECT user_id, event_type, min(t) AS t FROM e GROUP BY user_id, event_type UNION ALL
      SELECT r.user_id, r.event_type, min(e.t) AS t FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.t >= r.t + {span} GROUP BY r.user_id, r.event_type, r.t)
    """


@query("sup01_cooldown", COOLDOWN_SQL.format(span=259200000000) + "SELECT e.event_id, e.user_id, e.event_type FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.t = r.t")
def cooldown(spark: SparkSession, d: str) -> DataFrame:
    return windowed.cooldown(table(spark, d, "events"), ["user_id", "event_type"], "ts", 72 * HOUR).filter("passed").select("event_id", "user_id", "event_type")


@query("win38_vpn_hourly", f"""{derived_sql('packets')}, e AS (SELECT src_ip, event_id, epoch_us(ts) AS t FROM packets WHERE dst_port = 4444),
    r AS (SELECT src_ip, min(t) AS t FROM e GROUP BY src_ip UNION ALL SELECT r.src_ip, min(e.t) FROM r JOIN e ON e.src_ip = r.src_ip AND e.t >= r.t + 864000000000 GROUP BY r.src_ip, r.t)
    SELECT e.event_id, e.src_ip FROM r JOIN e ON e.src_ip = r.src_ip AND e.t = r.t""")
def vpn_traffic(spark: SparkSession, d: str) -> DataFrame:
    return windowed.cooldown(packets(spark, d).filter("dst_port = 4444"), ["src_ip"], "ts", 240 * HOUR).filter("passed").select("event_id", "src_ip")


@query("sup02_gate_statistics", COOLDOWN_SQL.format(span=259200000000) + """, p AS (SELECT count(*) AS n FROM r) SELECT p.n AS passed, (SELECT count(*) FROM e) - p.n AS suppressed, (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM e) x) AS pairs FROM p""")
def gate_statistics(spark: SparkSession, d: str) -> DataFrame:
    g = windowed.cooldown(table(spark, d, "events"), ["user_id", "event_type"], "ts", 72 * HOUR)
    return g.agg(F.sum(F.col("passed").cast("long")).alias("passed"), F.sum((~F.col("passed")).cast("long")).alias("suppressed"), F.countDistinct("user_id", "event_type").alias("pairs"))


def _nth(name: str, where: str, every: int, kind: str, severity: str) -> None:
    sql = f"""{derived_sql('packets')} SELECT event_id, ts, source_ip, '{kind}' AS attack_type, '{severity}' AS severity, nth FROM (
        SELECT event_id, ts, src_ip AS source_ip, row_number() OVER (PARTITION BY src_ip ORDER BY ts, event_id) AS nth FROM packets WHERE {where}) t WHERE nth % {every} = 0"""
    query(name, sql)(lambda s, d: windowed.nth_reset(packets(s, d), kind, severity, "src_ip", ["ts", "event_id"], every, where))


_nth("win10_dns_tunnel_volume", "dst_port = 53", 3, "dns_tunnel", "high")
_nth("win39_tor_count", "dst_port >= 9000", 4, "tor_traffic", "medium")
_nth("win37_connection_closes", "flags LIKE '%F%'", 3, "ssh_connection_flood", "medium")


def _frame(name: str, where: str, n: int, at_least: int, kind: str, severity: str, test, sql_test: str, key: str = "src_ip") -> None:
    sql = f"""{derived_sql('packets')} SELECT event_id, ts, source_ip, '{kind}' AS attack_type, '{severity}' AS severity, seen FROM (
        SELECT event_id, ts, {key} AS source_ip, count(*) OVER w AS seen, {sql_test} AS hit FROM packets WHERE {where}
        WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) t WHERE seen >= {at_least} AND hit"""
    query(name, sql)(lambda s, d: windowed.frame(packets(s, d), kind, severity, [key], ["ts", "event_id"], n, at_least, test, where))


_frame("win11_dns_tunnel_size", "dst_port = 53 AND payload_len > 200", 10, 3, "dns_tunnel", "critical", lambda w: F.avg("payload_len").over(w) > 300, "avg(payload_len) OVER w > 300")
_frame("win12_icmp_tunnel_avg", "protocol = 'icmp' AND payload_len <= 500", 20, 5, "icmp_tunnel", "medium", lambda w: F.avg("payload_len").over(w) > 150, "avg(payload_len) OVER w > 150")
_frame("win33_large_txt", "dst_port = 53 AND dns_txt_len > 512", 5, 2, "dns_tunnel_large_txt", "high", lambda w: F.avg("dns_txt_len").over(w) > 700, "avg(dns_txt_len) OVER w > 700")
_frame("win34_nxdomain", "dns_qname IS NOT NULL", 50, 5, "dns_tunnel_nxdomain", "medium", lambda w: F.avg((F.col("dns_rcode") == 3).cast("double")).over(w) > 0.2, "avg(CASE WHEN dns_rcode = 3 THEN 1.0 ELSE 0.0 END) OVER w > 0.2")
_frame("win42_ipv6_fragment_storm", "frag_offset > 0", 3, 3, "ipv6_fragment_storm", "high", lambda w: F.min("ip_id").over(w) == F.max("ip_id").over(w), "min(ip_id) OVER w = max(ip_id) OVER w")
_frame("win25_ttl_covert", "protocol = 'tcp'", 15, 6, "ttl_covert_channel", "medium", lambda w: F.size(F.collect_set("ttl").over(w)) >= 14, "len(list_distinct(list(ttl) OVER w)) >= 14")
_frame("win18_slow_loris", "flags = 'S'", 5, 4, "slow_loris", "high", lambda w: windowed.micros("ts") - F.min(windowed.micros("ts")).over(w) < 3 * 86400 * 10**6, "epoch_us(ts) - min(epoch_us(ts)) OVER w < 259200000000")
_frame("win22_low_entropy_isn", "flags = 'S'", 3, 3, "low_entropy_isn", "high", lambda w: F.max("tcp_seq").over(w) - F.min("tcp_seq").over(w) < 8000000, "max(tcp_seq) OVER w - min(tcp_seq) OVER w < 8000000")


@query("win21_ttl_inconsistency", f"""{derived_sql('packets')} SELECT event_id, src_ip FROM (SELECT event_id, src_ip, len(list_filter(ts_, lambda x: x < top - 5)) AS n, len(ts_) AS seen FROM (
    SELECT event_id, src_ip, list(ttl) OVER w AS ts_, max(ttl) OVER w AS top FROM packets WHERE protocol = 'tcp' WINDOW w AS (PARTITION BY src_ip ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) q) t WHERE seen >= 3 AND n >= 8""")
def ttl_inconsistency(spark: SparkSession, d: str) -> DataFrame:
    far = lambda w: F.size(F.filter(F.collect_list("ttl").over(w), lambda x: x < F.max("ttl").over(w) - 5)) >= 8
    return windowed.frame(packets(spark, d), "ttl_inconsistency", "medium", ["src_ip"], ["ts", "event_id"], 10, 3, far, "protocol = 'tcp'").select("event_id", F.col("source_ip").alias("src_ip"))


GAPS = "g AS (SELECT event_id, ts, {key} AS source_ip, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {key} ORDER BY ts, event_id)) / 1000000.0 AS gap FROM packets WHERE {where})"


def _steady(name: str, key: str, where: str, n: int, at_least: int, low: float, high: float, variance: float, kind: str) -> None:
    sql = f"""{derived_sql('packets')}, {GAPS.format(key=key, where=where)} SELECT event_id, ts, source_ip, '{kind}' AS attack_type, 'medium' AS severity, seen FROM (
        SELECT event_id, ts, source_ip, count(*) OVER w AS seen, avg(gap) OVER w AS m, var_pop(gap) OVER w AS v FROM g WHERE gap IS NOT NULL
        WINDOW w AS (PARTITION BY source_ip ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) t WHERE seen >= {at_least} AND m > {low} AND m < {high} AND v < {variance}"""
    query(name, sql)(lambda s, d: windowed.steady_gaps(packets(s, d).filter(where), kind, "medium", [key], ["ts", "event_id"], "ts", n, at_least, low, high, variance))


_steady("win20_timed_probe", "src_ip", "true", 6, 5, 5.0, 60000.0, 4.0e8, "timed_probe")
_steady("win35_dns_beaconing", "dns_qname", "dns_qname IS NOT NULL", 5, 2, 1.0, 2000000.0, 1.0e11, "dns_beaconing")


@query("win19_timing_evasion", f"""{derived_sql('packets')}, {GAPS.format(key='src_ip', where='true')},
    k AS (SELECT source_ip, ts, event_id, CASE WHEN gap < 14400 THEN 'burst' WHEN gap BETWEEN 14400 AND 86400 THEN 'pause' ELSE 'other' END AS kind FROM g WHERE gap IS NOT NULL),
    f AS (SELECT *, CASE WHEN kind <> coalesce(lag(kind) OVER (PARTITION BY source_ip ORDER BY ts, event_id), '') THEN 1 ELSE 0 END AS fresh FROM k),
    u AS (SELECT *, sum(fresh) OVER (PARTITION BY source_ip ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM f),
    c AS (SELECT source_ip, run, kind, count(*) AS len FROM u GROUP BY source_ip, run, kind),
    p AS (SELECT source_ip, sum(len) AS gaps, sum(CASE WHEN kind = 'burst' AND len >= 2 THEN 1 ELSE 0 END) AS bursts, sum(CASE WHEN kind = 'pause' THEN len ELSE 0 END) AS pauses FROM c GROUP BY source_ip)
    SELECT source_ip AS src_ip, CAST(gaps AS BIGINT) AS gaps, CAST(bursts AS BIGINT) AS bursts, CAST(pauses AS BIGINT) AS pauses FROM p WHERE gaps < 70 AND bursts + pauses >= 3 AND bursts >= 0.15 * (bursts + pauses) AND pauses >= 0.15 * (bursts + pauses) AND bursts > 0""")
def timing_evasion(spark: SparkSession, d: str) -> DataFrame:
    return windowed.gap_runs(packets(spark, d), "src_ip", ["ts", "event_id"], "ts", 14400, 14400, 86400, 70, 3, 0.15)


@query("win23_adaptive_outlier", f"""{derived_sql('packets')} SELECT event_id, src_ip, value FROM (SELECT event_id, src_ip, value, count(value) OVER w AS n, avg(value) OVER w AS m, coalesce(stddev_samp(value) OVER w, 0) AS sd FROM packets
    WINDOW w AS (PARTITION BY src_ip ORDER BY epoch_us(ts) RANGE BETWEEN 863999999999 PRECEDING AND 1 PRECEDING)) t WHERE n >= 3 AND CASE WHEN sd > 0 THEN abs(value - m) > 3 * sd ELSE abs(value - m) > 0 END""")
def adaptive_outlier(spark: SparkSession, d: str) -> DataFrame:
    return windowed.outliers(packets(spark, d).select("event_id", "src_ip", "ts", "value"), ["src_ip"], "ts", "value", 240 * HOUR).select("event_id", "src_ip", "value")


@query("win14_fragment_overlap", f"""{derived_sql('packets')} SELECT event_id, src_ip FROM (SELECT event_id, src_ip, row_number() OVER (PARTITION BY src_ip, ip_id, frag_offset ORDER BY ts, event_id) AS n FROM packets WHERE frag_offset > 0) t WHERE n > 1""")
def fragment_overlap(spark: SparkSession, d: str) -> DataFrame:
    w = windowed.Window.partitionBy("src_ip", "ip_id", "frag_offset").orderBy("ts", "event_id")
    return packets(spark, d).filter("frag_offset > 0").withColumn("n", F.row_number().over(w)).filter("n > 1").select("event_id", "src_ip")


@query("win13_fragment_set", f"""{derived_sql('packets')} SELECT event_id, src_ip, kind FROM (SELECT event_id, src_ip, CASE WHEN count(*) OVER w > 64 THEN 'fragment_storm' WHEN sum(payload_len) OVER w > 1000 AND protocol = 'tcp' THEN 'fragment_oversize' WHEN payload_len < 100 AND more_fragments THEN 'tiny_fragment' END AS kind
    FROM packets WHERE frag_offset > 0 OR more_fragments WINDOW w AS (PARTITION BY src_ip, dst_ip, ip_id, protocol ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) t WHERE kind IS NOT NULL""")
def fragment_set(spark: SparkSession, d: str) -> DataFrame:
    w = windowed.running(["src_ip", "dst_ip", "ip_id", "protocol"], ["ts", "event_id"])
    kind = F.when(F.count(F.lit(1)).over(w) > 64, "fragment_storm").when((F.sum("payload_len").over(w) > 1000) & (F.col("protocol") == "tcp"), "fragment_oversize").when((F.col("payload_len") < 100) & F.col("more_fragments"), "tiny_fragment")
    return packets(spark, d).filter("frag_offset > 0 OR more_fragments").withColumn("kind", kind).filter("kind is not null").select("event_id", "src_ip", "kind")


@query("win15_arp_spoofing", f"""{derived_sql('packets')} SELECT event_id, src_ip FROM (SELECT event_id, src_ip, src_mac <> fm AS off, sum(CASE WHEN src_mac <> fm THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n
    FROM (SELECT event_id, ts, src_ip, src_mac, first_value(src_mac) OVER (PARTITION BY src_ip ORDER BY ts, event_id) AS fm FROM packets) f) t WHERE off AND n >= 3""")
def arp_spoofing(spark: SparkSession, d: str) -> DataFrame:
    w = windowed.running(["src_ip"], ["ts", "event_id"])
    off = F.col("src_mac") != F.first("src_mac").over(w)
    return packets(spark, d).withColumn("off", off).withColumn("n", F.sum(F.col("off").cast("long")).over(w)).filter("off AND n >= 3").select("event_id", "src_ip")


@query("win41_paws_violation", f"""{derived_sql('packets')} SELECT event_id, src_ip FROM (SELECT event_id, src_ip, tsval, max(tsval) OVER (PARTITION BY src_ip ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM packets) t WHERE tsval < m AND m - tsval < 2147483648""")
def paws_violation(spark: SparkSession, d: str) -> DataFrame:
    w = windowed.Window.partitionBy("src_ip").orderBy("ts", "event_id").rowsBetween(windowed.Window.unboundedPreceding, -1)
    return packets(spark, d).withColumn("m", F.max("tsval").over(w)).filter("tsval < m AND m - tsval < 2147483648").select("event_id", "src_ip")


@query("win43_device_cap", f"""{derived_sql('packets')} SELECT event_id, src_mac, n FROM (SELECT event_id, src_mac, count(*) OVER (PARTITION BY src_mac ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM packets WHERE flags = 'S') t WHERE n > 5""")
def device_cap(spark: SparkSession, d: str) -> DataFrame:
    return packets(spark, d).filter("flags = 'S'").withColumn("n", F.count(F.lit(1)).over(windowed.running(["src_mac"], ["ts", "event_id"]))).filter("n > 5").select("event_id", "src_mac", "n")


@query("win32_unusual_hours", """WITH h AS (SELECT user_id, hour(ts) AS h, count(*) AS n FROM events GROUP BY user_id, hour(ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, count(*) OVER (PARTITION BY user_id) AS hours FROM h)
    SELECT user_id, CAST(h AS INT) AS h, n FROM s WHERE total >= 20 AND hours >= 3 AND n < 2""")
def unusual_hours(spark: SparkSession, d: str) -> DataFrame:
    w = windowed.Window.partitionBy("user_id")
    h = table(spark, d, "events").groupBy("user_id", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("total", F.sum("n").over(w)).withColumn("hours", F.count(F.lit(1)).over(w)).filter("total >= 20 AND hours >= 3 AND n < 2").select("user_id", "h", "n")


@query("win44_rate_limiter", """SELECT user_id, day, n, bytes FROM (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS bytes FROM events GROUP BY ALL) t WHERE n > 4 OR bytes > 200""")
def rate_limiter(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("bytes"))
    return per.filter("n > 4 OR bytes > 200")


@query("win31_self_baseline", """WITH p AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT user_id, day, n, count(*) OVER w AS k, avg(n) OVER w AS m, stddev_pop(n) OVER w AS sd FROM p WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT user_id, day, n, round(CASE WHEN sd > 0 THEN abs(n - m) / sd ELSE 0 END, 6) AS z FROM b WHERE k >= 5 AND CASE WHEN sd > 0 THEN abs(n - m) / sd ELSE 0 END > 3""")
def self_baseline(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    # rows without a day come last
    p = p.withColumn("at", F.coalesce("day", F.lit("9999-12-31").cast("date")))
    found = folds.fold_rows(p, "user_id", "at", "at", folds.beside_own_past(5, 3.0))
    return found.select("user_id", "day", "n", F.round("z", 6).alias("z"))


@query("win46_metric_zscore", """WITH b AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY user_id HAVING count(*) >= 10)
    SELECT event_id, CASE WHEN z > 3 THEN 'critical' WHEN z > 2.5 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT event_id, CASE WHEN sd > 0 THEN abs(value - m) / sd ELSE 0 END AS z FROM events JOIN b USING (user_id)) t WHERE z > 2""")
def metric_zscore(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    b = e.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"), F.count(F.lit(1)).alias("k")).filter("k >= 10")
    z = F.when(F.col("sd") > 0, F.abs(F.col("value") - F.col("m")) / F.col("sd")).otherwise(0.0)
    return e.join(b, "user_id").withColumn("z", z).filter("z > 2").select("event_id", F.when(F.col("z") > 3, "critical").when(F.col("z") > 2.5, "high").otherwise("medium").alias("severity"))


@query("win47_clean_flow_skip", """SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bad FROM events) t WHERE NOT (i > 10 AND bad = 0)""")
def clean_flow_skip(spark: SparkSession, d: str) -> DataFrame:
    w = windowed.running(["user_id"], ["ts", "event_id"])
    e = table(spark, d, "events").withColumn("i", F.count(F.lit(1)).over(w)).withColumn("bad", F.max((F.col("event_type") == "error").cast("int")).over(w))
    return e.filter("NOT (i > 10 AND bad = 0)").select("event_id")


FLOW_SQL = "concat(least(concat(src_ip, ':', CAST(src_port AS STRING)), concat(dst_ip, ':', CAST(dst_port AS STRING))), '|', greatest(concat(src_ip, ':', CAST(src_port AS STRING)), concat(dst_ip, ':', CAST(dst_port AS STRING))), '|', protocol)"


def _flow():
    return flow_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("protocol"))


@query("par11_flow_key", f"{derived_sql('packets')} SELECT event_id, {FLOW_SQL} AS flow FROM packets")
def flow_keys(spark: SparkSession, d: str) -> DataFrame:
    return packets(spark, d).select("event_id", _flow().alias("flow"))


@query("win48_connections", f"""{derived_sql('packets')} SELECT flow, arg_min(src_ip, o) AS initiator, count(*) AS packets, CAST(sum(raw_len) AS BIGINT) AS bytes, min(ts) AS first_seen, max(ts) AS last_seen,
    CASE WHEN max(CASE WHEN flags LIKE '%R%' OR flags LIKE '%F%' THEN 1 ELSE 0 END) = 1 THEN 'CLOSED' WHEN max(CASE WHEN flags = 'S' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN flags = 'SA' THEN 1 ELSE 0 END) = 1 THEN 'ESTABLISHED'
         WHEN max(CASE WHEN flags = 'SA' THEN 1 ELSE 0 END) = 1 THEN 'SYN_RECV' WHEN max(CASE WHEN flags = 'S' THEN 1 ELSE 0 END) = 1 THEN 'SYN_SENT' ELSE 'NEW' END AS state
    FROM (SELECT *, {FLOW_SQL} AS flow, epoch_us(ts) AS o FROM packets) p GROUP BY flow""")
def connections(spark: SparkSession, d: str) -> DataFrame:
    return windowed.connections(packets(spark, d), _flow())


@query("hsk1_handshake_evidence", f"""{derived_sql('packets')}, r AS (SELECT event_id, ts, flags, src_ip AS host, true AS sends FROM packets UNION ALL SELECT event_id, ts, flags, dst_ip, false FROM packets),
    c AS (SELECT event_id, host, CAST(sum(CASE WHEN flags = 'S' AND sends THEN 1 ELSE 0 END) OVER w AS BIGINT) AS syn_sent, CAST(sum(CASE WHEN flags = 'SA' AND NOT sends THEN 1 ELSE 0 END) OVER w AS BIGINT) AS synack_received FROM r WINDOW w AS (PARTITION BY host ORDER BY ts, event_id, sends ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT *, synack_received = 0 AND syn_sent - synack_received >= 3 AS spoofed FROM c""")
def handshake_evidence(spark: SparkSession, d: str) -> DataFrame:
    return windowed.handshakes(packets(spark, d)).select("event_id", "host", "syn_sent", "synack_received", "spoofed")


TOKEN = "concat_ws('.', event_type, CAST(CASE WHEN value >= 20 THEN 2 WHEN value >= 5 THEN 1 ELSE 0 END AS STRING))"


@query("win45_ngram_perplexity", f"""WITH t AS (SELECT user_id, lag(tok, 2) OVER w AS a, lag(tok) OVER w AS b, tok AS c FROM (SELECT *, {TOKEN} AS tok FROM events) e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT * FROM t WHERE a IS NOT NULL AND b IS NOT NULL), n3 AS (SELECT a, b, c, count(*) AS n3 FROM g GROUP BY a, b, c), n2 AS (SELECT a, b, count(*) AS n2 FROM g GROUP BY a, b), v AS (SELECT count(DISTINCT {TOKEN}) AS v FROM events)
    SELECT user_id, round(exp(-avg(ln((n3 + 0.01) / (n2 + 0.01 * v)))), 6) AS perplexity, count(*) AS n FROM g JOIN n3 USING (a, b, c) JOIN n2 USING (a, b), v GROUP BY user_id""")
def ngram_perplexity(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "events").withColumn("tok", F.concat_ws(".", "event_type", ladder(F.col("value"), (5, 20)).cast("string")))
    return windowed.perplexity(tokens, "user_id", ["ts", "event_id"], "tok").select("user_id", F.round("perplexity", 6).alias("perplexity"), "n")


@query("win30_session_fragments", """WITH c AS (SELECT conv_id, turn, (regexp_matches(text, '(?i)que')) AS a, regexp_matches(text, '(?i)the') AS b FROM conversations), x AS (SELECT conv_id, turn, 'que' AS class FROM c WHERE a UNION ALL SELECT conv_id, turn, 'the' FROM c WHERE b),
    n AS (SELECT conv_id, class, turn, row_number() OVER (PARTITION BY conv_id, class ORDER BY turn) AS n FROM x) SELECT conv_id, class, turn FROM n WHERE n = 2""")
def session_fragments(spark: SparkSession, d: str) -> DataFrame:
    classes = [("que", "(?i)que"), ("the", "(?i)the")]
    hits = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in classes]), lambda x: x.isNotNull())
    x = table(spark, d, "conversations").select("conv_id", "turn", F.explode(hits).alias("class"))
    w = windowed.Window.partitionBy("conv_id", "class").orderBy("turn")
    return x.withColumn("n", F.row_number().over(w)).filter("n = 2").select("conv_id", "class", "turn")


@query("win29_short_connections", """SELECT event_id, user_id FROM (SELECT event_id, user_id, event_type, epoch_us(ts) - max(CASE WHEN event_type = 'signup' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS age FROM events) t WHERE event_type = 'error' AND age < 14400000000""")
def short_connections(spark: SparkSession, d: str) -> DataFrame:
    opened = F.max(F.when(F.col("event_type") == "signup", windowed.micros("ts"))).over(windowed.running(["user_id"], ["ts", "event_id"]))
    return table(spark, d, "events").withColumn("age", windowed.micros("ts") - opened).filter("event_type = 'error' AND age < 14400000000").select("event_id", "user_id")


@query("win24_seq_covert", f"""{derived_sql('packets')} SELECT event_id, src_ip, CAST(n AS INT) AS printable FROM (SELECT event_id, src_ip, len(list_filter(list(x) OVER (PARTITION BY src_ip ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), lambda y: y BETWEEN 32 AND 126)) AS n FROM (
    SELECT event_id, src_ip, ts, ((tcp_seq % 256) - lag(tcp_seq % 256) OVER (PARTITION BY src_ip ORDER BY ts, event_id) + 256) % 256 AS x FROM packets) q WHERE x IS NOT NULL) t WHERE n >= 12""")
def seq_covert(spark: SparkSession, d: str) -> DataFrame:
    w = windowed.Window.partitionBy("src_ip").orderBy("ts", "event_id")
    x = (F.col("tcp_seq") % 256 - F.lag(F.col("tcp_seq") % 256).over(w) + 256) % 256
    rows = packets(spark, d).withColumn("x", x).filter("x is not null")
    n = F.size(F.filter(F.collect_list("x").over(windowed.last_rows(["src_ip"], ["ts", "event_id"], 25)), lambda y: y.between(32, 126)))
    return rows.withColumn("printable", n).filter("printable >= 12").select("event_id", "src_ip", "printable")


@query("win50_evidence_window", """WITH d AS (SELECT user_id, event_id AS hit, ts AS hit_ts FROM events WHERE event_type = 'error' AND value > 60), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), h AS (SELECT d.user_id, d.hit, o.i FROM d JOIN o ON o.event_id = d.hit)
    SELECT h.hit, o.event_id FROM h JOIN o ON o.user_id = h.user_id AND o.i BETWEEN h.i - 4 AND h.i - 1""")
def evidence_window(spark: SparkSession, d: str) -> DataFrame:
    w = windowed.Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("prior", F.array(*[F.lag("event_id", k).over(w) for k in range(1, 5)]))
    hits = rows.filter("event_type = 'error' AND value > 60").select(F.col("event_id").alias("hit"), F.explode("prior").alias("event_id"))
    return hits.filter("event_id is not null")


@query("win49_payload_assembly", "SELECT conv_id, CAST(count(*) AS INT) AS n_parts, sha256(coalesce(string_agg(text, '' ORDER BY turn, text), '')) AS payload_sha256 FROM conversations GROUP BY conv_id")
def payload_assembly(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("parts"))
    return c.select("conv_id", F.size("parts").alias("n_parts"), F.sha2(F.array_join(F.transform("parts", lambda p: p["text"]), ""), 256).alias("payload_sha256"))


HEADER_CASES = [
    ("null_scan", "medium", "protocol = 'tcp' AND flags = ''"), ("xmas_scan", "medium", "protocol = 'tcp' AND ((flags LIKE '%F%' AND flags LIKE '%S%') OR (flags LIKE '%F%' AND flags LIKE '%U%') OR (flags LIKE '%P%' AND flags LIKE '%U%'))"),
    ("invalid_tcp_flags", "medium", "protocol = 'tcp' AND (flags LIKE '%FS%' OR flags LIKE '%FR%' OR flags LIKE '%SR%')"), ("fragmentation_attack", "medium", "frag_offset > 0 OR more_fragments"), ("protocol_anomaly", "low", "protocol NOT IN ('tcp', 'udp', 'icmp', 'ipv6')"),
    ("service_mismatch", "medium", "protocol = 'tcp' AND src_port < 1024 AND dst_port IN (22, 80, 443, 53, 8080, 3306, 23, 445)"), ("rare_port_pairing", "low", "src_port < 1024 AND dst_port < 1024 AND src_port <> dst_port AND (src_port IN (22, 80, 443) OR dst_port IN (22, 80, 443))"),
    ("jumbo_frame", "low", "raw_len > 9000"), ("slow_drip", "medium", "flags LIKE '%P%' AND payload_len = 1"), ("icmp_tunnel", "high", "protocol = 'icmp' AND payload_len > 500"), ("http_tunnel", "high", "dst_port IN (80, 443, 8080, 8443) AND payload_len > 50000"),
    ("tor_traffic", "high", "src_ip IN ('10.0.1.9', '10.0.2.22')"), ("suspicious_port", "high", "dst_port IN (4444, 5555, 31337)"), ("suspicious_tls", "medium", "tls_sni LIKE '%.onion%'"), ("proxy_traffic", "low", "http_uri LIKE 'http://%' OR http_uri LIKE 'https://%'"), ("ttl_anomaly", "medium", "ttl < 64"),
]


@query("st01_header_detectors", f"{derived_sql('packets')} " + " UNION ALL ".join(f"SELECT event_id, src_ip AS source_ip, '{n}' AS attack_type, '{s}' AS severity FROM packets WHERE {w}" for n, s, w in HEADER_CASES))
def header_detectors(spark: SparkSession, d: str) -> DataFrame:
    return stateless.detect(packets(spark, d), stateless.header_rules(("10.0.1.9", "10.0.2.22"))).select("event_id", "source_ip", "attack_type", "severity")


@query("st16_ttl_confidence", f"{derived_sql('packets')} SELECT event_id, round(least(0.3 + 0.01 * (64 - ttl), 0.8), 6) AS confidence FROM packets WHERE ttl < 64")
def ttl_confidence(spark: SparkSession, d: str) -> DataFrame:
    hits = stateless.detect(packets(spark, d), [r for r in stateless.header_rules() if r.attack_type == "ttl_anomaly"])
    return hits.select("event_id", F.round("confidence", 6).alias("confidence"))


WEB_SQL = f"""{derived_sql('packets')}, u AS (SELECT *, url_decode(replace(http_uri, '+', ' ')) AS d FROM packets)
    SELECT event_id, attack_type FROM (SELECT event_id, CASE WHEN regexp_matches(d, '{PATTERN_SQL["sql_injection"]}') THEN 'sql_injection' WHEN regexp_matches(d, '{PATTERN_SQL["xss"]}') THEN 'xss_attempt'
      WHEN regexp_matches(d, '{PATTERN_SQL["command_injection"]}') THEN 'command_injection' WHEN regexp_matches(d, '{PATTERN_SQL["path_traversal"]}') THEN 'path_traversal' WHEN regexp_matches(user_agent, '{PATTERN_SQL["scanner_signature"]}') THEN 'scanner_detected'
      WHEN regexp_matches(cookie, '{PATTERN_SQL["sql_injection"]}') OR regexp_matches(cookie, '{PATTERN_SQL["xss"]}') THEN 'cookie_injection' WHEN regexp_matches(forwarded, '{PATTERN_SQL["path_traversal"]}') THEN 'header_injection' WHEN upgrade = 'websocket' THEN 'websocket_upgrade'
      WHEN n_content_length > 0 AND chunked THEN 'http_smuggling_cl_te' WHEN n_content_length > 1 THEN 'http_smuggling_dual_cl' END AS attack_type FROM u) t WHERE attack_type IS NOT NULL"""


@query("st23_web_chain", WEB_SQL)
def web_chain(spark: SparkSession, d: str) -> DataFrame:
    return stateless.web_attacks(packets(spark, d)).select("event_id", "attack_type")


HOST_SQL = """ SELECT event_id, h.attack_type, h.severity FROM (SELECT event_id, CASE
    WHEN event_kind = 'exec' AND filename LIKE '%/bin/bash%' AND (args LIKE '%/dev/tcp%' OR args LIKE '%bash -i%') THEN {'attack_type': 'reverse_shell', 'severity': 'critical'} WHEN event_kind = 'exec' AND filename LIKE '%/bin/bash%' AND args LIKE '%curl%' AND args LIKE '%>%' THEN {'attack_type': 'download_execute', 'severity': 'high'}
    WHEN event_kind = 'exec' AND filename LIKE '%/bin/bash%' AND args LIKE '%sudo%' AND uid <> 0 THEN {'attack_type': 'privilege_escalation_attempt', 'severity': 'medium'} WHEN event_kind = 'exec' AND filename LIKE '%nc%' AND (args LIKE '%-e%' OR args LIKE '%--exec%') THEN {'attack_type': 'reverse_shell', 'severity': 'critical'}
    WHEN event_kind = 'exec' AND filename LIKE '%python%' AND args LIKE '%socket%' THEN {'attack_type': 'reverse_shell', 'severity': 'high'}
    WHEN event_kind = 'connect' AND dst_port = 4444 THEN {'attack_type': 'suspicious_connection', 'severity': 'high'} WHEN event_kind = 'connect' AND dst_port > 10000 AND protocol = 'TCP' THEN {'attack_type': 'high_port_connection', 'severity': 'medium'} WHEN event_kind = 'connect' AND dst_port = 22 THEN {'attack_type': 'external_ssh', 'severity': 'low'}
    WHEN event_kind = 'open' AND filename LIKE '%/etc/passwd%' THEN {'attack_type': 'credential_access', 'severity': 'medium'} WHEN event_kind = 'open' AND filename LIKE '%/etc/shadow%' THEN {'attack_type': 'credential_access', 'severity': 'high'}
    WHEN event_kind = 'open' AND (filename LIKE '%/.ssh/%' OR filename LIKE '%/.aws/%') THEN {'attack_type': 'credential_access', 'severity': 'medium'} WHEN event_kind = 'open' AND filename LIKE '%/var/log/%' THEN {'attack_type': 'log_tampering', 'severity': 'medium'}
    WHEN event_kind = 'open' AND filename LIKE '%/proc/self/%' THEN {'attack_type': 'process_memory_access', 'severity': 'medium'} WHEN event_kind = 'open' AND filename LIKE '%/var/www/%.php%' THEN {'attack_type': 'webshell_creation', 'severity': 'critical'}
    WHEN event_kind = 'kill' THEN {'attack_type': 'process_termination', 'severity': 'low'} END AS h FROM host_events) t WHERE h IS NOT NULL"""


@query("st34_host_rules", derived_sql("host_events") + HOST_SQL)
def host_rules(spark: SparkSession, d: str) -> DataFrame:
    h = derive(table(spark, d, "events"), "host_events").withColumn("source", F.lit("host"))
    return stateless.detect_first(h, stateless.host_rules(), "source").select("event_id", "attack_type", "severity")


#: Files by k beside those of the derived host events.
FILES = "CASE k % 9 WHEN 0 THEN '/home/a/.ssh/id_rsa' WHEN 1 THEN '/root/.aws/credentials' WHEN 2 THEN '/proc/self/mem' WHEN 3 THEN '/usr/bin/ncat' WHEN 4 THEN '/etc/passwd' WHEN 5 THEN '/srv/http/a.jsp' ELSE filename END"
ARGUMENTS = "CASE WHEN k % 9 = 3 THEN '10.0.0.1 4444 --exec sh' ELSE args END"


@query("st36_host_files", derived_sql("host_events") + HOST_SQL.replace("FROM host_events)", f"FROM (SELECT * REPLACE ({FILES} AS filename, {ARGUMENTS} AS args) FROM host_events) f)").replace("LIKE '%/var/www/%.php%'", "LIKE '%/var/www/%.php%' OR event_kind = 'open' AND filename LIKE '%/srv/http%.jsp%'"))
def host_files(spark: SparkSession, d: str) -> DataFrame:
    h = derive(table(spark, d, "events"), "host_events").selectExpr("event_id", "ts", "k", "event_kind", "uid", f"{FILES} AS filename", f"{ARGUMENTS} AS args", "dst_port", "protocol", "'host' AS source")
    return stateless.detect_first(h, stateless.host_rules(), "source").select("event_id", "attack_type", "severity")


@query("st39_dns_entropy", f"""{derived_sql('packets')}, q AS (SELECT event_id, string_split(split_part(dns_qname, '.', 1), '') AS cs FROM packets WHERE dns_qname IS NOT NULL), c AS (SELECT event_id, unnest(cs) AS ch FROM q), f AS (SELECT event_id, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY event_id, ch),
    e AS (SELECT event_id, -sum((n / t) * log2(n / t)) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY event_id) AS t FROM f) z GROUP BY event_id) SELECT event_id, round(least(0.5 + 0.15 * (bits - 4), 0.95), 6) AS confidence FROM e WHERE bits > 4.0""")
def dns_entropy(spark: SparkSession, d: str) -> DataFrame:
    return stateless.dns_entropy(packets(spark, d)).select("event_id", "confidence")


@query("par12_label_entropy", f"""{derived_sql('packets')}, q AS (SELECT DISTINCT split_part(dns_qname, '.', 1) AS label FROM packets WHERE dns_qname IS NOT NULL), c AS (SELECT label, unnest(string_split(label, '')) AS ch FROM q), f AS (SELECT label, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY label, ch)
    SELECT label, round(-sum((n / t) * log2(n / t)), 6) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY label) AS t FROM f) z GROUP BY label""")
def label_entropy(spark: SparkSession, d: str) -> DataFrame:
    labels = packets(spark, d).filter("dns_qname is not null").select(F.substring_index("dns_qname", ".", 1).alias("label")).distinct()
    return labels.select("label", F.round(entropy(F.col("label")), 6).alias("bits"))


@query("st40_policy", f"""{derived_sql('packets')} SELECT event_id, src_ip FROM packets WHERE dst_port NOT IN (22, 80, 443, 53) OR protocol NOT IN ('tcp', 'udp') OR NOT (hour(ts) >= 20 OR hour(ts) < 6)""")
def policy(spark: SparkSession, d: str) -> DataFrame:
    return stateless.policy_violations(packets(spark, d), (22, 80, 443, 53), ("tcp", "udp"), (20, 6)).select("event_id", F.col("source_ip").alias("src_ip"))


@query("rul05_multi_rule", f"""{derived_sql('packets')} SELECT event_id, 'net-smb' AS rule_id, 'medium' AS severity FROM packets WHERE CAST(dst_port AS STRING) LIKE '%445%' OR CAST(dst_port AS STRING) LIKE '%139%' UNION ALL SELECT event_id, 'net-telnet', 'medium' FROM packets WHERE dst_port = 23
    UNION ALL SELECT event_id, 'net-dns', 'high' FROM packets WHERE dst_port = 53 AND dns_txt_len > 600 UNION ALL SELECT event_id, 'web-xss', 'high' FROM packets WHERE http_uri LIKE '%<script%' UNION ALL SELECT event_id, 'web-scan', 'low' FROM packets WHERE user_agent LIKE 'sqlmap%' OR user_agent LIKE '%Nikto%'""")
def multi_rule(spark: SparkSession, d: str) -> DataFrame:
    return rules.match_rules(packets(spark, d), rules.RULES).select("event_id", "rule_id", "severity")


@query("rul06_rules_by_category", f"""{derived_sql('packets')}, m AS (SELECT 'reconnaissance' AS category FROM packets WHERE CAST(dst_port AS STRING) LIKE '%445%' OR CAST(dst_port AS STRING) LIKE '%139%' UNION ALL SELECT 'insecure_protocol' FROM packets WHERE dst_port = 23
    UNION ALL SELECT 'exfiltration' FROM packets WHERE dst_port = 53 AND dns_txt_len > 600 UNION ALL SELECT 'injection' FROM packets WHERE http_uri LIKE '%<script%' UNION ALL SELECT 'reconnaissance' FROM packets WHERE user_agent LIKE 'sqlmap%' OR user_agent LIKE '%Nikto%') SELECT category, count(*) AS n FROM m GROUP BY category""")
def rules_by_category(spark: SparkSession, d: str) -> DataFrame:
    return rules.match_rules(packets(spark, d), rules.RULES).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


#: First bytes of a packet by its flags and address; the others have none.
PAYLOAD = "CASE flags WHEN 'PA' THEN concat('GET ', http_uri, ' HTTP/1.1') WHEN 'SA' THEN 'SSH-2.0-x' WHEN 'A' THEN concat(chr(22), chr(3), chr(1)) WHEN 'SF' THEN 'EHLO x' WHEN 'FR' THEN 'USER x' ELSE '' END"
BY_PORT = " ".join(f"WHEN {port} THEN '{name}'" for port, name in APP_PORTS.items())


@query("par10_app_protocol", f"{derived_sql('packets')} SELECT event_id, coalesce(CASE dst_port {BY_PORT} END, CASE src_port {BY_PORT} END) AS app FROM packets")
def app_protocol(spark: SparkSession, d: str) -> DataFrame:
    return packets(spark, d).select("event_id", parse.app_protocol(F.col("src_port"), F.col("dst_port"), F.lit("")).alias("app"))


@query("par10_app_protocol_all", f"""{derived_sql('packets')} SELECT event_id, CASE WHEN regexp_matches(payload, '^(GET|POST|PUT|HEAD|DELETE|OPTIONS|PATCH) ') THEN 'http' WHEN payload LIKE 'SSH-%' THEN 'ssh' WHEN starts_with(payload, concat(chr(22), chr(3))) THEN 'tls' WHEN payload LIKE 'EHLO%' OR payload LIKE 'HELO%' THEN 'smtp' WHEN payload LIKE 'USER %' OR payload LIKE 'PASS %' THEN 'ftp'
    ELSE coalesce(CASE dst_port {BY_PORT} END, CASE src_port {BY_PORT} END) END AS app FROM (SELECT *, {PAYLOAD} AS payload FROM packets) p""")
def app_protocol_all(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d).selectExpr("event_id", "src_port", "dst_port", f"{PAYLOAD} AS payload")
    return p.select("event_id", parse.app_protocol(F.col("src_port"), F.col("dst_port"), F.col("payload")).alias("app"))


@query("par13_client_fingerprint", f"""{derived_sql('packets')}, l AS (SELECT event_id, tls_sni, list_transform(range(0, k % 7 + 1), lambda i: i * 257 + k) AS c, list_transform(range(0, k % 5 + 1), lambda i: i * 257 + k) AS e FROM packets)
    SELECT event_id, concat('t12', CASE WHEN length(tls_sni) > 0 THEN 'd' ELSE 'i' END, lpad(CAST(len(c) AS STRING), 2, '0'), lpad(CAST(len(e) AS STRING), 2, '0'), 'h2_', sha256(array_to_string(list_transform(c, lambda x: lpad(lower(hex(x)), 4, '0')), ','))[1:12], '_',
      sha256(array_to_string(list_transform(list_filter(e, lambda x: x NOT IN (0, 16)), lambda x: lpad(lower(hex(x)), 4, '0')), ','))[1:12]) AS fingerprint FROM l""")
def client_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    lists = lambda a: F.transform(F.sequence(F.lit(0), F.col("k") % a), lambda i: (i * 257 + F.col("k")).cast("int"))
    return packets(spark, d).select("event_id", ja4(F.lit(771), lists(7), lists(5), F.col("tls_sni"), F.lit("h2")).alias("fingerprint"))


def _over(value: str, edges: tuple[float, ...]) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN {value} > {e} THEN 1 ELSE 0 END" for e in edges) + " AS STRING)"


TOKEN_SQL = f"""concat_ws('.', CASE WHEN src_port > 1024 THEN '0' ELSE '1' END, {_over('payload_len', parse.LENGTH_EDGES)}, {_over('coalesce(iat, 0.0)', parse.GAP_EDGES)}, {_over('ttl', parse.TTL_EDGES)}, CASE WHEN protocol = 'tcp' THEN '0' ELSE '1' END,
    CASE WHEN flags LIKE '%S%' THEN '1' ELSE '0' END, CASE WHEN flags LIKE '%A%' THEN '1' ELSE '0' END, CASE WHEN flags LIKE '%F%' THEN '1' ELSE '0' END, {_over('src_port', parse.PORT_EDGES)}, {_over('dst_port', parse.PORT_EDGES)}, CAST(least(win // 4096, 15) AS STRING))"""
TOKENS_SQL = f"""{derived_sql('packets')}, tokens AS (SELECT src_ip, ts, event_id, {TOKEN_SQL} AS tok FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY src_ip ORDER BY ts, event_id)) / 1000000.0 AS iat FROM packets) p)"""


def tokens(spark: SparkSession, d: str) -> DataFrame:
    p = windowed.with_gaps(packets(spark, d), ["src_ip"], ["ts", "event_id"], "ts")
    return p.select("src_ip", "ts", "event_id", parse.packet_token(F.col("gap")).alias("tok"))


@query("par17_packet_tokens", f"{TOKENS_SQL} SELECT tok AS token, count(*) AS n FROM tokens GROUP BY tok")
def packet_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).groupBy(F.col("tok").alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query("win45_packet_perplexity", f"""{TOKENS_SQL}, t AS (SELECT src_ip, lag(tok, 2) OVER w AS a, lag(tok) OVER w AS b, tok AS c, pow(0.999, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0) AS wt FROM tokens WINDOW w AS (PARTITION BY src_ip ORDER BY ts, event_id)),
    g AS (SELECT * FROM t WHERE a IS NOT NULL AND b IS NOT NULL), n3 AS (SELECT a, b, c, sum(wt) AS n3 FROM g GROUP BY a, b, c), n2 AS (SELECT a, b, sum(wt) AS n2 FROM g GROUP BY a, b), v AS (SELECT count(DISTINCT tok) AS v FROM tokens)
    SELECT src_ip, round(exp(-avg(ln((n3 + 0.01) / (n2 + 0.01 * v)))), 4) AS perplexity, count(*) AS n, exp(-avg(ln((n3 + 0.01) / (n2 + 0.01 * v)))) > 100 AS anomalous FROM g JOIN n3 USING (a, b, c) JOIN n2 USING (a, b), v GROUP BY src_ip""")
def packet_perplexity(spark: SparkSession, d: str) -> DataFrame:
    age = (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - windowed.micros("ts")) / 86400e6
    found = windowed.perplexity(tokens(spark, d), "src_ip", ["ts", "event_id"], "tok", decay=F.pow(F.lit(0.999), age))
    return found.select("src_ip", F.round("perplexity", 4).alias("perplexity"), "n", "anomalous")


@query("agg15_flow_features", None)
def flow_features(spark: SparkSession, d: str) -> DataFrame:
    return report.flow_features(two_way(packets(spark, d)), _flow(), 6 * HOUR)


def two_way(p: DataFrame) -> DataFrame:
    """Packets, and of those with an even k a reply each: a second later, its ends swapped, a ninth as long."""
    swapped = {"src_ip": F.col("dst_ip"), "dst_ip": F.col("src_ip"), "src_port": F.col("dst_port"), "dst_port": F.col("src_port")}
    reply = {"event_id": -F.col("event_id"), "ts": F.expr("ts + INTERVAL 1 SECOND"), "raw_len": F.floor(F.col("raw_len") / 9).cast("int")}
    return p.unionByName(p.filter("k % 2 = 0").withColumns(swapped | reply))


@query("agg15_flow_core", """WITH o AS (SELECT user_id, ts, event_id, value, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM o)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS packets, round(sum(value), 4) AS total, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0, 6) AS duration FROM s GROUP BY user_id, session""")
def flow_core(spark: SparkSession, d: str) -> DataFrame:
    s = report.flow_sessions(table(spark, d, "events"), F.col("user_id"), 12 * HOUR)
    t = windowed.micros("ts")
    return s.groupBy(F.col("flow").alias("user_id"), "session").agg(F.count(F.lit(1)).alias("packets"), F.round(F.sum("value"), 4).alias("total"), F.round((F.max(t) - F.min(t)) / 1e6, 6).alias("duration"))


@query("par09_text_gate", """SELECT doc_id, (CASE WHEN length(text) < 8 THEN p = 0 ELSE p <= 0.15 * length(text) END) AND length(text) > 0 AS is_text FROM (SELECT doc_id, text, length(regexp_replace(text, '[\\x20-\\x7e\\r\\n\\t]', '', 'g')) AS p FROM documents) t""")
def text_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", parse.is_text(F.col("text")).alias("is_text"))


@query("fn_broadcast_address", f"{derived_sql('packets')} SELECT event_id FROM packets WHERE dst_ip LIKE '%.255'")
def broadcast_address(spark: SparkSession, d: str) -> DataFrame:
    return packets(spark, d).filter(is_broadcast(F.col("dst_ip"))).select("event_id")


@query("par08_payload_normaliser", f"{derived_sql('packets')} SELECT event_id, url_decode(replace(http_uri, '+', ' ')) AS uri FROM packets")
def payload_normaliser(spark: SparkSession, d: str) -> DataFrame:
    return packets(spark, d).select("event_id", parse.normalise(F.col("http_uri")).alias("uri"))
