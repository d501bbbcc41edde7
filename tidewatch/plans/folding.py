"""Queries of folds that carry values, of evidence windows and of large lists, with SQL twins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, folds, report, suppress, windowed
from ..sources.derive import derived_sql
from ..sources.scratch import folder
from .detect import packets
from .registry import query, table

HOUR, DAY = 3_600, 86_400

_ORDERED = "row_number() OVER (PARTITION BY src_ip ORDER BY ts, event_id) AS i"


@query("win16_mac_reset", f"""{derived_sql('packets')}, o AS (SELECT src_ip, event_id, src_mac, {_ORDERED} FROM packets),
    r AS (SELECT src_ip, event_id, i, [src_mac] AS kept, false AS hit FROM o WHERE i = 1 UNION ALL
      SELECT src_ip, event_id, i, CASE WHEN len(k) >= 3 THEN [] ELSE k END, len(k) >= 3 FROM (
        SELECT o.src_ip, o.event_id, o.i, CASE WHEN list_contains(r.kept, o.src_mac) THEN r.kept ELSE list_append(r.kept, o.src_mac) END AS k FROM r JOIN o ON o.src_ip = r.src_ip AND o.i = r.i + 1) a)
    SELECT event_id, src_ip FROM r WHERE hit""")
def mac_reset(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d).select("src_ip", "ts", "event_id", F.col("src_mac").alias("value"))
    return folds.fold_rows(p, "src_ip", "ts", "event_id", folds.distinct_then_reset(3)).select("event_id", "src_ip")


_BASE = f"""{derived_sql('packets')}, w AS (SELECT src_ip, event_id, ts, count(*) OVER v / 864000.0 AS pps, sum(raw_len) OVER v * 8 / 864000.0 AS bps, count(*) OVER v AS n FROM packets
      WINDOW v AS (PARTITION BY src_ip ORDER BY epoch_us(ts) RANGE BETWEEN 863999999999 PRECEDING AND CURRENT ROW)),
    o AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY src_ip ORDER BY ts, event_id) AS i FROM w),
    a AS (SELECT src_ip, event_id, t, i, t AS last, true AS judged FROM o WHERE i = 1 UNION ALL
      SELECT o.src_ip, o.event_id, o.t, o.i, CASE WHEN o.t - a.last >= 86400000000 THEN o.t ELSE a.last END, o.t - a.last >= 86400000000 FROM a JOIN o ON o.src_ip = a.src_ip AND o.i = a.i + 1),
    j AS (SELECT o.src_ip, o.event_id, o.pps, o.bps, row_number() OVER (PARTITION BY o.src_ip ORDER BY o.ts, o.event_id) AS i FROM a JOIN o ON o.src_ip = a.src_ip AND o.i = a.i WHERE a.judged AND o.n >= 2),
    z AS (SELECT src_ip, event_id, i, 0.0::DOUBLE AS pz, 0.0::DOUBLE AS bz, 1::BIGINT AS n, pps::DOUBLE AS m1, 0.0::DOUBLE AS s1, bps::DOUBLE AS m2, 0.0::DOUBLE AS s2 FROM j WHERE i = 1 UNION ALL
      SELECT src_ip, event_id, i, pz, bz, CASE WHEN take THEN n + 1 ELSE n END, CASE WHEN take THEN m1 + (p - m1) / (n + 1) ELSE m1 END,
        CASE WHEN take THEN s1 + (p - m1) * (p - (m1 + (p - m1) / (n + 1))) ELSE s1 END, CASE WHEN take THEN m2 + (b - m2) / (n + 1) ELSE m2 END, CASE WHEN take THEN s2 + (b - m2) * (b - (m2 + (b - m2) / (n + 1))) ELSE s2 END
      FROM (SELECT *, n < 6 OR abs(pz) < 1.5 AS take FROM (SELECT j.src_ip, j.event_id, j.i, z.n, z.m1, z.s1, z.m2, z.s2, j.pps::DOUBLE AS p, j.bps::DOUBLE AS b,
          CASE WHEN z.n >= 3 AND sqrt(z.s1 / z.n) >= 0.0000001 THEN (j.pps - z.m1) / sqrt(z.s1 / z.n) ELSE 0 END AS pz, CASE WHEN z.n >= 3 AND sqrt(z.s2 / z.n) >= 0.0000001 THEN (j.bps - z.m2) / sqrt(z.s2 / z.n) ELSE 0 END AS bz
        FROM z JOIN j ON j.src_ip = z.src_ip AND j.i = z.i + 1) x) y)"""


@query("win31_learned_baseline", f"""{_BASE} SELECT event_id, src_ip AS source_ip, attack_type, CASE WHEN abs(z) < 5 THEN 'medium' ELSE 'high' END AS severity, round(z, 5) AS z FROM (
    SELECT event_id, src_ip, 'baseline_pps_anomaly' AS attack_type, pz AS z FROM z UNION ALL SELECT event_id, src_ip, 'baseline_bps_anomaly', bz FROM z) t WHERE abs(z) > 1.5""")
def learned_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Ten days' rates, judged daily: few events a host, so short histories and low thresholds; the law is the same."""
    found = folds.baseline_anomalies(packets(spark, d), "src_ip", "ts", "raw_len", 10 * DAY, DAY, 2, 1.5, warm=3, settled=6, least_sigma=1e-7)
    return found.select("event_id", "source_ip", "attack_type", "severity", F.round("z", 5).alias("z"))


SEGMENTS = (
    "event_id", "ts", "user_id", "CAST(CASE WHEN k % 10 = 9 THEN 0 ELSE 1000000 + epoch_s % 4000000 END AS BIGINT) AS seq",
    "CASE k % 5 WHEN 0 THEN concat('GET /', CAST(k AS STRING), ' HTTP/1.1', crlf, 'Host: x', crlf, crlf) WHEN 1 THEN concat('POST /b HTTP/1.1', crlf, 'Content-Length: ', CAST(k % 12 AS STRING), crlf, crlf, 'he') WHEN 2 THEN 'llo' WHEN 3 THEN '' ELSE concat('X-A: ', CAST(k AS STRING), crlf) END AS text",
)


@query("win49_flow_messages", f"""{derived_sql()}, c AS (SELECT *, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS epoch_s, chr(13) || chr(10) AS crlf FROM base), s AS (SELECT {', '.join(SEGMENTS)} FROM c),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM s WHERE text <> ''),
    r AS (SELECT user_id, i, seq + length(text) AS nxt, text AS buf FROM o WHERE i = 1 UNION ALL
      SELECT o.user_id, o.i, CASE WHEN o.seq >= r.nxt THEN o.seq + length(o.text) ELSE r.nxt END, CASE WHEN o.seq >= r.nxt THEN r.buf || o.text ELSE r.buf END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1),
    b AS (SELECT user_id, arg_max(buf, i) AS rest FROM r GROUP BY user_id),
    m AS (SELECT user_id, 0 AS nth, '' AS msg, rest FROM b UNION ALL
      SELECT user_id, nth + 1, rest[1:size], rest[size + 1:] FROM (SELECT *, position(e IN rest) + 3 + coalesce(try_cast(regexp_extract(split_part(rest, e, 1), '(?i)content-length: ([0-9]+)', 1) AS INT), 0) AS size FROM (SELECT *, chr(13) || chr(10) || chr(13) || chr(10) AS e FROM m) y WHERE contains(rest, e)) x WHERE length(rest) >= size)
    SELECT user_id, CAST(nth AS BIGINT) AS nth, CAST(length(msg) AS BIGINT) AS length, sha256(msg) AS sha256 FROM m WHERE nth > 0""")
def flow_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the flows whose segments are derived from events: in order, behind, empty, with and without bodies."""
    from ..sources.derive import BASE, K_SPARK

    base = table(spark, d, "events").selectExpr(*BASE, K_SPARK).withColumn("epoch_s", F.floor(windowed.micros("ts") / 1_000_000)).withColumn("crlf", F.lit("\r\n"))
    s = base.selectExpr(*SEGMENTS).select("event_id", "ts", "user_id", "seq", F.col("text").cast("binary").alias("payload"), F.lit(80).alias("port"))
    m = folds.fold_rows(s, "user_id", "ts", "event_id", folds.assembled((80,)))
    return m.select("user_id", "nth", "length", F.sha2("message", 256).alias("sha256"))


@query("win50_evidence_all", f"""{derived_sql('packets')}, o AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS place FROM packets),
    c AS (SELECT src_ip, event_id, epoch_us(ts) AS t, {_ORDERED} FROM packets WHERE flags = 'FR' OR protocol = 'proto_89' OR dst_port = 23),
    r AS (SELECT src_ip, event_id, i, t AS last, true AS hit FROM c WHERE i = 1 UNION ALL
      SELECT c.src_ip, c.event_id, c.i, CASE WHEN c.t - r.last >= 432000000000 THEN c.t ELSE r.last END, c.t - r.last >= 432000000000 FROM r JOIN c ON c.src_ip = r.src_ip AND c.i = r.i + 1)
    SELECT r.event_id AS hit, r.src_ip AS source_ip, CAST(h.place - p.place AS INT) AS nth, p.event_id FROM r JOIN o h ON h.event_id = r.event_id JOIN o p ON p.place BETWEEN h.place - 64 AND h.place - 1 WHERE r.hit""")
def evidence_all(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d)
    hits = p.filter("flags = 'FR' OR protocol = 'proto_89' OR dst_port = 23").select("event_id", "ts", F.col("src_ip").alias("source_ip"), F.when(F.col("k") % 2 == 0, "high").otherwise("critical").alias("severity"))
    return evidence.evidence(p, hits, cooldown_s=5 * DAY)


@query("cor07_consumed", f"""{derived_sql('packets')}, o AS (SELECT src_ip, event_id, epoch_us(ts) AS t, CASE WHEN protocol = 'udp' THEN 1 ELSE 2 END AS kind, row_number() OVER (PARTITION BY src_ip ORDER BY ts, CASE WHEN protocol = 'udp' THEN 1 ELSE 2 END, event_id) AS i FROM packets WHERE protocol IN ('udp', 'tcp')),
    r AS (SELECT src_ip, event_id, i, CASE WHEN kind = 1 THEN t END AS opened, CASE WHEN kind = 1 THEN event_id END AS of, CAST(NULL AS BIGINT) AS hit FROM o WHERE i = 1 UNION ALL
      SELECT o.src_ip, o.event_id, o.i, CASE WHEN o.kind = 1 THEN o.t WHEN o.t - r.opened < 43200000000 THEN NULL ELSE r.opened END, CASE WHEN o.kind = 1 THEN o.event_id ELSE r.of END, CASE WHEN o.kind = 2 AND o.t - r.opened < 43200000000 THEN r.of END FROM r JOIN o ON o.src_ip = r.src_ip AND o.i = r.i + 1)
    SELECT event_id, src_ip, hit AS opened_by FROM r WHERE hit IS NOT NULL""")
def consumed(spark: SparkSession, d: str) -> DataFrame:
    found = folds.consumed(packets(spark, d), "src_ip", "ts", F.col("protocol") == "udp", F.col("protocol") == "tcp", 12 * HOUR)
    return found.select("event_id", "src_ip", "opened_by")


#: Ranges from the suppliers' and parts' numbers: nested, overlapping and disjoint, in an order of their own.
RANGES = "CAST(CASE WHEN p_partkey % 97 = 0 THEN 1 ELSE 2 END * 1000000 + (p_partkey * 7919) % 1000003 AS BIGINT) AS ord", "concat('r', CAST(p_partkey % 50 AS STRING)) AS label", "CAST(167772160 + (p_partkey * 104729) % 90000 AS BIGINT) AS lo", "CAST(167772160 + (p_partkey * 104729) % 90000 + CASE WHEN p_partkey % 97 = 0 THEN 20000 ELSE p_partkey % 40 END AS BIGINT) AS hi"


@query("sup03_many_ranges", f"""{derived_sql('packets')}, g AS (SELECT {', '.join(RANGES)} FROM part), a AS (SELECT DISTINCT src_ip, CAST(split_part(src_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(src_ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(src_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(src_ip, '.', 4) AS BIGINT) AS n FROM packets),
    l AS (SELECT a.src_ip, arg_min(g.label, g.ord) AS label FROM a JOIN g ON a.n BETWEEN g.lo AND g.hi GROUP BY a.src_ip) SELECT p.event_id, l.label FROM packets p LEFT JOIN l USING (src_ip)""")
def many_ranges(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").selectExpr(*RANGES, "CAST(NULL AS STRING) AS lo6", "CAST(NULL AS STRING) AS hi6")
    return suppress.range_label(packets(spark, d), "src_ip", g).select("event_id", "label")


@query("cor01_filtered_blocks", """WITH b AS (SELECT user_id, ts AS created, ts + INTERVAL 2 DAY AS until FROM events WHERE event_type = 'error' AND value > 80) SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM b WHERE b.user_id = e.user_id AND e.ts >= b.created AND e.ts < b.until)""")
def filtered_blocks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    b = e.filter("event_type = 'error' AND value > 80").select(F.col("user_id").alias("ip_address"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 2 days")).alias("block_until"))
    return suppress.active_block(e, b, "user_id", filtered=True).select("event_id")


@query("ret01_partitions", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-11 12:00:00'")
def partitions(spark: SparkSession, d: str) -> DataFrame:
    """A copy of events by date, of which ten days before a noon stay."""
    path = folder(spark, "retention")
    table(spark, d, "events").withColumn("date", F.to_date("ts").cast("string")).write.partitionBy("date").parquet(path)
    report.retain_partitions(spark, path, "ts", datetime(2024, 1, 21, 12), 10)
    return spark.read.parquet(path).select("event_id")


@query("str07_standing_blocks", f"""{derived_sql('packets')}, s AS (SELECT event_id, src_ip, epoch_us(ts) AS t, CASE WHEN event_type = 'error' THEN CASE WHEN k % 10 = 0 THEN 0 ELSE CAST(k AS BIGINT) * 7200 END END AS ttl, ts FROM packets),
    l AS (SELECT *, last_value(CASE WHEN ttl IS NOT NULL THEN t + ttl * 1000000 END IGNORE NULLS) OVER (PARTITION BY src_ip ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until,
      last_value(ttl IGNORE NULLS) OVER (PARTITION BY src_ip ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM s)
    SELECT event_id, src_ip, CAST(until AS BIGINT) AS until FROM l WHERE ttl IS NULL AND held > 0 AND t < until""")
def standing_blocks(spark: SparkSession, d: str) -> DataFrame:
    return folds.fold_rows(block_rows(packets(spark, d)), "src_ip", "ts", "event_id", folds.standing_block()).select("event_id", "src_ip", "until")


def block_rows(p: DataFrame) -> DataFrame:
    """Packets of which the errors are block commands with a time to live, every tenth of them a lift."""
    return p.withColumn("ttl", F.when(F.col("event_type") == "error", F.when(F.col("k") % 10 == 0, 0).otherwise(F.col("k") * 7200)))


@query("str07_cached_intel", f"""{derived_sql('packets')}, s AS (SELECT event_id, src_ip, epoch_us(ts) AS t, ts, k, event_type = 'error' AS brings FROM packets), l AS (SELECT *,
      last_value(CASE WHEN brings AND k % 2 = 0 THEN {{'t': t, 's': k % 60, 'm': k > 97}} END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN brings AND k % 2 = 1 THEN {{'t': t, 's': k % 60, 'm': k > 97}} END IGNORE NULLS) OVER w AS b FROM s WINDOW w AS (PARTITION BY src_ip ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    f AS (SELECT event_id, src_ip, CASE WHEN t - a.t < 864000000000 THEN a END AS a, CASE WHEN t - b.t < 864000000000 THEN b END AS b FROM l WHERE NOT brings)
    SELECT event_id, src_ip, CAST(greatest(coalesce(a.s, 0), coalesce(b.s, 0)) AS INT) AS abuse_score, coalesce(a.m, false) OR coalesce(b.m, false) OR greatest(coalesce(a.s, 0), coalesce(b.s, 0)) >= 50 AS malicious FROM f WHERE a IS NOT NULL OR b IS NOT NULL""")
def cached_intel(spark: SparkSession, d: str) -> DataFrame:
    return folds.fold_rows(intel_rows(packets(spark, d)), "src_ip", "ts", "event_id", folds.cached_intel(10 * DAY)).select("event_id", "src_ip", "abuse_score", "malicious")


def intel_rows(p: DataFrame) -> DataFrame:
    """Packets of which the errors are two providers' words about the source."""
    brings = F.col("event_type") == "error"
    return p.withColumns({"provider": F.when(brings, F.when(F.col("k") % 2 == 0, "a").otherwise("b")), "abuse_score": F.when(brings, F.col("k") % 60).cast("int"), "malicious": F.when(brings, F.col("k") > 97)})



# Lengths and offsets of fragments that make all kinds of faults.
PARTS = ("event_id", "ts", "src_ip", "'d' AS dst_ip", "CAST(k % 2 AS INT) AS ip_id", "protocol", "CAST(CASE WHEN k % 4 = 0 THEN 0 ELSE (event_id % 90) * 8 END AS INT) AS frag_offset", "k % 3 <> 0 AS more_fragments", "CAST(CASE WHEN k % 5 = 0 THEN 0 WHEN k % 7 = 0 THEN 30 ELSE k * 300 END AS INT) AS payload_len", "raw_len", "CASE WHEN k % 6 = 0 THEN 'M' END AS flags")


@query("win13_fragment_faults", f"""{derived_sql('packets')}, p AS (SELECT {', '.join(PARTS)} FROM (SELECT * REPLACE (concat('10.0.0.', CAST(user_id % 9 AS STRING)) AS src_ip) FROM packets) x),
    f AS (SELECT *, CASE WHEN payload_len <> 0 THEN payload_len ELSE raw_len END AS len, more_fragments OR coalesce(flags LIKE '%M%', false) AS more, row_number() OVER (PARTITION BY src_ip, ip_id, protocol ORDER BY ts, event_id) - 1 AS i FROM p WHERE frag_offset <> 0 OR more_fragments OR coalesce(flags LIKE '%M%', false)),
    s AS (SELECT *, i // 65 AS st, i % 65 + 1 AS nth, row_number() OVER (PARTITION BY src_ip, ip_id, protocol, i // 65, frag_offset ORDER BY ts, event_id) > 1 AS again, first_value(frag_offset + len) OVER (PARTITION BY src_ip, ip_id, protocol, i // 65 ORDER BY ts, event_id) AS fe FROM f),
    w AS (SELECT *, max(again) OVER v AS rep, max(nth > 1 AND frag_offset < fe) OVER v AS ins, sum(len) OVER v AS total FROM s WINDOW v AS (PARTITION BY src_ip, ip_id, protocol, st ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT event_id, src_ip AS source_ip, 'fragment_storm' AS attack_type, 'high' AS severity, 'count' AS reason FROM w WHERE nth > 64 UNION ALL SELECT event_id, src_ip, 'fragment_overlap', 'high', 'repeated offset' FROM w WHERE rep UNION ALL SELECT event_id, src_ip, 'fragment_overlap', 'high', 'inside the first' FROM w WHERE ins
    UNION ALL SELECT event_id, src_ip, 'tiny_fragment', 'medium', 'length' FROM w WHERE len < 100 AND more UNION ALL SELECT event_id, src_ip, 'fragment_oversize', 'critical', 'total' FROM w WHERE total > 65535 AND protocol = 'tcp'""")
def fragment_faults(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d).withColumn("src_ip", F.concat(F.lit("10.0.0."), (F.col("user_id") % 9).cast("string"))).selectExpr(*PARTS)
    return windowed.fragment_faults(p).select("event_id", "source_ip", "attack_type", "severity", "reason")


def _covert_sql(of: str, kind: str, printable: int, where: str) -> str:
    return f"""SELECT event_id, src_ip AS source_ip, '{kind}' AS attack_type, 'high' AS severity FROM (SELECT *, list_filter(list_transform(range(1, len(seen)), lambda i: (seen[i + 1] - seen[i] + 256) % 256), lambda x: x BETWEEN 32 AND 126) AS p,
        CASE WHEN nn > 1000 THEN {{'n': rn, 's': rs, 'q': rq}} ELSE {{'n': nn, 's': ns, 'q': nq}} END AS x FROM (SELECT event_id, src_ip, b, list(b) OVER (o ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS seen, count(b) OVER r AS nn, coalesce(sum(b) OVER r, 0) AS ns, coalesce(sum(b * b) OVER r, 0) AS nq,
          count(b) OVER (o ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING) AS rn, coalesce(sum(b) OVER (o ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING), 0) AS rs, coalesce(sum(b * b) OVER (o ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING), 0) AS rq
          FROM (SELECT event_id, ts, src_ip, CAST({of} % 256 AS BIGINT) AS b FROM numbers WHERE {where}) y WINDOW o AS (PARTITION BY src_ip ORDER BY ts, event_id), r AS (PARTITION BY src_ip ORDER BY epoch_us(ts) RANGE BETWEEN 432000000000 PRECEDING AND 1 PRECEDING)) z) t
        WHERE len(seen) >= 10 AND len(p) >= {printable} AND len(list_distinct(p[-{printable}:])) <= {max(3.0, 0.7 * printable)} AND x.n >= 3 AND CASE WHEN x.n * x.q - x.s * x.s > 0 THEN abs(x.n * b - x.s) * sqrt(x.n - 1) > 3 * sqrt(x.n * (x.n * x.q - x.s * x.s)) ELSE abs(x.n * b - x.s) > 0 END"""


# Numbers that step by one of a few printable amounts, and jump now and then.
NUMBERS = ("event_id", "ts", "src_ip", "CASE WHEN k % 4 = 0 THEN 'PA' WHEN k % 4 = 1 THEN 'S' ELSE 'A' END AS flags", "CAST(CASE WHEN k % 23 = 0 THEN 250 WHEN k % 2 = 0 THEN 10 ELSE 70 END AS BIGINT) AS seq", "CAST(CASE WHEN k % 29 = 0 THEN 251 WHEN k % 3 = 0 THEN 5 ELSE 66 END AS BIGINT) AS ack")

HAS_ACK = "flags LIKE '%A%'"


@query("win24_covert_outliers", f"{derived_sql('packets')}, numbers AS (SELECT {', '.join(NUMBERS)} FROM packets) {_covert_sql('seq', 'seq_covert_channel', 8, 'true')} UNION ALL {_covert_sql('ack', 'ack_covert_channel', 9, HAS_ACK)}")
def covert_outliers(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d).selectExpr(*NUMBERS)
    seq = windowed.covert_numbers(p, "seq", "seq_covert_channel", 8, seconds=5 * DAY)
    ack = windowed.covert_numbers(p, "ack", "ack_covert_channel", 9, HAS_ACK, seconds=5 * DAY)
    return seq.unionByName(ack).select("event_id", "source_ip", "attack_type", "severity")


# Classes of a line by its number: some lines are of several.
CLASSES = "CASE k % 8 WHEN 0 THEN [0] WHEN 1 THEN [1] WHEN 2 THEN [0, 2] WHEN 3 THEN [0, 1, 3] WHEN 4 THEN [3] ELSE [] END"
_NAMES = ("sql", "xss", "cmd", "traversal")


def _crossing_sql() -> str:
    """A recursion whose state is a list of times for each class, null once the class is reported."""
    live = "l{c} IS NOT NULL AND list_contains(cl, {c})"
    times = "list_append(list_filter(l{c}, lambda x: o.t - x < 432000000000), o.t)"
    crosses = [f"(r.{live.format(c=c).replace('list_contains(cl', 'list_contains(o.cl')} AND len({times.format(c=c).replace('l' + str(c) + ',', 'r.l' + str(c) + ',')}) >= 3)" for c in range(4)]
    first = "CASE " + " ".join(f"WHEN {x} THEN {c}" for c, x in enumerate(crosses)) + " END"
    new = []
    for c in range(4):
        grown = times.format(c=c).replace(f"l{c},", f"r.l{c},")
        new.append(f"CASE WHEN r.l{c} IS NULL OR f = {c} THEN NULL WHEN list_contains(cl, {c}) AND (f IS NULL OR {c} < f) THEN {grown.replace('o.t', 't')} ELSE r.l{c} END AS l{c}".replace("r.l", "l"))
    return f"""r AS (SELECT src_ip, event_id, i, CAST(NULL AS INT) AS f, {', '.join(f'CASE WHEN list_contains(cl, {c}) THEN [t] ELSE CAST([] AS BIGINT[]) END AS l{c}' for c in range(4))} FROM o WHERE i = 1 UNION ALL
      SELECT src_ip, event_id, i, f, {', '.join(new)} FROM (SELECT o.src_ip, o.event_id, o.i, o.t, o.cl, r.l0, r.l1, r.l2, r.l3, {first} AS f FROM r JOIN o ON o.src_ip = r.src_ip AND o.i = r.i + 1) n)"""


@query("win30_first_crossing", f"""{derived_sql('packets')}, o AS (SELECT src_ip, event_id, epoch_us(ts) AS t, {CLASSES} AS cl, row_number() OVER (PARTITION BY src_ip ORDER BY ts, event_id) AS i FROM packets), {_crossing_sql()}
    SELECT event_id, src_ip AS source_ip, 'session_correlated_' || CASE f WHEN 0 THEN 'sql' WHEN 1 THEN 'xss' WHEN 2 THEN 'cmd' ELSE 'traversal' END || '_attack' AS attack_type FROM r WHERE f IS NOT NULL""")
def first_crossing(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d).selectExpr("event_id", "ts", "src_ip", CLASSES.replace("[]", "CAST(array() AS array<int>)").replace("[", "array(").replace("]", ")") + " AS classes")
    found = folds.fold_rows(p, "src_ip", "ts", "event_id", folds.first_crossing(_NAMES, 5 * DAY, 3))
    return found.select("event_id", F.col("src_ip").alias("source_ip"), F.concat(F.lit("session_correlated_"), "class", F.lit("_attack")).alias("attack_type"))


FLOWS = ("event_id", "ts", "concat(src_ip, '|', CAST(k % 2 AS STRING), '|', CAST(dst_port % 2 AS STRING)) AS flow", "concat(protocol, '.', flags, '.', CAST(raw_len // 400 AS STRING)) AS tok")


@query("win45_flow_perplexity", f"""{derived_sql('packets')}, f AS (SELECT {', '.join(FLOWS)} FROM packets), t AS (SELECT flow, lag(tok, 2) OVER w AS a, lag(tok) OVER w AS b, tok AS c FROM f WINDOW w AS (PARTITION BY flow ORDER BY ts, event_id)),
    g AS (SELECT * FROM t WHERE a IS NOT NULL AND b IS NOT NULL), n3 AS (SELECT a, b, c, count(*) AS n3 FROM g GROUP BY a, b, c), n2 AS (SELECT a, b, count(*) AS n2 FROM g GROUP BY a, b), v AS (SELECT count(*) AS v FROM g)
    SELECT flow, round(exp(-avg(ln((n3 + 0.01) / (n2 + 0.01 * v + 1)))), 4) AS perplexity, count(*) AS n, exp(-avg(ln((n3 + 0.01) / (n2 + 0.01 * v + 1)))) > 100 AS anomalous FROM g JOIN n3 USING (a, b, c) JOIN n2 USING (a, b), v GROUP BY flow""")
def flow_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """By flow; smoothing spreads over the contexts counted: of two laws that the survey leaves open, the one of the sensor's own model."""
    f = packets(spark, d).selectExpr(*[c.replace("raw_len // 400", "raw_len div 400") for c in FLOWS])
    return windowed.perplexity(f, "flow", ["ts", "event_id"], "tok", by_contexts=True).select("flow", F.round("perplexity", 4).alias("perplexity"), "n", "anomalous")


@query("win25_ttl_outliers", f"""{derived_sql('packets')}, t AS (SELECT event_id, ts, src_ip, CAST(CASE WHEN k % 31 = 0 THEN 250 ELSE 60 + k % 7 END AS BIGINT) AS b FROM packets)
    SELECT event_id, src_ip AS source_ip FROM (SELECT event_id, src_ip, b, len(list(b) OVER w) AS m, len(list_distinct(list(b) OVER w)) AS kinds, count(b) OVER r AS n, coalesce(sum(b) OVER r, 0) AS s, coalesce(sum(b * b) OVER r, 0) AS q FROM t
      WINDOW w AS (PARTITION BY src_ip ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), r AS (PARTITION BY src_ip ORDER BY epoch_us(ts) RANGE BETWEEN 864000000000 PRECEDING AND 1 PRECEDING)) x
    WHERE m >= 15 AND kinds >= 6 AND n >= 3 AND CASE WHEN n * q - s * s > 0 THEN abs(n * b - s) * sqrt(n - 1) > 3 * sqrt(n * (n * q - s * s)) ELSE abs(n * b - s) > 0 END""")
def ttl_outliers(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d).withColumn("ttl", F.when(F.col("k") % 31 == 0, 250).otherwise(60 + F.col("k") % 7))
    return windowed.covert_ttls(p, seconds=10 * DAY).select("event_id", "source_ip")
