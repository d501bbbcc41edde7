"""Queries of what follows from detections: explanations, protocols, action plans, incidents, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import explain, suppress
from ..sources import reference
from .registry import query, table
from .reports import A_SQL, attacks

DAY = 86_400


def _templates_sql() -> str:
    return reference.sql_values([(k, explain.template(k)) for k in explain.LEVELS], ("kind", "text"))


@query("par16_structured_explanations", f"""{A_SQL}, e AS (SELECT event_id, CASE WHEN attack_type = 'syn_flood' THEN 'reverse_shell' WHEN attack_type = 'crypto_miner' THEN 'data_exfiltration' ELSE attack_type END AS attack_type, source_ip AS dst_ip, CASE WHEN k % 3 = 0 THEN NULL ELSE k END AS port, CASE WHEN k % 2 = 0 THEN k END AS n, k AS threat_score FROM attacks)
    SELECT event_id, replace(replace(replace(replace(replace(replace(t.text, '{{extra}}', CASE WHEN threat_score > 0 THEN concat('Threat score: ', threat_score, '/100', chr(10)) ELSE '' END), '{{attack_type}}', attack_type), '{{dst_ip}}', dst_ip), '{{port}}', coalesce(CAST(port AS STRING), 'unknown')), '{{filename}}', 'unknown'), '{{count}}', coalesce(CAST(n AS STRING), 'multiple')) AS explanation
    FROM e JOIN {_templates_sql()} t ON t.kind = CASE WHEN e.attack_type IN ('reverse_shell', 'data_exfiltration', 'port_scan', 'sql_injection', 'ssh_bruteforce') THEN e.attack_type ELSE 'unknown' END""")
def structured_explanations(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("attack_type") == "syn_flood", "reverse_shell").when(F.col("attack_type") == "crypto_miner", "data_exfiltration").otherwise(F.col("attack_type"))
    rows = attacks(spark, d).select("event_id", kind.alias("attack_type"), F.col("source_ip").alias("dst_ip"), F.when(F.col("k") % 3 != 0, F.col("k")).alias("port"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("count"), F.col("k").alias("threat_score"))
    return explain.explained(rows).select("event_id", "explanation")


@query("par14_type_protocols", f"{A_SQL} SELECT protocol, n, round(100.0 * n / sum(n) OVER (), 4) AS share FROM (SELECT coalesce(m.protocol, 'OTHER') AS protocol, count(*) AS n FROM attacks a LEFT JOIN {reference.sql_values(list(reference.TYPE_PROTOCOLS.items()), ('attack_type', 'protocol'))} m USING (attack_type) GROUP BY 1) t")
def type_protocols(spark: SparkSession, d: str) -> DataFrame:
    known = F.broadcast(spark.createDataFrame(list(reference.TYPE_PROTOCOLS.items()), "attack_type string, protocol string"))
    per = attacks(spark, d).join(known, "attack_type", "left").groupBy(F.coalesce("protocol", F.lit("OTHER")).alias("protocol")).agg(F.count(F.lit(1)).alias("n"))
    # one row a protocol
    total = per.agg(F.sum("n").alias("total"))
    return per.join(F.broadcast(total)).select("protocol", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("share"))


_LABEL = "CASE WHEN k % 6 = 0 THEN 'google' WHEN k % 6 = 1 THEN 'private' END"


@query("ver02_action_plan", f"""{A_SQL}, w AS (SELECT DISTINCT concat('10.0.0.', CAST(c_custkey AS STRING)) AS ip FROM customer WHERE c_custkey % 40 = 0), s AS (SELECT DISTINCT concat('10.0.1.', CAST(s_suppkey AS STRING)) AS ip FROM supplier),
    p AS (SELECT *, {_LABEL} AS label, severity IN ('high', 'critical') AND k % 4 <> 3 AS grave FROM attacks), q AS (SELECT p.*, s.ip AS spared FROM p LEFT JOIN s ON s.ip = p.source_ip WHERE severity <> 'info' AND source_ip NOT IN (SELECT ip FROM w) AND NOT coalesce(label = 'google' AND attack_type = 'port_scan', false)),
    o AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY source_ip, attack_type, grave ORDER BY ts, event_id) AS i FROM q),
    r AS (SELECT source_ip, attack_type, grave, event_id, i, t AS last, true AS passed, severity, spared FROM o WHERE i = 1 UNION ALL
      SELECT o.source_ip, o.attack_type, o.grave, o.event_id, o.i, CASE WHEN o.t - r.last >= 432000000000 THEN o.t ELSE r.last END, o.t - r.last >= 432000000000, o.severity, o.spared FROM r JOIN o ON o.source_ip = r.source_ip AND o.attack_type = r.attack_type AND o.grave = r.grave AND o.i = r.i + 1)
    SELECT event_id, true AS records, grave AND passed AS alerts, grave AND spared IS NULL AS blocks FROM r""")
def action_plan(spark: SparkSession, d: str) -> DataFrame:
    a = attacks(spark, d).withColumn("verdict", F.when(F.col("k") % 4 != 3, "drop").otherwise("pass")).withColumn("label", F.expr(_LABEL))
    white = table(spark, d, "customer").filter("c_custkey % 40 = 0").select(F.concat(F.lit("10.0.0."), F.col("c_custkey").cast("string")).alias("ip"))
    spared = table(spark, d, "supplier").select(F.concat(F.lit("10.0.1."), F.col("s_suppkey").cast("string")).alias("ip"))
    return suppress.action_plan(a, white, spared, 5 * DAY).select("event_id", "records", "alerts", "blocks")


@query("ver02_host_plan", f"""{A_SQL}, k AS (SELECT source_ip AS ip, max(k) > 95 AS malicious, CAST(avg(k) AS INT) + 20 AS score FROM attacks GROUP BY source_ip)
    SELECT a.event_id, severity IN ('high', 'critical') AS alerts, severity = 'critical' AND (k.malicious OR k.score >= 70) AS blocks FROM attacks a JOIN k ON k.ip = a.source_ip WHERE severity <> 'info' AND NOT coalesce({_LABEL.replace('k %', 'a.k %')} = 'google' AND attack_type = 'port_scan', false)""")
def host_plan(spark: SparkSession, d: str) -> DataFrame:
    a = attacks(spark, d).withColumn("label", F.expr(_LABEL))
    known = a.groupBy(F.col("source_ip").alias("ip")).agg((F.max("k") > 95).alias("malicious"), (F.round(F.avg("k")).cast("int") + 20).alias("score"))
    return suppress.host_action_plan(a, known).select("event_id", "alerts", "blocks")


@query("ver03_incident_plan", f"""{A_SQL}, o AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY source_ip, attack_type ORDER BY ts, event_id) AS i FROM attacks),
    r AS (SELECT source_ip, attack_type, event_id, i, t AS last, true AS passed, severity, k FROM o WHERE i = 1 UNION ALL
      SELECT o.source_ip, o.attack_type, o.event_id, o.i, CASE WHEN o.t - r.last >= 432000000000 THEN o.t ELSE r.last END, o.t - r.last >= 432000000000, o.severity, o.k FROM r JOIN o ON o.source_ip = r.source_ip AND o.attack_type = r.attack_type AND o.i = r.i + 1)
    SELECT event_id, CASE severity WHEN 'critical' THEN 'isolate' WHEN 'high' THEN 'full_response' ELSE 'log_only' END AS playbook, CAST(s AS BIGINT) AS sla_seconds, k * 20 > s AS breached FROM (SELECT *, CASE severity WHEN 'critical' THEN 300 WHEN 'high' THEN 600 WHEN 'medium' THEN 1800 ELSE 3600 END AS s FROM r WHERE passed) x""")
def incident_plan(spark: SparkSession, d: str) -> DataFrame:
    return suppress.incident_plan(attacks(spark, d), F.col("k") * 20, 5 * DAY, {"critical": "isolate"}).select("event_id", "playbook", "sla_seconds", "breached")
