"""Queries that run as streams: the driver's tables are taken in by readStream, and what the sinks hold at the end is the result."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, report, rules
from ..sources import readers
from ..sources.derive import BASE, K_SPARK, TABLES, derive, derived_sql
from ..sources.scratch import folder
from ..streaming import reload, snapshots, stateful
from ..streaming.ordered import STORE, ordered, valid_at
from .folding import block_rows, intel_rows
from .registry import ORACLES, query, table

DAY = 86_400


def _unmarked(spark: SparkSession, d: str, name: str = "events") -> DataFrame:
    # a pattern, as a stream takes no path of a single file
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def stream(spark: SparkSession, d: str, name: str = "events") -> DataFrame:
    """A table as a stream. Its end is known, so the watermark, on ``_end``, may pass its last row: nothing is left waiting."""
    return _unmarked(spark, d, name).withColumn("_end", F.col("ts").cast("timestamp") + F.expr("interval 30 days")).withWatermark("_end", "0 seconds")


def packet_stream(spark: SparkSession, d: str) -> DataFrame:
    """Derived packets as a stream, with the column that has the watermark."""
    return stream(spark, d).selectExpr(*BASE, K_SPARK, "_end").selectExpr(*TABLES["packets"], "_end")


@contextmanager
def _store(spark: SparkSession):
    """The state store that keyed state needs, for as long as a stream runs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def taken(spark: SparkSession, rows: DataFrame, batch: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> DataFrame | None:
    """Run a stream to its end; the rows that its file sink then holds, if ``batch`` doesn't take them."""
    out, checkpoint = folder(spark, "stream"), folder(spark, "checkpoint")
    with _store(spark):
        if mode == "append":
            q = readers.ingest(rows, out, checkpoint, batch)
        else:
            write = lambda b, _: b.write.mode("overwrite").parquet(out)
            q = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()
    return None if batch else spark.read.schema(rows.schema).parquet(out)


@query("str02_tumbling_stream", ORACLES["str02_tumbling"])
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    rows = stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    w = taken(spark, stateful.tumbling(rows, "user_id", "1 day"), mode="complete")
    return w.select("user_id", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


@query("str03_sliding_stream", """SELECT user_id, strftime(CAST(date_trunc('day', ts) AS TIMESTAMP) - to_days(CAST(back AS INT)), '%Y-%m-%d') AS start, count(*) AS n FROM events, (SELECT unnest([0, 1, 2]) AS back) b GROUP BY ALL""")
def sliding(spark: SparkSession, d: str) -> DataFrame:
    rows = stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    w = taken(spark, stateful.tumbling(rows, "user_id", "3 days", slide="1 day"), mode="complete")
    return w.select("user_id", F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


@query("str04_sessions_stream", ORACLES["str04_sessions"])
def sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    w = taken(spark, stateful.sessions(rows, "user_id", "12 hours"), mode="complete")
    return w.select("user_id", (F.row_number().over(report.Window.partitionBy("user_id").orderBy("start")) - 1).cast("long").alias("i"), "n")


@query("str05_cooldown_stream", """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT user_id, event_id, i, t AS last, true AS passed FROM o WHERE i = 1 UNION ALL
      SELECT o.user_id, o.event_id, o.i, CASE WHEN o.t - r.last >= 432000000000 THEN o.t ELSE r.last END, o.t - r.last >= 432000000000 FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
    SELECT user_id, event_id FROM r WHERE passed""")
def cooldown(spark: SparkSession, d: str) -> DataFrame:
    return taken(spark, ordered(stream(spark, d), "user_id", "ts", "event_id", folds.gate(5 * DAY), "_end")).select("user_id", "event_id")


@query("str06_counter_stream", """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT user_id, event_id, i, [t] AS kept, false AS hit FROM o WHERE i = 1 UNION ALL
      SELECT user_id, event_id, i, CASE WHEN len(k) >= 4 THEN [] ELSE k END, len(k) >= 4 FROM (
        SELECT o.user_id, o.event_id, o.i, list_append(list_filter(r.kept, lambda x: x >= o.t - 432000000000), o.t) AS k FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) a)
    SELECT user_id, event_id FROM r WHERE hit""")
def counter(spark: SparkSession, d: str) -> DataFrame:
    return taken(spark, ordered(stream(spark, d), "user_id", "ts", "event_id", folds.counter(5 * DAY, 4), "_end")).select("user_id", "event_id")


@query("str07_blocks_stream", ORACLES["str07_standing_blocks"])
def blocks(spark: SparkSession, d: str) -> DataFrame:
    return taken(spark, ordered(block_rows(packet_stream(spark, d)), "src_ip", "ts", "event_id", folds.standing_block(), "_end")).select("event_id", "src_ip", "until")


@query("str07_intel_stream", ORACLES["str07_cached_intel"])
def intel(spark: SparkSession, d: str) -> DataFrame:
    return taken(spark, ordered(intel_rows(packet_stream(spark, d)), "src_ip", "ts", "event_id", folds.cached_intel(10 * DAY), "_end")).select("event_id", "src_ip", "abuse_score", "malicious")


@query("str07_validity_stream", """WITH b AS (SELECT user_id, ts AS f, ts + INTERVAL 2 DAY AS u, event_id AS block_id FROM events WHERE event_type = 'error' AND value > 40) SELECT e.event_id, b.block_id FROM events e JOIN b ON b.user_id = e.user_id AND e.ts >= b.f AND e.ts < b.u""")
def validity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'error' AND value > 40")
    b = e.select("user_id", F.col("event_id").alias("block_id"), F.col("ts").alias("valid_from"), (F.col("ts") + F.expr("interval 2 days")).alias("valid_to"))
    return taken(spark, valid_at(stream(spark, d), b, "user_id", "ts").select("event_id", "block_id"))


@query("str08_follows_stream", """SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 DAY WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def follows(spark: SparkSession, d: str) -> DataFrame:
    rows = stateful.event_time(_unmarked(spark, d), delay="1 day")
    return taken(spark, stateful.follows(rows.filter("event_type = 'view'"), rows.filter("event_type = 'click'"), "user_id", DAY)).select("a_id", "b_id")


@query("str09_rules_stream", ORACLES["rul05_multi_rule"])
def reloaded_rules(spark: SparkSession, d: str) -> DataFrame:
    """Packets of a stream against the rules of a folder that is looked at before every micro-batch."""
    edited, out = Path(tempfile.mkdtemp(prefix="spark-")), folder(spark, "matches")
    (edited / "rules.json").write_text(json.dumps({"rules": rules.RULES}))
    taken(spark, packet_stream(spark, d), reload.matching(str(edited), lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")))
    return spark.read.parquet(out).select("event_id", "rule_id", "severity")


@query("str10_upsert_stream", f"{derived_sql('packets')} SELECT src_ip AS ip_address, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS attack_count FROM packets WHERE event_type = 'error' GROUP BY src_ip")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    """Attackers kept by a stream: each micro-batch is merged into the snapshot before it."""
    kept = snapshots.Snapshot(spark, folder(spark, "attackers"))
    attacks = packet_stream(spark, d).filter("event_type = 'error'").select(F.col("src_ip").alias("source_ip"), "ts", F.lit(None).cast("string").alias("country"))
    taken(spark, attacks, snapshots.upserting(kept, report.attackers))
    return kept.read().drop("country")


@query("src02_log_stream", f"{ORACLES['par01_log_classifier'].replace('event_id, ', '')}")
def log_stream(spark: SparkSession, d: str) -> DataFrame:
    """Log lines spooled as text files, taken in as a stream with their fields."""
    spool = folder(spark, "spool")
    derive(table(spark, d, "events"), "log_lines").select("line").write.text(spool)
    return taken(spark, readers.log_records(spark, spool, streaming=True)).select("log_type", "log_ip", "log_user")


@query("src04_syslog_stream", f"""{derived_sql('syslog_lines')} SELECT s.source_ip, p.hostname, p.facility, p.level, a.attack_type FROM syslog_lines s JOIN ({ORACLES['par04_syslog']}) p USING (event_id) LEFT JOIN ({ORACLES['par05_syslog_attacks']}) a USING (event_id)""")
def syslog_stream(spark: SparkSession, d: str) -> DataFrame:
    """Raw syslog spooled as text, a folder for each sender, taken in as a stream with fields and attack types."""
    spool = folder(spark, "spool")
    derive(table(spark, d, "events"), "syslog_lines").select("source_ip", "raw").write.partitionBy("source_ip").text(spool)
    return taken(spark, readers.syslog_files(spark, spool, streaming=True)).select("source_ip", "hostname", "facility", "level", "attack_type")
