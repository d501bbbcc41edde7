"""Sources: text logs, packet and host event tables, deception hits; batch and streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import parse

PACKET_SCHEMA = "event_id long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, flags string, tcp_seq long, tcp_ack long, ttl int, win int, frag_offset int, more_fragments boolean, ip_id int, raw_len int, payload_len int, payload binary, src_mac string"
HOST_SCHEMA = "timestamp timestamp, event_type string, pid int, uid int, username string, comm string, filename string, args string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, raw_data map<string,string>"
# Host event codes.
HOST_CODES = {1: "exec", 2: "connect", 3: "open", 4: "kill", 5: "write", 6: "network"}


def host_kind(code: Column) -> Column:
    """The event type of a code; null for an unknown one."""
    return F.get(F.array(F.lit(None).cast("string"), *[F.lit(HOST_CODES[i]) for i in sorted(HOST_CODES)]), code.cast("int"))


def log_files(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """source, line of text files; bytes that aren't UTF-8 come as replacement characters."""
    reader = spark.readStream if streaming else spark.read
    return reader.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line"))


def log_records(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """source, line, and what ``parse.log_attacks`` reads in each line of the files; a stream takes in new files only."""
    return parse.log_attacks(log_files(spark, path, streaming))


def syslog_records(rows: DataFrame, raw: str = "raw", source_ip: Column | None = None) -> DataFrame:
    """Raw syslog rows, a table or a stream, with their fields, attack_type and severity (both null for none).

    A row in neither format is dropped. ``source_ip`` names the sender where the rows have no such column.
    """
    rows = rows.withColumn("source_ip", source_ip) if source_ip is not None else rows
    read = parse.syslog(rows, raw).withColumn("attack_type", parse.syslog_attack(F.col("message"), F.col("level")))
    return read.withColumn("severity", F.when(F.col("attack_type").isNotNull(), parse.syslog_severity(F.col("attack_type"))))


def syslog_files(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Syslog spooled as text files in a folder for each sender (source_ip=ADDRESS): source_ip, raw and the fields of ``syslog_records``."""
    reader = spark.readStream if streaming else spark.read
    # the sender's folder is read from the file's path, so that an address stays text
    lines = reader.option("recursiveFileLookup", "true").text(path).select(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "source_ip=([^/]+)/", 1)).alias("source_ip"), F.col("value").alias("raw"))
    return syslog_records(lines)


def syslog_topic(spark: SparkSession, servers: str, topic: str, streaming: bool = True) -> DataFrame:
    """Syslog from a Kafka topic whose keys are the senders' addresses; needs Spark's Kafka package."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return syslog_records(reader.load().select(F.col("key").cast("string").alias("source_ip"), F.col("value").cast("string").alias("raw")))


def ingest(stream: DataFrame, path: str, checkpoint: str, batch: Callable[[DataFrame, int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Start taking a stream into parquet files at ``path``, or into ``batch``. Restarted with its checkpoint it goes on where it stopped.

    The checkpoint names the files taken in and the file sink the batches written, so each line comes once, restarts and
    retries or not. ``once`` stops when all that is there is taken in.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", path).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def packets(spark: SparkSession, path: str, form: str = "parquet", streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(PACKET_SCHEMA).format(form).load(path)


def host_events(spark: SparkSession, path: str, form: str = "parquet", streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(HOST_SCHEMA).format(form).load(path)


def deception_hits(lines: DataFrame, line: str = "line") -> DataFrame:
    """One critical detection for each address in ``[HIT] ... from IP`` lines: its first event."""
    ip = F.regexp_extract(line, r"\[HIT\].* from ([\d.]+)", 1)
    hits = lines.withColumn("source_ip", ip).filter("source_ip <> ''")
    return hits.groupBy("source_ip").agg(F.min("event_id").alias("event_id")).withColumn("attack_type", F.lit("honeypot_connection")).withColumn("severity", F.lit("critical"))


def above_mark(rows: DataFrame, mark: int, ident: str = "id") -> DataFrame:
    """Rows beyond the saved high-water mark."""
    return rows.filter(F.col(ident) > mark)
