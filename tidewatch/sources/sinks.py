"""Output formats of detections, and the alert outbox."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities as each format numbers them.
ECS = {"critical": 100, "high": 80, "medium": 50, "low": 20, "info": 10}
CEF = {"critical": 10, "high": 8, "medium": 5, "low": 3, "info": 1}
SYSLOG = {"critical": 0, "high": 1, "medium": 3, "low": 5, "info": 6}


def _level(severity: Column, table: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, n in table.items():
        out = F.when(severity == name, n).otherwise(out)
    return out


def ecs() -> Column:
    """Nested JSON of a detection."""
    return F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
            F.struct(F.lit("alert").alias("kind"), F.col("attack_type").alias("action"), _level(F.col("severity"), ECS, 50).alias("severity")).alias("event"),
            F.struct(F.col("source_ip").alias("ip")).alias("source"),
        )
    )


def _escape(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("="), F.lit("\\="))


def cef() -> Column:
    """A CEF line; fields stand only where there is a value."""
    head = F.concat_ws("|", F.lit("CEF:0"), F.lit("tidewatch"), F.lit("sensor"), F.lit("1"), "attack_type", "attack_type", _level(F.col("severity"), CEF, 5).cast("string"))
    return F.concat(head, F.lit("|"), F.concat_ws(" ", F.when(F.col("source_ip").isNotNull(), F.concat(F.lit("src="), _escape(F.col("source_ip")))), F.concat(F.lit("externalId="), F.col("event_id").cast("string"))))


def syslog_line() -> Column:
    """Priority, host, and a structured data block."""
    pri = F.lit(16 * 8) + _level(F.col("severity"), SYSLOG, 4)
    return F.format_string("<%d>1 %s sensor tidewatch - - [det type=\"%s\" src=\"%s\"] %s", pri, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "attack_type", "source_ip", "severity")


def stix() -> Column:
    """An indicator whose id follows from type and source, so that reruns agree."""
    ident = F.concat(F.lit("indicator--"), F.substring(F.sha2(F.concat_ws("|", "attack_type", "source_ip"), 256), 1, 32))
    return F.to_json(F.struct(F.lit("indicator").alias("type"), ident.alias("id"), F.col("attack_type").alias("name"), F.concat(F.lit("[ipv4-addr:value = '"), F.col("source_ip"), F.lit("']")).alias("pattern")))


def stix_bundle() -> Column:
    """A bundle of one indicator with the detection's techniques (column mitre) as references; ids are UUIDs that follow from type and source."""
    digest = F.sha2(F.concat_ws("|", "attack_type", "source_ip"), 256)
    uuid = lambda at: F.concat_ws("-", F.substring(digest, at, 8), F.substring(digest, at + 8, 4), F.concat(F.lit("4"), F.substring(digest, at + 13, 3)), F.concat(F.lit("8"), F.substring(digest, at + 17, 3)), F.substring(digest, at + 20, 12))
    refs = F.transform("mitre", lambda t: F.struct(F.lit("mitre-attack").alias("source_name"), F.concat(F.lit("https://attack.mitre.org/techniques/"), t).alias("url")))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    indicator = F.struct(
        F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("indicator--"), uuid(1)).alias("id"), at.alias("created"), at.alias("modified"), at.alias("valid_from"),
        F.concat(F.lit("[ipv4-addr:value = '"), "source_ip", F.lit("']")).alias("pattern"), F.lit("stix").alias("pattern_type"), F.array(F.lit("malicious-activity")).alias("indicator_types"), F.col("attack_type").alias("name"),
        F.when(F.size("mitre") > 0, refs).alias("external_references"),
    )
    return F.to_json(F.struct(F.lit("bundle").alias("type"), F.concat(F.lit("bundle--"), uuid(33)).alias("id"), F.array(indicator).alias("objects")))


#: Formats by name; add a function without arguments that returns a text column.
FORMATS: dict[str, Callable[[], Column]] = {"ecs": ecs, "cef": cef, "syslog": syslog_line, "stix": stix, "stix_bundle": stix_bundle}


def formatted(detections: DataFrame, *names: str) -> DataFrame:
    """event_id and one column for each format."""
    return detections.select("event_id", *[FORMATS[n]().alias(n) for n in names])


def write_lines(detections: DataFrame, name: str, path: str) -> None:
    detections.select(FORMATS[name]().alias("value")).write.mode("append").text(path)


def unsent(alerts: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Alerts that no delivery row names, oldest first: the outbox."""
    return alerts.join(deliveries.select("alert_id"), "alert_id", "left_anti").orderBy("created_at", "alert_id")


def deliver(batch: DataFrame, channels: dict[str, Callable[[DataFrame], None]], log: Callable[[str, str], None]) -> None:
    """Hand a micro-batch to every channel; one that fails is logged and doesn't stop the others."""
    for name, send in channels.items():
        try:
            send(batch)
        except Exception as error:  # noqa: BLE001
            log(name, str(error))
