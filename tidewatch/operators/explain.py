"""Explanations of detections: structured templates, joined by type and filled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Types that have a template, with risk and confidence; the last stands for all others.
LEVELS = {
    "reverse_shell": ("CRITICAL", 90),
    "download_execute": ("HIGH", 75),
    "webshell": ("CRITICAL", 85),
    "ssh_bruteforce": ("HIGH", 95),
    "sql_injection": ("CRITICAL", 90),
    "credential_theft": ("HIGH", 80),
    "suspicious_connection": ("HIGH", 70),
    "high_port_connection": ("MEDIUM", 50),
    "port_scan": ("MEDIUM", 75),
    "ssh_key_added": ("HIGH", 85),
    "cron_persistence": ("HIGH", 80),
    "process_termination": ("MEDIUM", 40),
    "data_exfiltration": ("CRITICAL", 70),
    "unknown": ("MEDIUM", 50),
}

#: What happened, what it means, and what to do first, in this library's own words.
TEXTS = {
    "reverse_shell": ("{dst_ip}:{port} holds a shell on this host", "whoever is at the other end runs commands here", ("cut the connection and block the address", "take the host off the network", "keep memory and disk as they are")),
    "download_execute": ("{filename} was fetched and run", "code from outside runs with this user's rights", ("find what was fetched", "look for new files and processes", "follow its connections")),
    "webshell": ("{filename} appeared in a web folder", "it answers commands sent as web requests", ("remove the file", "look for others like it", "read the web server's log since then")),
    "ssh_bruteforce": ("{count} failed ssh logins from {dst_ip}", "passwords are being guessed", ("block the address unless it is known", "check logins that succeeded since", "allow keys only")),
    "sql_injection": ("{filename} was asked with SQL in it", "a database may answer or change by a stranger's words", ("read this address's requests", "see whether any was answered", "bind parameters instead of joining text")),
    "credential_theft": ("{filename} was opened", "it holds what opens other doors", ("see who opened it and why", "change what it holds")),
    "suspicious_connection": ("a connection to {dst_ip}:{port}, a port of {malware}", "such ports are used to steer hosts from outside", ("cut the connection", "look the address up", "look for others to it")),
    "high_port_connection": ("a connection to {dst_ip}:{port}", "ports that nothing listens on by custom pass simple filters", ("ask whether it is meant", "see how regular it is")),
    "port_scan": ("{dst_ip} tried many ports", "it learns what this host offers", ("block the address", "see which ports answered")),
    "ssh_key_added": ("{username} has a new ssh key", "a key opens the door again without a password", ("ask the user", "remove keys nobody knows")),
    "cron_persistence": ("{filename} runs on a schedule now", "it comes back after each restart", ("see what it runs", "remove it if nobody knows it")),
    "process_termination": ("process {pid} was ended", "it may have watched over this host", ("see what it was", "start it again")),
    "data_exfiltration": ("much data went to {dst_ip}:{port}", "it may be gone for good", ("block the destination", "find what went", "keep the evidence")),
    "unknown": ("{attack_type} from {dst_ip}", "nothing more is known of it", ("look at the event", "look for others near it")),
}
FIELDS = ("attack_type", "dst_ip", "port", "filename", "username", "count", "pid", "malware")


def template(kind: str) -> str:
    """The text of a type with its marks unfilled."""
    (risk, confidence), (what, why, actions) = LEVELS[kind], TEXTS[kind]
    return "\n".join([f"What: {what}", f"Why: {why}", f"Risk: {risk}", "{extra}Do:", *[f"- {a}" for a in actions], f"Confidence: {confidence}%"])


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(kind, template(kind)) for kind in LEVELS], "_kind string, _text string")


def explained(detections: DataFrame) -> DataFrame:
    """``detections`` with ``explanation``: the type's template, or that of unknown ones, with the row's FIELDS filled in.

    Columns that are missing or null read unknown, a missing count reads multiple. ``mitre`` (techniques) and ``threat_score`` (over 0), where the
    rows have them, add a line each.
    """
    has = set(detections.columns)
    kind = F.when(F.col("attack_type").isin(*[k for k in LEVELS if k != "unknown"]), F.col("attack_type")).otherwise("unknown")
    text = F.col("_text")
    parts = []
    if "mitre" in has:
        parts.append(F.when(F.size("mitre") > 0, F.concat(F.lit("MITRE: "), F.array_join("mitre", ", "), F.lit("\n"))))
    if "threat_score" in has:
        parts.append(F.when(F.col("threat_score") > 0, F.concat(F.lit("Threat score: "), F.col("threat_score").cast("string"), F.lit("/100\n"))))
    extra = F.concat(*[F.coalesce(p, F.lit("")) for p in parts]) if parts else F.lit("")
    text = F.replace(text, F.lit("{extra}"), extra)
    for name in FIELDS:
        missing = F.lit("multiple" if name == "count" else "unknown")
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.col(name).cast("string"), missing) if name in has else missing)
    # fourteen rows
    return detections.withColumn("_kind", kind).join(F.broadcast(templates(detections.sparkSession)), "_kind").withColumn("explanation", text).drop("_kind", "_text")
