"""User-written rules compiled to column predicates, and look-ups of what a type means."""

from __future__ import annotations

import json
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import reference


def field(path: str) -> Column:
    """A column by dotted path, through structs and maps; a number indexes a list."""
    first, *rest = path.split(".")
    return reduce(lambda c, p: c.getItem(int(p) if p.isdigit() else p), rest, F.col(first))


def compile_condition(condition: dict, columns: list[str] | None = None) -> Column:
    """The predicate of a pattern, field or composite condition; what can't be read matches nothing.

    With ``columns`` given, a field outside them matches nothing either.
    """
    kind = condition.get("type")
    named = condition.get("field", "raw_line")
    if kind in ("pattern", "field") and columns is not None and named.split(".")[0] not in columns:
        return F.lit(False)
    if kind == "pattern":
        try:
            re.compile(condition["pattern"])
        except re.error:
            return F.lit(False)
        return F.coalesce(field(named).cast("string").rlike("(?i)" + condition["pattern"]), F.lit(False))
    if kind == "field":
        c, v = field(named), condition.get("value")
        text = c.cast("string")
        tests = {
            "equals": lambda: text == str(v), "contains": lambda: text.contains(str(v)), "startswith": lambda: text.startswith(str(v)), "endswith": lambda: text.endswith(str(v)),
            "gt": lambda: c.cast("double") > float(v), "lt": lambda: c.cast("double") < float(v), "in": lambda: text.isin(*[x.strip() for x in str(v).split(",")]),
        }
        return F.coalesce(tests[condition["operator"]](), F.lit(False)) if condition.get("operator") in tests else F.lit(False)
    if kind == "composite":
        parts = [compile_condition(c, columns) for c in condition.get("conditions", [])]
        if not parts:
            return F.lit(False)
        return reduce((lambda a, b: a & b) if condition.get("logic", "and") == "and" else (lambda a, b: a | b), parts)
    return F.lit(False)


def load_rules(folder: str) -> list[dict]:
    """Rules of every JSON file in the folder, and of every YAML file where a parser is installed, by name.

    Disabled ones are left out, later ones replace earlier ones of one id. Reading a folder again takes in what has changed.
    """
    rules: dict[str, dict] = {}
    for path in sorted([*Path(folder).glob("*.json"), *Path(folder).glob("*.yaml")]):
        if path.suffix == ".yaml":
            import yaml

            read = yaml.safe_load(path.read_text()) or {}
        else:
            read = json.loads(path.read_text())
        for rule in read.get("rules", []):
            if rule.get("enabled", True) and rule.get("id"):
                rules[rule["id"]] = rule
    return list(rules.values())


def match_rules(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Every row with every rule that matches it: rule_id, rule_name, severity, category, mitre, actions. One scan."""

    def hit(r: dict) -> Column:
        texts = [F.lit(r.get(k, default)).alias(n) for k, n, default in (("id", "rule_id", ""), ("name", "rule_name", ""), ("severity", "severity", "medium"), ("category", "category", "unknown"))]
        lists = [F.array(*map(F.lit, r.get(k, default))).cast("array<string>").alias(k) for k, default in (("mitre", []), ("actions", ["alert"]))]
        return F.when(compile_condition(r["condition"], df.columns), F.struct(*texts, *lists))

    return df.withColumn("h", F.explode(F.filter(F.array(*[hit(r) for r in rules]), lambda h: h.isNotNull()))).select("*", "h.*").drop("h")


#: Example rules over the packets' columns.
RULES = [
    {"id": "net-smb", "name": "SMB Enumeration", "severity": "medium", "category": "reconnaissance", "condition": {"type": "pattern", "field": "dst_port", "pattern": "(445|139)"}},
    {"id": "net-telnet", "name": "Telnet Usage", "severity": "medium", "category": "insecure_protocol", "condition": {"type": "field", "field": "dst_port", "operator": "equals", "value": 23}},
    {"id": "net-dns", "name": "DNS Tunneling Indicator", "severity": "high", "category": "exfiltration", "condition": {"type": "composite", "logic": "and", "conditions": [{"type": "field", "field": "dst_port", "operator": "equals", "value": 53}, {"type": "field", "field": "dns_txt_len", "operator": "gt", "value": 600}]}},
    {"id": "web-xss", "name": "XSS Attempt", "severity": "high", "category": "injection", "condition": {"type": "pattern", "field": "http_uri", "pattern": "(<script|javascript:|onerror|onload|<iframe|<svg)"}},
    {"id": "web-scan", "name": "Scanner", "severity": "low", "category": "reconnaissance", "condition": {"type": "composite", "logic": "or", "conditions": [{"type": "field", "field": "user_agent", "operator": "startswith", "value": "sqlmap"}, {"type": "field", "field": "user_agent", "operator": "contains", "value": "Nikto"}]}},
]


def _pattern(where: str, pattern: str) -> dict:
    return {"type": "pattern", "field": where, "pattern": pattern}


def _test(where: str, operator: str, value) -> dict:
    return {"type": "field", "field": where, "operator": operator, "value": value}


def _all(*conditions: dict) -> dict:
    return {"type": "composite", "logic": "and", "conditions": list(conditions)}


def _rule(ident: str, name: str, severity: str, category: str, condition: dict, mitre: list[str], *actions: str) -> dict:
    return {"id": ident, "name": name, "severity": severity, "category": category, "condition": condition, "mitre": mitre, "actions": list(actions or ("alert",))}


# The rules that are there without any file.
SHIPPED = [
    _rule("web-sql-001", "SQL Injection Detected", "critical", "injection", _pattern("path", r"(union\s+select|select\s+.*\s+from|insert\s+into|update\s+.*\s+set|delete\s+from|drop\s+table|;\s*--|'\s*or\s*'|1\s*=\s*1)"), ["T1190", "T1059"], "alert", "block_ip"),
    _rule("web-xss-001", "XSS Attempt Detected", "high", "injection", _pattern("path", r"(<script|javascript:|on\w+\s*=|onerror|onload|<iframe|<svg)"), ["T1189"]),
    _rule("web-path-traversal-001", "Path Traversal Attempt", "high", "file_access", _pattern("path", r"(\.\./|\.\.\\|%2e%2e%2f|%2e%2e/|\.\.%2f|%2e%2e%5c)"), ["T1190"]),
    _rule("web-lfi-001", "Local File Inclusion", "critical", "file_access", _pattern("path", r"(etc/passwd|etc/shadow|proc/self|\.\./\.\./)"), ["T1190", "T1005"], "alert", "block_ip"),
    _rule("web-rfi-001", "Remote File Inclusion", "critical", "file_access", _pattern("path", r"(php://|file://|http://|https://|data://)"), ["T1190"]),
    _rule("web-cmd-001", "Command Injection Attempt", "critical", "injection", _pattern("path", r"(;\s*\w+|&&\s*\w+|\|\s*\w+|`[^`]+`|\$\([^)]+\))"), ["T1059", "T1190"], "alert", "block_ip"),
    _rule("web-ssrf-001", "SSRF Attempt", "high", "injection", _pattern("path", r"(127\.0\.0\.1|localhost|169\.254\.169\.254|metadata\.google)"), ["T1190"]),
    _rule("web-admin-001", "Admin Panel Probe", "low", "reconnaissance", _pattern("path", r"(/admin|/wp-admin|/phpmyadmin|/manager|/console|/solr|/actuator|/.env|/config\.php|/wp-config)"), ["T1086"]),
    _rule("web-scanner-001", "Security Scanner Detected", "low", "reconnaissance", _pattern("user_agent", r"(nikto|nmap|sqlmap|dirbuster|gobuster|wpscan|nuclei|masscan|zgrab|acunetix|burp)"), ["T1595"]),
    _rule("web-xxe-001", "XXE Attempt", "critical", "injection", _pattern("path", r"(<!DOCTYPE|<!ENTITY|ENTITY|SYSTEM|PUBLIC)"), ["T1190"]),
    _rule("web-deser-001", "Deserialization Attack", "critical", "injection", _pattern("path", r"(base64_decode|eval\(|unserialize|ObjectInputStream|__construct)"), ["T1059"]),
    _rule("net-portscan-001", "Port Scan Detected", "medium", "reconnaissance", _all(_test("event_type", "equals", "connect"), _test("connection_count", "gt", 10)), ["T1595", "T1082"], "alert", "block_ip"),
    _rule("net-synflood-001", "SYN Flood Detection", "high", "dos", _test("syn_count", "gt", 100), ["T1498"]),
    _rule("net-smb-001", "SMB Enumeration", "medium", "reconnaissance", _pattern("dst_port", "(445|139)"), ["T1021", "T1040"]),
    _rule("net-ldap-enum-001", "LDAP Enumeration", "medium", "reconnaissance", _pattern("dst_port", "389"), ["T1087", "T1082"]),
    _rule("net-dns-tunnel-001", "DNS Tunneling Indicator", "high", "exfiltration", _all(_test("dst_port", "equals", 53), _test("dns_query_length", "gt", 200)), ["T1573", "T1041"]),
    _rule("net-ftp-anon-001", "FTP Anonymous Login", "low", "misconfiguration", _test("username", "equals", "anonymous"), ["T1078"]),
    _rule("net-telnet-001", "Telnet Usage", "medium", "insecure_protocol", _test("dst_port", "equals", 23), ["T1072"]),
    _rule("net-ftp-brute-001", "FTP Brute Force", "high", "credential_attack", _test("failed_attempts", "gt", 5), ["T1110"], "alert", "block_ip"),
]


def severity_of(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The catalogue's severity and category of attack_type; medium and unknown where it has none."""
    known = F.broadcast(reference.attack_types(spark).withColumnRenamed("severity", "_s").withColumnRenamed("category", "_c"))
    return df.join(known, "attack_type", "left").withColumn("severity", F.coalesce("_s", F.lit("medium"))).withColumn("category", F.coalesce("_c", F.lit("unknown"))).drop("_s", "_c")


def with_techniques(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``mitre``: the type's techniques in their order; ``tactics``: their tactics, where known."""
    t = reference.attack_techniques(spark).join(reference.technique_tactics(spark), "technique", "left")
    per = t.groupBy("attack_type").agg(F.array_sort(F.collect_list(F.struct("place", "technique", "tactic"))).alias("t"))
    per = per.select("attack_type", F.col("t.technique").alias("mitre"), F.filter("t.tactic", lambda x: x.isNotNull()).alias("tactics"))
    return df.join(F.broadcast(per), "attack_type", "left")
