"""Sinks, readers and desk functions on edges that the twins don't show."""

import datetime as dt
import json
import uuid

from pyspark.sql import functions as F

from tidewatch.functions.exprs import z_score
from tidewatch.operators import desk, stateless
from tidewatch.sources import readers, sinks

T0 = dt.datetime(2024, 1, 2, 10)


def test_bundles_have_uuids_that_rerun_alike(spark):
    rows = [(1, T0, "1.2.3.4", "xss", ["T1189"]), (2, T0, "1.2.3.4", "xss", []), (3, T0, "5.6.7.8", "xss", None)]
    d = spark.createDataFrame(rows, "event_id long, ts timestamp, source_ip string, attack_type string, mitre array<string>")
    got = {r.event_id: json.loads(r.stix_bundle) for r in sinks.formatted(d, "stix_bundle").collect()}
    ids = [got[i]["objects"][0]["id"] for i in (1, 2, 3)]
    assert ids[0] == ids[1] != ids[2] and all(uuid.UUID(x.removeprefix("indicator--")).version == 4 for x in ids)
    assert got[1]["objects"][0]["external_references"] == [{"source_name": "mitre-attack", "url": "https://attack.mitre.org/techniques/T1189"}]
    assert "external_references" not in got[2]["objects"][0] and "external_references" not in got[3]["objects"][0] and got[1]["id"] != ids[0]


def test_lines_are_written_and_a_failing_channel_stops_no_other(spark, tmp_path):
    d = spark.createDataFrame([(1, T0, "1.2.3.4", "xss", "high"), (2, T0, "1.2.3.5", "xss", "low")], "event_id long, ts timestamp, source_ip string, attack_type string, severity string")
    sinks.write_lines(d, "syslog", f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 2
    sent, failed = [], []

    def broken(batch):
        raise OSError("down")

    sinks.deliver(d, {"first": broken, "second": lambda b: sent.append(b.count())}, lambda name, why: failed.append((name, "down" in why)))
    assert sent == [2] and failed == [("first", True)]


def test_packets_of_a_thin_feed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"event_id": 1, "src_ip": "1.1.1.1", "unknown": 5}\n{"event_id": 2, "dst_port": 80}\n')
    rows = sorted((r.event_id, r.src_ip, r.dst_port, r.protocol) for r in readers.packets(spark, str(tmp_path), "json").collect())
    assert rows == [(1, "1.1.1.1", None, None), (2, None, 80, None)]


def test_policies_with_hours_past_midnight(spark):
    rows = [(i, T0.replace(hour=h), "10.0.0.1", mac, port, "tcp") for i, (h, mac, port) in enumerate([(23, "aa", 22), (3, "aa", 22), (12, "aa", 22), (23, "aa", 23), (1, "00:0c:29:x", 1), (1, "", 1), (1, None, 1), (1, "zz", 1)])]
    p = spark.createDataFrame(rows, "event_id long, ts timestamp, src_ip string, src_mac string, dst_port int, protocol string")
    placed = desk.with_policy(p, spark.createDataFrame([("aa", "night"), ("aa", "night")], "mac string, policy string"), spark.createDataFrame([("00:0C:29", "VMware")], "prefix string, vendor string"))
    assert {r.event_id: r.policy for r in placed.collect()} == {0: "night", 1: "night", 2: "night", 3: "night", 4: "server", 5: None, 6: None, 7: "workstation"}
    policies = spark.createDataFrame([("night", 3, [22], None, 22, 6), ("server", 9, None, ["udp"], None, None)], "policy string, max_connections int, ports array<int>, protocols array<string>, from_hour int, to_hour int")
    got = {r.event_id: (r.severity, r.reason) for r in desk.policy_violations(placed, policies).collect()}
    assert got == {2: ("medium", "hour"), 3: ("high", "connections"), 4: ("medium", "protocol")}


def test_override_headers_of_any_case(spark):
    rows = [(1, {"X-Forwarded-For": "%2527%2520or%2520%25271%2527=%25271"}), (2, {"accept": "../.."}), (3, {"x-original-url": "../etc"}), (4, None), (5, {}), (6, {"X-REWRITE-URL": None}), (7, {"x-forwarded-host": "<SCRIPT>"})]
    d = spark.createDataFrame([(i, T0, "a", h) for i, h in rows], "event_id long, ts timestamp, src_ip string, headers map<string,string>")
    assert sorted(r.event_id for r in stateless.override_injection(d).collect()) == [1, 3, 7]


def test_captures_without_detections(spark):
    p = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "capture string, event_id long")
    d = spark.createDataFrame([(1, "x", "scan", "info"), (1, "x", "scan", "high"), (9, "y", "scan", "high")], "event_id long, source_ip string, attack_type string, severity string")
    e = spark.createDataFrame([("a", ["scan"], 1), ("b", [], 0)], "capture string, types array<string>, budget long")
    got = {r.capture: (r.packets, r.detected, r.actionable, r.types_found, r.top_sources, r.as_expected) for r in desk.capture_quality(p, d, e).collect()}
    assert got == {"a": (2, 1, 1, "scan", "x", True), "b": (1, 0, 0, "", None, True)}


def test_z_score(spark):
    r = spark.range(1).select(z_score(F.lit(5.0), F.lit(3.0), F.lit(2.0)).alias("a"), z_score(F.lit(5.0), F.lit(3.0), F.lit(0.0)).alias("b")).first()
    assert (r.a, r.b) == (1.0, 0.0)
