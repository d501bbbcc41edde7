"""Explanations, action plans and incidents; rules whose twins can't show every edge."""

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import explain, folds, suppress, windowed

T0 = dt.datetime(2024, 1, 2, 10)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_every_type_has_a_filled_explanation(spark):
    rows = [(i, k, "1.2.3.4", 22, None, ["T1", "T2"] if i % 2 else [], i % 3) for i, k in enumerate([*explain.LEVELS, "of no kind", None])]
    d = spark.createDataFrame(rows, "event_id long, attack_type string, dst_ip string, port int, filename string, mitre array<string>, threat_score int")
    got = {r.event_id: r.explanation for r in explain.explained(d).collect()}
    assert len(got) == len(rows) and not any(m in t for t in got.values() for m in ("{", "}"))
    assert all(("MITRE: T1, T2" in t) == bool(i % 2) and ("/100" in t) == bool(i % 3) for i, t in got.items())
    assert "unknown was fetched" in got[1] and "multiple failed" in got[3] and got[14].startswith("What: of no kind from 1.2.3.4") and got[15].startswith("What: unknown from")
    assert set(explain.TEXTS) == set(explain.LEVELS) and len(explain.LEVELS) == 14


def detections(spark, rows):
    return spark.createDataFrame([(i, at(s), ip, kind, sev, v, label) for i, s, ip, kind, sev, v, label in rows], "event_id long, ts timestamp, source_ip string, attack_type string, severity string, verdict string, label string")


def test_action_plan(spark):
    rows = [
        (1, 0, "a", "x", "critical", "drop", None), (2, 10, "a", "x", "high", "drop", None), (3, 900, "a", "x", "high", "drop", None), (4, 5, "a", "x", "high", "pass", None), (5, 5, "a", "y", "HIGH", "drop", None), (6, 0, "a", "x", "info", "drop", None),
        (7, 0, "w", "x", "critical", "drop", None), (8, 0, "n", "x", "critical", "drop", None), (9, 0, "g", "port_scan", "high", "drop", "google"), (10, 0, "g", "x", "high", "drop", "google"), (11, 0, "", "x", "high", "drop", None), (12, 0, "a", "z", "medium", "drop", None), (13, 0, None, "x", "high", "drop", None),
    ]
    ips = lambda *x: spark.createDataFrame([(i,) for i in x], "ip string")
    got = {r.event_id: (r.records, r.alerts, r.blocks) for r in suppress.action_plan(detections(spark, rows), ips("w", "w"), ips("n", "n")).collect()}
    # the gate of alerts is the one of grave detections: what isn't dropped doesn't hold them up
    assert got == {1: (True, True, True), 2: (True, False, True), 3: (True, True, True), 4: (True, False, False), 5: (True, True, True), 8: (True, True, False), 10: (True, True, True), 12: (True, False, False)}
    dry = suppress.action_plan(detections(spark, rows), dry_run=True).collect()
    assert not any(r.blocks for r in dry) and len(dry) == 9 and any(r.alerts for r in dry)


def test_host_plan(spark):
    rows = [(1, 0, "bad", "x", "critical", "", None), (2, 0, "bad", "x", "high", "", None), (3, 0, "mild", "x", "critical", "", None), (4, 0, "hot", "x", "critical", "", None), (5, 0, "new", "x", "critical", "", None), (6, 0, "bad", "x", "info", "", None), (7, 0, "bad", "x", "low", "", None)]
    known = spark.createDataFrame([("bad", True, 0), ("mild", False, 69), ("hot", None, 70)], "ip string, malicious boolean, score int")
    got = {r.event_id: (r.alerts, r.blocks) for r in suppress.host_action_plan(detections(spark, rows), known).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (True, False), 4: (True, True), 5: (True, False), 7: (False, False)}


def test_incidents_are_one_a_source_and_type(spark):
    rows = [(1, 0, "a", "x", "critical", "", None), (2, 299, "a", "x", "critical", "", None), (3, 300, "a", "x", "high", "", None), (4, 1, "a", "y", "low", "", None), (5, 1, "b", "x", "medium", "", None)]
    got = {r.event_id: (r.playbook, r.sla_seconds, r.breached) for r in suppress.incident_plan(detections(spark, rows), F.lit(601)).collect()}
    assert got == {1: ("full_response", 300, True), 3: ("full_response", 600, True), 4: ("log_only", 3600, False), 5: ("log_only", 1800, False)}


def test_fragment_storms_begin_anew(spark):
    rows = [(i, at(i), "a", "b", 1, "udp", 8 * (i + 1), True, 200, 300, "") for i in range(140)]
    d = spark.createDataFrame(rows, "event_id long, ts timestamp, src_ip string, dst_ip string, ip_id int, protocol string, frag_offset int, more_fragments boolean, payload_len int, raw_len int, flags string")
    got = windowed.fragment_faults(d).collect()
    assert sorted(r.event_id for r in got if r.attack_type == "fragment_storm") == [64, 129] and {r.severity for r in got} == {"high"}
    assert not [r for r in got if r.reason == "repeated offset"] and {r.event_id for r in got if r.reason == "inside the first"} == set(range(1, 65)) | set(range(66, 130)) | set(range(131, 140))


def test_a_row_reports_its_first_crossing_class_only():
    fold = folds.first_crossing(("sql", "xss"), 30, 2)
    rows = [(0, 1, [0, 1]), (1_000_000, 2, [0, 1]), (2_000_000, 3, [0, 1]), (3_000_000, 4, [0, 1]), (60_000_000, 5, [0, 1])]
    assert [(r[1], r[2]) for r in fold.step(fold.start(), rows)[1]] == [(2, "sql"), (3, "xss")]


def test_covert_text_needs_an_outlier(spark):
    values, n = [], 0
    for i in range(40):
        n = (n + (72 if i % 2 else 73)) % 256
        values.append(n)
    rows = [(i, at(i), "a", v if i < 39 else v, "A") for i, v in enumerate(values)]
    d = spark.createDataFrame(rows, "event_id long, ts timestamp, src_ip string, seq long, flags string")
    assert windowed.covert_numbers(d, "seq", "seq_covert_channel", 8).count() == 0
    # a long rest, then steps of one printable width, the last byte far from the rest
    rest = [(i, at(i / 2), "b", 200, "S") for i in range(400)] + [(400 + i, at(200 + i), "b", 240 + 40 * i, "A") for i in range(8)]
    d = spark.createDataFrame(rest, "event_id long, ts timestamp, src_ip string, seq long, flags string")
    assert [(r.event_id, r.severity, r.text) for r in windowed.covert_numbers(d, "seq", "seq_covert_channel", 8).collect()] == [(407, "high", "(" * 8)]
    assert windowed.covert_numbers(d, "seq", "ack_covert_channel", 8, "flags LIKE '%A%'").count() == 0
