"""Detectors fire where they should and stay silent where they should."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import exprs
from tidewatch.operators import parse, rules, stateless, suppress, windowed
from tidewatch.sources import reference

T0 = dt.datetime(2024, 1, 1)


def packets(spark, rows):
    """rows: (seconds, src_ip, dst_port, flags)."""
    data = [(i, T0 + dt.timedelta(seconds=s), src, "10.9.9.9", port, flags) for i, (s, src, port, flags) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id long, ts timestamp, src_ip string, dst_ip string, dst_port int, flags string")


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def test_rate_fires_only_on_a_burst(spark):
    rows = [(i * 0.01, "a", 80, "S") for i in range(50)] + [(i * 10, "b", 80, "S") for i in range(50)]
    hits = windowed.rate(packets(spark, rows), "syn_flood", "critical", "src_ip", "ts", 1, 30, "flags = 'S'").collect()
    assert {h.source_ip for h in hits} == {"a"} and len(hits) == 20


def test_window_is_half_open(spark):
    p = packets(spark, [(0, "a", 1, "S"), (10, "a", 1, "S")])
    assert not windowed.rate(p, "x", "low", "src_ip", "ts", 10, 1).count()
    assert windowed.rate(p, "x", "low", "src_ip", "ts", 10.001, 1).count() == 1


def test_distinct_ports(spark):
    p = packets(spark, [(i, "scan", i, "S") for i in range(20)] + [(i, "calm", 443, "S") for i in range(20)])
    hits = windowed.distinct_in_window(p, "port_scan", "medium", ["src_ip"], "ts", "dst_port", 15, 60).collect()
    assert {h.source_ip for h in hits} == {"scan"} and min(h.n for h in hits) == 15


def test_cooldown_counts_from_the_last_that_passed(spark):
    p = packets(spark, [(s, "a", 1, "") for s in (0, 200, 300, 500, 599, 600)] + [(1, "b", 1, "")])
    assert ids(windowed.cooldown(p, ["src_ip"], "ts", 300).filter("passed")) == [0, 2, 5, 6]


def test_counter_resets_after_it_fires(spark):
    p = packets(spark, [(s, "a", 1, "") for s in (0, 1, 2, 3, 4, 5, 6, 100)])
    assert ids(windowed.counter_with_reset(p, ["src_ip"], "ts", 50, 3)) == [2, 5]


def test_anchored_window_differs_from_sliding(spark):
    p = packets(spark, [(s, "a", 1, "") for s in (0, 9, 11, 12, 13)])
    assert ids(windowed.anchored_rate(p, ["src_ip"], "ts", 10, 2)) == [4]


def test_order_of_rows_does_not_matter(spark):
    rows = [(i * 37 % 100, "a" if i % 3 else "b", i % 7, "S") for i in range(60)]
    p = packets(spark, rows)
    shuffled = p.orderBy(F.rand(1)).repartition(3)
    assert ids(windowed.counter_with_reset(p, ["src_ip"], "ts", 20, 3)) == ids(windowed.counter_with_reset(shuffled, ["src_ip"], "ts", 20, 3))


def test_steady_gaps(spark):
    p = packets(spark, [(i * 10, "beacon", 1, "") for i in range(15)] + [(i * i, "human", 1, "") for i in range(15)])
    hits = windowed.steady_gaps(p, "timed_probe", "medium", ["src_ip"], ["ts", "event_id"], "ts", 10, 5, 5, 30, 0.1).collect()
    assert {h.source_ip for h in hits} == {"beacon"}


def test_handshake_evidence_does_not_look_ahead(spark):
    data = [(0, 0, "a", "v", "S"), (1, 1, "a", "v", "S"), (2, 2, "a", "v", "S"), (3, 3, "v", "a", "SA")]
    p = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), src, dst, f) for i, s, src, dst, f in data], "event_id long, ts timestamp, src_ip string, dst_ip string, flags string")
    seen = {r.event_id: r.spoofed for r in windowed.handshakes(p).filter("host = 'a'").collect()}
    assert seen == {0: False, 1: False, 2: True, 3: False}


@pytest.mark.parametrize(
    ("line", "kind", "ip"),
    [
        ("Jan 02 10:00:01 h sshd[1]: Failed password for invalid user bob from 10.1.1.1 port 22", "ssh_failed", "10.1.1.1"),
        ("Jan 02 10:00:01 h sshd-session[1]: Invalid user bob from 10.1.1.2", "ssh_invalid_user", "10.1.1.2"),
        ('10.1.1.3 - - [x] "GET /a?b HTTP/1.1" 200 12 "-" "curl"', "web_access", "10.1.1.3"),
        ("2024-01-02 10:00:00 7 [warning] access denied for user 'root'@'10.1.1.4'", "mysql_failed", "10.1.1.4"),
        ("nothing to see", None, None),
        ("", None, None),
    ],
)
def test_log_patterns(spark, line, kind, ip):
    r = parse.log_lines(spark.createDataFrame([(line,)], "line string")).first()
    assert (r.log_type, r.log_ip) == (kind, ip)


def test_web_signatures_see_encoded_text(spark):
    rows = ["/a?q=%3Cscript%3E", "/x?id=1 union select 1", "/plain", "%zz", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "u string").select(parse.web_signature(F.col("u"))).collect()]
    assert got == ["xss_attempt", "sql_injection", None, None, None]


def test_normalise_unwraps_layers(spark):
    rows = ["%253Cscript%253E", "&#x3c;b&#62;", r"\x3cimg>", "sel/**/ect", "plain", ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "u string").select(parse.normalise(F.col("u"))).collect()]
    assert got == ["<script>", "<b>", "<img>", "select", "plain", ""]


def test_http_request(spark):
    text = "POST /a b HTTP/1.1\r\nHost: x\r\nCookie: a=1\r\n\r\nbody"
    r = spark.createDataFrame([(text,)], "p string").select(parse.http_request(F.col("p")).alias("r")).select("r.*").first()
    assert (r.method, r.uri, r.headers, r.body) == ("POST", "/a b", {"host": "x", "cookie": "a=1"}, "body")


def test_syslog_both_formats(spark):
    rows = ["<34>1 2024-01-01T00:00:00Z web app 9 ID1 broken", "Jan  1 12:00:00 db cron[7]: run", "junk"]
    got = parse.syslog(spark.createDataFrame([(x,) for x in rows], "raw string")).collect()
    assert [(r.hostname, r.facility, r.level, r.pid) for r in got] == [("web", "auth", "critical", "9"), ("db", "user", "info", "7")]


def test_rules_compile(spark):
    df = spark.createDataFrame([(1, 445, {"a": "x"}), (2, 23, {"a": "y"})], "event_id int, dst_port int, m map<string,string>")
    table = [
        {"id": "p", "condition": {"type": "pattern", "field": "dst_port", "pattern": "445"}},
        {"id": "bad", "condition": {"type": "pattern", "field": "dst_port", "pattern": "("}},
        {"id": "m", "condition": {"type": "composite", "logic": "and", "conditions": [{"type": "field", "field": "m.a", "operator": "in", "value": "y, z"}, {"type": "field", "field": "dst_port", "operator": "lt", "value": 100}]}},
        {"id": "none", "condition": {"type": "other"}},
    ]
    assert sorted((r.event_id, r.rule_id) for r in rules.match_rules(df, table).collect()) == [(1, "p"), (2, "m")]


def test_ranges_take_the_first_label(spark):
    df = spark.createDataFrame([("104.16.3.4",), ("10.1.2.3",), ("9.9.9.9",), ("fe80::1",), ("2606:4700::5",), ("x",), (None,)], "ip string")
    got = {r.ip: r.label for r in suppress.range_label(df, "ip", reference.ranges(spark)).collect()}
    assert got == {"104.16.3.4": "cloudflare", "10.1.2.3": "private", "9.9.9.9": None, "fe80::1": "private", "2606:4700::5": "cloudflare", "x": None, None: None}


def test_verdicts(spark):
    e = spark.createDataFrame([(1, 0, True), (2, 0, False), (3, 99, False), (4, 0, True)], "event_id long, reputation int, throttled boolean")
    det = spark.createDataFrame([(2, "HIGH "), (2, "low"), (3, "low"), (4, "info")], "event_id long, severity string")
    assert {r.event_id: r.verdict for r in suppress.verdicts(det, e).collect()} == {1: "pass", 2: "drop", 3: "drop", 4: "rate_limit"}


def test_expressions(spark):
    df = spark.createDataFrame([("aabb", 5), ("", 1), (None, 0)], "s string, n int")
    assert [round(r[0], 6) for r in df.select(exprs.entropy(F.col("s"))).collect()] == [1.0, 0.0, 0.0]
    nr = spark.createDataFrame([([4, 1, 3, 2],)], "a array<int>").select(exprs.nearest_rank(F.col("a"), 75)).first()[0]
    assert nr == 4
    key = spark.createDataFrame([("a", 1, "b", 2), ("b", 2, "a", 1)], "s string, sp int, d string, dp int").select(exprs.flow_key(F.col("s"), F.col("sp"), F.col("d"), F.col("dp"), F.lit("tcp")))
    assert key.distinct().count() == 1


def test_stateless_chain_reports_the_first_hit(spark):
    df = spark.createDataFrame([(1, T0, "a", 5), (2, T0, "a", 50)], "event_id long, ts timestamp, src_ip string, n int")
    chain = [stateless.Rule("small", "low", F.col("n") < 100), stateless.Rule("tiny", "low", F.col("n") < 10)]
    assert [r.attack_type for r in stateless.detect_first(df, chain).collect()] == ["small", "small"]
    assert stateless.detect(df, chain).count() == 3


def test_log_types_are_attacks_by_themselves(spark):
    web = '10.0.0.1 - - [02/Jan/2024:10:00:00 +0000] "GET {} HTTP/1.1" 200 512 "-" "{}"'
    cases = [
        ("Jan 02 10:00:00 host sshd[7]: Invalid user bob from 10.0.0.1", "ssh_invalid_user"),
        ("Jan 02 10:00:00 host sshd[7]: Failed password for bob from 10.0.0.1 port 22", None),
        ("Jan 02 10:00:00 host vsftpd[7]: user ANONYMOUS LOGIN from 10.0.0.1", "anonymous_ftp"),
        ("2024-01-02T10:00:00 x Authentication failed for client=10.0.0.1", "mongo_unauthorized"),
        ("12 Jan 10:00:00 host redis-server: Authentication failed client=10.0.0.1", "redis_unauthorized"),
        ('2024-01-02T10:00:00 { "verb":"get","responseCode":403, "sourceIPs":["10.0.0.1"]', "k8s_unauthorized"),
        ("Jan 02 10:00:00 host sudo: bob : x COMMAND=id USER=root TTY=t PWD=/ WORKDIR=/", "sudo_failure"),
        (web.format("/run?c=;cat", "x"), "command_injection"), (web.format("http://169.254.169.254/latest", "x"), "rfi_attempt"), (web.format("/x", "sqlmap"), "scanner_detected"),
        (web.format("/etc/passwd", "x"), "lfi_attempt"), (web.format("/wp-admin", "x"), "admin_probe"), (web.format("/index", "x"), None),
        ("Jan 02 10:00:00 host sshd[7]: Accepted password for ${jndi:x} from 10.0.0.1 port 22", "log4j_attempt"), ("no known line", None),
    ]
    df = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(cases)], "i int, line string")
    assert [r.attack_type for r in parse.log_attacks(df).orderBy("i").collect()] == [kind for _, kind in cases]
