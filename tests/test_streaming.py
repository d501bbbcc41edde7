"""Streaming forms give the rows of the batch forms, all of them, restarted or not, in any session time zone."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import folds, report, windowed
from tidewatch.sources import readers
from tidewatch.streaming import ordered, reload, snapshots, stateful

T0 = dt.datetime(2024, 1, 1)
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def stored(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ordered.STORE)
    yield spark
    spark.conf.set(STORE, before)


def _run(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def _events(spark, folder, files=4):
    """Events in several files, each a micro-batch, out of order within the watermark's delay; a last row lets all before it pass."""
    rows = [(i, T0 + dt.timedelta(minutes=i * 7 % 600), i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    for k in range(files):
        df.filter(F.col("event_id") % files == k).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(9999, T0 + dt.timedelta(days=30), -1)], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata"])
def test_keyed_state_equals_batch(stored, tmp_path, zone):
    spark = stored
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df, stream = _events(spark, str(tmp_path / "in"))
        timed = stateful.event_time(stream, delay="1 day")
        pairs = [
            (stateful.cooldown(timed, "user_id", "ts", 3600), windowed.cooldown(df, ["user_id"], "ts", 3600).filter("passed")),
            (stateful.counter(timed, "user_id", "ts", 7200, 4), windowed.counter_with_reset(df, ["user_id"], "ts", 7200, 4)),
        ]
        for i, (got, want) in enumerate(pairs):
            rows = {(r.user_id, r.event_id, r.ts) for r in _run(spark, got, f"state{i}_{zone[:3]}") if r.user_id >= 0}
            assert rows and rows == {(r.user_id, r.event_id, r.ts) for r in want.select("user_id", "event_id", "ts").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_blocks_and_intel_end_alike_in_streams(stored, tmp_path):
    spark = stored
    t = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, "a", t(0), 10, None, None, None), (2, "a", t(9), None, None, None, None), (3, "a", t(10), None, "x", 70, False), (4, "a", t(11), None, None, None, None), (5, "a", t(29), 5, None, None, None), (6, "a", t(30), None, None, None, None), (7, "b", t(31), None, None, None, None), (8, "a", t(34), None, None, None, None)]
    schema = "event_id long, ip string, ts timestamp, ttl int, provider string, abuse_score int, malicious boolean"
    df = spark.createDataFrame(rows, schema)
    for part in ([5, 2, 8], [1, 4, 3], [7, 6]):  # arrival against time
        df.filter(F.col("event_id").isin(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(99, "z", t(10**6), None, None, None, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stateful.event_time(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), delay="1 hour")
    for name, fold in (("blocks", folds.standing_block()), ("intel", folds.cached_intel(20))):
        want = sorted(map(tuple, folds.fold_rows(df, "ip", "ts", "event_id", fold).collect()))
        assert want and sorted(map(tuple, _run(spark, ordered.ordered(stream, "ip", "ts", "event_id", fold), name))) == want


def test_validity_edges(stored, tmp_path):
    spark = stored
    df, stream = _events(spark, str(tmp_path / "in"))
    table = spark.createDataFrame([(1, T0, T0 + dt.timedelta(hours=2), "first"), (1, T0 + dt.timedelta(hours=2), None, "second"), (2, T0 + dt.timedelta(minutes=14), T0 + dt.timedelta(minutes=14), "never")], "user_id long, valid_from timestamp, valid_to timestamp, label string")
    got = {(r.event_id, r.label) for r in _run(spark, ordered.valid_at(stream, table, "user_id", "ts"), "validity")}
    assert got == {(r.event_id, r.label) for r in ordered.valid_at(df, table, "user_id", "ts").collect()} == {(r.event_id, "first" if r.ts < T0 + dt.timedelta(hours=2) else "second") for r in df.collect() if r.user_id == 1}


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_closed_windows_equal_batch(spark, tmp_path, slide):
    df, stream = _events(spark, str(tmp_path / "in"), files=1)
    rows = _run(spark, stateful.tumbling(stateful.event_time(stream, delay="1 minute"), "user_id", "1 hour", slide=slide), f"tumbling{bool(slide)}")
    want = {(r.user_id, r.start): r.n for r in stateful.tumbling(df, "user_id", "1 hour", slide=slide).collect()}
    assert want and {(r.user_id, r.start): r.n for r in rows if r.user_id >= 0} == want


def test_sessions_equal_batch(spark, tmp_path):
    df, stream = _events(spark, str(tmp_path / "in"), files=1)
    rows = _run(spark, stateful.sessions(stateful.event_time(stream, delay="1 minute"), "user_id", "20 minutes"), "sessions")
    want = {(r.user_id, r.start, r.end): r.n for r in stateful.sessions(df, "user_id", "20 minutes").collect()}
    assert want and {(r.user_id, r.start, r.end): r.n for r in rows if r.user_id >= 0} == want


def test_correlation_is_complete(spark, tmp_path):
    df, stream = _events(spark, str(tmp_path / "in"))
    timed = stateful.event_time(stream, delay="1 day")
    left, right = "event_id % 2 = 0", "event_id % 2 = 1"
    got = {(r.a_id, r.b_id) for r in _run(spark, stateful.follows(timed.filter(left), timed.filter(right), "user_id", 6000), "pairs")}
    assert got and got == {(r.a_id, r.b_id) for r in stateful.follows(df.filter(left), df.filter(right), "user_id", 6000).collect()}


def test_action_loop_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "high"), (2, "low")], "event_id long, severity string")
    write = stateful.act(lambda b: {"alerts": b.filter("severity = 'high'"), "rows": b}, str(tmp_path))
    write(df, 7)
    write(df, 7)
    assert spark.read.parquet(f"{tmp_path}/alerts").count() == 1 and spark.read.parquet(f"{tmp_path}/rows").count() == 2


def test_a_rule_added_between_batches_acts_on_the_second(spark, tmp_path):
    rule = lambda i, port: {"id": i, "name": i, "condition": {"type": "field", "field": "dst_port", "operator": "equals", "value": port}}
    folder, found = tmp_path / "rules", []
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"rules": [rule("one", 23)]}))
    rules = reload.RuleFolder(str(folder))
    write = reload.matching(rules, lambda b, n: found.append({(n, r.event_id, r.rule_id) for r in b.collect()}))
    df = spark.createDataFrame([(1, 23), (2, 445)], "event_id long, dst_port int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    start = lambda: readers.ingest(stream, "", str(tmp_path / "checkpoint"), write).awaitTermination()
    start()
    (folder / "b.json").write_text(json.dumps({"rules": [rule("two", 445)]}))
    df.withColumn("event_id", F.col("event_id") + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start()
    assert found == [{(0, 1, "one")}, {(1, 11, "one"), (1, 12, "two")}] and rules.version == 2
    (folder / "b.json").write_text("{ half an edit")
    assert len(rules.current()) == 2 and rules.problem and rules.version == 2
    os.remove(folder / "b.json")
    assert len(rules.current()) == 1 and rules.version == 3 and rules.problem is None


def test_a_list_is_read_anew_for_each_batch(spark, tmp_path):
    path, found = str(tmp_path / "list"), []
    write = reload.enriched(lambda s: s.read.parquet(path), lambda b, t: b.join(t, "user_id"), lambda b, n: found.append(b.count()))
    df = spark.createDataFrame([(1, 5), (2, 6)], "event_id long, user_id long")
    for known in ([(5,)], [(5,), (6,)]):
        spark.createDataFrame(known, "user_id long").write.mode("overwrite").parquet(path)
        write(df, len(found))
    assert found == [1, 2]


def test_a_retried_batch_changes_nothing(spark, tmp_path):
    kept = snapshots.Snapshot(spark, f"{tmp_path}/attackers")
    batch = lambda *rows: spark.createDataFrame([(ip, T0 + dt.timedelta(hours=h), c) for ip, h, c in rows], "source_ip string, ts timestamp, country string")
    write = snapshots.upserting(kept, report.attackers)
    assert kept.read() is None
    rows = lambda: sorted((r.ip_address, r.first_seen, r.last_seen, r.attack_count, r.country) for r in kept.read().collect())
    first, second = batch(("a", 0, None), ("a", 1, "XX"), ("b", 2, None)), batch(("a", 5, None), ("c", 6, "YY"))
    write(first, 0)
    write(second, 1)
    once = rows()
    write(second, 1)
    assert rows() == once and [(r[0], r[3], r[4]) for r in once] == [("a", 3, "XX"), ("b", 1, None), ("c", 1, "YY")]
    # a writer that died before its commit leaves a version that doesn't count
    write(second, 2)
    os.remove(f"{tmp_path}/attackers/version=2/_SUCCESS")
    assert rows() == once
    for n in range(2, 8):
        write(first, n)
    assert kept.versions() == [5, 6, 7]


@pytest.mark.parametrize("kind", ["log", "syslog"])
def test_each_line_comes_once_after_a_restart(spark, tmp_path, kind):
    spool, out, checkpoint = tmp_path / "spool", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    lines = {"log": 'Jan 02 10:00:11 host sshd[7]: Failed password for u{} from 10.0.0.9 port 22', "syslog": "<34>1 2024-01-02T10:00:00Z host1 svc - ID{} trojan found"}[kind]
    start = lambda: readers.ingest(readers.log_records(spark, str(spool), True) if kind == "log" else readers.syslog_files(spark, str(spool), True), out, checkpoint).awaitTermination()
    for k in range(3):
        sender = spool / f"source_ip=10.0.0.{k}"
        sender.mkdir(parents=True)
        (sender / "a.log").write_text("".join(lines.format(10 * k + i) + "\n" for i in range(4)))
        if kind == "log":
            (spool / f"{k}.log").write_bytes((sender / "a.log").read_bytes())
        start()
        start()  # nothing new
    got = spark.read.parquet(out).collect()
    assert len(got) == 12
    if kind == "log":
        assert sorted(r.log_user for r in got) == sorted(f"u{10 * k + i}" for k in range(3) for i in range(4)) and {r.log_type for r in got} == {"ssh_failed"}
    else:
        assert sorted({(r.source_ip, r.attack_type, r.severity) for r in got}) == [(f"10.0.0.{k}", "syslog_malware", "critical") for k in range(3)]
        assert len({r.message for r in got}) == 12


def test_host_codes(spark):
    r = spark.range(8).select(F.collect_list(F.coalesce(readers.host_kind(F.col("id")), F.lit("-"))).alias("k")).first()
    assert r.k == ["-", "exec", "connect", "open", "kill", "write", "network", "-"]


def test_waiting_rows_go_to_the_store_by_the_chunk():
    import pandas as pd

    class List:
        def __init__(self):
            self.calls, self.held = [], []

        def appendValue(self, value):
            self.calls.append(value)
            self.held.append(value)

        def appendList(self, values):
            self.calls += values
            self.held += values

        def get(self):
            return iter(self.held)

        def clear(self):
            self.held = []

        put = appendList

    class Value:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        waiting = List()
        getListState = lambda self, *_: self.waiting
        getValueState = lambda self, *_: Value()
        registerTimer = lambda self, _: None

    class Times:
        getCurrentWatermarkInMs = lambda self: 300

    handle = Handle()
    p = ordered._Ordered(folds.gate(0.1), "k", {"t": "bigint", "o": "bigint"}, ["t", "event_id"])
    p.init(handle)
    frames = [pd.DataFrame({"t": [(i * 7919) % 500 * 1000 for i in part], "o": list(part)}) for part in (range(250), range(250, 500))]
    list(p.handleInputRows(("a",), iter(frames), None))
    assert len(handle.waiting.calls) == 2
    found = pd.concat(p.handleExpiredTimer(("a",), Times(), None))
    assert found.t.tolist() == [0, 100_000, 200_000]
    list(p.handleInputRows(("a",), iter(()), None))
    Times.getCurrentWatermarkInMs = lambda self: 900
    assert pd.concat(p.handleExpiredTimer(("a",), Times(), None)).t.tolist() == [300_000, 400_000]
