"""Folds with values: edges, brute force, batches of any cut, large lists, partitions, evidence."""

import datetime as dt
import ipaddress
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import evidence, folds, report, suppress

T0 = dt.datetime(2024, 1, 2, 10)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run(spark, rows, schema, fold):
    df = spark.createDataFrame([(e, k, at(s), *rest) for e, k, s, *rest in rows], f"event_id long, k string, ts timestamp, {schema}" if schema else "event_id long, k string, ts timestamp")
    return sorted(map(tuple, folds.fold_rows(df.repartition(3), "k", "ts", "event_id", fold).drop("t").collect()), key=str)


def test_a_fold_does_not_depend_on_batches(spark):
    rows = [(i, f"k{i % 3}", i * 7 % 600) for i in range(400)] + [(1000 + i, None, i) for i in range(30)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        small = run(spark, rows, "", folds.counter(60, 4))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == run(spark, rows, "", folds.counter(60, 4)) and any(r[0] is None for r in small)


def test_blocks_end_at_their_time_and_can_be_lifted(spark):
    rows = [(1, "a", 0, 10), (2, "a", 9, None), (3, "a", 10, None), (4, "a", 20, 100), (5, "a", 30, None), (6, "a", 31, 0), (7, "a", 32, None), (8, "a", 40, 5), (9, "a", 42, 10), (10, "a", 51, None), (11, "a", 52, None), (12, "b", 1, None)]
    assert [r[1] for r in run(spark, rows, "ttl int", folds.standing_block())] == [10, 2, 5]


def test_intel_grows_old_provider_by_provider(spark):
    rows = [(1, "a", 0, "x", 30, False), (2, "a", 5, "y", 60, False), (3, "a", 6, None, None, None), (4, "a", 10, None, None, None), (5, "a", 14, None, None, None), (6, "a", 15, None, None, None), (7, "a", 16, "x", 1, True), (8, "a", 17, None, None, None)]
    got = {r[1]: r[2:] for r in run(spark, rows, "provider string, abuse_score int, malicious boolean", folds.cached_intel(10))}
    assert got == {3: (60, True), 4: (60, True), 5: (60, True), 8: (1, True)}


def test_a_baseline_learns_only_what_is_normal():
    fold = folds.learned_baseline()
    rows = [(i, i, 10.0 + i % 2, 100.0) for i in range(60)] + [(60 + i, 60 + i, 50.0, 100.0) for i in range(5)]
    state, out = fold.step(fold.start(), rows)
    assert [r[4] for r in out[:5]] == [0.0] * 5 and state[0] == 60 and all(r[4] > 5 and r[5] == 0 for r in out[60:])
    assert fold.step(fold.step(fold.start(), rows[:31])[0], rows[31:])[0] == state


def test_baseline_levels(spark):
    quiet = [(100 * m + i, "h", 60 * m + i) for m in range(12) for i in range(12 + m % 2)]
    loud = [(10_000 + i, "h", 60 * 13 + i / 50) for i in range(500)]
    df = spark.createDataFrame([(e, h, at(s), 60) for e, h, s in quiet + loud], "event_id long, h string, ts timestamp, size int")
    got = folds.baseline_anomalies(df, "h", "ts", "size").collect()
    assert {r.attack_type for r in got} == {"baseline_pps_anomaly", "baseline_bps_anomaly"} and all(r.severity == ("medium" if abs(r.z) < 5 else "high") for r in got) and min(r.event_id for r in got) >= 10_000


def messages(fold, segments):
    """Messages of segments fed one by one."""
    state, out = fold.start(), []
    for i, (seq, payload, port) in enumerate(segments):
        state, found = fold.step(state, [(i, i, seq, payload, port)])
        out += [r[4] for r in found]
    return out


def test_messages_by_arrival():
    m = b"GET / HTTP/1.1\r\nHost: x\r\n\r\n"
    post = b"POST / HTTP/1.1\r\nContent-Length: 5\r\n\r\nhello"
    f = folds.assembled((80,))
    assert messages(f, [(1, m, 80), (1 + len(m), post[:20], 80), (1, m, 80), (1 + len(m) + 20, post[20:] + m, 80)]) == [m, post, m]
    assert messages(f, [(1, b"\x16\x03 x\r\n\r\n", 9999)]) == [] and messages(f, [(1, m, 9999)]) == [m] and messages(f, [(1, b"", 80), (None, m, 80), (5, m, 80)]) == [m]
    assert messages(f, [(1, b"A: b\r\nContent-Length: zz\r\n\r\nrest", 80)]) == [b"A: b\r\nContent-Length: zz\r\n\r\n"]


@pytest.mark.parametrize("seed", range(25))
def test_reordered_segments_give_the_text(seed):
    r = random.Random(seed)
    whole = [b"POST /%d HTTP/1.1\r\nContent-Length: %d\r\n\r\n" % (i, n) + bytes(r.randrange(256) for _ in range(n)) for i, n in enumerate(r.choices(range(60), k=8))]
    text, start = b"".join(whole), r.choice([0, 77, (1 << 32) - 40, (1 << 32) - 1])
    cuts = sorted({0, len(text), *(r.randrange(len(text)) for _ in range(25))})
    parts = [((start + a) % (1 << 32), text[a:b], 80) for a, b in zip(cuts, cuts[1:], strict=False)]
    parts += [((start + a) % (1 << 32), text[a : a + r.randint(1, 60)], 80) for a in r.sample(range(len(text)), 15)]  # repeats and overlaps
    first, rest = parts[0], parts[1:]
    r.shuffle(rest)
    assert messages(folds.assembled((80,), reorder=True), [first, *rest]) == whole


def test_a_gap_that_never_fills_is_given_up():
    m = b"GET / HTTP/1.1\r\n\r\n"
    f = folds.assembled((80,), reorder=True, most_held=50)
    assert messages(f, [(0, m, 80), (100, m, 80), (100 + len(m), m, 80), (100 + 2 * len(m), m, 80)]) == [m] * 4


def test_each_opening_row_is_answered_once(spark):
    rows = [(1, "a", 0.0, "q"), (2, "a", 1.0, "t"), (3, "a", 1.5, "t"), (4, "a", 3.0, "q"), (5, "a", 3.5, "q"), (6, "a", 5.4, "t"), (7, "a", 9.0, "q"), (8, "a", 11.0, "t"), (9, "b", 0.0, "t"), (10, "a", 20.0, "t"), (11, "a", 20.0, "q"), (12, "a", 20.0, "x")]
    df = spark.createDataFrame([(e, k, at(s), p) for e, k, s, p in rows], "event_id long, k string, ts timestamp, p string")
    got = folds.consumed(df, "k", "ts", F.col("p") == "q", F.col("p") == "t", 2.0)
    assert sorted((r.event_id, r.opened_by) for r in got.collect()) == [(2, 1), (6, 5), (10, 11)]


def test_places_are_those_of_a_global_sort(spark):
    r = random.Random(2)
    rows = [(i, at(r.choice([0, 1, 1, r.randrange(500)]))) for i in range(1500)] + [(5000, None)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp").repartition(6)
    want = [i for i, _ in sorted(rows, key=lambda x: (x[1] is not None, x[1] or T0, x[0]))]
    for stretches in (1, 7, 200):
        got = evidence.numbered(df, "ts", "event_id", stretches).orderBy("place").collect()
        assert [x.event_id for x in got] == want and [x.place for x in got] == list(range(1, len(want) + 1))
    assert evidence.numbered(df.limit(0), "ts", "event_id").count() == 0


def test_evidence_windows(spark):
    df = spark.createDataFrame([(i, at(i // 3)) for i in range(400)], "event_id long, ts timestamp")
    hits = [(3, "a", "high"), (200, "a", "critical"), (201, "a", "critical"), (300, "b", "low"), (399, "b", "high")]
    d = spark.createDataFrame([(e, at(e // 3), s, v) for e, s, v in hits], "event_id long, ts timestamp, source_ip string, severity string")
    got = sorted((r.hit, r.nth, r.event_id) for r in evidence.evidence(df, d, cooldown_s=60, stretches=5).collect())
    assert got == sorted([(h, h - e, e) for h in (3, 200, 399) for e in range(max(0, h - 64), h)])


def brute(ranges, ip):
    n = ipaddress.ip_address(ip)
    return next((label for lo, hi, label in ranges if lo.version == n.version and lo <= n <= hi), None)


@pytest.mark.parametrize(("count", "expressed"), [(30, 256), (30, 1), (3000, 256)])
def test_long_range_lists(spark, count, expressed):
    r = random.Random(count)
    ranges = []
    for i in range(count):
        v6 = i % 4 == 0
        lo = ipaddress.ip_address((0x20010DB8 << 96) + r.randrange(1 << 20)) if v6 else ipaddress.ip_address((10 << 24) + r.randrange(1 << 18))
        ranges.append((lo, lo + r.choice([0, 3, 255, 5000]), f"l{i % 7}"))
    listed = spark.createDataFrame(
        [(i, label, None if lo.version == 6 else int(lo), None if lo.version == 6 else int(hi), format(int(lo), "032x") if lo.version == 6 else None, format(int(hi), "032x") if lo.version == 6 else None) for i, (lo, hi, label) in enumerate(ranges)],
        "ord int, label string, lo long, hi long, lo6 string, hi6 string",
    )
    ips = [str(lo + d) for lo, hi, _ in r.sample(ranges, 25) for d in (0, 1, int(hi) - int(lo), int(hi) - int(lo) + 1)] + ["9.255.255.255", "::", "255.255.255.255", "0.0.0.0"]
    df = spark.createDataFrame([(ip,) for ip in [*ips, None, "no address"]], "ip string")
    dead = [(lo, hi, None if label == "l3" else label) for lo, hi, label in ranges]
    got = suppress.range_label(df, "ip", listed, disabled=("l3",), expressed=expressed)
    assert {x.ip: x.label for x in got.collect()} == {**{ip: brute(dead, ip) for ip in ips}, None: None, "no address": None}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_limits_of_own_past_are_the_twins(spark, tmp_path):
    import __spark_entry__ as entry

    # counts by day whose next day lies on three deviations; sums of squares and running means round differently there
    r, rows = random.Random(31), []
    for user in range(3000):
        counts = [r.randrange(1, 9) for _ in range(r.randrange(5, 12))]
        k, s, q = len(counts), sum(counts), sum(c * c for c in counts)
        on = [n for n in range(1, 60) if (k * n - s) ** 2 == 9 * (k * q - s * s)]
        rows += [(user, dt.datetime(2024, 1, 1 + day, i // 60, i % 60)) for day, c in enumerate([*counts, *on[:1]]) if on for i in range(c)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = c.sql(f"select user_id, day from ({entry.oracle_sql()['win31_self_baseline']})").fetchall()
    got = [(x.user_id, x.day) for x in entry.queries()["win31_self_baseline"](spark, str(tmp_path)).collect()]
    assert want and sorted(got) == sorted(want)


def test_lists_beyond_the_arrays_are_joined(spark):
    r, ranges = random.Random(5), []
    for i in range(400):
        v6 = i % 4 == 0
        lo = ipaddress.ip_address((0x20010DB8 << 96) + r.randrange(1 << 16)) if v6 else ipaddress.ip_address((10 << 24) + r.randrange(1 << 14))
        ranges.append((lo, lo + r.choice([0, 3, 255, 5000]), f"l{i % 7}"))
    ranges += [(ipaddress.ip_address("0.0.0.0"), ipaddress.ip_address("255.255.255.255"), "every"), (ipaddress.ip_address("8000::"), ipaddress.ip_address("ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"), "upper")]
    shown = lambda a, w: int(a) if a.version == 4 and w == 4 else format(int(a), "032x") if a.version == 6 and w == 6 else None
    listed = spark.createDataFrame([(i, label, *(shown(a, w) for w in (4, 6) for a in (lo, hi))) for i, (lo, hi, label) in enumerate(ranges)], "ord int, label string, lo long, hi long, lo6 string, hi6 string")
    ips = [str(lo + d) for lo, hi, _ in r.sample(ranges[:-2], 60) for d in (0, 1, int(hi) - int(lo), int(hi) - int(lo) + 1)] + ["9.255.255.255", "::", "255.255.255.255", "0.0.0.0", "ffff::1", "7fff::1"]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate([*ips, *ips[:9], None, "no address"])], "n int, ip string")
    dead = [(lo, hi, None if label == "l3" else label) for lo, hi, label in ranges]
    got = suppress.range_label(df, "ip", listed, disabled=("l3",), most=100)
    assert got.columns == ["n", "ip", "label"]
    assert sorted(((x.n, x.label) for x in got.collect() if x.ip in ips), key=lambda x: x[0]) == [(i, brute(dead, ip)) for i, ip in enumerate([*ips, *ips[:9]])]
    assert [x.label for x in got.filter("ip is null or ip = 'no address'").collect()] == [None, None]


def test_a_hundred_thousand_ranges_are_cut_once():
    starts, labels = suppress.stretches([(10 * i, 10 * i + 5, f"l{i % 3}") for i in range(100_000)] + [(0, 10**7, "all")])
    assert len(starts) == len(labels) == 200_001 and labels[-1] is None and labels[1] == "all" and starts == sorted(set(starts))


def test_filtered_blocks_are_exact_and_in_the_plan(spark):
    events = spark.createDataFrame([(i, f"ip{i % 3000}", at(i % 500)) for i in range(6000)], "event_id long, source_ip string, ts timestamp")
    blocks = spark.createDataFrame([(f"ip{i}", at(a), at(a + 50)) for i in range(0, 900, 3) for a in (0, 30, 200)] + [("ip0", at(9), at(9)), (None, at(0), at(9))], "ip_address string, created_at timestamp, block_until timestamp")
    plain, filtered = (suppress.active_block(events, blocks, filtered=f) for f in (False, True))
    assert "Subquery" in filtered._jdf.queryExecution().executedPlan().toString()
    want = {i for i in range(6000) if i % 3000 < 900 and i % 3 == 0 and (i % 500 < 80 or 200 <= i % 500 < 250)}
    assert {r.event_id for r in plain.collect()} == {r.event_id for r in filtered.collect()} == want


def test_retention_touches_one_date(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * i)) for i in range(40)]
    path = f"{tmp_path}/t"
    df = spark.createDataFrame(rows, "event_id long, ts timestamp")
    df.withColumn("date", F.to_date("ts").cast("string")).write.partitionBy("date").parquet(path)
    files = lambda: {(d, f): os.stat(f"{path}/{d}/{f}").st_mtime_ns for d in os.listdir(path) if d.startswith("date=") for f in os.listdir(f"{path}/{d}") if f.endswith("parquet")}
    before = files()
    gone = report.retain_partitions(spark, path, "ts", dt.datetime(2024, 1, 8, 12), 3)
    assert gone == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"]
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == [i for i, t in rows if t >= dt.datetime(2024, 1, 5, 12)]
    assert {k: v for k, v in files().items() if k[0] > "date=2024-01-05"} == {k: v for k, v in before.items() if k[0] > "date=2024-01-05"}
    assert report.retain_partitions(spark, path, "ts", dt.datetime(2024, 1, 9), 3) == ["2024-01-05"]
