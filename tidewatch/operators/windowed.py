"""Windowed detectors over event time.

Sliding windows are range frames on microseconds, half-open on the left; frames by rows, running counts and distinct sets
use the same partition and order, so that Spark plans one exchange and one sort for detectors of one key. Where the order of
decisions matters (resets, anchored windows), ``fold`` scans each key's rows in order, one pass, constant state.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType


def micros(ts: str) -> Column:
    """A timestamp column as microseconds."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sliding(key: list[str], ts: str, seconds: float, closed: bool = False) -> Window:
    """(t - seconds, t], with the left end too if ``closed``."""
    span = int(seconds * 1_000_000)
    return Window.partitionBy(*key).orderBy(micros(ts)).rangeBetween(-span if closed else -span + 1, 0)


def last_rows(key: list[str], order: list[str], n: int) -> Window:
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(-n + 1, 0)


def running(key: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def detection(df: DataFrame, attack_type: str | Column, severity: str | Column, source: str = "src_ip", **extra: Column | str) -> DataFrame:
    """Rows in the detections' shape: event_id, ts, source_ip, attack_type, severity, and what ``extra`` adds."""
    of = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("event_id", "ts", F.col(source).alias("source_ip"), of(attack_type).alias("attack_type"), of(severity).alias("severity"), *[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in extra.items()])


def rate(df: DataFrame, attack_type: str, severity: str, key: str, ts: str, seconds: float, more_than: float, where: str = "true", weight: str | None = None, source: str | None = None) -> DataFrame:
    """Rows whose key has more than ``more_than`` rows (or sum of ``weight``) in the sliding window."""
    w = sliding([key], ts, seconds)
    rows = df.filter(where).withColumn("n", (F.sum(weight) if weight else F.count(F.lit(1))).over(w))
    return detection(rows.filter(F.col("n") > more_than), attack_type, severity, source or key, n="n")


def distinct_in_window(df: DataFrame, attack_type: str, severity: str | Column, key: list[str], ts: str, of: str, at_least: int, seconds: float | None, where: str = "true", order: str = "event_id") -> DataFrame:
    """Rows whose key has ``at_least`` distinct values of ``of`` in the sliding window, or so far.

    No set is held: a value counts one from the row at which it enters the window to the moment it leaves, and the count is a
    running sum of entries and leavings.
    """
    # dealt by key once: windows by key and value use that too
    rows = df.filter(where).withColumn("_t", micros(ts)).repartition(*key)
    if seconds is None:
        nth = F.row_number().over(Window.partitionBy(*key, of).orderBy(ts, order))
        enters = F.when(F.col(of).isNotNull() & (nth == 1), 1).otherwise(0)
        rows = rows.withColumn("_enters", enters).withColumn("n", F.sum("_enters").over(running(key, [ts, order])))
        return detection(rows.filter(F.col("n") >= at_least), attack_type, severity, key[0], n="n")
    span = int(seconds * 1_000_000)
    same = Window.partitionBy(*key, of).orderBy("_t", order)
    new = F.coalesce(F.col("_t") - F.lag("_t").over(same) >= span, F.lit(True)) & F.col(of).isNotNull()
    last = F.coalesce(F.lead("_t").over(same) - F.col("_t") >= span, F.lit(True)) & F.col(of).isNotNull()
    rows = rows.withColumn("_new", new).withColumn("_last", last)
    row = F.struct(F.col("_t").alias("at"), F.col("_new").cast("long").alias("change"), F.lit(True).alias("row"))
    leaves = F.when(F.col("_last"), F.struct((F.col("_t") + span).alias("at"), F.lit(-1).cast("long").alias("change"), F.lit(False).alias("row")))
    marks = rows.withColumn("_m", F.explode(F.filter(F.array(row, leaves), lambda m: m.isNotNull())))
    w = Window.partitionBy(*key).orderBy(F.col("_m.at")).rangeBetween(Window.unboundedPreceding, 0)
    found = marks.withColumn("n", F.sum("_m.change").over(w)).filter(F.col("_m.row") & (F.col("n") >= at_least))
    return detection(found, attack_type, severity, key[0], n="n")


def protocol_use(packets: DataFrame, at_least: int = 50, kinds: int = 3) -> DataFrame:
    """Packets of a host that has sent ``at_least`` in ``kinds`` protocols or more so far; null counts as one protocol, unknown."""
    w = running(["src_ip"], ["ts", "event_id"])
    rows = packets.repartition("src_ip").withColumn("_p", F.coalesce("protocol", F.lit("unknown")))
    first = F.row_number().over(Window.partitionBy("src_ip", "_p").orderBy("ts", "event_id")) == 1
    rows = rows.withColumn("_first", first.cast("long")).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("n", F.sum("_first").over(w))
    return detection(rows.filter((F.col("_n") >= at_least) & (F.col("n") >= kinds)), "proto_scan", "low", n="n")


def hopping(packets: DataFrame, step: int = 5) -> DataFrame:
    """Packets that bring a pair of hosts to ``step`` distinct ports, and to each multiple of it."""
    key = ["src_ip", "dst_ip"]
    rows = packets.filter("dst_port is not null").repartition(*key)
    first = F.row_number().over(Window.partitionBy(*key, "dst_port").orderBy("ts", "event_id")) == 1
    rows = rows.withColumn("_first", first.cast("long")).withColumn("n", F.sum("_first").over(running(key, ["ts", "event_id"])))
    return detection(rows.filter((F.col("_first") == 1) & (F.col("n") % step == 0)), "port_hopping", "medium", n="n")


def frame(df: DataFrame, attack_type: str, severity: str, key: list[str], order: list[str], n: int, at_least: int, test: Callable[[Window], Column], where: str = "true", source: str | None = None) -> DataFrame:
    """Rows where ``test`` holds over the key's last ``n`` rows, of which there are ``at_least``."""
    w = last_rows(key, order, n)
    rows = df.filter(where).withColumn("seen", F.count(F.lit(1)).over(w)).withColumn("hit", test(w))
    return detection(rows.filter((F.col("seen") >= at_least) & F.col("hit")), attack_type, severity, source or key[0], seen="seen")


def with_gaps(df: DataFrame, key: list[str], order: list[str], ts: str) -> DataFrame:
    """``gap``: seconds since the key's previous row; null for the first."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("gap", (micros(ts) - F.lag(micros(ts)).over(w)) / 1_000_000.0)


def steady_gaps(df: DataFrame, attack_type: str, severity: str, key: list[str], order: list[str], ts: str, n: int, at_least: int, mean_over: float, mean_under: float, variance_under: float) -> DataFrame:
    """Rows after which the last ``n`` gaps have a mean in the range and a small population variance."""
    w = last_rows(key, order, n)
    rows = with_gaps(df, key, order, ts).filter("gap is not null")
    rows = rows.withColumn("seen", F.count(F.lit(1)).over(w)).withColumn("mean", F.avg("gap").over(w)).withColumn("spread", F.var_pop("gap").over(w))
    keep = (F.col("seen") >= at_least) & (F.col("mean") > mean_over) & (F.col("mean") < mean_under) & (F.col("spread") < variance_under)
    return detection(rows.filter(keep), attack_type, severity, key[0], seen="seen")


class _Recent:
    """Count, mean and squared deviations of the values within ``span`` before a time, at a constant cost a value.

    Values are taken in at the front, with moments row by row (Welford), and leave at the back, where moments of all that are left are kept for every value;
    a back that has run out is made of the front. Nothing is subtracted, so equal values deviate by exactly nothing.
    """

    def __init__(self, span: int) -> None:
        self.span = span
        self.back: list[tuple[int, int, float, float]] = []  # newest first: time, and moments from here to the newest
        self.times: list[int] = []
        self.values: list[float] = []
        self.front = (0, 0.0, 0.0)
        self.sums: list[float] = []

    def mean(self, m: tuple[int, float, float], v: float) -> float:
        """The mean; of equal values, of which ``v`` is the newest, their sum by their number, as an average has it, so that it may be off in its last bit."""
        n, mean, squares = m
        if squares or not n:
            return mean
        if not self.sums or self.sums[0] != v:
            self.sums = [v]
        while len(self.sums) < n:
            self.sums.append(self.sums[-1] + v)
        return self.sums[n - 1] / n

    def add(self, t: int, v: float) -> None:
        self.times.append(t)
        self.values.append(v)
        self.front = _with(self.front, v)

    def moments(self, t: int) -> tuple[int, float, float]:
        gone = t - self.span
        back = self.back
        while back and back[-1][0] <= gone:
            back.pop()
        if not back and self.times and self.times[0] <= gone:
            m = (0, 0.0, 0.0)
            for i in range(len(self.times) - 1, bisect_right(self.times, gone) - 1, -1):
                m = _with(m, self.values[i])
                back.append((self.times[i], *m))
            self.times, self.values, self.front = [], [], (0, 0.0, 0.0)
        if not back:
            return self.front
        (n, mean, squares), (_, k, other, more) = self.front, back[-1]
        if not n:
            return k, other, more
        off = other - mean
        return n + k, mean + off * k / (n + k), squares + more + off * off * n * k / (n + k)


def _with(m: tuple[int, float, float], v: float) -> tuple[int, float, float]:
    n, mean, squares = m
    off = v - mean
    mean += off / (n + 1)
    return n + 1, mean, squares + off * (v - mean)


def recent_moments(df: DataFrame, key: list[str], ts: str, value: str, seconds: float) -> DataFrame:
    """``n``, ``mean`` and ``sd`` (of samples, 0 for fewer than two) of the key's values within ``seconds`` before each row's time, rows of the same time not included.

    One pass over sorted rows; the state is the times and values of a key's window. Rows without a time have each other.
    """
    span = int(seconds * 1_000_000)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, recent, same = None, None, []
        for batch in batches:
            if not len(batch):
                continue
            times, values = batch.column("_t").to_pylist(), batch.column("_v").to_pylist()
            cuts = np.r_[np.flatnonzero(_fresh(batch, key)), len(batch)].tolist()
            first = [repr(batch.column(k)[0].as_py()) for k in key]
            found = []
            for at, to in zip(cuts, cuts[1:], strict=False):
                if at or first != current:
                    recent, same, last, m, v = _Recent(span), [], None, None, 0.0
                for i in range(at, to):
                    if times[i] != last:
                        for v in same:
                            recent.add(last, v)
                        last, same = times[i], []
                        m = recent.moments(last)
                        m = m[0], recent.mean(m, v), m[2]
                    if values[i] is not None:
                        same.append(values[i])
                    found.append(m)
            current = [repr(batch.column(k)[len(batch) - 1].as_py()) for k in key]
            n, mean, squares = (np.array(c) for c in zip(*found, strict=True))
            kept = batch.drop_columns(["_t", "_v"])
            yield kept.append_column("n", pa.array(n, pa.int64())).append_column("mean", pa.array(mean, pa.float64(), mask=n == 0)).append_column("sd", pa.array(np.sqrt(np.where(n > 1, squares, 0.0) / np.maximum(n - 1, 1)), pa.float64()))

    rows = df.withColumn("_t", micros(ts)).withColumn("_v", F.col(value).cast("double"))
    schema = StructType([*df.schema, StructField("n", LongType()), StructField("mean", DoubleType()), StructField("sd", DoubleType())])
    timed = rows.filter("_t is not null").repartition(*key).sortWithinPartitions(*key, "_t").mapInArrow(scan, schema)
    w = Window.partitionBy(*key)
    rest = rows.filter("_t is null").withColumn("n", F.count("_v").over(w)).withColumn("mean", F.avg("_v").over(w)).withColumn("sd", F.coalesce(F.stddev_samp("_v").over(w), F.lit(0.0)))
    return timed.unionByName(rest.drop("_t", "_v"))


def outliers(df: DataFrame, key: list[str], ts: str, value: str, seconds: float, sigmas: float = 3.0, at_least: int = 3) -> DataFrame:
    """Rows whose value lies more than ``sigmas`` sample deviations from the mean of the rows before it in the window.

    With no spread before it, any change counts.
    """
    rows = recent_moments(df, key, ts, value, seconds)
    off = F.abs(F.col(value) - F.col("mean"))
    return rows.filter((F.col("n") >= at_least) & F.when(F.col("sd") > 0, off > sigmas * F.col("sd")).otherwise(off > 0))


def nth_reset(df: DataFrame, attack_type: str, severity: str, key: str, order: list[str], every: int, where: str = "true") -> DataFrame:
    """Every ``every``-th row of a key: a count that fires and starts again."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return detection(df.filter(where).withColumn("nth", nth).filter(F.col("nth") % every == 0), attack_type, severity, key, nth=F.col("nth").cast("long"))


def handshakes(packets: DataFrame, order: tuple[str, str] = ("ts", "event_id"), carry: tuple[str, ...] = ()) -> DataFrame:
    """Every packet by the roles of its hosts, with what the host had shown so far: SYNs sent, SYN-ACKs received.

    ``spoofed``: three SYNs and three unanswered, and no handshake completed. Columns named in ``carry`` come along.
    """
    roles = packets.select("event_id", "ts", *carry, F.explode(F.array(F.struct(F.col("src_ip").alias("host"), F.lit(True).alias("sends")), F.struct(F.col("dst_ip").alias("host"), F.lit(False).alias("sends")))).alias("r"), "flags")
    roles = roles.select("event_id", "ts", *carry, "flags", "r.host", "r.sends")
    w = running(["host"], [*order, "sends"])
    sent = F.sum(((F.col("flags") == "S") & F.col("sends")).cast("long")).over(w)
    answered = F.sum(((F.col("flags") == "SA") & ~F.col("sends")).cast("long")).over(w)
    rows = roles.withColumn("syn_sent", sent).withColumn("synack_received", answered)
    return rows.withColumn("spoofed", (F.col("synack_received") == 0) & (F.col("syn_sent") - F.col("synack_received") >= 3))


def connections(packets: DataFrame, key: Column) -> DataFrame:
    """One row a flow: state from its flags, packets and bytes each way, first and last seen."""
    last = F.max_by("flags", F.struct("ts", "event_id"))
    first_src = F.min_by("src_ip", F.struct("ts", "event_id"))
    flows = packets.withColumn("flow", key)
    ends = flows.groupBy("flow").agg(
        first_src.alias("initiator"), F.count(F.lit(1)).alias("packets"), F.sum("raw_len").cast("long").alias("bytes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), last.alias("last_flags"),
        F.max((F.col("flags") == "S").cast("int")).alias("syn"), F.max((F.col("flags") == "SA").cast("int")).alias("synack"), F.max(F.col("flags").contains("R").cast("int")).alias("rst"), F.max(F.col("flags").contains("F").cast("int")).alias("fin"),
    )
    state = F.when((F.col("rst") == 1) | (F.col("fin") == 1), "CLOSED").when((F.col("syn") == 1) & (F.col("synack") == 1), "ESTABLISHED").when(F.col("synack") == 1, "SYN_RECV").when(F.col("syn") == 1, "SYN_SENT").otherwise("NEW")
    return ends.withColumn("state", state).drop("syn", "synack", "rst", "fin", "last_flags")


def _fresh(batch: pa.RecordBatch, key: list[str]) -> np.ndarray:
    """True at each row whose key differs from the row before; nulls equal nulls and NaN equals NaN."""
    fresh = np.zeros(len(batch), bool)
    fresh[:1] = True
    for name in key:
        column = batch.column(name)
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        apart = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | pc.xor(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(column.type):
            apart &= ~(pc.fill_null(pc.is_nan(a), False).to_numpy(zero_copy_only=False) & pc.fill_null(pc.is_nan(b), False).to_numpy(zero_copy_only=False))
        fresh[1:] |= apart
    return fresh


def fold(df: DataFrame, key: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, np.ndarray], tuple[object, np.ndarray]], flag: str | None = None) -> DataFrame:
    """Scan every key's rows in order: ``step(state, times)`` returns the new state and a mark for each row.

    ``order`` begins with a timestamp, whose microseconds ``times`` are. Marked rows are kept, or all rows with the mark in a
    column ``flag``. Rows are dealt by key and sorted; a key's rows come in one or several Arrow batches and stay in their own
    types, so memory is one batch whatever a key's length, and a null key is a key like others.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            times = batch.column(order[0]).cast(pa.int64()).to_numpy(zero_copy_only=False)
            cuts = np.r_[np.flatnonzero(_fresh(batch, key)), len(batch)].tolist()
            first = [repr(batch.column(k)[0].as_py()) for k in key]
            marks = np.zeros(len(batch), bool)
            for at, to in zip(cuts, cuts[1:], strict=False):
                if at or first != current:
                    state = start()
                state, marks[at:to] = step(state, times[at:to])
            current = [repr(batch.column(k)[len(batch) - 1].as_py()) for k in key]
            yield batch.append_column(flag, pa.array(marks)) if flag else batch.filter(pa.array(marks))

    schema = StructType([*df.schema, StructField(flag, BooleanType())]) if flag else df.schema
    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(scan, schema)


def counter_with_reset(df: DataFrame, key: list[str], ts: str, seconds: float, threshold: int, order: str = "event_id") -> DataFrame:
    """Rows at which a key's count within the last ``seconds`` (closed) reaches ``threshold``; the count then starts again."""
    span = int(seconds * 1_000_000)

    def step(recent: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate([recent, times])
        marks = np.zeros(len(every), bool)
        # rows that end a run of ``threshold`` within the span; a run begins after the last hit
        ends = threshold - 1 + np.flatnonzero(every[threshold - 1 :] - every[: max(0, len(every) - threshold + 1)] <= span)
        begin, at = 0, 0
        while (at := int(np.searchsorted(ends, begin + threshold - 1))) < len(ends):
            marks[ends[at]] = True
            begin = int(ends[at]) + 1
        return every[max(begin, len(every) - threshold + 1) :], marks[len(recent) :]

    return fold(df.select(*key, order, ts), key, [ts, order], lambda: np.empty(0, np.int64), step)


def anchored_rate(df: DataFrame, key: list[str], ts: str, seconds: float, more_than: int, order: str = "event_id") -> DataFrame:
    """Rows beyond ``more_than`` in a window that opens at a key's first row and again at the first row over ``seconds`` later."""
    span = int(seconds * 1_000_000)

    def step(state: tuple[int | None, int], times: np.ndarray) -> tuple[tuple[int, int], np.ndarray]:
        opened, n = state
        marks, at = np.zeros(len(times), bool), 0
        while at < len(times):
            if opened is None or times[at] - opened > span:
                opened, n = int(times[at]), 0
            to = int(np.searchsorted(times, opened + span, "right"))
            marks[max(at, at + more_than - n) : to] = True
            n, at = n + to - at, to
        return (opened, n), marks

    return fold(df.select(*key, order, ts), key, [ts, order], lambda: (None, 0), step)


def cooldown(df: DataFrame, key: list[str], ts: str, seconds: float, order: str = "event_id", strict: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``passed``: a key's first row, then each that comes ``seconds`` or more (over it, if ``strict``) after the last that passed.

    Columns named in ``carry`` come along, so that nothing needs to be joined back.
    """
    span, side = int(seconds * 1_000_000), "right" if strict else "left"

    def step(last: int | None, times: np.ndarray) -> tuple[int, np.ndarray]:
        passed, at = np.zeros(len(times), bool), 0
        if last is not None:
            at = int(np.searchsorted(times, last + span, side))
        while at < len(times):
            passed[at], last = True, int(times[at])
            at = max(at + 1, int(np.searchsorted(times, last + span, side)))
        return last, passed

    return fold(df.select(*key, order, ts, *carry), key, [ts, order], lambda: None, step, "passed")


def throttled(df: DataFrame, key: str, ts: str, size: str, syn: Column, seconds: float = 60.0, packets: float = 100.0, syns: float = 50.0, total: float = 10_000_000.0, order: str = "event_id") -> DataFrame:
    """Rows of a key at which packets, SYNs or bytes per elapsed second of its anchored window exceed their limits.

    A window opens at a key's first row and again at the first row over ``seconds`` later; elapsed time counts as a tenth of a second
    at least. Windows come from a fold over times, the rates from running sums within them.
    """
    opens = fold(df.select(key, order, ts, F.col(size).alias("_size"), syn.cast("long").alias("_syn")), [key], [ts, order], lambda: None, _anchors(seconds), "_opens")
    w = Window.partitionBy(key).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = opens.withColumn("window", F.sum(F.col("_opens").cast("long")).over(w))
    inside = Window.partitionBy(key, "window").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("elapsed", F.greatest((micros(ts) - F.min(micros(ts)).over(inside)) / 1e6, F.lit(0.1)))
    per = {"packets_per_s": F.count(F.lit(1)).over(inside), "syns_per_s": F.sum("_syn").over(inside), "bytes_per_s": F.sum("_size").over(inside)}
    rows = rows.withColumns({name: n / F.col("elapsed") for name, n in per.items()})
    over = (F.col("packets_per_s") > packets) | (F.col("syns_per_s") > syns) | (F.col("bytes_per_s") > total)
    return rows.filter(over).select(order, key, ts, *per)


def _anchors(seconds: float) -> Callable:
    span = int(seconds * 1_000_000)

    def step(opened: int | None, times: np.ndarray) -> tuple[int, np.ndarray]:
        marks, at = np.zeros(len(times), bool), 0 if opened is None else int(np.searchsorted(times, opened + span, "right"))
        while at < len(times):
            marks[at], opened = True, int(times[at])
            at = int(np.searchsorted(times, opened + span, "right"))
        return opened, marks

    return step


def gap_runs(df: DataFrame, key: str, order: list[str], ts: str, short: float, low: float, high: float, most: int, at_least: int, share: float) -> DataFrame:
    """Keys that alternate: runs of short gaps against gaps in [low, high], each frequent enough; keys over ``most`` rows don't count."""
    gaps = with_gaps(df, [key], order, ts).filter("gap is not null")
    kind = F.when(F.col("gap") < short, "burst").when(F.col("gap").between(low, high), "pause").otherwise("other")
    w = Window.partitionBy(key).orderBy(*order)
    runs = gaps.withColumn("kind", kind).withColumn("fresh", (F.col("kind") != F.lag("kind", 1, "").over(w)).cast("long"))
    runs = runs.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "run", "kind").agg(F.count(F.lit(1)).alias("len"))
    per = runs.groupBy(key).agg(
        F.sum("len").alias("gaps"), F.sum(F.when((F.col("kind") == "burst") & (F.col("len") >= 2), 1).otherwise(0)).alias("bursts"), F.sum(F.when(F.col("kind") == "pause", F.col("len")).otherwise(0)).alias("pauses")
    )
    both = F.col("bursts") + F.col("pauses")
    return per.filter((F.col("gaps") < most) & (both >= at_least) & (F.col("bursts") >= share * both) & (F.col("pauses") >= share * both) & (F.col("bursts") > 0))


def unanswered_syns(packets: DataFrame) -> DataFrame:
    """A host's own SYNs while no SYN-ACK has come to it: event_id, ts, source_ip, tcp_seq, spoofed."""
    seen = handshakes(packets, carry=("tcp_seq",)).filter("sends AND flags = 'S' AND synack_received = 0").withColumnRenamed("host", "source_ip")
    return seen.select("event_id", "ts", "source_ip", "tcp_seq", "spoofed")


def slow_loris(packets: DataFrame, last: int = 20, at_least: int = 10, span: float = 0.05, per_second: float = 50.0) -> DataFrame:
    """SYNs of a host, none of which was answered, at which its last ``last`` come at more than ``per_second``; the sample then starts again.

    A sample has ``at_least`` SYNs over ``span`` seconds or more. One answered SYN clears a host for good: its connections complete.
    """
    shortest = int(span * 1_000_000)

    def step(recent: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate([recent, times])
        marks, begin = np.zeros(len(every), bool), 0
        at = np.arange(len(every))
        while begin < len(every):
            # of all rows since the last hit, the first whose sample is large, wide and dense enough
            size = np.minimum(at[begin:] - begin + 1, last)
            width = every[begin:] - every[at[begin:] - size + 1]
            hits = np.flatnonzero((size >= at_least) & (width >= shortest) & (size * 1e6 > per_second * width) & (at[begin:] >= len(recent)))
            if not len(hits):
                break
            begin += int(hits[0]) + 1
            marks[begin - 1] = True
        return every[max(begin, len(every) - last + 1) :], marks[len(recent) :]

    syns = unanswered_syns(packets).select("source_ip", "event_id", "ts")
    return detection(fold(syns, ["source_ip"], ["ts", "event_id"], lambda: np.empty(0, np.int64), step), "slow_loris", "high", "source_ip")


def low_entropy_isn(packets: DataFrame, last: int = 5, at_least: int = 4, small: int = 100, constant: int = 10_000) -> DataFrame:
    """SYNs of a host that looks spoofed whose last sequence numbers repeat, rise by little, or by one constant step; all zero says nothing."""
    w = last_rows(["source_ip"], ["ts", "event_id"], last)
    key = Window.partitionBy("source_ip").orderBy("ts", "event_id")
    # a host's SYNs, answered ones too, so that samples don't skip any
    seen = handshakes(packets, carry=("tcp_seq",)).filter("sends AND flags = 'S'").withColumnRenamed("host", "source_ip")
    seen = seen.withColumn("gap", F.abs(F.col("tcp_seq") - F.lag("tcp_seq").over(key)))
    inner = Window.partitionBy("source_ip").orderBy("ts", "event_id").rowsBetween(-last + 2, 0)
    rows = seen.withColumn("seen", F.count(F.lit(1)).over(w)).withColumn("top", F.max("tcp_seq").over(w)).withColumn("low", F.min("gap").over(inner)).withColumn("high", F.max("gap").over(inner))
    steady = (F.col("high") < small) | ((F.col("low") == F.col("high")) & (F.col("high") < constant))
    return detection(rows.filter((F.col("seen") >= at_least) & (F.col("top") > 0) & steady & F.col("spoofed")), "low_entropy_isn", "high", "source_ip", seen="seen")


def short_connections(packets: DataFrame, shorter: float = 0.5, last: int = 30, at_least: int = 10, short: int = 10) -> DataFrame:
    """Ends of connections at which ``short`` of a host's last ``last`` lived less than ``shorter`` seconds, if no SYN-ACK ever came to it.

    A connection lives from the host's last SYN to its next FIN or RST.
    """
    seen = handshakes(packets).filter("sends").withColumnRenamed("host", "source_ip")
    run = running(["source_ip"], ["ts", "event_id"])
    opened = F.last(F.when(F.col("flags") == "S", micros("ts")), ignorenulls=True).over(run)
    closes = F.col("flags").contains("F") | F.col("flags").contains("R")
    rows = seen.withColumn("lived", (micros("ts") - opened) / 1e6).filter(closes & F.col("lived").isNotNull())
    w = last_rows(["source_ip"], ["ts", "event_id"], last)
    rows = rows.withColumn("seen", F.count(F.lit(1)).over(w)).withColumn("n", F.sum((F.col("lived") < shorter).cast("long")).over(w))
    return detection(rows.filter((F.col("seen") >= at_least) & (F.col("n") >= short) & (F.col("synack_received") == 0)), "short_connection", "medium", "source_ip", n="n")


def session_fragments(lines: DataFrame, classes: tuple[tuple[str, str], ...], text: str, source: str, ts: str = "ts", order: str = "event_id", seconds: float = 30.0, at_least: int = 5) -> DataFrame:
    """The first row at which a source has ``at_least`` texts of a class within the window, once for each source and class.

    A text counts once in each class of which it has a fragment.
    """
    hits = F.filter(F.array(*[F.when(F.col(text).rlike(pattern), F.lit(name)) for name, pattern in classes]), lambda x: x.isNotNull())
    rows = lines.select(order, ts, F.col(source).alias("source_ip"), F.explode(hits).alias("class"))
    crossed = rows.withColumn("n", F.count(F.lit(1)).over(sliding(["source_ip", "class"], ts, seconds))).filter(F.col("n") >= at_least)
    first = F.row_number().over(Window.partitionBy("source_ip", "class").orderBy(ts, order))
    return crossed.withColumn("nth", first).filter("nth = 1").select(order, ts, "source_ip", F.concat(F.lit("session_correlated_"), F.col("class"), F.lit("_attack")).alias("attack_type"), F.lit("high").alias("severity"))


def fragment_sets(packets: DataFrame, storm: int = 64, tiny: int = 100, oversize: int = 65_535) -> DataFrame:
    """Fragments by what their set (source, destination, id, protocol) has become: storm (the count starts again), overlap, tiny, oversize.

    A fragment overlaps if its offset was there before or lies inside the set's first fragment; tiny is a fragment under ``tiny``
    bytes with more to come; a tcp set is oversize beyond ``oversize`` bytes.
    """
    key = ["src_ip", "dst_ip", "ip_id", "protocol"]
    w = running(key, ["ts", "event_id"])
    rows = packets.filter("frag_offset > 0 OR more_fragments").withColumn("nth", F.count(F.lit(1)).over(w)).withColumn("total", F.sum("payload_len").over(w))
    again = F.row_number().over(Window.partitionBy(*key, "frag_offset").orderBy("ts", "event_id")) > 1
    rows = rows.withColumn("again", again).withColumn("first_end", F.first(F.col("frag_offset") + F.col("payload_len")).over(w))
    kind = (
        F.when(F.col("nth") % (storm + 1) == 0, "fragment_storm")
        .when((F.col("nth") > 1) & (F.col("again") | (F.col("frag_offset") < F.col("first_end"))), "fragment_overlap")
        .when((F.col("payload_len") < tiny) & F.col("more_fragments"), "tiny_fragment")
        .when((F.col("total") > oversize) & (F.col("protocol") == "tcp"), "fragment_oversize")
    )
    return detection(rows.withColumn("kind", kind).filter("kind is not null"), F.col("kind"), F.lit("medium"))


def printable_deltas(packets: DataFrame, of: str, last: int = 25, at_least: int = 8, most_distinct: float = 0.6) -> DataFrame:
    """Rows whose source's last ``last`` deltas of a number's low byte hold ``at_least`` printable ones of few distinct values."""
    key = Window.partitionBy("src_ip").orderBy("ts", "event_id")
    low = F.pmod(F.col(of), F.lit(256))
    rows = packets.withColumn("delta", F.pmod(low - F.lag(low).over(key), F.lit(256))).filter("delta is not null")
    recent = F.filter(F.collect_list("delta").over(last_rows(["src_ip"], ["ts", "event_id"], last)), lambda d: d.between(32, 126))
    rows = rows.withColumn("_p", recent).withColumn("printable", F.size("_p")).withColumn("distinct", F.size(F.array_distinct("_p")))
    return rows.filter((F.col("printable") >= at_least) & (F.col("distinct") <= most_distinct * F.col("printable")))


def fragment_faults(packets: DataFrame, most: int = 64, tiny: int = 100, oversize: int = 65_535) -> DataFrame:
    """Everything that a fragment shows about its set (source, destination, id, protocol): event_id, ts, source_ip, attack_type, severity, reason.

    Beyond ``most`` fragments it is a storm (high) and the set begins anew with the next. Overlaps (high) are an offset met before in the
    set, and an offset before the end of the set's first fragment; both hold on once they are met. A fragment under ``tiny`` bytes with more to
    come is tiny (medium); a tcp set of more than ``oversize`` bytes is oversize (critical). A fragment's length is its payload's, or
    the packet's where that is 0 or null.
    """
    key = ["src_ip", "dst_ip", "ip_id", "protocol"]
    length = F.when(F.coalesce("payload_len", F.lit(0)) != 0, F.col("payload_len")).otherwise(F.coalesce("raw_len", F.lit(0)))
    more = F.coalesce("more_fragments", F.lit(False)) | F.coalesce(F.col("flags").contains("M"), F.lit(False))
    rows = packets.withColumn("_at", F.coalesce("frag_offset", F.lit(0))).withColumn("_len", length).withColumn("_more", more).filter((F.col("_at") != 0) | F.col("_more"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("ts", "event_id")) - 1
    rows = rows.withColumn("_set", F.floor(nth / (most + 1))).withColumn("_nth", nth % (most + 1) + 1)
    w = running([*key, "_set"], ["ts", "event_id"])
    again = F.row_number().over(Window.partitionBy(*key, "_set", "_at").orderBy("ts", "event_id")) > 1
    rows = rows.withColumn("_again", again).withColumn("_end", F.first(F.col("_at") + F.col("_len")).over(w))
    rows = rows.withColumn("_repeated", F.max("_again").over(w)).withColumn("_inside", F.max((F.col("_nth") > 1) & (F.col("_at") < F.col("_end"))).over(w)).withColumn("_total", F.sum("_len").over(w))
    fault = lambda test, kind, severity, reason: F.when(test, F.struct(F.lit(kind).alias("attack_type"), F.lit(severity).alias("severity"), F.lit(reason).alias("reason")))
    found = F.array(
        fault(F.col("_nth") > most, "fragment_storm", "high", "count"),
        fault(F.col("_repeated"), "fragment_overlap", "high", "repeated offset"),
        fault(F.col("_inside"), "fragment_overlap", "high", "inside the first"),
        fault((F.col("_len") < tiny) & F.col("_more"), "tiny_fragment", "medium", "length"),
        fault((F.col("_total") > oversize) & (F.col("protocol") == "tcp"), "fragment_oversize", "critical", "total"),
    )
    rows = rows.withColumn("_f", F.explode(F.filter(found, lambda x: x.isNotNull())))
    return rows.select("event_id", "ts", F.col("src_ip").alias("source_ip"), "_f.attack_type", "_f.severity", "_f.reason")


def beside_recent(rows: DataFrame, key: str, value: str, at: str, order: list[str], seconds: float, most: int = 1000) -> DataFrame:
    """``outlier``: a whole number over three sample deviations from the mean of its key's values of the last ``seconds`` before it, the newest ``most`` of them.

    There must be three such values; where they are all the same, any other is an outlier. ``at`` is the time in microseconds. Sums are whole numbers, so
    that any engine finds the same, and are differences of running ones: a row costs the same however many lie in its window.
    """
    values = {"n": F.col(value).isNotNull().cast("long"), "s": F.coalesce(F.col(value), F.lit(0)).cast("long"), "q": F.coalesce(F.col(value) * F.col(value), F.lit(0)).cast("long")}
    # sums before each row and, for those of the newest rows, less the sums before the first of them
    ordered = Window.partitionBy(key).orderBy(*order)
    before = lambda c: F.coalesce(F.sum(c).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", F.struct(*[before(c).alias(name) for name, c in values.items()]))
    first = F.lag("_before", most).over(ordered)
    rows = rows.withColumn("_newest", F.struct(*[(F.col(f"_before.{c}") - F.coalesce(first[c], F.lit(0))).alias(c) for c in values]))
    # a row's values enter with it and leave once it is older than the window; rows without a time are each other's neighbours and never leave
    span = int(seconds * 1e6)
    enters = F.struct(F.col(at).alias("at"), *[c.alias(name) for name, c in values.items()], F.lit(True).alias("row"))
    leaves = F.when(F.col(at).isNotNull(), F.struct((F.col(at) + span).alias("at"), *[(-c).alias(name) for name, c in values.items()], F.lit(False).alias("row")))
    rows = rows.withColumn("_m", F.explode(F.filter(F.array(enters, leaves), lambda m: m.isNotNull())))
    marks = Window.partitionBy(key, F.col(at).isNull()).orderBy(F.col("_m.at")).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_near", F.struct(*[F.coalesce(F.sum(f"_m.{c}").over(marks), F.lit(0)).alias(c) for c in values])).filter("_m.row")
    rows = rows.withColumn("_x", F.when(F.col("_near.n") > most, F.col("_newest")).otherwise(F.col("_near")))
    n, total, squares = (F.col(f"_x.{c}") for c in ("n", "s", "q"))
    # n (n - 1) times the variance, and n times the value's distance from the mean
    spread, off = n * squares - total * total, F.abs(n * F.col(value) - total)
    found = (n >= 3) & F.when(spread > 0, off * F.sqrt(n - 1) > 3 * F.sqrt(n * spread)).otherwise(off > 0)
    return rows.withColumn("outlier", found).drop("_before", "_near", "_newest", "_m", "_x")


def covert_ttls(packets: DataFrame, last: int = 15, kinds: int = 6, seconds: float = 300.0, baseline: int = 1000) -> DataFrame:
    """Rows at which a host's last ``last`` ttls are of ``kinds`` values or more and the row's own is an outlier."""
    order = ["ts", "event_id"]
    rows = packets.filter("ttl is not null").withColumn("_b", F.col("ttl").cast("long")).withColumn("_t", micros("ts"))
    rows = rows.withColumn("_seen", F.collect_list("_b").over(last_rows(["src_ip"], order, last)))
    # lists end before rows are sorted once more
    rows = rows.withColumn("_shown", (F.size("_seen") >= last) & (F.size(F.array_distinct("_seen")) >= kinds)).drop("_seen")
    hit = beside_recent(rows, "src_ip", "_b", "_t", order, seconds, baseline).filter("_shown AND outlier")
    return detection(hit, "ttl_covert_channel", "medium")


def covert_numbers(packets: DataFrame, of: str, attack_type: str, printable: int, where: str = "true", last: int = 25, samples: int = 10, seconds: float = 300.0, baseline: int = 1000) -> DataFrame:
    """Rows at which the low bytes of a host's numbers look like text: event_id, ts, source_ip, attack_type, severity, text.

    Of the differences (modulo 256) between the last ``last`` low bytes, ``printable`` at least are printable, and the last so many of those
    have few distinct values (0.7 of them, or three); and the byte itself is an outlier: over three sample deviations from the mean
    of those of the last ``seconds`` before it, ``baseline`` at most, of which there are three or more.
    """
    order = ["ts", "event_id"]
    rows = packets.filter(where).withColumn("_b", F.pmod(F.col(of), F.lit(256)).cast("long")).withColumn("_t", micros("ts"))
    rows = rows.withColumn("_seen", F.collect_list("_b").over(last_rows(["src_ip"], order, last)))
    deltas = F.filter(F.zip_with(F.slice("_seen", 2, last), F.slice("_seen", 1, F.greatest(F.size("_seen") - 1, F.lit(0))), lambda b, a: F.pmod(b - a, F.lit(256))), lambda d: d.between(32, 126))
    rows = rows.withColumn("_p", deltas).withColumn("_shown", (F.size("_seen") >= samples) & (F.size("_p") >= printable)).withColumn("_p", F.when(F.col("_shown"), F.slice("_p", -printable, printable)))
    rows = rows.withColumn("_shown", F.col("_shown") & (F.size(F.array_distinct("_p")) <= max(3.0, 0.7 * printable)))
    # lists end before rows are sorted once more
    rows = rows.withColumn("_text", F.when(F.col("_shown"), F.array_join(F.transform("_p", lambda d: F.char(d)), ""))).drop("_seen", "_p")
    hit, text = beside_recent(rows, "src_ip", "_b", "_t", order, seconds, baseline).filter("_shown AND outlier"), F.col("_text")
    return hit.select("event_id", "ts", F.col("src_ip").alias("source_ip"), F.lit(attack_type).alias("attack_type"), F.lit("high").alias("severity"), text.alias("text"))


def perplexity(tokens: DataFrame, flow: str, order: list[str], token: str, smoothing: float = 0.01, more_than: float = 100.0, decay: Column | None = None, by_contexts: bool = False) -> DataFrame:
    """Trigram perplexity of every flow, and whether it is over ``more_than``: counts over the table, add-``smoothing`` probabilities.

    ``by_contexts``: smoothing spreads over all contexts counted, and one more, instead of over the vocabulary: (n3 + s) / (n2 + s T + 1). With ``decay`` (a weight for each row, by its age) older grams count less. Grams are counted a flow first, so that a
    common one is not gathered row by row, and the tables of distinct grams are joined, whichever way their sizes allow.
    """
    w = Window.partitionBy(flow).orderBy(*order)
    weight = F.lit(1.0) if decay is None else decay
    grams = tokens.select(flow, F.lag(token, 2).over(w).alias("a"), F.lag(token, 1).over(w).alias("b"), F.col(token).alias("c"), weight.alias("w")).filter("a is not null and b is not null")
    size = tokens.select(F.countDistinct(token).alias("vocabulary"))
    per = grams.groupBy(flow, "a", "b", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    three = per.groupBy("a", "b", "c").agg(F.sum("w").alias("n3"))
    two = three.groupBy("a", "b").agg(F.sum("n3").alias("n2"))
    # one row
    scored = per.join(three.join(two, ["a", "b"]), ["a", "b", "c"]).join(F.broadcast(size))
    if by_contexts:
        scored = scored.join(F.broadcast(two.agg(F.sum("n2").alias("contexts"))))
    room = smoothing * F.col("contexts") + 1 if by_contexts else smoothing * F.col("vocabulary")
    p = F.greatest((F.col("n3") + smoothing) / (F.col("n2") + room), F.lit(1e-10))
    flows = scored.groupBy(flow).agg((-F.sum(F.col("n") * F.log(p)) / F.sum("n")).alias("surprise"), F.sum("n").alias("n"))
    return flows.select(flow, F.exp("surprise").alias("perplexity"), "n", (F.exp("surprise") > more_than).alias("anomalous"))
