"""Folds over a key's rows in order that carry values, one definition for tables and for streams.

A fold is a start state and a step: ``step(state, rows)`` gets some rows of one key, in order, as tuples (t, order, *values)
with t in microseconds, and returns the new state and what it reports, a tuple for each report. A state is of lists, numbers,
texts and None, so a stream can store it. ``fold_rows`` runs it over a table, ``streaming.ordered`` over a stream.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .windowed import cooldown, micros, sliding

State = list
Step = Callable[[State, list[tuple]], tuple[State, list[tuple]]]


@dataclass(frozen=True)
class Fold:
    """``columns`` are the values that a step gets, ``reports`` the schema of what it returns, ``idle`` the seconds after which a key's state says nothing any more."""

    columns: tuple[str, ...]
    reports: str
    start: Callable[[], State]
    step: Step
    idle: float | None = None


def fold_rows(df: DataFrame, key: str, ts: str, order: str, fold: Fold) -> DataFrame:
    """key and the fold's reports, for every key; a null key is a key like others.

    Rows are dealt by key and sorted; a key's rows come in one or several Arrow batches, so memory is a batch and a state.
    """
    names = ["_k", "_t", "_o", *[f"_v{i}" for i in range(len(fold.columns))]]
    rows = df.select(F.col(key).alias("_k"), micros(ts).alias("_t"), F.col(order).alias("_o"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(fold.columns)])
    schema = StructType([rows.schema["_k"], *_parse_datatype_string(fold.reports)])
    schema.fields[0].name, schema.names[0] = key, key
    kinds = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, current, state = False, None, None
        for batch in batches:
            found: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in names]
            at = 0
            while at < len(batch):
                to, own = at + 1, columns[0][at]
                while to < len(batch) and columns[0][to] == own:
                    to += 1
                if not begun or own != current:
                    begun, current, state = True, own, fold.start()
                state, reports = fold.step(state, list(zip(*(c[at:to] for c in columns[1:]), strict=True)))
                found += [(own, *r) for r in reports]
                at = to
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kinds.field(i).type) for i in range(len(kinds))], schema=kinds)

    return rows.repartition("_k").sortWithinPartitions("_k", "_t", "_o").mapInArrow(scan, schema)


def gate(seconds: float) -> Fold:
    """Rows that pass a cooldown: a key's first, then each ``seconds`` or more after the last that passed."""
    span = int(seconds * 1_000_000)

    def step(state: State, rows: list[tuple]) -> tuple[State, list[tuple]]:
        out = []
        for t, order in rows:
            if not state or t - state[0] >= span:
                state = [t]
                out.append((t, order))
        return state, out

    return Fold((), "t long, event_id long", list, step, seconds)


def beside_own_past(at_least: int, sigmas: float) -> Fold:
    """Counts more than ``sigmas`` population deviations from the mean of a key's counts before, of which there are ``at_least``: day, n, z.

    Deviations are Welford's, row by row in order: where a z lies on the limit itself, its last bit depends on how they are summed up.
    """

    def step(state: State, rows: list[tuple]) -> tuple[State, list[tuple]]:
        k, total, mean, squares = state
        out = []
        for _, _, day, n in rows:
            sd = math.sqrt(squares / k) if k else 0.0
            z = abs(n - total / k) / sd if sd > 0 else 0.0
            if k >= at_least and z > sigmas:
                out.append((day, n, z))
            k, total, off = k + 1, total + n, n - mean
            mean += off / k
            squares += off * (n - mean)
        return [k, total, mean, squares], out

    return Fold(("day", "n"), "day date, n long, z double", lambda: [0, 0, 0.0, 0.0], step)


def counter(seconds: float, threshold: int) -> Fold:
    """Rows at which a key's count within the last ``seconds`` (closed) reaches ``threshold``; the count then starts again."""
    span = int(seconds * 1_000_000)

    def step(state: State, rows: list[tuple]) -> tuple[State, list[tuple]]:
        out = []
        for t, order in rows:
            state = [x for x in state if x >= t - span] + [t]
            if len(state) >= threshold:
                state = []
                out.append((t, order))
        return state, out

    return Fold((), "t long, event_id long", list, step, seconds)


def standing_block() -> Fold:
    """Events of a source while its last block stands. Rows carry ``ttl``: a block's seconds (0 lifts it), null for an event.

    A block replaces the one before it; from its end on the source is free. Rows of one moment go by their order.
    """

    def step(state: State, rows: list[tuple]) -> tuple[State, list[tuple]]:
        out = []
        for t, order, ttl in rows:
            if ttl is not None:
                state = [t + int(ttl * 1_000_000)] if ttl > 0 else []
            elif state and t < state[0]:
                out.append((t, order, state[0]))
            elif state:
                state = []
        return state, out

    return Fold(("ttl",), "t long, event_id long, until long", list, step)


def cached_intel(ttl: float, malicious_from: int = 50) -> Fold:
    """What is known of a source at each of its events: the highest score of its providers' newest rows not older than ``ttl``.

    Rows with a ``provider`` bring a score and a word (abuse_score, malicious), others ask. Malicious if any provider says so or
    the score reaches ``malicious_from``; nothing known gives no report.
    """
    span = int(ttl * 1_000_000)

    def step(state: State, rows: list[tuple]) -> tuple[State, list[tuple]]:
        out = []
        for t, order, provider, score, malicious in rows:
            if provider is not None:
                state = [x for x in state if x[0] != provider] + [[provider, t, score, bool(malicious)]]
                continue
            state = [x for x in state if t - x[1] < span]
            if state:
                top = max(x[2] or 0 for x in state)
                out.append((t, order, top, top >= malicious_from or any(x[3] for x in state)))
        return state, out

    return Fold(("provider", "abuse_score", "malicious"), "t long, event_id long, abuse_score int, malicious boolean", list, step, ttl)


def distinct_then_reset(at_least: int) -> Fold:
    """Rows at which a key has shown ``at_least`` distinct values; it then starts again. Nulls don't count."""

    def step(state: State, rows: list[tuple]) -> tuple[State, list[tuple]]:
        out = []
        for t, order, value in rows:
            if value is None or value in state:
                continue
            state = [*state, value]
            if len(state) >= at_least:
                state = []
                out.append((t, order))
        return state, out

    return Fold(("value",), "t long, event_id long", list, step)


def learned_baseline(sigmas: float = 3.0, warm: int = 5, settled: int = 50, least_sigma: float = 0.001) -> Fold:
    """Deviations of two measures from a baseline that learns: mean and deviation of the values taken in so far (Welford).

    A value is judged before it is taken in; with fewer than ``warm`` values, or a deviation under ``least_sigma``, it deviates by 0. Both are
    taken in while there are fewer than ``settled``, later only where the first deviates by less than ``sigmas``.
    """

    def deviation(n: int, mean: float, m2: float, value: float) -> float:
        sigma = (m2 / n) ** 0.5 if n > 1 else 0.0
        return (value - mean) / sigma if n >= warm and sigma >= least_sigma else 0.0

    def step(state: State, rows: list[tuple]) -> tuple[State, list[tuple]]:
        n, a, a2, b, b2 = state
        out = []
        for t, order, first, second in rows:
            z1, z2 = deviation(n, a, a2, first), deviation(n, b, b2, second)
            out.append((t, order, first, second, z1, z2, n))
            if n < settled or abs(z1) < sigmas:
                n += 1
                d1, d2 = first - a, second - b
                a, b = a + d1 / n, b + d2 / n
                a2, b2 = a2 + d1 * (first - a), b2 + d2 * (second - b)
        return [n, a, a2, b, b2], out

    return Fold(("first", "second"), "t long, event_id long, first double, second double, first_z double, second_z double, learned long", lambda: [0, 0.0, 0.0, 0.0, 0.0], step)


def baseline_anomalies(packets: DataFrame, key: str, ts: str, size: str, window: float = 60.0, every: float = 5.0, at_least: int = 10, sigmas: float = 3.0, order: str = "event_id", **learning) -> DataFrame:
    """Packets and bits a second of a host against its own baseline: order, ts, source_ip, attack_type, severity, z.

    A host is judged at its first packet and again ``every`` seconds or more after the last time, over the last ``window`` seconds, if
    they hold ``at_least`` packets. Beyond ``sigmas`` deviations it is an anomaly, medium, from five on high; see ``learned_baseline``.
    """
    w = sliding([key], ts, window)
    rows = packets.filter(F.col(key).isNotNull() & (F.col(key) != "")) if dict(packets.dtypes)[key] == "string" else packets.filter(F.col(key).isNotNull())
    rows = rows.select(key, order, ts, F.count(F.lit(1)).over(w).alias("_n"), (F.sum(size).over(w) * 8 / window).alias("second"))
    rows = rows.withColumn("first", F.col("_n") / window)
    judged = cooldown(rows, [key], ts, every, order, carry=("_n", "first", "second")).filter(F.col("passed") & (F.col("_n") >= at_least))
    z = fold_rows(judged, key, ts, order, learned_baseline(sigmas, **learning))
    kinds = F.array(F.struct(F.lit("baseline_pps_anomaly").alias("attack_type"), F.col("first_z").alias("z")), F.struct(F.lit("baseline_bps_anomaly").alias("attack_type"), F.col("second_z").alias("z")))
    found = z.withColumn("k", F.explode(kinds)).filter(F.abs("k.z") > sigmas)
    severity = F.when(F.abs("k.z") < 5, "medium").otherwise("high")
    return found.select(F.col("event_id").alias(order), F.timestamp_micros("t").alias(ts), F.col(key).alias("source_ip"), "k.attack_type", severity.alias("severity"), "k.z")


def consumed(df: DataFrame, key: str, ts: str, opens: Column, closes: Column, seconds: float, order: str = "event_id") -> DataFrame:
    """Closing rows that answer an open one of their key less than ``seconds`` before; each open row is answered once.

    An open row is forgotten when another comes, and taken by the first closing row after it: so a closing row answers exactly if
    the row of either kind before it is an open one, near enough. No state is needed.
    """
    kind = F.when(opens, 1).when(closes, 2)
    rows = df.select(key, ts, order, kind.alias("kind")).filter("kind is not null")
    w = Window.partitionBy(key).orderBy(ts, "kind", order)
    rows = rows.withColumn("before", F.lag(F.struct("kind", micros(ts).alias("t"), F.col(order).alias("of"))).over(w))
    found = rows.filter((F.col("kind") == 2) & (F.col("before.kind") == 1) & (micros(ts) - F.col("before.t") < int(seconds * 1e6)))
    return found.select(order, key, ts, F.col("before.of").alias("opened_by"))


_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "CONNECT", "TRACE")
_LENGTH = re.compile(r"^content-length:[ \t]*([^\r\n]*)", re.IGNORECASE | re.MULTILINE)
#: Half of the sequence numbers: what lies farther ahead is behind.
_HALF = 1 << 31


def cut_messages(buffer: bytes, known_port: bool) -> tuple[list[bytes], bytes]:
    """Whole messages at the buffer's start, by header end and content-length, and what is left.

    On other ports than those of the web a buffer must begin like a request or name HTTP/ in its first 64 bytes.
    """
    found: list[bytes] = []
    if not known_port and (len(buffer) < 4 or buffer[:16].split(b" ")[0].decode("latin-1") not in _METHODS and b"HTTP/" not in buffer[:64]):
        return found, buffer
    while (end := buffer.find(b"\r\n\r\n")) >= 0:
        size = end + 4
        for value in _LENGTH.findall(buffer[:end].decode("latin-1")):
            text = value.split(":")[0].strip()
            if not text.lstrip("+").isdigit():
                break
            size = end + 4 + int(text)
        if len(buffer) < size:
            break
        found.append(buffer[:size])
        buffer = buffer[size:]
    return found, buffer


def assembled(ports: tuple[int, ...], reorder: bool = False, most_held: int = 1 << 20) -> Fold:
    """Messages of one direction of a flow, from segments (seq, payload, port) in order of arrival.

    As they arrive, a segment at or beyond the next sequence number is appended, gaps or not; others are dropped. With ``reorder``
    the first segment sets the beginning, numbers wrap at 2**32, what overlaps is trimmed, and segments ahead are held until the
    gap before them is filled; beyond ``most_held`` bytes held the gap is given up, so a flow's memory is bounded.
    Every message is reported with the row that completes it: its number in the flow, length and text.
    """

    def step(state: State, rows: list[tuple]) -> tuple[State, list[tuple]]:
        following, text, held, made = state
        buffer, out = text.encode("latin-1"), []
        for t, order, seq, payload, port in rows:
            if not payload or seq is None:
                continue
            body = bytes(payload)
            if not reorder:
                if seq < (following or 0):
                    continue
                buffer, following = buffer + body, seq + len(body)
            else:
                following = seq if following is None else following
                held = [*held, [(seq - following) % (1 << 32), body.decode("latin-1")]]
                held = [[at - (1 << 32) if at >= _HALF else at, x] for at, x in held]
                while held:
                    held.sort(key=lambda x: x[0])
                    if held[0][0] > 0 and sum(len(x) for _, x in held) <= most_held:
                        break
                    at, x = held.pop(0)
                    new = x[-at:] if at < 0 else x
                    if at < 0 and -at >= len(x):
                        continue
                    gained = max(at, 0) + len(new)
                    buffer, following = buffer + new.encode("latin-1"), (following + gained) % (1 << 32)
                    held = [[a - gained, y] for a, y in held]
            messages, buffer = cut_messages(buffer, port in ports)
            for m in messages:
                made += 1
                out.append((t, order, made, len(m), m))
        return [following, buffer.decode("latin-1"), held, made], out

    return Fold(("seq", "payload", "port"), "t long, event_id long, nth long, length long, message binary", lambda: [None, "", [], 0], step, 300.0)


def first_crossing(names: tuple[str, ...], seconds: float = 30.0, at_least: int = 5) -> Fold:
    """A source's first row with ``at_least`` rows of a class in the window (t - seconds, t], once for each class.

    Rows carry the classes of their text (places in ``names``). A row's classes are tried in order; the first that crosses is reported, and
    the row's classes after it are not counted. Classes reported before don't count at all.
    """
    span = int(seconds * 1_000_000)

    def step(state: State, rows: list[tuple]) -> tuple[State, list[tuple]]:
        state, out = [None if x is None else list(x) for x in state], []
        for t, order, classes in rows:
            for c in classes or ():
                if state[c] is None:
                    continue
                # the last few times are all that a later row can need
                state[c] = [x for x in state[c] if t - x < span][-at_least:] + [t]
                if len(state[c]) >= at_least:
                    state[c] = None
                    out.append((t, order, names[c]))
                    break
        return state, out

    return Fold(("classes",), "t long, event_id long, class string", lambda: [[] for _ in names], step)


def stored(state: State) -> str:
    return json.dumps(state)


def restored(text: str) -> State:
    return json.loads(text)
