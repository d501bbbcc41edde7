"""Suppression, correlation and verdicts."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ipv4_number, ipv6_hex, is_actionable, severity_norm, severity_rank
from .windowed import cooldown, micros

# Types that content networks cause and that don't count from there, and those of private networks.
CDN_NOISE = ("broadcast_storm", "timing_evasion", "port_scan", "session_correlated_sql_attack", "session_correlated_cmd_attack")
PRIVATE_NOISE = ("broadcast_storm",)
#: Rows of a range list that is held in arrays, beyond which it is joined; stretches of addresses that become one expression, beyond which they are searched in arrays.
MOST_RANGES, EXPRESSED = 200_000, 256
#: Bits of a dotted address's number (any three digits a part) and of an IPv6 address; bits of a prefix that is joined by broadcast, as many addresses share it.
BITS4, BITS6, SHORT = 34, 128, 13


def stretches(ranges: list[tuple[int, int, str | None]]) -> tuple[list[int], list[str | None]]:
    """Starts of disjoint stretches, ascending from 0, and their labels: that of the first of ``ranges`` (lo, hi, label) that holds them."""
    edges = sorted([(lo, 1, i) for i, (lo, _, _) in enumerate(ranges)] + [(hi + 1, 0, i) for i, (_, hi, _) in enumerate(ranges)])
    starts, labels, open_, gone = [0], [None], [], set()
    at = 0
    while at < len(edges):
        where = edges[at][0]
        while at < len(edges) and edges[at][0] == where:
            _, opens, i = edges[at]
            heapq.heappush(open_, i) if opens else gone.add(i)
            at += 1
        while open_ and open_[0] in gone:
            heapq.heappop(open_)
        label = ranges[open_[0]][2] if open_ else None
        if where == starts[-1]:
            labels[-1] = label
        elif label != labels[-1]:
            starts.append(where)
            labels.append(label)
    return starts, labels


def _search(value: Column, starts: list, labels: list[str | None]) -> Column:
    """The label of the last start at or below the value, by halving: an expression of a depth of log2 of the stretches."""

    def half(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(labels[lo])
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(starts[mid]), half(mid, hi)).otherwise(half(lo, mid))

    return F.when(value.isNotNull(), half(0, len(starts)).cast("string"))


def _covered(lo: pd.Series, hi: pd.Series, width: pd.Series) -> pd.Series:
    """The largest aligned blocks of addresses that make up a range (hex digits), as bits of their prefixes."""

    def blocks(at: int, end: int, bits: int) -> list[str]:
        found, end = [], min(end, (1 << bits) - 1)
        while at <= end:
            size = min((at & -at).bit_length() - 1 if at else bits, (end - at + 1).bit_length() - 1)
            found.append(format(at, f"0{bits}b")[: bits - size])
            at += 1 << size
        return found

    return pd.Series([blocks(int(a, 16), int(b, 16), w) for a, b, w in zip(lo, hi, width, strict=True)])


def _joined_label(df: DataFrame, ip: str, ranges: DataFrame, disabled: tuple[str, ...]) -> DataFrame:
    """``range_label`` by joins, for lists of any length.

    Ranges become aligned blocks of addresses, twice as many as an address has bits at most, of equal blocks the one first in the list; an address meets the blocks
    that have one of its prefixes. Each distinct address is searched once. Blocks of short prefixes, of which there are few, are broadcast.
    """
    four = ranges.filter("lo is not null and hi >= 0").select("ord", "label", F.hex(F.greatest("lo", F.lit(0).cast("long"))).alias("a"), F.hex("hi").alias("b"), F.lit(BITS4).alias("width"), F.lit("4").alias("family"))
    six = ranges.filter("lo6 is not null").select("ord", "label", F.col("lo6").alias("a"), F.col("hi6").alias("b"), F.lit(BITS6).alias("width"), F.lit("6").alias("family"))
    cut = four.unionByName(six).select("ord", "label", "family", F.explode(F.pandas_udf(_covered, "array<string>")("a", "b", "width")).alias("prefix"))
    blocks = cut.groupBy(F.concat("family", "prefix").alias("block")).agg(F.min(F.struct("ord", "label")).alias("first"))

    digits = F.regexp_replace(F.substring(ipv6_hex(F.col("_ip")), 1, 32), "[^0-9a-f]", "0")
    bits6 = F.concat(F.lit("6"), *[F.lpad(F.bin(F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long")), 32, "0") for i in range(4)])
    bits4 = F.concat(F.lit("4"), F.lpad(F.bin(ipv4_number(F.col("_ip"))), BITS4, "0"))
    known = df.select(F.col(ip).alias("_ip")).distinct().withColumn("_bits", F.coalesce(bits4, bits6)).filter("_bits is not null")
    met = lambda lengths: known.select("_ip", F.explode(F.transform(lengths, lambda n: F.substring(F.col("_bits"), F.lit(1), n))).alias("block"))
    few = met(F.sequence(F.lit(1), F.lit(SHORT + 1))).join(F.broadcast(blocks.filter(F.length("block") <= SHORT + 1)), "block")
    many = met(F.sequence(F.lit(SHORT + 2), F.length("_bits"))).join(blocks.filter(F.length("block") > SHORT + 1), "block")
    found = few.unionByName(many).groupBy("_ip").agg(F.min("first").alias("_first")).select("_ip", F.col("_first.label").alias("_label"))
    label = F.when(F.col("_label").isin(*disabled), None).otherwise(F.col("_label")) if disabled else F.col("_label")
    return df.join(found, F.col(ip) == F.col("_ip"), "left").withColumn("label", label).drop("_ip", "_label")


def range_label(df: DataFrame, ip: str, ranges: DataFrame, disabled: tuple[str, ...] = (), expressed: int = EXPRESSED, most: int = MOST_RANGES) -> DataFrame:
    """``label``: that of the first range, in list order, that holds the address; null for none.

    A range with a disabled label ends the search without a label. A list of up to ``most`` ranges is cut into disjoint stretches of
    addresses, sorted; a row's stretch is found by halving, in an expression while there are few, in broadcast arrays beyond: nothing
    is shuffled, and a row's cost grows with the logarithm of the list. Longer lists stay with Spark: ``_joined_label``.
    """
    if ranges.limit(most + 1).count() > most:
        return _joined_label(df, ip, ranges, disabled)
    listed = ranges.orderBy("ord", "label").collect()
    label = lambda r: None if r.label in disabled else r.label
    four = stretches([(int(r.lo), int(r.hi), label(r)) for r in listed if r.lo is not None])
    six = stretches([(int(r.lo6, 16), int(r.hi6, 16), label(r)) for r in listed if r.lo6 is not None])
    hexes = [format(x, "032x") for x in six[0]]
    # an array of one, so that the address is read once and filters on the label stay above
    rows = df.withColumn("_a", F.explode(F.array(F.struct(ipv4_number(F.col(ip)).alias("n"), ipv6_hex(F.col(ip)).alias("h")))))
    if len(four[0]) + len(hexes) <= expressed:
        found = F.coalesce(_search(F.col("_a.n"), *four), _search(F.col("_a.h"), hexes, six[1]))
        return rows.withColumn("label", F.explode(F.array(found))).drop("_a")
    held = df.sparkSession.sparkContext.broadcast((np.array(four[0], np.int64), np.array([*four[1], None], object), np.array(hexes, "S32"), np.array([*six[1], None], object)))

    @F.pandas_udf("string")
    def look_up(n: pd.Series, h: pd.Series) -> pd.Series:
        starts, labels, starts6, labels6 = held.value
        known, known6 = n.notna().to_numpy(), h.notna().to_numpy()
        at = np.where(known, np.searchsorted(starts, n.fillna(0).to_numpy(np.int64), "right") - 1, len(labels) - 1)
        at6 = np.where(known6, np.searchsorted(starts6, h.fillna("").to_numpy(str).astype("S32"), "right") - 1, len(labels6) - 1)
        return pd.Series(np.where(known, labels[at], labels6[at6]), dtype=object)

    return rows.withColumn("label", look_up("_a.n", "_a.h")).drop("_a")


def drop_noise(detections: DataFrame, ip: str = "source_ip", cdn_types: tuple[str, ...] = CDN_NOISE, private_types: tuple[str, ...] = PRIVATE_NOISE) -> DataFrame:
    """Without what content networks cause; private addresses lose broadcast_storm alone."""
    cdn = F.col("label").isin("cloudflare", "google", "aws") & F.col("attack_type").isin(*cdn_types)
    private = (F.col("label") == "private") & F.col("attack_type").isin(*private_types)
    return detections.filter(~F.coalesce(cdn | private, F.lit(False)))


def protect(actions: DataFrame, own: list[str], ip: str = "source_ip") -> DataFrame:
    """``action``: blocks of protected addresses become refused."""
    return actions.withColumn("action", F.when((F.col("action") == "block") & F.col(ip).isin(*own), "refused").otherwise(F.col("action")))


def solicited(packets: DataFrame, flow: Column, own: Column, idle: float) -> DataFrame:
    """``solicited``: an inbound packet of a flow session that we opened earlier; sessions end after ``idle`` seconds."""
    w = Window.partitionBy("flow").orderBy("ts", "event_id")
    rows = packets.withColumn("flow", flow).withColumn("own", own)
    fresh = F.coalesce(micros("ts") - F.lag(micros("ts")).over(w) > int(idle * 1e6), F.lit(True))
    rows = rows.withColumn("fresh", fresh.cast("long")).withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("flow", "session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("solicited", ~F.col("own") & F.coalesce(F.max(F.col("own").cast("int")).over(before) == 1, F.lit(False))).drop("fresh")


def dampen(reports: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Per (source, type): unconfirmed reports, whether damped (3 or more), and the type's multiplier: 1, 1.5, at 6 or more 3."""
    open_ = reports.join(confirmed, ["source_ip", "attack_type"], "left_anti")
    per = open_.groupBy("source_ip", "attack_type").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("attack_type").agg(F.max("n").alias("worst"))
    return per.join(top, "attack_type").select("source_ip", "attack_type", "n", (F.col("n") >= 3).alias("damped"), F.when(F.col("worst") >= 6, 3.0).when(F.col("worst") >= 3, 1.5).otherwise(1.0).alias("multiplier"))


#: Words of 64 bits in a key filter, at least and at most: 8 KB to 8 MB, ten bits a key in between.
FEWEST_WORDS, MOST_WORDS = 1 << 10, 1 << 20


def key_filter(keys: DataFrame, key: str, n: int) -> tuple[Column, int]:
    """A Bloom filter of about ``n`` keys: one array of 64-bit words, read as a scalar subquery, and the number of its words."""
    words = min(MOST_WORDS, max(FEWEST_WORDS, 1 << (max(1, n * 10 // 64) - 1).bit_length()))
    marks = F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in _marks(F.col(key), words)])
    set_ = keys.filter(F.col(key).isNotNull()).select(F.explode(marks).alias("m")).groupBy(F.col("m.word").alias("id")).agg(F.bit_or("m.bit").alias("bits"))
    every = keys.sparkSession.range(words).join(set_, "id", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("bits"))
    return every.scalar(), words


def _marks(key: Column, words: int) -> list[tuple[Column, Column]]:
    """The three (word, bit) of a key."""
    places = [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(64 * words)) for seed in range(3)]
    return [(F.floor(p / 64), F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) for p in places]


def may_hold(bits: Column, words: int, key: Column) -> Column:
    """False only for keys that the filter surely doesn't hold."""
    found = [F.get(bits, w.cast("int")).bitwiseAND(b) != 0 for w, b in _marks(key, words)]
    return F.coalesce(found[0] & found[1] & found[2], F.lit(False))


def merged_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of an address that touch or overlap as one: ip_address, created_at, block_until."""
    by = Window.partitionBy("ip_address").orderBy("created_at", "block_until")
    ends = F.max("block_until").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = blocks.filter("created_at < block_until").withColumn("_new", F.coalesce(F.col("created_at") > ends, F.lit(True)).cast("long"))
    rows = rows.withColumn("_nth", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("ip_address", "_nth").agg(F.min("created_at").alias("created_at"), F.max("block_until").alias("block_until")).drop("_nth")


def active_block(events: DataFrame, blocks: DataFrame, ip: str = "source_ip", filtered: bool = False) -> DataFrame:
    """Events of a source while a block of it stands: created_at <= ts < block_until.

    ``filtered``: for large lists, most events of sources that were never blocked are sorted out by a Bloom filter of the blocked
    ones before they are exchanged; the join that follows is exact.
    """
    merged = merged_blocks(blocks)
    b = merged.select(F.col("ip_address").alias("_ip"), "created_at", "block_until")
    if filtered:
        keys = blocks.select("ip_address").distinct()
        bits, words = key_filter(keys, "ip_address", keys.count())
        events = events.filter(may_hold(bits, words, F.col(ip)))
    return events.join(b, (F.col(ip) == F.col("_ip")) & (F.col("ts") >= F.col("created_at")) & (F.col("ts") < F.col("block_until")), "left_semi")


def reputation(feed: DataFrame, provider: str) -> DataFrame:
    """A provider's rows (ip, harmless, malicious, suspicious) in the common shape."""
    total = F.col("harmless") + F.col("malicious") + F.col("suspicious")
    return feed.select("ip", F.lit(provider).alias("provider"), "malicious", "suspicious", total.alias("total"))


def intel(feeds: DataFrame, at: Column, ttl_seconds: int) -> DataFrame:
    """Per ip: the highest score of its providers' newest unexpired rows; malicious if any says so or the score reaches 50."""
    fresh = feeds.filter(micros("fetched_at") + ttl_seconds * 1_000_000 > at)
    newest = fresh.groupBy("ip", "provider").agg(F.max_by(F.struct("abuse_score", "malicious"), F.struct("fetched_at", "abuse_score")).alias("r"))
    per = newest.groupBy("ip").agg(F.max("r.abuse_score").alias("abuse_score"), F.max(F.col("r.malicious").cast("int")).alias("m"))
    return per.select("ip", "abuse_score", ((F.col("m") == 1) | (F.col("abuse_score") >= 50)).alias("malicious"))


def first_within(left: DataFrame, right: DataFrame, key: str, seconds: float) -> DataFrame:
    """Each left row with the first right row of its key that follows within ``seconds``: one sort, no pairs."""
    rows = left.select(key, "ts", F.col("event_id"), F.lit(0).alias("side")).unionByName(right.select(key, "ts", "event_id", F.lit(1).alias("side")))
    # from late to early, so that the frame only grows
    after = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("side"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.last(F.when(F.col("side") == 1, F.struct("ts", "event_id")), ignorenulls=True).over(after)
    found = rows.withColumn("n", nxt).filter("side = 0 and n is not null")
    return found.filter(F.unix_micros(F.col("n.ts").cast("timestamp")) - micros("ts") <= int(seconds * 1e6)).select("event_id", key, "ts", F.col("n.event_id").alias("next_id"))


def verdicts(detections: DataFrame, events: DataFrame) -> DataFrame:
    """One verdict an event: drop for high or critical, log_only for medium, then by reputation, then rate_limit, else pass.

    ``events`` has event_id, reputation and throttled; an event without detections passes.
    """
    top = detections.withColumn("r", severity_rank(severity_norm(F.col("severity")))).groupBy("event_id").agg(F.max("r").alias("worst"), F.count(F.lit(1)).alias("n_detections"))
    v = (
        F.when(F.col("worst").isNull(), "pass").when(F.col("worst") >= 3, "drop").when(F.col("worst") == 2, "log_only").when(F.col("reputation") >= 70, "drop").when(F.col("reputation") >= 40, "log_only")
        .when(F.col("throttled"), "rate_limit").otherwise("pass")
    )
    return events.join(top, "event_id", "left").select("event_id", F.coalesce("n_detections", F.lit(0)).cast("long").alias("n_detections"), v.alias("verdict"))


def incidents(passed: DataFrame, elapsed: Column) -> DataFrame:
    """Playbook and time allowed by severity, and whether ``elapsed`` seconds breach it."""
    allowed = F.when(F.col("severity") == "critical", 300).when(F.col("severity") == "high", 600).when(F.col("severity") == "medium", 1800).otherwise(3600)
    book = F.when(F.col("severity") == "critical", "isolate").when(F.col("severity") == "high", "block").when(F.col("severity") == "medium", "watch").otherwise("record")
    return passed.withColumn("playbook", book).withColumn("sla_seconds", allowed.cast("long")).withColumn("breached", elapsed > allowed)


def action_plan(detections: DataFrame, whitelist: DataFrame | None = None, no_block: DataFrame | None = None, seconds: float = 900.0, dry_run: bool = False) -> DataFrame:
    """What follows from packet detections: event_id, source_ip, attack_type, severity, records, alerts, blocks.

    ``detections`` has event_id, ts, source_ip, attack_type, severity, verdict and label (of ``range_label``). Observations, rows without a
    source, whitelisted sources and what the label's network causes by itself lead to nothing. The rest is recorded; what is high or critical and
    dropped alerts, once a source and type for ``seconds``, and is blocked, throttled or not, unless ``no_block`` lists the source or it is a
    dry run. Both lists have a column ip.
    """
    rows = drop_noise(detections.filter(is_actionable(F.col("severity")) & F.coalesce(F.col("source_ip") != "", F.lit(False))))
    if whitelist is not None:
        rows = rows.join(whitelist.select(F.col("ip").alias("source_ip")).distinct(), "source_ip", "left_anti")
    if no_block is not None:
        rows = rows.join(no_block.select(F.col("ip").alias("source_ip"), F.lit(True).alias("_spared")).distinct(), "source_ip", "left")
    else:
        rows = rows.withColumn("_spared", F.lit(None).cast("boolean"))
    rows = rows.withColumn("_grave", F.lower("severity").isin("high", "critical") & (F.col("verdict") == "drop"))
    gate = cooldown(rows, ["source_ip", "attack_type", "_grave"], "ts", seconds, carry=("severity", "_spared"))
    blocks = F.lit(False) if dry_run else F.col("_grave") & F.col("_spared").isNull()
    return gate.select("event_id", "source_ip", "attack_type", "severity", F.lit(True).alias("records"), (F.col("_grave") & F.col("passed")).alias("alerts"), blocks.alias("blocks"))


def host_action_plan(detections: DataFrame, known: DataFrame, dry_run: bool = False) -> DataFrame:
    """What follows from host detections: high and critical ones alert; critical ones block sources that ``known`` (ip, malicious, score) calls malicious or scores 70 or more."""
    rows = drop_noise(detections.filter(is_actionable(F.col("severity"))))
    k = known.select(F.col("ip").alias("source_ip"), "malicious", "score")
    level = F.lower("severity")
    bad = F.coalesce(F.col("malicious"), F.lit(False)) | (F.coalesce("score", F.lit(0)) >= 70)
    blocks = F.lit(False) if dry_run else (level == "critical") & bad
    return rows.join(k, "source_ip", "left").select("event_id", "source_ip", "attack_type", "severity", F.lit(True).alias("records"), level.isin("high", "critical").alias("alerts"), blocks.alias("blocks"))


def incident_plan(alerts: DataFrame, elapsed: Column, seconds: float = 300.0, playbooks: dict[str, str] | None = None) -> DataFrame:
    """Incidents of alerts (event_id, ts, source_ip, attack_type, severity), one a source and type for ``seconds``: playbook, sla_seconds, breached.

    High and critical ones run their severity's playbook (``playbooks``, else full_response), others the default one (else log_only); an incident
    is breached when ``elapsed`` seconds exceed what its severity allows.
    """
    books = playbooks or {}
    kept = cooldown(alerts.withColumn("_elapsed", elapsed), ["source_ip", "attack_type"], "ts", seconds, carry=("severity", "_elapsed")).filter("passed")
    allowed = F.when(F.col("severity") == "critical", 300).when(F.col("severity") == "high", 600).when(F.col("severity") == "medium", 1800).otherwise(3600)
    book = F.when(F.col("severity") == "critical", books.get("critical", "full_response")).when(F.col("severity") == "high", books.get("high", "full_response")).otherwise(books.get("default", "log_only"))
    return kept.select("event_id", "source_ip", "attack_type", "severity", book.alias("playbook"), allowed.cast("long").alias("sla_seconds"), (F.col("_elapsed") > allowed).alias("breached"))
