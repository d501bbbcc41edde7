"""What analysts look at: fingerprints and device policies, drill-downs, key figures, capture quality, alert rules, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip_label, is_actionable, severity_norm, severity_rank
from .parse import port_in_text
from .report import top_per_group
from .windowed import micros, running

# Types that count as critical among the key figures, and vendors whose machines are servers.
CRITICAL_TYPES = ("exploit_attempt", "rce_attempt", "shellcode_detected", "command_injection", "log4j_attempt", "shellshock_attempt", "eternalblue_attempt", "sql_injection")
SERVER_VENDORS = ("VMware", "VirtualBox", "Microsoft Hyper-V")


def fingerprint_hits(hellos: DataFrame, malicious: DataFrame) -> DataFrame:
    """One row for each client hello (event_id, ts, src_ip, ja4, sni): a malicious fingerprint (high, 0.9) where ``malicious`` lists its ja4, else an observation (info, 0.1).

    Rows without a fingerprint are left out. The list is joined, whichever way its size allows.
    """
    listed = malicious.select(F.col("ja4").alias("_ja4")).filter("_ja4 is not null").distinct()
    bad = F.col("_ja4").isNotNull()
    rows = hellos.filter("ja4 is not null").join(listed, F.col("ja4") == F.col("_ja4"), "left")
    seen = F.concat(F.lit("JA4="), "ja4", F.when(F.coalesce("sni", F.lit("")) != "", F.concat(F.lit(" SNI="), "sni")).otherwise(""))
    details = F.when(bad, F.concat(F.lit("Known malicious JA4: "), "ja4")).otherwise(seen)
    return rows.select("event_id", "ts", F.col("src_ip").alias("source_ip"), F.when(bad, "malicious_tls_fingerprint").otherwise("tls_fingerprint").alias("attack_type"), F.when(bad, "high").otherwise("info").alias("severity"), F.when(bad, 0.9).otherwise(0.1).alias("confidence"), details.alias("details"))


def with_policy(packets: DataFrame, devices: DataFrame, vendors: DataFrame, mac: str = "src_mac") -> DataFrame:
    """``policy``: that of the registered device (mac, policy), else server where the address's prefix (first eight characters, upper case) is a virtual machine vendor's (prefix, vendor), else workstation.

    Packets without an address have none.
    """
    own = devices.select(F.col("mac").alias("_mac"), F.col("policy").alias("_policy")).dropDuplicates(["_mac"])
    maker = vendors.select(F.upper("prefix").alias("_prefix"), F.col("vendor").alias("_vendor")).dropDuplicates(["_prefix"])
    rows = packets.join(own, F.col(mac) == F.col("_mac"), "left").join(maker, F.upper(F.substring(mac, 1, 8)) == F.col("_prefix"), "left")
    kind = F.when(F.col("_vendor").isin(*SERVER_VENDORS), "server").otherwise("workstation")
    return rows.withColumn("policy", F.when(F.coalesce(F.col(mac), F.lit("")) != "", F.coalesce("_policy", kind))).drop("_mac", "_policy", "_prefix", "_vendor")


def policy_violations(packets: DataFrame, policies: DataFrame, mac: str = "src_mac") -> DataFrame:
    """Packets (with ``policy``) against their policies: a device's packets beyond max_connections (high), else a port, protocol or hour that isn't allowed (medium).

    ``policies``: policy, max_connections, ports (array), protocols (array), from_hour, to_hour; a null array or hour allows all, the hours
    are from_hour <= hour < to_hour, past midnight where from_hour is the larger. Devices of unknown policies are left alone.
    """
    known = policies.select(F.col("policy").alias("_p"), "max_connections", "ports", "protocols", "from_hour", "to_hour")
    rows = packets.filter("policy is not null").join(known, F.col("policy") == F.col("_p"))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(running([mac], ["ts", "event_id"])))
    hour, begin, end = F.hour("ts"), F.col("from_hour"), F.col("to_hour")
    inside = F.when(begin <= end, (hour >= begin) & (hour < end)).otherwise((hour >= begin) | (hour < end))
    reason = (
        F.when(F.col("_n") > F.col("max_connections"), "connections")
        .when(~F.coalesce(F.array_contains("ports", F.col("dst_port")), F.lit(True)), "port")
        .when(~F.coalesce(F.array_contains("protocols", F.col("protocol")), F.lit(True)), "protocol")
        .when(~F.coalesce(inside, F.lit(True)), "hour")
    )
    found = rows.withColumn("reason", reason).filter("reason is not null")
    return found.select("event_id", "ts", F.col("src_ip").alias("source_ip"), F.lit("zt_policy_violation").alias("attack_type"), F.when(F.col("reason") == "connections", "high").otherwise("medium").alias("severity"), "reason")


def drill_down(attacks: DataFrame, blocks: DataFrame, now: Column, text: str, n: int = 5) -> DataFrame:
    """Of every source: first_seen, last_seen, attack_count, its ``n`` commonest types and ports named in ``text``, whether a block stands at ``now``."""
    per = attacks.groupBy("source_ip").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("attack_count"))
    lists = lambda rows, of, name: top_per_group(rows, ["source_ip"], of, n).groupBy("source_ip").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(of).cast("string").alias("of"), "n"))), lambda x: F.concat(x["of"], F.lit(":"), x["n"].cast("string"))), ",").alias(name))
    ports = attacks.withColumn("port", port_in_text(F.col(text))).filter("port is not null")
    stands = blocks.filter((F.col("created_at") <= now) & (F.col("block_until") > now)).select(F.col("ip_address").alias("source_ip"), F.lit(True).alias("blocked")).distinct()
    found = per.join(lists(attacks, "attack_type", "top_types"), "source_ip", "left").join(lists(ports, "port", "top_ports"), "source_ip", "left").join(stands, "source_ip", "left")
    return found.withColumns({"blocked": F.coalesce("blocked", F.lit(False)), "top_types": F.coalesce("top_types", F.lit("")), "top_ports": F.coalesce("top_ports", F.lit(""))})


def key_figures(attacks: DataFrame, blocks: DataFrame, packets: DataFrame, now: Column) -> DataFrame:
    """One row: packets of the last second, attacks of the last 24 hours, standing blocks, attacks of critical types, the source with most."""
    at = F.unix_micros(now.cast("timestamp"))
    rate = packets.agg(F.count(F.when((micros("ts") > at - 1_000_000) & (micros("ts") <= at), 1)).alias("rate"))
    day = F.count(F.when((micros("ts") > at - 86_400_000_000) & (micros("ts") <= at), 1)).alias("n_day")
    per = attacks.groupBy("source_ip").agg(F.count(F.lit(1)).alias("n"), day, F.count(F.when(F.col("attack_type").isin(*CRITICAL_TYPES), 1)).alias("n_critical"))
    main = per.agg(F.coalesce(F.sum("n_day"), F.lit(0)).alias("attacks"), F.coalesce(F.sum("n_critical"), F.lit(0)).alias("critical"), F.min_by("source_ip", F.struct(-F.col("n"), F.col("source_ip"))).alias("top_ip"))
    stands = blocks.agg(F.countDistinct(F.when((F.col("created_at") <= now) & (F.col("block_until") > now), F.col("ip_address"))).alias("blocked"))
    # four tables of one row
    return rate.join(F.broadcast(main)).join(F.broadcast(stands)).select("rate", "attacks", "blocked", "critical", "top_ip")


def incident_report(incidents: DataFrame, n: int = 10) -> DataFrame:
    """Rows (panel, name, n, worst) of incidents (source_ip, severity, status, attack_type, mitre): totals by status, severities, techniques (the type where there is none), and the ``n`` sources with most, with their worst severity."""
    count = F.count(F.lit(1)).alias("n")
    none = F.lit(None).cast("string").alias("worst")
    panel = lambda name, rows, by: rows.groupBy(by.alias("name")).agg(count).select(F.lit(name).alias("panel"), "name", "n", none)
    levels = F.array(*map(F.lit, ("info", "low", "medium", "high", "critical")))
    techniques = F.explode(F.when(F.size("mitre") > 0, F.col("mitre")).otherwise(F.array("attack_type")))
    sources = incidents.groupBy(F.col("source_ip").alias("name")).agg(count, F.get(levels, F.max(severity_rank(severity_norm(F.col("severity"))))).alias("worst"))
    sources = sources.orderBy(F.desc("n"), "name").limit(n).select(F.lit("sources").alias("panel"), "name", "n", "worst")
    parts = [panel("status", incidents, F.col("status")), panel("severity", incidents, severity_norm(F.col("severity"))), panel("techniques", incidents.select(techniques.alias("t")), F.col("t")), sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def capture_quality(packets: DataFrame, detections: DataFrame, expected: DataFrame, n: int = 5) -> DataFrame:
    """Of every capture: packets, those with any and with an actionable detection, types found, ``n`` top sources, and whether it is as expected.

    ``packets`` has capture and event_id, ``detections`` event_id, source_ip, attack_type, severity, ``expected`` capture, types (array) and
    budget, the actionable packets that a benign capture may have (null: any number). As expected: one of the types was found, where any are named, and
    the budget holds.
    """
    found = detections.join(packets.select("event_id", "capture"), "event_id")
    per = packets.groupBy("capture").agg(F.count(F.lit(1)).alias("packets"))
    hits = found.groupBy("capture", "event_id").agg(F.max(is_actionable(F.col("severity")).cast("int")).alias("acts")).groupBy("capture").agg(F.count(F.lit(1)).alias("detected"), F.sum("acts").alias("actionable"))
    types = found.groupBy("capture").agg(F.array_sort(F.collect_set("attack_type")).alias("found"))
    sources = top_per_group(found.filter("source_ip <> ''"), ["capture"], "source_ip", n)
    sources = sources.groupBy("capture").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_ip"))), lambda x: x["source_ip"]), ",").alias("top_sources"))
    rows = per.join(hits, "capture", "left").join(types, "capture", "left").join(sources, "capture", "left").join(expected, "capture", "left")
    rows = rows.withColumns({"detected": F.coalesce("detected", F.lit(0)), "actionable": F.coalesce("actionable", F.lit(0)), "found": F.coalesce("found", F.array().cast("array<string>"))})
    fine = ((F.size(F.coalesce("types", F.array().cast("array<string>"))) == 0) | F.arrays_overlap("found", "types")) & F.coalesce(F.col("actionable") <= F.col("budget"), F.lit(True))
    return rows.select("capture", "packets", "detected", "actionable", F.array_join("found", ",").alias("types_found"), "top_sources", fine.alias("as_expected"))


def alert_rules(attacks: DataFrame, blocks: DataFrame, limits: dict[str, float], block_limit: float, width: str = "5 minutes") -> DataFrame:
    """Windows in which attacks of a severity, or blocks, come at more a second than their limit: start, rule, rate."""
    seconds = F.unix_seconds(F.col("w.end")) - F.unix_seconds(F.col("w.start"))
    per = attacks.groupBy(F.window(F.col("ts").cast("timestamp"), width).alias("w"), severity_norm(F.col("severity")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    rows = per.withColumn("limit", F.try_element_at(limit, F.col("rule")))
    stops = blocks.groupBy(F.window(F.col("created_at").cast("timestamp"), width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("w", F.lit("blocks").alias("rule"), "n", F.lit(float(block_limit)).alias("limit"))
    return rows.unionByName(stops).withColumn("rate", F.col("n") / seconds).filter("rate > limit").select(F.col("w.start").alias("start"), "rule", "rate")


def metrics(packets: DataFrame, attacks: DataFrame, blocks: DataFrame, length: int = 64) -> DataFrame:
    """Counters (name, label, level, n): packets by verdict, attacks by type (clipped) and severity, blocks by method."""
    none, count = F.lit(None).cast("string"), F.count(F.lit(1)).alias("n")
    a = packets.groupBy(F.col("verdict").alias("label")).agg(count).select(F.lit("packets").alias("name"), "label", none.alias("level"), "n")
    b = attacks.groupBy(clip_label(F.col("attack_type"), length).alias("label"), F.col("severity").alias("level")).agg(count).select(F.lit("attacks").alias("name"), "label", "level", "n")
    c = blocks.groupBy(F.col("method").alias("label")).agg(count).select(F.lit("blocks").alias("name"), "label", none.alias("level"), "n")
    return a.unionByName(b).unionByName(c)


def unusual_hours(rows: DataFrame, key: str, ts: str, at_least: int = 200, hours: int = 3, share: float = 0.3, seldom: int = 2, order: str = "event_id", step: int = 1) -> DataFrame:
    """Rows in an hour of the day that their host has hardly been seen in (the row included, fewer than ``seldom`` times), once it has ``at_least`` rows in ``hours`` hours or more, but in less than ``share`` of the day.

    A row in the hour of the row before it is not judged again. With a ``step`` hours are taken so many together.
    """
    hour = F.floor(F.hour(ts) / step) * step
    w = running([key], [ts, order])
    seen = rows.withColumn("_h", hour).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_before", F.lag("_h").over(Window.partitionBy(key).orderBy(ts, order)))
    nth = F.row_number().over(Window.partitionBy(key, "_h").orderBy(ts, order))
    seen = seen.withColumn("_nth", nth).withColumn("_hours", F.sum((F.col("_nth") == 1).cast("long")).over(w))
    hit = (F.col("_nth") < seldom) & ~F.coalesce(F.col("_before") == F.col("_h"), F.lit(False)) & (F.col("_n") >= at_least) & (F.col("_hours") >= hours) & (F.col("_hours") / 24 < share)
    return seen.filter(hit).select(order, ts, F.col(key).alias("source_ip"), F.lit("unusual_hours_activity").alias("attack_type"), F.lit("low").alias("severity"), F.col("_h").cast("int").alias("hour"))


def dashboard(attacks: DataFrame, blocks: DataFrame, hits: DataFrame, alerts: DataFrame, now: Column, n: int = 10) -> DataFrame:
    """Rows (panel, place, name, value) of five panels: the ``n`` commonest types, the newest attacks, the newest standing blocks, hits of each kind of deception, alerts of the last hour by severity.

    ``hits`` has kind, ``alerts`` created_at and severity; attacks and blocks of one moment go by source.
    """
    at = F.unix_micros(now.cast("timestamp"))
    count = F.count(F.lit(1)).alias("n")

    def panel(name: str, rows: DataFrame, order: list[Column], label: Column, value: Column, most: int | None = n) -> DataFrame:
        # the first rows of a total order, so a window over few
        rows = rows.select(*[c.alias(f"_o{i}") for i, c in enumerate(order)], label.cast("string").alias("name"), value.cast("string").alias("value"))
        by = [F.col(f"_o{i}") for i in range(len(order))]
        first = rows.orderBy(*by).limit(most) if most else rows
        place = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*by))
        return first.withColumn("place", place).select(F.lit(name).alias("panel"), "place", "name", "value")

    types = attacks.groupBy("attack_type").agg(count)
    stands = blocks.filter((micros("created_at") <= at) & (micros("block_until") > at))
    recent = alerts.filter((micros("created_at") > at - 3_600_000_000) & (micros("created_at") <= at)).groupBy(severity_norm(F.col("severity")).alias("severity")).agg(count)
    parts = [
        panel("types", types, [-F.col("n"), F.col("attack_type")], F.col("attack_type"), F.col("n")),
        panel("attacks", attacks, [-micros("ts"), F.col("source_ip"), F.col("attack_type")], F.col("source_ip"), F.col("attack_type")),
        panel("blocks", stands, [-micros("created_at"), F.col("ip_address")], F.col("ip_address"), F.date_format("block_until", "yyyy-MM-dd HH:mm:ss")),
        panel("deception", hits.groupBy("kind").agg(count), [F.col("kind")], F.col("kind"), F.col("n"), None),
        panel("alerts", recent, [F.col("severity")], F.col("severity"), F.col("n"), None),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def attacker_countries(attackers: DataFrame, now: Column, n: int = 5) -> DataFrame:
    """Rows (panel, name, n): all attackers (ip_address, last_seen, country), those seen in the last 24 hours, and the ``n`` countries with most, where one is known."""
    at = F.unix_micros(now.cast("timestamp"))
    none = F.lit(None).cast("string").alias("name")
    every = attackers.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("panel"), none, "n")
    day = attackers.filter(micros("last_seen") >= at - 86_400_000_000).agg(F.count(F.lit(1)).alias("n")).select(F.lit("last_day").alias("panel"), none, "n")
    top = attackers.filter("country is not null").groupBy(F.col("country").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(n)
    return every.unionByName(day).unionByName(top.select(F.lit("country").alias("panel"), "name", "n"))


def pipeline_counters(packets: DataFrame, at: str = "ts") -> DataFrame:
    """By verdict: packets, mean latency (``latency``), and packets a second between the table's first and last."""
    span = packets.agg(((F.max(micros(at)) - F.min(micros(at))) / 1e6).alias("_s"))
    per = packets.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.avg("latency").alias("mean_latency"))
    # one row
    return per.join(F.broadcast(span)).select("verdict", "n", "mean_latency", F.when(F.col("_s") > 0, F.col("n") / F.col("_s")).alias("rate"))


def technique_coverage(detections: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row: techniques and tactics of the detections (columns mitre, tactics: arrays), sorted and counted, and the share of the catalogue's types (attack_type) that were seen."""
    t = detections.select(F.explode("mitre").alias("x")).agg(F.array_sort(F.collect_set("x")).alias("t"))
    c = detections.select(F.explode("tactics").alias("x")).agg(F.array_sort(F.collect_set("x")).alias("c"))
    seen = catalogue.select("attack_type").distinct().join(detections.select("attack_type").distinct().withColumn("_seen", F.lit(True)), "attack_type", "left")
    share = seen.agg(F.count("_seen").alias("seen"), F.count(F.lit(1)).alias("known"))
    # techniques and tactics are few, whatever the table
    return t.join(F.broadcast(c)).join(F.broadcast(share)).select(
        F.size("t").alias("n_techniques"), F.size("c").alias("n_tactics"), F.array_join("t", ",").alias("techniques"), F.array_join("c", ",").alias("tactics"), (F.col("seen") / F.col("known")).alias("share")
    )
