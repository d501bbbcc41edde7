"""Reports over stored tables: attackers, attacks, blocks, alerts, audit rows, incidents."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What an attack of a severity adds to its source's threat score; any other severity counts as medium.
WEIGHTS = {"low": 1, "medium": 3, "high": 10, "critical": 25}


def attackers(attacks: DataFrame, prior: DataFrame | None = None, ip: str = "source_ip", ts: str = "ts") -> DataFrame:
    """ip_address, first_seen, last_seen, attack_count, country: new attacks merged into the prior snapshot."""
    fresh = attacks.groupBy(F.col(ip).alias("ip_address")).agg(F.min(ts).alias("f"), F.max(ts).alias("l"), F.count(F.lit(1)).alias("n"), F.max("country").alias("c"))
    if prior is None:
        return fresh.select("ip_address", F.col("f").alias("first_seen"), F.col("l").alias("last_seen"), F.col("n").alias("attack_count"), F.col("c").alias("country"))
    both = prior.join(fresh, "ip_address", "full")
    return both.select(
        "ip_address", F.least("first_seen", "f").alias("first_seen"), F.greatest("last_seen", "l").alias("last_seen"),
        (F.coalesce("attack_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("attack_count"), F.coalesce("c", "country").alias("country"),
    )


def weight(severity: Column) -> Column:
    w = F.lit(WEIGHTS["medium"])
    for name, value in WEIGHTS.items():
        w = F.when(F.lower(severity) == name, value).otherwise(w)
    return w


def threat_scores(attacks: DataFrame, ip: str = "source_ip") -> DataFrame:
    """Summed weights of (deduplicated) attacks, 100 at most."""
    return attacks.groupBy(ip).agg(F.least(F.lit(100), F.sum(weight(F.col("severity")))).cast("long").alias("threat_score"))


def count_scores(attacks: DataFrame, ip: str = "source_ip") -> DataFrame:
    return attacks.groupBy(ip).agg(F.least(F.lit(100), 20 * F.count(F.lit(1))).cast("long").alias("score"))


def band(score: Column) -> Column:
    """80, 50 and 20 are the floors of critical, high and medium."""
    return F.when(score >= 80, "critical").when(score >= 50, "high").when(score >= 20, "medium").otherwise("low")


def top(df: DataFrame, by: list[Column], n: int, offset: int = 0) -> DataFrame:
    """The first ``n`` rows in a total order, after ``offset``."""
    return df.orderBy(*by).offset(offset).limit(n) if offset else df.orderBy(*by).limit(n)


def top_per_group(df: DataFrame, key: list[str], of: str, n: int) -> DataFrame:
    """The ``n`` commonest values of ``of`` in every group, ties by value: key, of, n, rank."""
    counts = df.groupBy(*key, of).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), of)))
    return ranked.filter(F.col("rank") <= n)


def rate_history(df: DataFrame, ts: str, start: Column, end: Column, step: str) -> DataFrame:
    """Counts per step from ``start`` to ``end``, steps without rows too."""
    spark = df.sparkSession
    grid = spark.range(1).select(F.explode(F.sequence(start, end, F.expr(f"interval {step}"))).alias("bucket"))
    counts = df.groupBy(F.window(F.col(ts).cast("timestamp"), step).start.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def baselines(metrics: DataFrame, key: list[str], value: str, at_least: int = 10) -> DataFrame:
    """n, mean, sample deviation, min, max, median and nearest-rank 95th percentile of every key with enough values.

    The percentile comes from a rank, so no group is gathered.
    """
    w = Window.partitionBy(*key).orderBy(value)
    ranked = metrics.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    return (
        ranked.groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"),
            F.avg(F.when(F.col("_i").isin(-1) | (F.col("_i") == F.floor((F.col("_n") - 1) / 2)) | (F.col("_i") == F.floor(F.col("_n") / 2)), F.col(value))).alias("median"),
            F.max(F.when(F.col("_i") == F.least(F.floor(F.col("_n") * 95 / 100), F.col("_n") - 1), F.col(value))).alias("p95"),
        )
        .filter(F.col("n") >= at_least)
    )


def nearest_ranks(df: DataFrame, key: list[str], value: str, percent: int) -> DataFrame:
    """``rank`` of every key: element floor(n * percent / 100) of the sorted values, the last one at most.

    Values are counted first, so that a window holds a key's distinct values, never its rows.
    """
    per = df.groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*key)
    ranked = per.withColumn("_to", F.sum("_n").over(w.orderBy(F.col(value).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_of", F.sum("_n").over(w))
    return ranked.filter(F.col("_to") > F.least(F.expr(f"_of * {percent} div 100"), F.col("_of") - 1)).groupBy(*key).agg(F.min(value).alias("rank"))


#: Packets of a task that cuts flows into sessions, about: tasks grow in number with the table, not in memory.
TASK_ROWS = 250_000


def flow_sessions(packets: DataFrame, flow: Column, idle: float) -> DataFrame:
    """``flow`` and ``session``: a flow's packets, cut where it rests for more than ``idle`` seconds; dealt by flow, TASK_ROWS to a task."""
    w = Window.partitionBy("flow").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    tasks = max(int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-packets.count() // TASK_ROWS))
    rows = packets.withColumn("flow", flow).repartition(tasks, "flow").withColumn("gap", (t - F.lag(t).over(w)) / 1e6)
    return rows.withColumn("session", F.sum(F.when(F.col("gap") > idle, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def flow_features(packets: DataFrame, flow: Column, idle: float = 120.0) -> DataFrame:
    """Counts, durations, length and gap statistics, flag counts and ttl of every flow session, each way; forward is the initiator's."""
    rows = flow_sessions(packets, flow, idle)
    key = Window.partitionBy("flow", "session")
    # the order in which sessions were cut serves for their first packets too
    w = Window.partitionBy("flow").orderBy("ts", "event_id")
    rows = rows.withColumn("_starts", ~F.lag("session").over(w).eqNullSafe(F.col("session")))
    first = F.last(F.when(F.col("_starts"), F.struct("src_ip")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))["src_ip"]
    rows = rows.withColumn("fwd", F.col("src_ip") == first).withColumn("iat", F.when(~F.col("_starts"), F.col("gap")))
    for name, value in (("len", "raw_len"), ("iat", "iat")):
        rows = rows.withColumn(f"_{name}_i", F.row_number().over(key.orderBy(F.col(value).asc_nulls_last(), "event_id")) - 1).withColumn(f"_{name}_n", F.count(value).over(key))
    aggs = [F.count(F.lit(1)).alias("packets"), F.sum("raw_len").cast("long").alias("bytes"), F.sum("payload_len").cast("long").alias("payload_bytes")]
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    aggs.append(((F.max(t) - F.min(t)) / 1e6).alias("duration"))
    for side, keep in (("fwd", F.col("fwd")), ("bwd", ~F.col("fwd"))):
        aggs += [F.sum(keep.cast("long")).alias(f"{side}_packets"), F.sum(F.when(keep, F.col("raw_len")).otherwise(0)).cast("long").alias(f"{side}_bytes")]
        for stat, fn in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max)):
            aggs.append(F.coalesce(fn(F.when(keep, F.col("raw_len"))), F.lit(0)).cast("double").alias(f"{side}_len_{stat}"))
            aggs.append(F.coalesce(fn(F.when(keep, F.col("iat"))), F.lit(0)).cast("double").alias(f"{side}_iat_{stat}"))
    for name, value in (("len", "raw_len"), ("iat", "iat")):
        aggs += [F.coalesce(fn(value), F.lit(0)).cast("double").alias(f"{name}_{stat}") for stat, fn in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
        for p in (25, 75):
            at = F.least(F.floor(F.col(f"_{name}_n") * p / 100), F.col(f"_{name}_n") - 1)
            aggs.append(F.coalesce(F.max(F.when(F.col(f"_{name}_i") == at, F.col(value))), F.lit(0)).cast("double").alias(f"{name}_p{p}"))
    for letter, label in zip("SAFRPU", ("syn", "ack", "fin", "rst", "psh", "urg"), strict=True):
        aggs.append(F.sum(F.col("flags").contains(letter).cast("long")).alias(f"{label}_count"))
    aggs += [F.avg("ttl").alias("ttl_mean"), F.stddev_pop("ttl").alias("ttl_std"), F.min("ttl").alias("ttl_min"), F.max("ttl").alias("ttl_max"), F.avg("win").alias("win_mean"), F.countDistinct("dst_port").alias("dst_ports")]
    out = rows.groupBy("flow", "session").agg(*aggs)
    per = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    return out.withColumn("packets_per_s", per(F.col("packets"), F.col("duration"))).withColumn("bytes_per_s", per(F.col("bytes"), F.col("duration"))).withColumn("fwd_share", F.col("fwd_packets") / F.col("packets"))


#: What a flow's values are summed up by.
STATS = ("mean", "std", "min", "max", "p25", "p75")


def flow_vector(packets: DataFrame, flow: Column, idle: float = 120.0) -> DataFrame:
    """flow, session and 54 features of every flow session, as the classifiers of flows take them.

    Packets each way, duration, payload bytes a packet; mean, population deviation, least, largest and nearest-rank quartiles of payload lengths and gaps, of all
    packets and each way; flags as counts and a packet; tls_version, tls_ciphers and tls_exts (largest; 0 where the packets have no such columns); mean ttl each way.
    Forward is the way of the session's first packet; its gap is 0. Ranks come from sorts within a session, which spill; nothing is collected.
    """
    order = [F.col("ts"), F.col("event_id")]
    rows = flow_sessions(packets, flow, idle)
    key = Window.partitionBy("flow", "session")
    ends = F.struct("src_ip", "src_port")
    rows = rows.withColumn("fwd", F.coalesce(ends == F.first(ends).over(key.orderBy(*order)), F.lit(False)))
    rows = rows.withColumn("len", F.coalesce("payload_len", F.lit(0)).cast("double")).withColumn("iat", F.when(F.row_number().over(key.orderBy(*order)) == 1, 0.0).otherwise(F.coalesce("gap", F.lit(0.0))))
    sides = {"": (["flow", "session"], F.lit(True)), "fwd_": (["flow", "session", "fwd"], F.col("fwd")), "bwd_": (["flow", "session", "fwd"], ~F.col("fwd"))}
    for name in ("len", "iat"):
        for tag, by in (("all", ["flow", "session"]), ("own", ["flow", "session", "fwd"])):
            w = Window.partitionBy(*by)
            rows = rows.withColumn(f"_{name}_{tag}", F.row_number().over(w.orderBy(name, *order)) - 1)
    for tag, by in (("all", ["flow", "session"]), ("own", ["flow", "session", "fwd"])):
        rows = rows.withColumn(f"_n_{tag}", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    total, t = F.count(F.lit(1)), F.unix_micros(F.col("ts").cast("timestamp"))
    none = lambda c: F.coalesce(c, F.lit(0.0)).cast("double")
    aggs = [F.sum(F.col("fwd").cast("long")).cast("double").alias("fwd_pkts"), F.sum((~F.col("fwd")).cast("long")).cast("double").alias("bwd_pkts"), total.cast("double").alias("total_pkts"), ((F.max(t) - F.min(t)) / 1e6).alias("flow_duration"), (F.sum("len") / total).alias("bytes_per_pkt")]
    for side, (_, keep) in sides.items():
        tag = "own" if side else "all"
        for name, label in (("len", "pkt_len"), ("iat", "iat")):
            value = F.when(keep, F.col(name))
            for stat, fn in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max)):
                aggs.append(none(fn(value)).alias(f"{side}{label}_{stat}"))
            for p in (25, 75):
                place = F.least(F.floor(F.col(f"_n_{tag}") * p / 100), F.col(f"_n_{tag}") - 1)
                aggs.append(none(F.max(F.when(keep & (F.col(f"_{name}_{tag}") == place), F.col(name)))).alias(f"{side}{label}_p{p}"))
    shown = F.upper(F.coalesce("flags", F.lit("")))
    for letter, label in zip("SAFR", ("syn", "ack", "fin", "rst"), strict=True):
        n = F.sum(F.length(shown) - F.length(F.replace(shown, F.lit(letter), F.lit(""))))
        aggs += [n.cast("double").alias(f"{label}_count"), (n / total).alias(f"{label}_ratio")]
    for name in ("tls_version", "tls_ciphers", "tls_exts"):
        aggs.append(none(F.max(name)).alias(name) if name in packets.columns else F.lit(0.0).alias(name))
    aggs += [none(F.avg(F.when(keep, F.col("ttl")))).alias(f"{side}ttl_mean") for side, (_, keep) in sides.items() if side]
    return rows.groupBy("flow", "session").agg(*aggs)


def incident_summary(incidents: DataFrame, by: str, resolved: str, source: str) -> DataFrame:
    """Of every severity: incidents, resolved and open ones, and how many sources they come from."""
    return incidents.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col(resolved).cast("long")).alias("resolved"), F.sum((~F.col(resolved)).cast("long")).alias("open"), F.countDistinct(source).alias("attackers"),
    )


def retain(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows not older than ``days``."""
    return df.filter(F.col(ts) >= now - F.expr(f"interval {days} days"))


def retain_partitions(spark: SparkSession, path: str, ts: str, now: datetime, days: int, by: str = "date") -> list[str]:
    """Take rows older than ``days`` out of a parquet table that is partitioned by date; returns the dates that are gone.

    Whole dates before the limit are removed, the date that holds it is rewritten alone (dynamic partition overwrite); files of other
    dates are not touched, so the work is that of a day, whatever the table holds.
    """
    limit = now - timedelta(days=days)
    day = limit.strftime("%Y-%m-%d")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dates = sorted(s.getPath().getName().removeprefix(f"{by}=") for s in fs.listStatus(where(path)) if s.getPath().getName().startswith(f"{by}="))
    gone = [d for d in dates if d < day]
    if day in dates:
        # the type is the column's own, so that a date is not read as text or the reverse
        rows = spark.read.parquet(path).filter((F.col(by).cast("string") == day) & (F.col(ts) >= F.lit(limit).cast("timestamp_ntz" if dict(spark.read.parquet(path).dtypes)[ts] == "timestamp_ntz" else "timestamp")))
        if rows.isEmpty():
            gone.append(day)
        else:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    for d in gone:
        fs.delete(where(f"{path}/{by}={d}"), True)
    return gone


def union_detections(*parts: DataFrame) -> DataFrame:
    """Detector outputs in one shape; rows without type or source are dropped."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.filter((F.coalesce("attack_type", F.lit("")) != "") & (F.coalesce("source_ip", F.lit("")) != ""))
