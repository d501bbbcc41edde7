"""What happened just before a detection: a global order without a global sort, and a range join by blocks of places."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windowed import cooldown, micros

#: Stretches of time that rows are numbered in; a stretch is one task's sort.
STRETCHES = 200


def numbered(df: DataFrame, ts: str, order: str, stretches: int = STRETCHES) -> DataFrame:
    """``df`` with ``place``, from 1, in order of (ts, order) over the whole table.

    Stretches of time of about equal numbers of rows are numbered each by itself; a stretch's start comes from the row counts
    of those before. Only the stretches' bounds and counts come to the driver. Rows of one moment lie in one stretch, rows without a
    time come first.
    """
    rows = df.withColumn("_t", micros(ts))
    cuts = rows.agg(F.percentile_approx("_t", [i / stretches for i in range(1, stretches)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    at = F.lit(0)
    if cuts:
        bounds = F.array(*map(F.lit, cuts))
        # the number of bounds at or below the time, by the place it would be sorted to
        after = F.array_position(F.transform(bounds, lambda b: b > F.col("_t")), True).cast("int") - 1
        at = F.when(F.col("_t").isNull(), 0).when(F.col("_t") >= cuts[-1], len(cuts)).otherwise(after)
    rows = rows.withColumn("_s", at)
    counts = {r._s: r.n for r in rows.groupBy("_s").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = list(accumulate([0, *[counts.get(i, 0) for i in range(len(cuts) + 1)]]))
    starts = F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col("_s"))
    place = F.row_number().over(Window.partitionBy("_s").orderBy("_t", order)) + starts
    return rows.withColumn("place", place.cast("long")).drop("_t", "_s")


def evidence(packets: DataFrame, detections: DataFrame, ts: str = "ts", order: str = "event_id", before: int = 64, cooldown_s: float = 300.0, stretches: int = STRETCHES) -> DataFrame:
    """For each high or critical detection that a source's cooldown lets pass, the ``before`` packets before it, of all sources.

    ``detections`` has order, ts, source_ip and severity; a detection belongs to the packet of its order. Result: hit, source_ip, nth (1 is the
    packet just before) and the packet's order. A hit meets the packets of the two or more blocks of ``before`` places that its window
    touches, so packets are exchanged once, by block, whatever the number of hits.
    """
    grave = detections.filter(F.col("severity").isin("high", "critical")).dropDuplicates([order])
    passed = cooldown(grave, ["source_ip"], ts, cooldown_s, order).filter("passed").select(F.col(order).alias("hit"), "source_ip")
    placed = numbered(packets.select(order, ts), ts, order, stretches).select(order, "place")
    hits = passed.join(placed.withColumnRenamed(order, "hit").withColumnRenamed("place", "at"), "hit")
    hits = hits.withColumn("block", F.explode(F.sequence(F.floor((F.col("at") - before) / before), F.floor((F.col("at") - 1) / before))))
    seen = placed.withColumn("block", F.floor(F.col("place") / before))
    near = hits.join(seen, "block").filter((F.col("place") < F.col("at")) & (F.col("place") >= F.col("at") - before))
    return near.select("hit", "source_ip", (F.col("at") - F.col("place")).cast("int").alias("nth"), order)
