"""Streaming forms: watermarked windows, sessions, keyed state, correlations and the action loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import folds
from .ordered import ordered


def event_time(df: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """``ts`` as a timestamp with a watermark: later rows are dropped."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(df: DataFrame, key: str, width: str, ts: str = "ts", slide: str | None = None) -> DataFrame:
    """key, start, n of tumbling or sliding windows."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def sessions(df: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _reported(df: DataFrame, key: str, ts: str, order: str, fold: folds.Fold) -> DataFrame:
    return ordered(df, key, ts, order, fold).select(key, F.col("event_id").alias(order), F.timestamp_micros("t").alias(ts))


def cooldown(df: DataFrame, key: str, ts: str, seconds: float, order: str = "event_id") -> DataFrame:
    """Rows that pass the gate: a key's first, then each ``seconds`` or more after the last that passed."""
    return _reported(df, key, ts, order, folds.gate(seconds))


def counter(df: DataFrame, key: str, ts: str, seconds: float, threshold: int, order: str = "event_id") -> DataFrame:
    """Rows at which the count within ``seconds`` reaches the threshold; it then starts again."""
    return _reported(df, key, ts, order, folds.counter(seconds, threshold))


def follows(left: DataFrame, right: DataFrame, key: str, seconds: int, ts: str = "ts") -> DataFrame:
    """Pairs of a left row and a right row of its key at most ``seconds`` later; both sides have watermarks."""
    a = left.select(F.col(key).alias("a_key"), F.col(ts).alias("a_ts"), F.col("event_id").alias("a_id"))
    b = right.select(F.col(key).alias("b_key"), F.col(ts).alias("b_ts"), F.col("event_id").alias("b_id"))
    return a.join(b, (F.col("a_key") == F.col("b_key")) & F.col("b_ts").between(F.col("a_ts"), F.col("a_ts") + F.expr(f"interval {seconds} seconds")))


def act(plan: Callable[[DataFrame], dict[str, DataFrame]], folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each table that ``plan`` makes of a batch, in a folder of the batch's number, so that a retry replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        for name, rows in plan(batch).items():
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return write
