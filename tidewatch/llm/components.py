"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, releasing

#: Links for each of which a node's larger neighbours are dealt to one task more, and the most tasks.
SALTED, MOST_SALTS = 1 << 22, 64


def _step(rows: DataFrame, large: bool) -> DataFrame:
    """(u, v) of a step over rows (x, y) or (x, s, y), dealt by all but y; one pass over sorted rows, a group's state is its least y.

    The large step ties x's larger neighbours to the least of x and its neighbours. The small step, where all y are less than x,
    ties x and its other neighbours to the least.
    """
    keys = [c for c in rows.columns if c != "y"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple[tuple, int, int] | None = None  # the last group so far, its least y, its last y
        for batch in batches:
            if not len(batch):
                continue
            own = np.column_stack([batch.column(c).to_numpy() for c in keys])
            x, y = own[:, 0], batch.column("y").to_numpy()
            fresh = np.r_[True, (own[1:] != own[:-1]).any(axis=1)]
            again = np.r_[False, y[1:] == y[:-1]] & ~fresh
            starts = np.flatnonzero(fresh)
            first = y[starts].copy()
            if tail is not None and tuple(own[0]) == tail[0]:
                first[0], fresh[0], again[0] = tail[1], False, y[0] == tail[2]
            least = np.repeat(first, np.diff(np.r_[starts, len(y)]))
            tail = tuple(own[-1]), int(least[-1]), int(y[-1])
            if large:
                keep = (y > x) & ~again
                u, v = y[keep], np.minimum(x, least)[keep]
            else:
                other = (y != least) & ~again
                u, v = np.r_[x[fresh], y[other]], np.r_[least[fresh], least[other]]
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "y").mapInArrow(releasing(work), "u long, v long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` (u, v).

    Each step replaces links by links to smaller nodes: a large step ties a node's larger neighbours to its smallest
    neighbour, a small step its smaller ones. It ends with a star for each component. Every pair of steps is written, so nothing is
    recomputed; no links come to the driver, only their number and a checksum. A star's centre has as many links as its
    component has nodes: its larger neighbours are dealt to several tasks, more on more links, each of which gets the few smaller ones.
    """
    path = scratch.write(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    seen = None
    while True:
        edges = scratch.read(path, "u long, v long")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        salts = min(MOST_SALTS, 1 + state[0] // SALTED)
        larger = edges.select(F.col("v").alias("x"), F.pmod(F.xxhash64("u"), F.lit(salts)).alias("s"), F.col("u").alias("y"))
        smaller = edges.select(F.col("u").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("s"), F.col("v").alias("y"))
        large = _step(larger.unionByName(smaller), True)
        old, path = path, scratch.write(_step(large.select(F.col("u").alias("x"), F.col("v").alias("y")), False), "links")
        scratch.drop(old)
    stars = scratch.read(path, "u long, v long")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
