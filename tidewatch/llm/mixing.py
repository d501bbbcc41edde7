"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source gets the same expected number of copies: its source's target over its source's size. The whole
part is certain; the fractional parts are rounded in pairs. A pair exchanges words at random until one of the two is
whole, so a source's expected words never change by more than what is left at the end of the reduction tree: one
document's fraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, union_all

#: Documents that one task rounds together, about; residuals that one task combines, at most.
GROUP_ROWS, FAN_IN = 4_096, 4_096
CAP = 3.0
#: Weights by a source's place in code point order, null last; they repeat.
WEIGHTS = (1, 2, 3)
WHOLE = 1e-9
#: A document over this part of the rest is rounded against the rest.
DOMINANT = 0.01


def count_words(text: Column) -> Column:
    """Runs of characters other than space and \\x09-\\x0D; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, n_docs, target, for ``sizes`` (source, size) with one row a document.

    A target is the weight's part of all words, at most ``cap`` times the source's size; what the capped leave is shared
    again by weight. Sources are ordered by the level at which they reach the cap: with all before one capped, the rest
    share what is left, and the first that stays below its cap fixes the level for the rest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    # at this level a source just reaches its cap
    rows = per.withColumn("weight", weight).withColumn("reach", cap * F.col("source_size") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("reach", "weight", "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("weight_left"))
        .withColumn("share", F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "weight", "source", "level"))).over(everything)["level"])
    )
    return rows.select("source", "source_size", "n_docs", F.least(cap * F.col("source_size"), F.col("weight") * F.col("share")).alias("target"))


def pivot(frame: pd.DataFrame, seed: int) -> np.ndarray:
    """Round ``part`` of rows with positive ``size`` so that sum(size * part) stays; at most one row stays fractional.

    Rows go from large to small, ties by their key, so what stays open at the end is small. Two partners exchange words:
    either the one grows and the other shrinks or the reverse, as far as one of them becomes whole, with odds that keep both
    expectations. While all open rows share one fraction and the largest outweighs DOMINANT of the rest, its partner is
    the rest as one bundle, which then shares a new fraction; afterwards the carried row's partner is the next row.
    """
    order = np.lexsort((frame["key"].to_numpy(), -frame["size"].to_numpy()))
    size, part = frame["size"].to_numpy(np.float64)[order].tolist(), frame["part"].to_numpy(np.float64)[order].tolist()
    coins = np.random.Generator(np.random.PCG64(seed)).random(len(part)).tolist()
    snap = lambda p: float(round(p)) if p <= WHOLE or p >= 1 - WHOLE else p

    def exchange(a: float, p: float, b: float, q: float, coin: float) -> tuple[float, float]:
        up = min((1 - p) * a, q * b)  # words that the first can take from the second
        down = min(p * a, (1 - q) * b)  # and give to it
        moved = up if coin * (up + down) < down else -down
        return snap(p + moved / a), snap(q - moved / b)

    part = [snap(p) for p in part]
    first = 0
    if part and len(set(part)) == 1 and 0 < part[0] < 1:
        rest, shared = sum(size), part[0]
        while first < len(part) - 1 and size[first] > DOMINANT * (rest - size[first]) and 0 < shared < 1:
            rest -= size[first]
            part[first], shared = exchange(size[first], shared, rest, shared, coins[first])
            first += 1
        part[first:] = [shared] * (len(part) - first)
    held = -1
    for i, p in enumerate(part):
        if p in (0.0, 1.0):
            continue
        if held >= 0:
            part[held], part[i] = exchange(size[held], part[held], size[i], p, coins[i])
        held = held if held >= 0 and part[held] not in (0.0, 1.0) else i if part[i] not in (0.0, 1.0) else -1
    out = np.empty(len(part))
    out[order] = part
    return out


def _round_groups(rows: DataFrame) -> DataFrame:
    """One level of the reduction tree: pivot within every (source, grp)."""

    def work(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the groups are bounded by GROUP_ROWS (in expectation) and FAN_IN
        frame = pd.concat(list(frames), ignore_index=True)
        seed = int(np.bitwise_xor.reduce(frame["key"].to_numpy(np.int64))) & (2**63 - 1)
        yield frame.assign(part=pivot(frame, seed))

    return rows.groupBy("src", "grp").applyInPandas(work, rows.schema)


def _mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, group_rows: int = GROUP_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``mix`` and their key, a hash of id and text."""
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    sizes = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"), _key().alias("key")), "sizes")
    goal = scratch.save(targets(sizes, weights, cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a table with a row for each source is joined by its key, not broadcast: nothing bounds the number of sources
    goal = goal.withColumnRenamed("source", "of")
    rows = sizes.join(goal, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, F.floor(rate + F.lit(WHOLE))).otherwise(0).cast("int").alias("whole"),
        F.when(F.col("size") > 0, rate - F.floor(rate + F.lit(WHOLE))).otherwise(0.0).alias("part"),
        "key",
        F.xxhash64("source").alias("src"),
        F.ceil(F.col("n_docs") / group_rows).cast("long").alias("groups"),
    )
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("key"), F.col("groups"))).withColumn("part", F.greatest(F.col("part"), F.lit(0.0)))
    done, groups = [], scratch.read(scratch.write(_round_groups(rows), "level"), rows.schema)
    whole = (F.col("part") == 0) | (F.col("part") == 1)
    while True:
        done.append(groups.filter(whole))
        left = groups.filter(~whole)
        widest = left.agg(F.max("groups")).first()[0]
        if widest is None or widest <= 1:
            # one fraction a source at most: to the nearer side
            done.append(left.withColumn("part", F.round("part")))
            break
        up = left.withColumn("grp", F.floor(F.col("grp") / FAN_IN)).withColumn("groups", F.ceil(F.col("groups") / FAN_IN))
        groups = scratch.read(scratch.write(_round_groups(up.select(*rows.columns)), "level"), rows.schema)
    copies = (F.col("whole") + F.col("part")).cast("int")
    return union_all(done).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "key"
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, group_rows: int = GROUP_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """Copies of every document in the mix: doc_id, source, size, source_size, target, copies, taken.

    Null and empty texts have size 0 and take no words; they get no copies. Null sources form one source, the last. A null
    doc_id is a key like any other. Repeated rows are rounded one by one. An empty table gives no rows. Other columns
    are ignored. Only ids, sources and sizes are shuffled; coins come from the keys of a group, so reruns agree.
    """
    return _mixed(docs, weights, cap, group_rows, scratch).drop("key")


def repeat(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, whatever its id.

    Rows repeated with id and text share their copies evenly, the remainder in no particular order; rows without words are
    not taken. Columns may have any name.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    of = [F.col("key").alias("of"), F.col("size").alias("words")]
    taken = _mixed(docs, scratch=scratch, **options).groupBy(*of).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0")
    # written, so that a row repeated very often can be split in the join
    taken = scratch.save(taken, "taken")
    # the rows' own columns lie in a struct, so that no name of theirs meets one of ours
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key().alias("id"), count_words(F.col("text")).alias("size"))
    # both sides are exchanged at every size; small tables are not broadcast, so that a run on little tells of one on much
    joined = sized.join(taken.hint("merge"), (F.col("id") == F.col("of")) & (F.col("size") == F.col("words")))
    once = joined.filter("rows = 1").withColumn("n", F.col("copies"))
    more = joined.filter("rows > 1").withColumn("nth", F.row_number().over(Window.partitionBy("id", "size").orderBy("id")))
    more = more.withColumn("n", F.floor(F.col("copies") / F.col("rows")) + (F.col("nth") <= F.col("copies") % F.col("rows")).cast("int")).drop("nth")
    every = once.unionByName(more).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return every.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
