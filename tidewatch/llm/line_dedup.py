"""Line dedup by overlapping windows of three lines.

Every three consecutive lines form a window. A window that stands in several places is kept at the first, by (doc_id,
text, line); the lines that later places cover are removed, overlapping ones once. Each removed line equals a line at an
earlier place, so every distinct line of the corpus stays somewhere.

What repeats on fewer lines than a window has, between differing neighbours or in a text of fewer lines, is not seen; the
README gives figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, split_by_ids

WINDOW = 3
#: Windows that are broadcast, at most: each holds more than this part of all repeated places.
HOT_WINDOWS = 256


def _windows(hashed: Column, size: int) -> Column:
    """Array of the windows' hashes, 96 bits each; windows of blank lines alone are null, fewer lines than ``size`` give none."""
    return F.transform(
        F.sequence(F.lit(0), F.size(hashed) - size),
        lambda i: F.when(
            ~F.forall(F.slice(hashed, i + 1, size), lambda x: x["blank"]),
            F.struct(
                F.xxhash64(*[F.get(hashed, i + k)["a"] for k in range(size)]).alias("a"),
                F.hash(*[F.get(hashed, i + k)["b"] for k in range(size)]).alias("b"),
            ),
        ),
    )


def repeated_windows(docs: DataFrame, size: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, txt (the text's hash) and line of every window occurrence but the first of its window.

    A window that many places share is not dealt to one task: the HOT_WINDOWS of them at most that hold more than their part of
    the repeated places are broadcast, and what stands once is filtered before the join.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    hashes = F.transform(F.split(F.col("text"), "\n", -1), lambda line: F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"), (F.trim(line) == "").alias("blank")))
    placed = (
        docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("txt"), hashes.alias("hashed"))
        .filter(F.size("hashed") >= size)
        .select("doc_id", "txt", F.posexplode(_windows(F.col("hashed"), size)).alias("line", "w"))
        .filter("w is not null")
        .select("doc_id", "txt", F.col("line").cast("int").alias("line"), "w.a", "w.b")
    )
    first = placed.groupBy("a", "b").agg(F.min(F.struct("doc_id", "txt", "line")).alias("first"), F.count(F.lit(1)).alias("places")).filter("places > 1")
    first = scratch.save(first, "repeated")
    share = (first.agg(F.sum("places")).first()[0] or 0) // HOT_WINDOWS
    hot = F.broadcast(first.filter(F.col("places") > share).drop("places"))
    likely, _ = split_by_ids(placed, first.select("a"), "a")
    found = likely.join(hot, ["a", "b"]).unionByName(
        likely.join(hot.select("a", "b"), ["a", "b"], "left_anti").join(first.filter(F.col("places") <= share).drop("places"), ["a", "b"])
    )
    return found.filter(F.struct("doc_id", "txt", "line") != F.col("first")).select("doc_id", "txt", "line")


def dedup_lines(docs: DataFrame, size: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with text cleaned, plus n_lines, n_removed.

    Null texts stay null and texts of fewer than ``size`` lines stay as they are, with n_removed 0; a row with a null
    doc_id is left alone. Windows of blank lines alone don't count. Rows repeated with doc_id and text form one document
    and are cleaned alike: their windows stand once. Different texts under one doc_id are different documents. A text whose
    lines all go becomes empty. An empty table gives an empty table; other columns are carried along, whatever their
    names; columns named n_lines or n_removed are replaced. Texts that lose nothing are not shuffled.
    """
    cleaned = clean(docs, size, scratch)
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return cleaned.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in own], "n_lines", "n_removed")


def clean(docs: DataFrame, size: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """row, text, n_lines, n_removed: ``dedup_lines`` with each row as it came in a struct, so that no column is replaced."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    starts = repeated_windows(docs, size, scratch).groupBy("doc_id", "txt").agg(F.collect_set("line").alias("starts"))
    starts = scratch.save(starts.withColumn("key", F.xxhash64("doc_id", "txt")), "starts")
    # the rows' own columns lie in a struct, so that no name of theirs meets one of ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", F.xxhash64("text")).alias("key"))
    likely, rest = split_by_ids(rows, starts.select("key"), "key")
    at = starts.select(F.col("key").alias("at"), F.col("doc_id").alias("of"), "starts")
    likely = likely.join(at, (F.col("key") == F.col("at")) & (F.col("row.doc_id") == F.col("of")), "left").select("row", "starts")
    both = likely.unionByName(rest.select("row", F.lit(None).cast("array<int>").alias("starts")))
    lines = F.split("row.text", "\n", -1)
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (size - 1)))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered), lambda i: F.get(lines, i))
    text = F.when(F.col("starts").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return both.select(
        "row",
        text.alias("text"),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("starts").isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_removed"),
    )
